"""Training-data operators: scoring, language, personal data, decontamination, deduplication, quality, encoding,
toxicity, web pages, hard negatives, source divergence.

Nothing outside this package (and ``corpus_pipeline.py`` and ``tests/llm``) imports it.
"""
