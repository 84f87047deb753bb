"""The training-corpus pipeline: documents in, encoded clean documents out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet in the shared
folder and read again as the next stage's docs. All but the last return the columns of documents.
"""

from dialoom.llm import op4_decontaminate, op5_jaccard, op6_quality, op8_lines, op9_bpe
from dialoom.llm.store import saved, table

STAGES = [
    ("quality_rules", op6_quality.stage),
    ("line_dedup", op8_lines.stage),
    ("jaccard_join", op5_jaccard.stage),
    ("decontaminate", op4_decontaminate.stage),
    ("bpe_encode", op9_bpe.stage),
]

#: The trees, the exact join and the encoder can't be told in SQL; run() is tested against a plain version of its rules.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), name)
    return docs
