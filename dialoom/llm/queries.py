"""Registered queries and SQL of this package."""

from . import (
    op1_lm_scoring, op2_language, op3_pii, op4_decontaminate, op5_jaccard, op6_quality, op7_passages, op8_lines, op8_sql,
    op9_bpe, op10_toxicity, op11_html, op12_negatives, op13_divergence,
)

QUERIES = {
    "op1_lm_scoring": op1_lm_scoring.query,
    "op2_language": op2_language.query,
    "op3_pii": op3_pii.query,
    "op4_decontaminate": op4_decontaminate.query,
    "op5_jaccard": op5_jaccard.query,
    "op6_quality": op6_quality.query,
    "op7_passages": op7_passages.query,
    "op8_lines": op8_lines.query,
    "op9_bpe": op9_bpe.query,
    "op10_toxicity": op10_toxicity.query,
    "op11_html": op11_html.query,
    "op12_negatives": op12_negatives.query,
    "op13_divergence": op13_divergence.query,
}

ORACLE_SQL = {"op8_lines": op8_sql.line_dedup(), "op12_negatives": op12_negatives.ORACLE_SQL, "op13_divergence": op13_divergence.ORACLE_SQL}
