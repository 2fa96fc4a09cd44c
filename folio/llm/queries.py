"""Registered queries of the corpus operators and their DuckDB SQL."""

from __future__ import annotations

from .embedding_dedup import op10_embedding_dedup
from .html_text import op1_html_text
from .language_id import op8_language_id
from .line_dedup import OP11_SQL, op11_line_dedup
from .mixing import OP3_SQL, op3_mixing
from .near_dedup import op2_near_dedup
from .packing import op7_packing
from .quality_classifier import op5_quality_classifier
from .quality_rules import OP6_SQL, op6_quality_rules
from .spelling_variants import OP13_SQL, op13_spelling_variants
from .toxicity import op9_toxicity
from .url_filter import OP4_SQL, op4_url_filter
from .vector_codes import OP12_SQL, op12_vector_codes

QUERIES = {
    "op1_html_text": op1_html_text,
    "op2_near_dedup": op2_near_dedup,
    "op3_mixing": op3_mixing,
    "op4_url_filter": op4_url_filter,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_quality_rules": op6_quality_rules,
    "op7_packing": op7_packing,
    "op8_language_id": op8_language_id,
    "op9_toxicity": op9_toxicity,
    "op10_embedding_dedup": op10_embedding_dedup,
    "op11_line_dedup": op11_line_dedup,
    "op12_vector_codes": op12_vector_codes,
    "op13_spelling_variants": op13_spelling_variants,
}
ORACLES = {"op3_mixing": OP3_SQL, "op4_url_filter": OP4_SQL, "op6_quality_rules": OP6_SQL, "op11_line_dedup": OP11_SQL, "op12_vector_codes": OP12_SQL, "op13_spelling_variants": OP13_SQL}
