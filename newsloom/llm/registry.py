"""Queries of this subpackage, and their SQL."""

from __future__ import annotations

from newsloom.llm.decontaminate import OP9_SQL, op9_decontamination
from newsloom.llm.html_extract import op2_html_extract
from newsloom.llm.language_id import op1_language_id
from newsloom.llm.packing import op7_packing
from newsloom.llm.quality_classifier import op10_quality_classifier
from newsloom.llm.quality_rules import op8_quality_rules
from newsloom.llm.sharding import OP5_SQL, op5_sharding
from newsloom.llm.simhash_dedup import op3_simhash_dedup
from newsloom.llm.spelling import OP12_SQL, op12_spelling_variants
from newsloom.llm.token_counts import op6_token_counts
from newsloom.llm.top_k import OP13_SQL, op13_top_k
from newsloom.llm.url_filter import op4_url_filter
from newsloom.llm.vector_codes import OP11_SQL, op11_vector_codes

QUERIES = {
    f.__name__: f
    for f in (
        op1_language_id,
        op2_html_extract,
        op3_simhash_dedup,
        op4_url_filter,
        op5_sharding,
        op6_token_counts,
        op7_packing,
        op8_quality_rules,
        op9_decontamination,
        op10_quality_classifier,
        op11_vector_codes,
        op12_spelling_variants,
        op13_top_k,
    )
}
ORACLES: dict[str, str] = {"op5_sharding": OP5_SQL, "op9_decontamination": OP9_SQL, "op11_vector_codes": OP11_SQL, "op12_spelling_variants": OP12_SQL, "op13_top_k": OP13_SQL}
