"""The training-data queries and their SQL, by name."""

from __future__ import annotations

from . import chat_format, exact_dedup, language_id, line_dedup, mixing, near_dedup, packing, quality_classifier, token_files, topk_search

QUERIES = {
    "op1_exact_dedup": exact_dedup.op1_exact_dedup,
    "op2_token_files": token_files.op2_token_files,
    "op3_packing": packing.op3_packing,
    "op4_mixing": mixing.op4_mixing,
    "op5_chat_format": chat_format.op5_chat_format,
    "op6_quality_classifier": quality_classifier.op6_quality_classifier,
    "op7_line_dedup": line_dedup.op7_line_dedup,
    "op8_near_dedup": near_dedup.op8_near_dedup,
    "op9_language_id": language_id.op9_language_id,
    "op10_topk_search": topk_search.op10_topk_search,
}
ORACLES = {
    "op1_exact_dedup": exact_dedup.ORACLE,
    "op4_mixing": mixing.ORACLE,
    "op5_chat_format": chat_format.ORACLE,
    "op7_line_dedup": line_dedup.ORACLE,
    "op10_topk_search": topk_search.ORACLE,
}
