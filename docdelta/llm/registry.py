"""The queries of this folder, by name, and SQL for those that SQL can express."""

from __future__ import annotations

import corpus_pipeline
from docdelta.llm import conversation_repair, decontaminate, fingerprint, html_text, jaccard_join, line_dedup, lm_score, near_dedup, quality, source_mix, spelling, suffix_dedup, token_store

QUERIES = {
    "op1_quality": quality.op1_quality,
    "op2_line_dedup": line_dedup.op2_line_dedup,
    "op3_fingerprint": fingerprint.op3_fingerprint,
    "op4_lm_score": lm_score.op4_lm_score,
    "op5_source_mix": source_mix.op5_source_mix,
    "op6_near_dedup": near_dedup.op6_near_dedup,
    "op7_decontaminate": decontaminate.op7_decontaminate,
    "op8_token_store": token_store.op8_token_store,
    "op9_suffix_dedup": suffix_dedup.op9_suffix_dedup,
    "op10_html_text": html_text.op10_html_text,
    "op11_conversation_repair": conversation_repair.op11_conversation_repair,
    "op12_jaccard_join": jaccard_join.op12_jaccard_join,
    "op13_spelling": spelling.op13_spelling,
    "pipeline": corpus_pipeline.run,
}

SQL = {
    "op2_line_dedup": line_dedup.SQL,
    "op6_near_dedup": near_dedup.SQL,
    "op7_decontaminate": decontaminate.SQL,
    "op9_suffix_dedup": suffix_dedup.SQL,
    "op11_conversation_repair": conversation_repair.SQL,
    "op12_jaccard_join": jaccard_join.SQL,
    "op13_spelling": spelling.SQL,
}
