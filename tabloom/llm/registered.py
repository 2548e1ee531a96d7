"""Queries of this subpackage and their SQL."""

from __future__ import annotations

import corpus_pipeline
from tabloom.llm import (
    centroids,
    chat_format,
    decontaminate,
    language_id,
    licenses,
    mixing,
    near_duplicates,
    page_text,
    prefix_trie,
    quality_ledger,
    run_index,
    token_counts,
    token_files,
)

QUERIES = {
    "op1_page_text": page_text.op1_page_text,
    "op2_license_scan": licenses.op2_license_scan,
    "op3_mixing": mixing.op3_mixing,
    "op4_language_id": language_id.op4_language_id,
    "op5_quality_rules": quality_ledger.op5_quality_rules,
    "op6_token_counts": token_counts.op6_token_counts,
    "op7_token_files": token_files.op7_token_files,
    "op8_repeated_spans": run_index.op8_repeated_spans,
    "op9_decontamination": decontaminate.op9_decontamination,
    "op10_near_duplicates": near_duplicates.op10_near_duplicates,
    "op11_centroids": centroids.op11_centroids,
    "op12_chat_format": chat_format.op12_chat_format,
    "op13_prefix_trie": prefix_trie.op13_prefix_trie,
    "pipeline": corpus_pipeline.run,
}
ORACLE = {"op5_quality_rules": quality_ledger.OP5_SQL}
