"""Queries of this subpackage and their SQL texts."""

from __future__ import annotations

from boardsieve.llm import (
    decontaminate,
    embedding_dedup,
    hard_negatives,
    html_text,
    language_id,
    mixing,
    repeats,
    secret_scan,
    simhash,
    token_counts,
    url_filter,
    vector_codes,
    warc,
)

QUERIES = {
    "op1_warc": warc.op1_warc,
    "op2_suffix_array_dedup": repeats.op2_suffix_array_dedup,
    "op3_decontamination": decontaminate.op3_decontamination,
    "op4_secret_scan": secret_scan.op4_secret_scan,
    "op5_simhash_near_dedup": simhash.op5_simhash_near_dedup,
    "op6_embedding_near_dedup": embedding_dedup.op6_embedding_near_dedup,
    "op7_token_counts": token_counts.op7_token_counts,
    "op8_html_extraction": html_text.op8_html_extraction,
    "op9_mixing": mixing.op9_mixing,
    "op10_language_id": language_id.op10_language_id,
    "op11_vector_codes": vector_codes.op11_vector_codes,
    "op12_hard_negatives": hard_negatives.op12_hard_negatives,
    "op13_url_filter": url_filter.op13_url_filter,
}

SQL = {
    "op4_secret_scan": secret_scan.OP4_SQL,
    "op6_embedding_near_dedup": embedding_dedup.OP6_SQL,
    "op9_mixing": mixing.OP9_SQL,
    "op11_vector_codes": vector_codes.OP11_SQL,
    "op12_hard_negatives": hard_negatives.OP12_SQL,
    "op13_url_filter": url_filter.OP13_SQL,
}
