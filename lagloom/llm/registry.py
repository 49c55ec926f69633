"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from lagloom.llm import byte_bpe, edit_embedding, exact_dedup, hilbert, language, lexical, merkle, mixing, quality, simhash, token_store, topk, url_filter


def queries() -> dict:
    return {
        "op1_hilbert_sharding": hilbert.op1_hilbert_sharding,
        "op2_language": language.op2_language,
        "op3_mixing": mixing.op3_mixing,
        "op4_url_filter": url_filter.op4_url_filter,
        "op5_topk": topk.op5_topk,
        "op6_byte_bpe": byte_bpe.op6_byte_bpe,
        "op7_exact_dedup": exact_dedup.op7_exact_dedup,
        "op8_simhash": simhash.op8_simhash,
        "op9_token_store": token_store.op9_token_store,
        "op10_quality": quality.op10_quality,
        "op11_edit_fingerprints": edit_embedding.op11_edit_fingerprints,
        "op12_merkle_manifest": merkle.op12_merkle_manifest,
        "op13_lexical_search": lexical.op13_lexical_search,
    }


def oracle_sql() -> dict:
    return {
        "op4_url_filter": url_filter.OP4_SQL,
        "op5_topk": topk.OP5_SQL,
        "op7_exact_dedup": exact_dedup.OP7_SQL,
        "op12_merkle_manifest": merkle.OP12_SQL,
        "op13_lexical_search": lexical.OP13_SQL,
    }
