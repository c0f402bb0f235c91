"""Queries of the training-data operators, with DuckDB SQL where SQL can say the same."""

from __future__ import annotations

from triplane.llm import ann, bpe, chat, dedup, html, langid, packing, pipeline, quality, shards, topk


def queries():
    return {
        "op1_exact_topk": topk.query,
        "op2_chat_format": chat.query,
        "op3_minhash_dedup": dedup.query,
        "op4_best_fit_packing": packing.query,
        "op5_language_id": langid.query,
        "op6_lpt_sharding": shards.query,
        "op7_quality_gam": quality.query,
        "op8_html_extraction": html.query,
        "op9_byte_bpe": bpe.query,
        "op10_additive_ann": ann.query,
        "pipeline": pipeline.run,
    }


def oracle_sql():
    return {"op1_exact_topk": topk.ORACLE, "op2_chat_format": chat.ORACLE, "op3_minhash_dedup": dedup.ORACLE}
