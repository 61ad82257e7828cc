"""The queries of this subpackage and, where SQL expresses them, their DuckDB texts."""

from __future__ import annotations

from . import chat, langid, packing, quality, sharding, simhash, spbpe, tokenbin, topk, toxicity

QUERIES = {
    "op1_packing": packing.op1_packing,
    "op2_sharding": sharding.op2_sharding,
    "op3_sentencepiece": spbpe.op3_sentencepiece,
    "op4_quality_rules": quality.op4_quality_rules,
    "op5_topk": topk.op5_topk,
    "op6_language_id": langid.op6_language_id,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_chat": chat.op8_chat,
    "op9_simhash": simhash.op9_simhash,
    "op10_token_binary": tokenbin.op10_token_binary,
}

ORACLE_SQL = {
    "op2_sharding": sharding.ORACLE_SQL,
    "op4_quality_rules": quality.ORACLE_SQL,
    "op5_topk": topk.ORACLE_SQL,
    "op8_chat": chat.ORACLE_SQL,
}
