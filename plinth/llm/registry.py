"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

import corpus_pipeline

from . import bpe, langid, mixing, secrets, sharding, simhash, substrings, syncmers, topk, toxicity

QUERIES = (
    toxicity.op5_toxicity, langid.op1_language_id, syncmers.op10_fingerprints, substrings.op8_substring_dedup, simhash.op2_simhash_near_dedup, topk.op7_exact_topk,
    secrets.op3_secret_scans, bpe.op4_bpe, sharding.op6_sharding, mixing.op9_mixing,
)
SQL = {"op6_sharding": sharding.OP6_SQL, "op7_exact_topk": topk.OP7_SQL, "op8_substring_dedup": substrings.OP8_SQL, "op9_mixing": mixing.OP9_SQL}


def queries() -> dict:
    return {query.__name__: query for query in QUERIES} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict:
    return dict(SQL)
