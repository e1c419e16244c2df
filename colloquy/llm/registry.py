"""The registered queries of this subpackage and their oracle SQL."""

from __future__ import annotations

import corpus_pipeline

from . import chat, codes, lexical, oracles, quality, queries

QUERIES = {name: f for name, f in vars(queries).items() if name.startswith("op") and callable(f)}
ORACLES: dict[str, str] = {"op1_minhash_near_dedup": oracles.NEAR_DUPLICATES, "op5_quality_rules": quality.oracle(), "op6_chat_formatting": chat.oracle(), "op11_vector_codes": codes.ORACLE, "op13_ranked_search": lexical.ORACLE}

QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL is not None:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
