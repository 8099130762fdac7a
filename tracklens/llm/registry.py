"""The training-data queries and, where SQL can express them, their SQL."""

from __future__ import annotations

from tracklens.llm import divergence, exact_dedup, language, line_dedup, packing, pieces, quality_net, quality_rules, sharding, simhash_dedup, suffix_dedup, tokens, whitening

MODULES = [line_dedup, sharding, pieces, language, quality_rules, suffix_dedup, simhash_dedup, exact_dedup, packing, tokens, whitening, divergence, quality_net]
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in MODULES for name, sql in m.ORACLE_SQL.items()}
