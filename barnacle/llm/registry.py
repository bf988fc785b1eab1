"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import binary, bpe, kneser, neardup, packing, quality, sharding, toxicity, urls, vectors

MODULES = [binary, bpe, kneser, neardup, packing, quality, sharding, toxicity, urls, vectors]


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.ORACLES.items()}
