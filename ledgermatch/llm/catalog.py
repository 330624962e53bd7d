"""The queries of this package and their SQL counterparts."""

from __future__ import annotations

from ledgermatch.llm import (byte_bpe, centroids, exact_dedup, langid, line_dedup, lm_score, merkle, mixing, ngram_join, packing, quality,
                             sentencepiece, substring_dedup)

MODULES = [sentencepiece, ngram_join, lm_score, substring_dedup, langid, exact_dedup, line_dedup, mixing, quality, packing, byte_bpe, centroids, merkle]


def queries() -> dict:
    return {name: fn for module in MODULES for name, fn in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.SQL.items()}
