"""Queries and DuckDB SQL of the training-data operators, gathered for the entry file."""

from __future__ import annotations

from . import chat_format, exact_dedup, iso_media, line_dedup, lm_scoring, ngram_join, packing, pii, quality, sentence_pieces

MODULES = (quality, iso_media, exact_dedup, lm_scoring, packing, line_dedup, ngram_join, sentence_pieces, pii, chat_format)


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.SQL.items()}
