"""Registered queries and the SQL each is held against."""

from . import corpus_queries, lang_queries, rule_queries, source_queries, text_queries

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for _part in (corpus_queries, lang_queries, rule_queries, source_queries, text_queries):
    QUERIES |= _part.QUERIES
    ORACLES |= _part.ORACLES
