"""The registered queries and their SQL twins."""

from __future__ import annotations

from falloff.plans import corpus_queries, figure_queries, interpret_queries, review_queries, series_queries

FLAGSHIP = "interpret_all"
QUERIES: dict = {**series_queries.QUERIES, **interpret_queries.QUERIES, **corpus_queries.QUERIES, **review_queries.QUERIES, **figure_queries.QUERIES}
ORACLE_SQL: dict[str, str] = {**series_queries.ORACLE_SQL, **interpret_queries.ORACLE_SQL, **corpus_queries.ORACLE_SQL, **review_queries.ORACLE_SQL, **figure_queries.ORACLE_SQL}
