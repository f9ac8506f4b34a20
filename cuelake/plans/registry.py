"""A query and its DuckDB equivalent, under one name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cuelake.sources.tables import CUES_SQL

Query = Callable[[SparkSession, str], DataFrame]


class Plans:
    """The queries of one module."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracles: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None, *, over_cues: bool = False) -> Callable[[Query], Query]:
        """Register a query; ``over_cues`` puts the cue view before ``sql``, which may begin with a comma."""

        def keep(query: Query) -> Query:
            self.queries[name] = query
            if sql is not None:
                self.oracles[name] = CUES_SQL + sql if over_cues else sql
            return query

        return keep


def banned_sql(x: str) -> str:
    """How often a display text holds what it must not hold, in DuckDB."""
    return rf"""(len(regexp_extract_all({x}, '(?i)[，。,⋯‥?!]|\.{{3,}}|…{{2,}}|[？！]{{2,}}|</?\s*i\s*>')) - len(list_filter(range(2, length({x})),
            lambda i: substr({x}, i, 1) = ',' AND regexp_matches(substr({x}, i - 1, 1) || substr({x}, i + 1, 1), '^\p{{Nd}}{{2}}$'))))"""
