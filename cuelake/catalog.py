"""Queries over the reference tables and their DuckDB equivalents."""

from __future__ import annotations

from cuelake.plans import batches, contracts, corpus, events, layout, matching, media, segments, sequences, summaries, sweeps, texts
from cuelake.plans.registry import Query

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
for _plans in (media.P, corpus.P, sequences.P, events.P, texts.P, segments.P, summaries.P, contracts.P, layout.P, matching.P, batches.P, sweeps.P):
    QUERIES |= _plans.queries
    ORACLE_SQL |= _plans.oracles
