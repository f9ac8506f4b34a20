"""The largest safe size per key, found by bisection from successes and failures, in batch form and as a stream.

Events are (key, seq, kind, size, peak, budget, maximum): ``success`` with the share of
the budget it took, or ``oom``.  Per key the state is the largest safe size, the
smallest unsafe one and the recommendation; it follows the order of ``seq``.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any, NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

GROWTH = 0.8  # a size that takes less of the budget than this may grow
TTL_MS = 30 * 24 * 3600 * 1000
KIND = "key string, safe long, unsafe long, recommended long, last_size long, last_kind string, n long"


class Profile(NamedTuple):
    """What is known of a key: largest safe size (0: none), smallest unsafe one, what to try next."""

    safe: int = 0
    unsafe: int | None = None
    recommended: int = 1
    last_size: int = 0
    last_kind: str = ""
    n: int = 0


def after(p: Profile, kind: str, size: int, peak: float, budget: float, maximum: int) -> Profile:
    """The profile after one event.

    A success at or above the smallest unsafe size takes that back; with room in
    the budget the next try lies midway to the upper bound.  A failure takes back
    every safe claim at or above it and halves towards what is safe.
    """
    size = max(1, size)
    most = max(size, maximum)
    if kind == "success":
        safe = max(p.safe, size)
        unsafe = None if p.unsafe is not None and size >= p.unsafe else p.unsafe
        upper = most + 1 if unsafe is None else unsafe
        roomy = budget > 0 and max(0.0, peak) / budget < GROWTH
        to = (safe + upper) // 2 if roomy and upper - safe > 1 else safe
        to = to if unsafe is None else min(to, max(1, unsafe - 1))
    else:
        unsafe = size if p.unsafe is None else min(size, p.unsafe)
        safe = min(p.safe, max(0, unsafe - 1))
        to = max(1, size // 2) if safe == 0 else (safe + unsafe) // 2 if unsafe - safe > 1 else safe
        to = min(to, max(1, unsafe - 1))
    return Profile(safe, unsafe, max(1, min(most, to)), size, kind, p.n + 1)


def profiles(events: DataFrame) -> DataFrame:
    """(key, safe, unsafe, recommended, last_size, last_kind, n) after all events, in the order of ``seq``.

    Rows stream through sorted by key; the state is one profile.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, p = None, Profile()
        names = [c.split()[0] for c in KIND.split(", ")]
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64()]

        def rows(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names)

        for b in batches:
            out = []
            for r in b.to_pylist():
                if (r["key"],) != key:
                    if key is not None:
                        out.append((*key, *p))
                    key, p = (r["key"],), Profile()
                p = after(p, r["kind"], r["size"], r["peak"], r["budget"], r["maximum"])
            yield rows(out)
        if key is not None:
            yield rows([(*key, *p)])

    cols = events.select(F.col("key").cast("string").alias("key"), "seq", "kind", "size", "peak", "budget", "maximum")
    return cols.repartition("key").sortWithinPartitions("key", "seq").mapInArrow(run, KIND)


def stream_profiles(events: DataFrame) -> DataFrame:
    """``profiles`` over a stream: a row for each key whenever it changes."""

    def step(key: tuple[Any, ...], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        safe, unsafe, *rest = state.get if state.exists else (0, -1, 1, 0, "", 0)
        p = Profile(safe, None if unsafe < 0 else unsafe, *rest)
        rows = pd.concat(list(frames)).sort_values("seq")
        for kind, size, peak, budget, most in rows[["kind", "size", "peak", "budget", "maximum"]].itertuples(index=False, name=None):
            p = after(p, kind, int(size), float(peak), float(budget), int(most))
        state.update((p.safe, -1 if p.unsafe is None else p.unsafe, p.recommended, p.last_size, p.last_kind, p.n))
        state.setTimeoutDuration(TTL_MS)
        out = pd.DataFrame([(key[0], *p)], columns=[c.split()[0] for c in KIND.split(", ")])
        yield out.astype({"unsafe": "Int64"})

    return events.withColumn("key", F.col("key").cast("string")).groupBy("key").applyInPandasWithState(
        step, KIND, "safe long, unsafe long, recommended long, last_size long, last_kind string, n long", "update",
        GroupStateTimeout.ProcessingTimeTimeout,
    )


def recommended(rows: DataFrame, known: DataFrame, heuristic: Column, maximum: Column) -> DataFrame:
    """``rows`` (key, ...) with ``recommended``: the profile's size within 1 and the maximum, else the heuristic."""
    met = rows.join(known.select("key", F.col("recommended").alias("held")), "key", "left")
    most = F.greatest(heuristic, maximum)
    size = F.greatest(F.lit(1), F.least(most, F.coalesce("held", heuristic)))
    return met.withColumn("recommended", size).drop("held")
