"""Operators with order-dependent state or dynamic programming, as Arrow and grouped pandas functions.

Grouped functions get one medium at a time; a medium's rows are few thousands.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuelake.functions import kernels


def edit_counts(reference: Column, hypothesis: Column) -> Column:
    """struct(distance, ins, dels, subs); nulls count as empty."""

    @F.arrow_udf("struct<distance int, ins int, dels int, subs int>")
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        pairs = [(x or "", y or "") for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)]
        return pa.StructArray.from_arrays([pa.array(c, pa.int32()) for c in kernels.edit_counts(pairs).T], ["distance", "ins", "dels", "subs"])

    return run(reference, hypothesis)


def common_subsequence(a: Column, b: Column) -> Column:
    """Length of a longest common subsequence; nulls count as empty."""

    @F.arrow_udf("int")
    def run(x: pa.Array, y: pa.Array) -> pa.Array:
        return pa.array([kernels.common_subsequence(p or "", q or "") for p, q in zip(x.to_pylist(), y.to_pylist(), strict=True)], pa.int32())

    return run(a, b)


def tandem_repeat(text: Column) -> Column:
    """struct(unit, run, chars) of the strongest repetition."""

    @F.arrow_udf("struct<unit string, run int, chars int>")
    def run(x: pa.Array) -> pa.Array:
        rows = kernels.tandem_repeats([p or "" for p in x.to_pylist()])
        unit, copies, chars = zip(*rows, strict=True) if rows else ((), (), ())
        return pa.StructArray.from_arrays(
            [pa.array(unit, pa.string()), pa.array(copies, pa.int32()), pa.array(chars, pa.int32())], ["unit", "run", "chars"]
        )

    return run(text)


def wrapped(text: Column, units: int = 16) -> Column:
    """Text as at most two lines."""

    @F.arrow_udf("string")
    def run(x: pa.Array) -> pa.Array:
        return pa.array(["\n".join(kernels.wrap_line(p.as_py() or "", units)) for p in x], pa.string())

    return run(text)


def cut_at_pauses(pauses: DataFrame, key: str, total_ms: int, most_ms: int = 30_000, least_ms: int = 2_000) -> DataFrame:
    """(key, chunk, start_ms, end_ms): greedy tiling of [0, total] at pause midpoints, per key."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        spans = list(zip(pdf["start_ms"].tolist(), pdf["end_ms"].tolist(), strict=True))
        cut = kernels.cut_at_pauses(spans, total_ms, most_ms, least_ms)
        return pd.DataFrame({key: pdf[key].iloc[0], "chunk": range(len(cut)), "start_ms": [a for a, _ in cut], "end_ms": [b for _, b in cut]})

    kind = pauses.schema[key].dataType.simpleString()
    return pauses.select(key, "start_ms", "end_ms").groupBy(key).applyInPandas(run, f"{key} {kind}, chunk long, start_ms long, end_ms long")


def shard_plan(rows: DataFrame, by: str, order: str, size: str, most: int) -> DataFrame:
    """(by, order, shard): rows in order, a new shard when the next does not fit.

    Sorted rows stream through with one running sum, so a key of any size needs no memory.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, shard, used = None, 0, 0
        for b in batches:
            out = []
            for k, n in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                fresh = (k,) != key
                key, shard, used = (k,), 0 if fresh else shard, 0 if fresh else used
                if used and used + n > most:
                    shard, used = shard + 1, 0
                used += n
                out.append(shard)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.int64())], [by, order, "shard"])

    t = rows.schema
    dealt = rows.select(by, order, F.coalesce(F.col(size), F.lit(0)).alias(size)).repartition(by).sortWithinPartitions(by, order)
    return dealt.mapInArrow(run, f"{by} {t[by].dataType.simpleString()}, {order} {t[order].dataType.simpleString()}, shard long")


def balanced_split(groups: DataFrame, group: str, positives: str, size: str, parts: int, seed: str) -> DataFrame:
    """(group, part): whole groups dealt out evenly.

    The dealing is sequential, so one task orders the groups: four small values
    each, never the rows behind them.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        got = kernels.balanced_groups(list(pdf[[group, "p", "s", "draw"]].itertuples(index=False, name=None)), parts)
        return pd.DataFrame({group: list(got), "part": list(got.values())})

    rows = groups.select(
        F.col(group).cast("string").alias(group), F.col(positives).cast("long").alias("p"), F.col(size).cast("long").alias("s"),
        F.sha2(F.concat(F.lit(f"{seed}:"), F.col(group).cast("string")), 256).alias("draw"),
    )
    return rows.groupBy(F.lit("all").alias("all")).applyInPandas(run, f"{group} string, part long")


def blank_runs(frames: DataFrame, key: str, blank: Column, least: int) -> DataFrame:
    """(key, start_frame, end_frame): runs of blank frames of at least ``least``; frames are (key, frame, ...)."""
    w = Window.partitionBy(key).orderBy("frame")
    islands = frames.where(blank).select(key, "frame", (F.col("frame") - F.row_number().over(w)).alias("island"))
    runs = islands.groupBy(key, "island").agg(F.min("frame").alias("start_frame"), (F.max("frame") + 1).alias("end_frame"))
    return runs.where(F.col("end_frame") - F.col("start_frame") >= least).select(key, "start_frame", "end_frame")


def filled(frames: DataFrame, key: str, value: str) -> Column:
    """The last known value up to a frame, the first known one before that."""
    w = Window.partitionBy(key).orderBy("frame")
    back = F.last(value, ignorenulls=True).over(w)
    ahead = F.first(value, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    return F.coalesce(back, ahead)


def frame_labels(spans: DataFrame, key: str, label: str, frame_ms: int, frames: int) -> DataFrame:
    """(key, frame, label) for every frame of every key; later spans win, holes are ``unsure``.

    ``spans``: (key, pos, start_ms, end_ms, label), pos in order of writing.
    """
    first, last = F.floor(F.col("start_ms") / frame_ms), F.ceil(F.col("end_ms") / frame_ms) - 1
    spread = spans.where(first <= F.least(last, F.lit(frames - 1))).select(
        key, "pos", label, F.explode(F.sequence(first, F.least(last, F.lit(frames - 1)))).alias("frame")
    )
    said = spread.groupBy(key, "frame").agg(F.max(F.struct("pos", label)).alias("top"))
    grid = spans.select(key).distinct().withColumn("frame", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(frames - 1).cast("long"))))
    return grid.join(said, [key, "frame"], "left").select(key, "frame", F.coalesce(F.col(f"top.{label}"), F.lit("unsure")).alias(label))
