"""Interval algebra on rows (key, start_ms, end_ms), half-open, and range joins.

A range join cuts time into bins: both sides are spread over the bins they
touch, meet on (key, bin) and count once, in the bin where the overlap begins.
That is an equi join, so Catalyst can shuffle and split it, whatever the key's
size; the bin should be near the usual length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BIN_MS = 10_000


def clamp(spans: DataFrame, low_ms: int, high_ms: int) -> DataFrame:
    """Spans cut to [low, high]; empty ones go."""
    cut = spans.withColumn("start_ms", F.greatest("start_ms", F.lit(low_ms))).withColumn(
        "end_ms", F.least("end_ms", F.lit(high_ms))
    )
    return cut.where("end_ms > start_ms")


def merge(spans: DataFrame, key: str, gap_ms: int | Column = 0) -> DataFrame:
    """(key, start_ms, end_ms, n): unions of spans whose gaps are at most ``gap_ms``, which may be a field of the key."""
    w = Window.partitionBy(key).orderBy("start_ms", "end_ms")
    reach = F.max("end_ms").over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.coalesce(F.col("start_ms") - F.col("reach") > gap_ms, F.lit(True)).cast("int")
    islands = (
        spans.select(key, "start_ms", "end_ms").withColumn("reach", reach).withColumn("island", F.sum(fresh).over(w))
    )
    merged = islands.groupBy(key, "island").agg(
        F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.count(F.lit(1)).alias("n")
    )
    return merged.select(key, "start_ms", "end_ms", "n")


def gaps(spans: DataFrame, key: str, low_ms: int, high_ms: int) -> DataFrame:
    """(key, start_ms, end_ms): what the spans of a key leave of [low, high]."""
    return holes(clamp(spans, low_ms, high_ms), key, low_ms, high_ms)


def holes(spans: DataFrame, key: str, low_ms: int, high_ms: int) -> DataFrame:
    """``gaps`` of spans inside [low, high] already; an empty span at ``high_ms`` makes a key known that has no other.

    One pass over a key's unions: the last one also gives what follows it.
    """
    merged = merge(spans, key)
    w = Window.partitionBy(key).orderBy("start_ms")
    hole = lambda s, e: F.struct(s.cast("long").alias("s"), e.cast("long").alias("e"))
    before = hole(F.coalesce(F.lag("end_ms").over(w), F.lit(low_ms)), F.col("start_ms"))
    behind = F.when(F.lead("start_ms").over(w).isNull(), hole(F.col("end_ms"), F.lit(high_ms)))
    found = merged.select(key, F.array(before, behind).alias("both")).select(key, F.explode("both").alias("h"))
    return found.where("h.e > h.s").select(key, F.col("h.s").alias("start_ms"), F.col("h.e").alias("end_ms"))


def equal_pieces(spans: DataFrame, max_ms: int, carry: tuple[str, ...]) -> DataFrame:
    """Every span cut into as few equal pieces as keep to ``max_ms`` (whole milliseconds)."""
    n = F.ceil((F.col("end_ms") - F.col("start_ms")) / max_ms)
    cut = spans.withColumn("n", n).withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    at = lambda k: F.col("start_ms") + F.floor((F.col("end_ms") - F.col("start_ms")) * k / F.col("n"))
    return cut.select(*carry, "piece", at(F.col("piece")).alias("piece_start_ms"), at(F.col("piece") + 1).alias("piece_end_ms"))


def speech_regions(
    pauses: DataFrame, key: str, low_ms: int, high_ms: int,
    *, join_ms: int = 400, least_ms: int = 1000, pad_ms: int = 150, max_ms: int = 20_000,
) -> DataFrame:
    """What lies between pauses: joined over short gaps, short ones dropped, padded, joined again, cut evenly."""
    speech = merge(gaps(pauses, key, low_ms, high_ms), key, join_ms).where(F.col("end_ms") - F.col("start_ms") >= least_ms)
    padded = speech.select(
        key,
        F.greatest(F.lit(low_ms), F.col("start_ms") - pad_ms).alias("start_ms"),
        F.least(F.lit(high_ms), F.col("end_ms") + pad_ms).alias("end_ms"),
    )
    return equal_pieces(merge(padded, key), max_ms, (key, "start_ms", "end_ms"))


def _binned(spans: DataFrame, bin_ms: int) -> DataFrame:
    first, last = F.floor(F.col("start_ms") / bin_ms), F.floor((F.col("end_ms") - 1) / bin_ms)
    return spans.withColumn("bin", F.explode(F.sequence(first, F.greatest(first, last))))


def overlap_pairs(a: DataFrame, b: DataFrame, key: str, a_id: str, b_id: str, least_ms: int = 1, bin_ms: int = BIN_MS, times: bool = False) -> DataFrame:
    """(key, a_id, b_id, overlap_ms[, b_start, b_end]): pairs that share at least ``least_ms``; ids are renamed a_id and b_id."""
    left = _binned(a.select(key, F.col(a_id).alias("a_id"), "start_ms", "end_ms"), bin_ms)
    right = _binned(b.select(key, F.col(b_id).alias("b_id"), "start_ms", "end_ms"), bin_ms)
    right = right.withColumnsRenamed({"start_ms": "b_start", "end_ms": "b_end"})
    begin = F.greatest("start_ms", "b_start")
    met = left.join(right, [key, "bin"]).withColumn("overlap_ms", F.least("end_ms", "b_end") - begin)
    return met.where((F.col("overlap_ms") >= least_ms) & (F.floor(begin / bin_ms) == F.col("bin"))).select(
        key, "a_id", "b_id", "overlap_ms", *(("b_start", "b_end") if times else ())
    )


def at_point(points: DataFrame, spans: DataFrame, key: str, point: str, span_id: str, bin_ms: int = BIN_MS) -> DataFrame:
    """Points with the spans that hold them (start <= point < end): all columns of points, and ``span_id``."""
    left = points.withColumn("bin", F.floor(F.col(point) / bin_ms))
    right = _binned(spans.select(key, span_id, "start_ms", "end_ms"), bin_ms).withColumnsRenamed(
        {"start_ms": "s_ms", "end_ms": "e_ms"}
    )
    return left.join(right, [key, "bin"]).where((F.col("s_ms") <= F.col(point)) & (F.col(point) < F.col("e_ms"))).drop(
        "bin", "s_ms", "e_ms"
    )


def covered(spans: DataFrame, regions: DataFrame, key: str, span_id: str) -> DataFrame:
    """(key, span_id, covered_ms): how much of each span the union of the regions covers."""
    union = merge(regions, key).withColumn("region", F.col("start_ms"))
    pairs = overlap_pairs(spans, union, key, span_id, "region")
    total = pairs.groupBy(key, F.col("a_id").alias(span_id)).agg(F.sum("overlap_ms").alias("covered_ms"))
    return spans.select(key, span_id).join(total, [key, span_id], "left").select(
        key, span_id, F.coalesce("covered_ms", F.lit(0)).alias("covered_ms")
    )


def nearest(points: DataFrame, anchors: DataFrame, key: str, point_id: str, point: str, within_ms: int) -> DataFrame:
    """Each point's nearest anchor within reach: smallest distance, strong first, then the earlier."""
    left = points.select(key, point_id, point).withColumn(
        "bin", F.explode(F.sequence(F.floor((F.col(point) - within_ms) / within_ms), F.floor((F.col(point) + within_ms) / within_ms)))
    )
    right = anchors.select(key, "anchor_ms", "strong").withColumn("bin", F.floor(F.col("anchor_ms") / within_ms))
    met = left.join(right, [key, "bin"]).withColumn("off_ms", F.abs(F.col("anchor_ms") - F.col(point)))
    best = F.min(F.struct("off_ms", (~F.col("strong")).alias("weak"), "anchor_ms"))
    return (
        met.where(F.col("off_ms") <= within_ms)
        .groupBy(key, point_id)
        .agg(best.alias("best"))
        .select(key, point_id, "best.anchor_ms", "best.off_ms", (~F.col("best.weak")).alias("strong"))
    )


def fixed_windows(total_ms: int, window_ms: int, context_ms: int, spark) -> DataFrame:
    """(window, start_ms, end_ms): overlapping windows with hop = window - 2 * context."""
    hop = window_ms - 2 * context_ms
    return spark.range(0, max(1, -(-(total_ms - 2 * context_ms) // hop))).select(
        F.col("id").alias("window"),
        (F.col("id") * hop).alias("start_ms"),
        F.least(F.col("id") * hop + window_ms, F.lit(total_ms)).cast("long").alias("end_ms"),
    )


def keep_slices(windows: DataFrame, context_ms: int, key: str) -> DataFrame:
    """The part of each overlapping window that no earlier one has emitted, without its right context unless last."""
    w = Window.partitionBy(key).orderBy("start_ms")
    last = F.lead("start_ms").over(w).isNull()
    until = F.when(last, F.col("end_ms")).otherwise(F.col("end_ms") - context_ms)
    out = windows.withColumn("until", until)
    emitted = F.max("until").over(w.rowsBetween(Window.unboundedPreceding, -1))
    return out.select(key, "window", F.greatest("start_ms", F.coalesce(emitted, F.lit(0))).alias("keep_from_ms"), F.col("until").alias("keep_to_ms"))
