"""Neighbour features, runs and display timelines over cues in canonical order.

Windows are partitioned by medium and ordered by (start_ms, end_ms, cue_id), so
every result is deterministic.  A medium holds a few thousand cues at most.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuelake.functions import text as tx

# Fixed values in milliseconds: two and twenty frames of 24000/1001 a second.
GAP_MS, MIN_DISPLAY_MS, MAX_DISPLAY_MS = 83, 834, 7000
SHORT_GAP_MS, LINGER_MS = 500, 500


def by_media() -> Window:
    """The canonical order of a medium's cues."""
    return Window.partitionBy("media_id").orderBy("start_ms", "end_ms", "cue_id")


def neighbours(cues: DataFrame, text_col: str = "src_text") -> DataFrame:
    """prev_gap_ms, next_gap_ms (>= 0, null at the ends), prev_text_same, next_text_same."""
    w, key = by_media(), tx.compact(F.col(text_col))
    out = cues.withColumn("key", key)
    return out.select(
        "media_id",
        "cue_id",
        F.greatest(F.lit(0), F.col("start_ms") - F.lag("end_ms").over(w)).alias("prev_gap_raw"),
        F.lag("end_ms").over(w).alias("prev_end"),
        F.greatest(F.lit(0), F.lead("start_ms").over(w) - F.col("end_ms")).alias("next_gap_raw"),
        F.lead("start_ms").over(w).alias("next_start"),
        F.coalesce((F.col("key") != "") & (F.lag("key").over(w) == F.col("key")), F.lit(False)).alias("prev_text_same"),
        F.coalesce((F.col("key") != "") & (F.lead("key").over(w) == F.col("key")), F.lit(False)).alias("next_text_same"),
    ).select(
        "media_id",
        "cue_id",
        F.when(F.col("prev_end").isNotNull(), F.col("prev_gap_raw")).alias("prev_gap_ms"),
        F.when(F.col("next_start").isNotNull(), F.col("next_gap_raw")).alias("next_gap_ms"),
        "prev_text_same",
        "next_text_same",
    )


def same_text_runs(cues: DataFrame, text_col: str = "src_text", max_gap_ms: int = 1000) -> DataFrame:
    """run_length and 0-based run_position in runs of equal compact text and small gaps; (0, 0) without text."""
    w = by_media()
    keyed = cues.select("media_id", "cue_id", "start_ms", "end_ms", tx.compact(F.col(text_col)).alias("key"))
    breaks = F.coalesce(
        (F.lag("key").over(w) != F.col("key")) | (F.col("start_ms") - F.lag("end_ms").over(w) > max_gap_ms), F.lit(True)
    )
    islands = keyed.withColumn("breaks", breaks).withColumn("island", F.sum(F.col("breaks").cast("int")).over(w))
    run = Window.partitionBy("media_id", "island")
    empty = F.col("key") == ""
    return islands.select(
        "media_id",
        "cue_id",
        F.when(empty, 0).otherwise(F.count(F.lit(1)).over(run)).cast("long").alias("run_length"),
        F.when(empty, 0)
        .otherwise(F.row_number().over(run.orderBy("start_ms", "end_ms", "cue_id")) - 1)
        .cast("long")
        .alias("run_position"),
    )


def normalize_timeline(cues: DataFrame) -> DataFrame:
    """Ends capped two frames before the next start, never before the own start; too_short flags."""
    cap = F.greatest(F.col("start_ms"), F.col("next_start") - GAP_MS)
    late = F.col("next_start").isNotNull() & (F.col("end_ms") + GAP_MS > F.col("next_start"))
    out = cues.withColumn("next_start", F.lead("start_ms").over(by_media()))
    display = F.when(late, cap).otherwise(F.col("end_ms"))
    return out.select(
        "media_id",
        "cue_id",
        "start_ms",
        display.alias("display_end_ms"),
        (late & (cap - F.col("start_ms") < MIN_DISPLAY_MS)).alias("too_short"),
    )


def reading_ms(units: Column) -> Column:
    """Reading time of display units (times 100): 350 ms and one second for every seven."""
    return 350 + F.floor(units * 10 / 7.0)


def display_window(cues: DataFrame, text_col: str = "tgt_text") -> DataFrame:
    """Reading-speed windows: at least the reading time, at most 1.65 times it or 900 ms more, before the next cue."""
    w = by_media()
    target = F.greatest(reading_ms(tx.display_units(F.col(text_col))), F.lit(MIN_DISPLAY_MS).cast("long"))
    out = cues.withColumn("target", target).withColumn("next_start", F.lead("start_ms").over(w))
    # ``greatest`` and ``least`` skip nulls: the last cue has no limit.
    limit = F.when(F.col("next_start").isNotNull(), F.greatest(F.col("start_ms") + 50, F.col("next_start") - GAP_MS))
    cap = F.greatest(F.floor(F.col("target") * 165 / 100), F.col("target") + 900)
    trimmed = F.least(F.col("end_ms"), limit, F.col("start_ms") + cap)
    wanted = F.least(F.col("start_ms") + F.col("target"), limit)
    end = F.least(F.greatest(trimmed, wanted), limit)
    return out.select(
        "media_id",
        "cue_id",
        "start_ms",
        F.when(end <= F.col("start_ms"), F.col("start_ms") + 50).otherwise(end).alias("window_end_ms"),
    )


def polish_timeline(cues: DataFrame) -> DataFrame:
    """Short gaps closed to two frames, longer ones shortened by lingering, never 500 ms past the spoken end."""
    out = cues.withColumn("next_start", F.lead("start_ms").over(by_media()))
    start, end0 = F.col("start_ms"), F.greatest(F.col("start_ms") + 50, F.col("end_ms"))
    max_end = F.greatest(start + 50, F.col("next_start") - GAP_MS)
    gap = F.greatest(F.lit(0), F.col("next_start") - end0)
    held = F.least(end0 + LINGER_MS, F.greatest(start + 50, F.col("next_start") - SHORT_GAP_MS))
    target = F.when(gap < SHORT_GAP_MS, max_end).otherwise(held)
    end = F.when(F.col("next_start").isNull(), end0 + LINGER_MS).otherwise(F.least(F.greatest(end0, target), max_end))
    return out.select(
        "media_id", "cue_id", "start_ms", F.greatest(start + 50, F.least(end, F.col("end_ms") + LINGER_MS)).alias("polished_end_ms")
    )


def _next_limit() -> Column:
    """The next start, not before the own start; null at the last cue, which ``least`` skips."""
    return F.when(F.col("next_start").isNotNull(), F.greatest("start_ms", "next_start"))


def repair_windows(cues: DataFrame, min_ms: int = 600, tiny_ms: int = 100) -> DataFrame:
    """Ends trimmed to the next start; cues of at most ``tiny_ms`` stretched to ``min_ms``; trimmed again."""
    w = by_media()
    trimmed = cues.withColumn("next_start", F.lead("start_ms").over(w)).withColumn(
        "end1", F.least(F.col("end_ms"), _next_limit())
    )
    stretched = F.when(F.col("end1") - F.col("start_ms") <= tiny_ms, F.col("start_ms") + min_ms).otherwise(F.col("end1"))
    out = trimmed.withColumn("end2", stretched)
    return out.select(
        "media_id",
        "cue_id",
        "start_ms",
        F.least(F.col("end2"), _next_limit()).alias("repaired_end_ms"),
    )


def layout_flags(cues: DataFrame) -> DataFrame:
    """Ends clamped to seven seconds, with duration and gap violations (a gap counts for both its cues)."""
    w = by_media()
    out = cues.withColumn("clamped", F.col("end_ms") - F.col("start_ms") > MAX_DISPLAY_MS).withColumn(
        "display_end_ms", F.least("end_ms", F.col("start_ms") + MAX_DISPLAY_MS)
    )
    near_next = F.lead("start_ms").over(w) - F.col("display_end_ms") < GAP_MS
    near_prev = F.col("start_ms") - F.lag("display_end_ms").over(w) < GAP_MS
    return out.select(
        "media_id",
        "cue_id",
        "display_end_ms",
        "clamped",
        (F.col("display_end_ms") - F.col("end_ms")).alias("shift_end_ms"),
        (F.col("display_end_ms") - F.col("start_ms") < MIN_DISPLAY_MS).alias("duration_violation"),
        (F.coalesce(near_next, F.lit(False)) | F.coalesce(near_prev, F.lit(False))).alias("gap_violation"),
    )


def gap_anchors(cues: DataFrame, min_gap_ms: int = 120, strong_ms: int = 600) -> DataFrame:
    """Midpoints of the gaps between neighbouring cues, strong from 600 ms on."""
    out = cues.withColumn("next_start", F.lead("start_ms").over(by_media()))
    gap = F.col("next_start") - F.col("end_ms")
    return out.where(gap >= min_gap_ms).select(
        "media_id",
        "cue_id",
        F.floor((F.col("end_ms") + F.col("next_start")) / 2).alias("anchor_ms"),
        gap.alias("gap_ms"),
        (gap >= strong_ms).alias("strong"),
    )


def word_segments(words: DataFrame) -> DataFrame:
    """Consecutive words of one chunk (media_id, pos, word, chunk) as segments; a null chunk never breaks."""
    w = Window.partitionBy("media_id").orderBy("pos")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    known = F.last("chunk", ignorenulls=True).over(before)
    breaks = F.coalesce(F.col("chunk") != known, F.lit(False))
    islands = words.withColumn("breaks", breaks).withColumn("segment", F.sum(F.col("breaks").cast("long")).over(w))
    return islands.groupBy("media_id", "segment").agg(
        F.min("pos").alias("first_pos"),
        F.max("pos").alias("last_pos"),
        F.count(F.lit(1)).alias("n_words"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda x: x["word"]), " ").alias("text"),
    )


def _running(lengths: Column) -> Column:
    """Sums of every array up to each of its numbers, in one pass over a batch."""

    @F.arrow_udf("array<long>")
    def run(x: pa.Array) -> pa.Array:
        at = x.offsets.to_numpy().astype(np.int64)
        upto = np.concatenate(([0], np.cumsum(x.values.to_numpy(zero_copy_only=False))))
        own = upto[1 + at[0] : 1 + at[-1]] - np.repeat(upto[at[:-1]], np.diff(at))
        return pa.ListArray.from_arrays(pa.array(at - at[0], pa.int32()), pa.array(own, pa.int64()))

    return run(lengths)


def proportional_tokens(cues: DataFrame, text_col: str = "src_text") -> DataFrame:
    """Tokens of a cue with shares of its window by length; the last token ends exactly.

    A cue's sums are made in its own row, so that tokens are neither dealt out nor sorted.
    """
    toks = cues.select("cue_id", "start_ms", "end_ms", tx.tokens(F.col(text_col)).alias("tokens"))
    toks = toks.withColumn("upto", _running(F.transform("tokens", F.length).cast("array<long>")))
    total = F.try_element_at("upto", F.lit(-1))
    rows = toks.where(F.size("tokens") > 0).select(
        "cue_id", "start_ms", "end_ms", total.alias("total"), F.posexplode_outer(F.arrays_zip("tokens", "upto")).alias("token_index", "t")
    )
    at = lambda n: F.col("start_ms") + F.floor((F.col("end_ms") - F.col("start_ms")) * n / F.col("total"))
    upto = F.col("t.upto")
    return rows.select(
        "cue_id", F.col("token_index").cast("long").alias("token_index"), F.col("t.tokens").alias("token"),
        at(upto - F.length("t.tokens")).alias("token_start_ms"), at(upto).alias("token_end_ms"),
    )
