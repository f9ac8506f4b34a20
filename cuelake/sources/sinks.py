"""Subtitle and line-delimited JSON sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuelake.functions import text as tx
from cuelake.functions import timecode as tc
from cuelake.operators.windows import by_media


def srt_blocks(cues: DataFrame, *text_cols: str) -> DataFrame:
    """(media_id, cue_id, number, block): numbered SRT blocks; cues without any text go.

    Ends are at least 50 ms after starts.  Several text columns become lines.
    """
    lines = [F.when(F.btrim(tx.text(F.col(c))) != "", F.col(c)) for c in text_cols]
    kept = cues.withColumn("lines", F.concat_ws("\n", *lines)).where("lines <> ''")
    kept = kept.withColumn("end_ms", F.greatest("end_ms", F.col("start_ms") + 50))
    number = F.row_number().over(by_media()).cast("long")
    return kept.withColumn("number", number).select("media_id", "cue_id", "number", _block(tc.srt_time).alias("block"))


def _block(time) -> Column:
    when = F.concat(time(F.col("start_ms")), F.lit(" --> "), time(F.col("end_ms")))
    return F.concat_ws("\n", F.col("number").cast("string"), when, F.col("lines"), F.lit(""))


def write_srt(cues: DataFrame, path: str, *text_cols: str) -> None:
    """One folder per medium with the blocks in order; a medium is written by one task."""
    blocks = srt_blocks(cues, *text_cols).repartition("media_id").sortWithinPartitions("media_id", "number")
    blocks.select("media_id", F.col("block").alias("value")).write.partitionBy("media_id").mode("overwrite").text(path)


def write_vtt(cues: DataFrame, path: str, text_col: str) -> None:
    """WebVTT: as ``write_srt``, with the header line first."""
    kept = cues.withColumn("lines", tx.text(F.col(text_col))).where("lines <> ''")
    kept = kept.withColumn("number", F.row_number().over(by_media()).cast("long"))
    body = kept.select("media_id", "number", _block(tc.vtt_time).alias("value"))
    head = kept.select("media_id", F.lit(0).cast("long").alias("number"), F.lit("WEBVTT\n").alias("value")).distinct()
    out = head.union(body).repartition("media_id").sortWithinPartitions("media_id", "number")
    out.select("media_id", "value").write.partitionBy("media_id").mode("overwrite").text(path)


def write_splits(rows: DataFrame, path: str, split_col: str = "split") -> None:
    """Line-delimited JSON, one folder per split."""
    rows.write.partitionBy(split_col).mode("overwrite").json(path)


def append_keyed(rows: DataFrame, path: str) -> None:
    """Append (key, value) lines to a cache; the last line of a key counts when it is read."""
    rows.select("key", "value").write.mode("append").json(path)


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Registry after an upsert: new rows, and the old rows whose key is not among them."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)
