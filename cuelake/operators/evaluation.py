"""Predicted against reference cues: recall, precision, character errors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuelake.functions import text as tx
from cuelake.operators.intervals import merge, overlap_pairs
from cuelake.operators.sequences import edit_counts


def timeline_metrics(reference: DataFrame, predicted: DataFrame, key: str = "media_id") -> DataFrame:
    """(key, ref_ms, pred_ms, shared_ms, recall, precision) of the union of each side's time; null ratios for no time."""
    a, b = merge(reference, key).withColumn("a", F.col("start_ms")), merge(predicted, key).withColumn("b", F.col("start_ms"))
    size = F.sum(F.col("end_ms") - F.col("start_ms"))
    shared = overlap_pairs(a, b, key, "a", "b").groupBy(key).agg(F.sum("overlap_ms").alias("shared_ms"))
    both = a.groupBy(key).agg(size.alias("ref_ms")).join(b.groupBy(key).agg(size.alias("pred_ms")), key, "full")
    both = both.join(shared, key, "left").na.fill(0, ["ref_ms", "pred_ms", "shared_ms"])
    ratio = lambda n: F.col("shared_ms") / F.nullif(F.col(n), F.lit(0))
    return both.select(key, "ref_ms", "pred_ms", "shared_ms", ratio("ref_ms").alias("recall"), ratio("pred_ms").alias("precision"))


def matched_texts(reference: DataFrame, predicted: DataFrame, text_col: str, least_ms: int = 100) -> DataFrame:
    """(media_id, cue_id, ref_text, pred_text): every reference cue with the texts that overlap it, in order of time."""
    met = overlap_pairs(reference, predicted, "media_id", "cue_id", "cue_id", least_ms)
    said = predicted.select(F.col("cue_id").alias("b_id"), "start_ms", "end_ms", tx.text(F.col(text_col)).alias("said"))
    parts = F.array_sort(F.collect_list(F.struct("start_ms", "end_ms", "b_id", "said")))
    joined = met.join(said, "b_id").groupBy(F.col("a_id").alias("cue_id")).agg(
        F.array_join(F.transform(parts, lambda x: x["said"]), "").alias("pred_text")
    )
    rows = reference.select("media_id", "cue_id", tx.text(F.col(text_col)).alias("ref_text"))
    return rows.join(joined, "cue_id", "left").withColumn("pred_text", tx.text(F.col("pred_text")))


def character_errors(matched: DataFrame) -> DataFrame:
    """(media_id, n_ref, chars, distance, ins, dels, subs, cer) over the letters and digits of matched texts."""
    a, b = tx.letters_and_digits(F.col("ref_text")), tx.letters_and_digits(F.col("pred_text"))
    rows = matched.select("media_id", F.length(a).alias("chars"), edit_counts(a, b).alias("e"))
    total = rows.groupBy("media_id").agg(
        F.count(F.lit(1)).alias("n_ref"), F.sum("chars").alias("chars"),
        *(F.sum(f"e.{c}").alias(c) for c in ("distance", "ins", "dels", "subs")),
    )
    return total.withColumn("cer", F.col("distance") / F.greatest("chars", F.lit(1)))
