"""One plan for many parameter sets: what a gate of pauses keeps, by configuration and label."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuelake.operators import intervals

BIN_MS = 50_000
DEFAULT = {"min_blank_ms": 600, "min_speech_ms": 1000, "merge_gap_ms": 400, "pad_ms": 150}
# The sweep moves one axis at a time; the first is the control that must lose nothing.
SWEEP = {
    "keep_everything": {"min_blank_ms": 1_000_000_000}, "default": {}, "blank_0.4": {"min_blank_ms": 400}, "blank_0.8": {"min_blank_ms": 800},
    "blank_1.2": {"min_blank_ms": 1200}, "pad_0.0": {"pad_ms": 0}, "pad_0.3": {"pad_ms": 300}, "min_speech_0.0": {"min_speech_ms": 0},
    "min_speech_2.0": {"min_speech_ms": 2000}, "merge_0.0": {"merge_gap_ms": 0}, "merge_1.0": {"merge_gap_ms": 1000},
}


def _keyed(rows: DataFrame, media: str, configs: dict[str, dict[str, int]]) -> DataFrame:
    """Every row once for each configuration, with the key (medium, name, settings)."""
    sets = [F.struct(F.lit(n).alias("config"), *(F.lit({**DEFAULT, **c}[k]).cast("long").alias(k) for k in DEFAULT)) for n, c in configs.items()]
    spread = rows.withColumn("c", F.explode(F.array(*sets)))
    return spread.withColumn("key", F.struct(F.col(media).alias("media"), "c.*")).drop("c", media)


def kept_regions(pauses: DataFrame, media: DataFrame, key: str, total_ms: int, configs: dict[str, dict[str, int]] = SWEEP) -> DataFrame:
    """(key, start_ms, end_ms): what each configuration keeps of [0, total] of every medium in ``media``.

    Pauses of at least ``min_blank_ms`` cut; what lies between them is joined over
    ``merge_gap_ms``, dropped below ``min_speech_ms``, padded and joined again.  A medium
    without such pauses is kept whole.
    """
    long = _keyed(pauses.select(key, "start_ms", "end_ms"), key, configs).where("end_ms - start_ms >= key.min_blank_ms")
    long = intervals.clamp(long, 0, total_ms)
    # An empty span at the end stands for every medium: what no pause cuts is one hole.
    at_end = F.lit(total_ms).cast("long")
    every = _keyed(media.select(key).distinct(), key, configs).select("key", at_end.alias("start_ms"), at_end.alias("end_ms"))
    between = intervals.holes(long.select("key", "start_ms", "end_ms").unionByName(every), "key", 0, total_ms)
    speech = intervals.merge(between, "key", F.col("key.merge_gap_ms")).where("end_ms - start_ms >= key.min_speech_ms")
    padded = speech.select(
        "key", F.greatest(F.lit(0), F.col("start_ms") - F.col("key.pad_ms")).alias("start_ms"), F.least(F.lit(total_ms), F.col("end_ms") + F.col("key.pad_ms")).alias("end_ms")
    )
    return intervals.merge(padded, "key").select("key", "start_ms", "end_ms")


def pregate_sweep(pauses: DataFrame, spans: DataFrame, key: str, total_ms: int, configs: dict[str, dict[str, int]] = SWEEP) -> DataFrame:
    """(config, label, labelled_ms, kept_ms, lost_ms, recall, decoded_ms, decode_fraction) over all media of ``spans`` (key, span_id, label, start_ms, end_ms).

    Spans are held against the union of the kept regions; empty spans go.  All
    configurations share one plan, keyed by medium and configuration.
    """
    good = spans.where("end_ms > start_ms")
    # Rows without a medium meet nothing; told here, both uses of the regions are the same plan and share its exchange.
    regions = kept_regions(pauses, spans, key, total_ms, configs).where("key.media IS NOT NULL")
    decoded = regions.groupBy(F.col("key.config").alias("config")).agg(F.sum(F.col("end_ms") - F.col("start_ms")).alias("decoded_ms"))
    labelled = good.groupBy("label").agg(F.sum(F.col("end_ms") - F.col("start_ms")).alias("labelled_ms"))
    named = regions.select(F.col("key.media").alias(key), F.col("key.config").alias("config"), "start_ms", "end_ms")
    # Spans meet the regions of all configurations at once; regions are long, and so are the bins.
    pairs = intervals.overlap_pairs(good, named, key, "label", "config", bin_ms=BIN_MS)
    kept = pairs.groupBy(F.col("b_id").alias("config"), F.col("a_id").alias("label")).agg(F.sum("overlap_ms").alias("kept_ms"))
    # One row per configuration and label: both are short lists.
    names = spans.sparkSession.createDataFrame([(n,) for n in configs], "config string")
    grid = labelled.withColumn("config", F.explode(F.array(*(F.lit(n) for n in configs))))
    # The same distinct media as in ``kept_regions``, so that Spark uses their exchange again.
    n_media = spans.select(key).distinct().agg(F.count(key)).scalar()
    out = grid.join(kept, ["config", "label"], "left").join(F.broadcast(names.join(decoded, "config", "left")), "config")
    ms = F.coalesce("kept_ms", F.lit(0))
    return out.select(
        "config", "label", "labelled_ms", ms.alias("kept_ms"), F.greatest(F.lit(0), F.col("labelled_ms") - ms).alias("lost_ms"),
        (ms / F.col("labelled_ms")).alias("recall"), F.coalesce("decoded_ms", F.lit(0)).alias("decoded_ms"),
        (F.coalesce("decoded_ms", F.lit(0)) / (n_media * total_ms)).alias("decode_fraction"),
    )
