"""Content-addressed caches, lookups and resumable work as joins on hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def text_key(text: Column, prefix: str = "") -> Column:
    """SHA-1 of a text; null counts as empty."""
    return F.concat(F.lit(prefix), F.sha1(F.coalesce(text, F.lit(""))))


def row_key(*fields: Column) -> Column:
    """24 hex digits of SHA-256 over NUL-joined fields, nulls as empty."""
    return F.substring(F.sha2(F.array_join(F.array(*(F.coalesce(f.cast("string"), F.lit("")) for f in fields)), "\u0000"), 256), 1, 24)


def signature(**settings: object) -> Column:
    """12 hex digits of SHA-1 over the settings as JSON, names in order."""
    named = [F.lit(v).alias(k) for k, v in sorted(settings.items())]
    return F.substring(F.sha1(F.to_json(F.struct(*named))), 1, 12)


def last_writer(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key: the one with the largest order.  Map-side combining carries hot keys."""
    return _picked(rows, [key], F.max_by("r", order))


def first_occurrence(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row per key combination: the one with the smallest order."""
    return _picked(rows, keys, F.min_by("r", order))


def _picked(rows: DataFrame, keys: list[str], pick: Column) -> DataFrame:
    whole = rows.withColumn("r", F.struct(*rows.columns))
    return whole.groupBy(*keys).agg(pick.alias("r")).select("r.*")


def probe(rows: DataFrame, batch_cache: DataFrame, row_cache: DataFrame) -> DataFrame:
    """``rows`` (batch_key, row_key, ...) with value and level: batch, row or pending.

    Both caches are (key, value) with unique keys.
    """
    b = batch_cache.select(F.col("key").alias("batch_key"), F.col("value").alias("b_value"))
    r = row_cache.select(F.col("key").alias("row_key"), F.col("value").alias("r_value"))
    met = rows.join(b, "batch_key", "left").join(r, "row_key", "left")
    level = F.when(F.col("b_value").isNotNull(), "batch").when(F.col("r_value").isNotNull(), "row").otherwise("pending")
    return met.withColumn("value", F.coalesce("b_value", "r_value")).withColumn("level", level).drop("b_value", "r_value")


def pending(rows: DataFrame, done: DataFrame, *keys: str) -> DataFrame:
    """Rows whose key combination is not done yet; null keys are never done."""
    return rows.join(done.select(*keys).distinct(), list(keys), "left_anti")


def repaired(rows: DataFrame, fixes: DataFrame, key: str, value: str) -> DataFrame:
    """``rows`` with ``value`` replaced where ``fixes`` (key, fixed) has a non-empty one."""
    met = rows.join(fixes.select(key, "fixed"), key, "left")
    return met.withColumn(value, F.coalesce(F.nullif(F.col("fixed"), F.lit("")), F.col(value))).drop("fixed")


def strict_lookup(rows: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Inner join that raises when a key of ``rows`` is unknown or repeats in ``known``."""
    if not known.groupBy(key).count().where("count > 1").isEmpty():
        raise ValueError(f"{key} repeats among the known rows")
    if not rows.join(known, key, "left_anti").isEmpty():
        raise ValueError(f"unknown {key}")
    return rows.join(known, key)


def assert_disjoint(a: DataFrame, b: DataFrame, key: str) -> None:
    """Raise when a key is on both sides (a leak)."""
    if not a.select(key).intersect(b.select(key)).isEmpty():
        raise ValueError(f"{key} on both sides")
