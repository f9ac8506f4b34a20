"""Rates with confidence intervals, confusion counts, weighted means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Z = 1.96


def wilson(hits: Column, total: Column, z: float = Z) -> tuple[Column, Column]:
    """Wilson score interval of a rate; nulls without observations."""
    n = F.when(total > 0, total.cast("double"))
    p = hits / n
    centre, spread = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    scale = 1 + z * z / n
    return (centre - spread) / scale, (centre + spread) / scale


def difference(hits_a: Column, n_a: Column, hits_b: Column, n_b: Column, z: float = Z) -> tuple[Column, Column, Column]:
    """Difference of two rates with its interval; nulls when a side has no observations."""
    a, b = hits_a / F.when(n_a > 0, n_a), hits_b / F.when(n_b > 0, n_b)
    spread = z * F.sqrt(a * (1 - a) / F.nullif(n_a, F.lit(0)) + b * (1 - b) / F.nullif(n_b, F.lit(0)))
    return a - b, a - b - spread, a - b + spread


def rates(rows: DataFrame, stratum: str, hit: Column) -> DataFrame:
    """n, hits, rate and its interval per stratum."""
    per = rows.groupBy(stratum).agg(F.count(F.lit(1)).alias("n"), F.count_if(hit).alias("hits"))
    low, high = wilson(F.col("hits"), F.col("n"))
    return per.select(stratum, "n", "hits", (F.col("hits") / F.col("n")).alias("rate"), low.alias("low"), high.alias("high"))


def confusion(rows: DataFrame, stratum: str, said: Column, true: Column) -> DataFrame:
    """Counts of true and false positives and negatives per stratum."""
    return rows.groupBy(stratum).agg(
        F.count_if(said & true).alias("tp"),
        F.count_if(said & ~true).alias("fp"),
        F.count_if(~said & true).alias("fn"),
        F.count_if(~said & ~true).alias("tn"),
    )


def agreement(counts: DataFrame) -> DataFrame:
    """Recall, specificity and agreement of confusion counts; null where nothing was to be found."""
    ratio = lambda a, b: F.col(a) / F.nullif(F.col(a) + F.col(b), F.lit(0))
    n = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    return counts.select(
        "*",
        ratio("tp", "fn").alias("recall"),
        ratio("tn", "fp").alias("specificity"),
        ((F.col("tp") + F.col("tn")) / F.nullif(n, F.lit(0))).alias("agreement"),
    )


def weighted_mean(value: Column, weight: Column) -> Column:
    """Weighted mean with weights of at least one."""
    w = F.greatest(weight, F.lit(1))
    return F.sum(value * w) / F.sum(w)


def nearest_rank(rows: DataFrame, by: str, value: str, q: float) -> DataFrame:
    """(by, value): per group, the element at index min(n - 1, int(n * q)) of the sorted values, no interpolation.

    Values are counted first: what is ordered is a group's distinct values, never its rows.
    Nulls do not count; a group of nothing else gives null.
    """
    counts = rows.groupBy(by, value).agg(F.count(value).alias("count"))
    group = Window.partitionBy(by)
    upto, n = F.sum("count").over(group.orderBy(value)), F.sum("count").over(group)
    ranked = counts.select(by, value, "count", upto.alias("upto"), n.alias("n"))
    rank = F.least(F.col("n"), F.floor(F.col("n") * q) + 1)
    here = (F.col("upto") >= rank) & ((F.col("upto") - F.col("count") < rank) | (F.col("n") == 0))
    return ranked.where(here).select(by, value)


def against_floor(strata: DataFrame, stratum: str, floor: str) -> DataFrame:
    """Rates of every stratum against the floor stratum: difference, interval, and whether they are apart."""
    base = strata.where(F.col(stratum) == floor).select(F.col("hits").alias("f_hits"), F.col("n").alias("f_n"), F.lit(1).alias("one"))
    met = strata.where(F.col(stratum) != floor).withColumn("one", F.lit(1)).join(F.broadcast(base), "one")  # one row
    d, low, high = difference(F.col("hits"), F.col("n"), F.col("f_hits"), F.col("f_n"))
    return met.select(stratum, "n", "hits", d.alias("difference"), low.alias("low"), high.alias("high"), ((low > 0) | (high < 0)).alias("separated"))


def monotone(rows: DataFrame, order: str, value: str) -> Column:
    """Whether a value never falls from one row to the next (few rows: one ladder)."""
    return F.coalesce(F.col(value) >= F.lag(value).over(Window.partitionBy(F.lit(0)).orderBy(order)), F.lit(True))
