"""Splits, samples and batches, seeded by hashes so that a rerun draws the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuelake.functions import text as tx


WHOLE = Window.unboundedPreceding, Window.unboundedFollowing


def draw(seed: str, key: Column) -> Column:
    """Sort key of a seeded permutation."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def stratified(rows: DataFrame, stratum: str, quota: int, seed: str, key: str) -> DataFrame:
    """The first ``quota`` rows of every stratum in seeded order, with their rank.

    Spark's partial window limit keeps at most ``quota`` rows per task and stratum before the shuffle.
    """
    w = Window.partitionBy(stratum).orderBy(draw(seed, F.col(key)), key)
    return rows.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= quota)


def disjoint_samples(rows: DataFrame, stratum: str, sizes: dict[str, int], seed: str, key: str) -> DataFrame:
    """Named samples without common rows: consecutive ranges of one permutation per stratum."""
    w = Window.partitionBy(stratum).orderBy(draw(seed, F.col(key)), key)
    ranked = rows.withColumn("rank", F.row_number().over(w).cast("long"))
    name, upto = F.lit(None).cast("string"), 0
    for sample, size in sizes.items():
        name = F.when(F.col("rank").between(upto + 1, upto + size), sample).otherwise(name)
        upto += size
    return ranked.where(F.col("rank") <= upto).withColumn("sample", name)


def group_split(rows: DataFrame, group: str, permille: int, seed: str) -> DataFrame:
    """Whole groups to ``val`` in seeded order until they hold the share of rows; the rest to ``train``.

    Only the groups' sizes are ordered, not the rows.
    """
    sizes = rows.groupBy(group).agg(F.count(F.lit(1)).alias("n")).withColumn("draw", draw(seed, F.col(group)))
    # Sums run over ranges of the draw first, a bounded number of rows, then within each range.
    ranged = sizes.withColumn("range", F.substring("draw", 1, 4))
    sums = ranged.groupBy("range").agg(F.sum("n").alias("in_range"))
    line = Window.orderBy("range")
    bounds = sums.select(
        "range", (F.sum("in_range").over(line) - F.col("in_range")).alias("first"), F.sum("in_range").over(line.rowsBetween(*WHOLE)).alias("total")
    )
    within = Window.partitionBy("range").orderBy("draw", group)
    before = F.col("first") + F.sum("n").over(within) - F.col("n")
    split = F.when(before * 1000 < F.col("total") * permille, "val").otherwise("train")
    return ranged.join(bounds, "range").select(group, "n", split.alias("split"))


def positional_split(rows: DataFrame, by: str, order: str, val: int, test: int, train: int) -> DataFrame:
    """Rows of each ``by`` in order: val, then test, then train, as many as asked; the rest goes."""
    pos = F.row_number().over(Window.partitionBy(by).orderBy(order))
    ranked = rows.withColumn("pos", pos.cast("long"))
    split = F.when(F.col("pos") <= val, "val").when(F.col("pos") <= val + test, "test").otherwise("train")
    return ranked.where(F.col("pos") <= val + test + train).withColumn("split", split)


def fixed_batches(rows: DataFrame, by: str, order: str, size: int) -> DataFrame:
    """Batch numbers from 0 in order, ``size`` rows each."""
    return rows.withColumn("batch", F.expr(f"(row_number() over (partition by {by} order by {order}) - 1) div {size}"))


def batch_costs(batches: DataFrame, by: str, text: str) -> DataFrame:
    """Cost (characters) of each batch and its place in longest-first order."""
    cost = batches.groupBy(by, "batch").agg(F.sum(F.length(tx.text(F.col(text)))).alias("cost"))
    order = Window.partitionBy(by).orderBy(F.desc("cost"), "batch")
    return cost.withColumn("submit", F.row_number().over(order).cast("long"))


def length_buckets(rows: DataFrame, length: Column, bucket: int) -> DataFrame:
    """Bucket numbers by length, so that a batch pads little."""
    return rows.withColumn("bucket", F.expr("0L") + F.floor(length / bucket))


def vocabulary(texts: DataFrame, text: str, least: int, most: int) -> DataFrame:
    """(id, char, n): the most frequent non-space characters, ids from 2; ties by character."""
    chars = texts.select(F.explode(F.split(tx.text(F.col(text)), "")).alias("char")).where(r"char rlike '^\\S$'")
    counts = chars.groupBy("char").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    top = counts.orderBy(F.desc("n"), "char").limit(most)
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc("n"), "char")  # over ``most`` rows
    return top.select((F.row_number().over(order) + 1).cast("long").alias("id"), "char", "n")


def coverage(texts: DataFrame, text: str, vocab: DataFrame) -> DataFrame:
    """(total, covered): non-space characters, and those in the vocabulary."""
    chars = texts.select(F.explode(F.split(tx.text(F.col(text)), "")).alias("char")).where(r"char rlike '^\\S$'")
    counts = chars.groupBy("char").agg(F.count(F.lit(1)).alias("n")).join(vocab.select("char", "id"), "char", "left")
    return counts.agg(F.sum("n").alias("total"), F.sum(F.when(F.col("id").isNotNull(), F.col("n")).otherwise(0)).alias("covered"))


def encode(text: Column, vocab: dict[str, int]) -> Column:
    """Ids of the characters of a text; 1 for unknown ones."""
    table = F.create_map(*(F.lit(x) for pair in vocab.items() for x in pair))
    chars = F.filter(F.split(tx.text(text), ""), lambda c: c != "")
    return F.transform(chars, lambda c: F.coalesce(F.try_element_at(table, c), F.lit(1)))
