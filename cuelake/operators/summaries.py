"""Summaries, rankings and set operations that reports are made of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuelake.operators.sampling import draw


def describe(rows: DataFrame, by: str, value: str) -> DataFrame:
    """(by, n, median, p90, p99, mean, max) with interpolated quantiles."""
    q = rows.groupBy(by).agg(
        F.count(value).alias("n"), F.percentile(value, [0.5, 0.9, 0.99]).alias("q"), F.avg(value).alias("mean"), F.max(value).alias("max")
    )
    return q.select(by, "n", *(F.col("q")[i].alias(c) for i, c in enumerate(("median", "p90", "p99"))), "mean", "max")


def top_per_group(rows: DataFrame, by: str, value: str, tie: str, most: int) -> DataFrame:
    """The rows of the largest values of every group with their rank; Spark keeps ``most`` a task before the shuffle."""
    w = Window.partitionBy(by).orderBy(F.desc(value), tie)
    return rows.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= most)


def blank_manifest(rows: DataFrame, by: str, text: Column) -> DataFrame:
    """(by, n, empty, empty_ratio): rows and those without text, the ratio to six places."""
    per = rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.count_if(text == "").alias("empty"))
    return per.withColumn("empty_ratio", F.round(F.col("empty") / F.greatest("n", F.lit(1)), 6))


def rate_margins(rates: DataFrame, by: str, rate: str, floor: object) -> DataFrame:
    """``rates`` with the margin in percentage points over the floor label's rate; null without a floor."""
    base = F.max(F.when(F.col(by) == floor, F.col(rate))).over(Window.partitionBy(F.lit(0)))  # a row per label
    return rates.withColumn("margin_pp", F.round((F.col(rate) - base) * 100, 6))


def totals_with_zeros(rows: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """(label, n): counts of the known labels, zero for those that no row has."""
    return labels.join(rows.groupBy(label).agg(F.count(F.lit(1)).alias("n")), label, "left").na.fill(0, ["n"])


def sweep(spans: DataFrame, by: str, thresholds: list[int]) -> DataFrame:
    """(least_ms, by, kept, kept_ms, all_ms): what every threshold keeps; each span meets a short literal list."""
    met = spans.withColumn("least_ms", F.explode(F.array(*(F.lit(t) for t in thresholds)))).withColumn("d", F.col("end_ms") - F.col("start_ms"))
    kept = F.col("d") >= F.col("least_ms")
    return met.groupBy("least_ms", by).agg(
        F.count_if(kept).alias("kept"), F.sum(F.when(kept, F.col("d")).otherwise(0)).alias("kept_ms"), F.sum("d").alias("all_ms")
    )


def sparse_sum(value: Column) -> Column:
    """Sum of what is present; null when nothing is."""
    return F.sum(value)


def stage_rows(stages: DataFrame, by: str, total: str, parts: list[str], least: int) -> DataFrame:
    """(by, pos, stage, value): one row per part in the given order, then what they leave of the total if it is ``least`` or more."""
    rest = F.col(total) - sum((F.col(p) for p in parts[1:]), F.col(parts[0]))
    items = [F.struct(F.lit(i).alias("pos"), F.lit(p).alias("stage"), F.col(p).alias("value")) for i, p in enumerate(parts)]
    other = F.when(rest >= least, F.struct(F.lit(len(parts)).alias("pos"), F.lit("other").alias("stage"), rest.alias("value")))
    listed = F.filter(F.array(*items, other), lambda x: x.isNotNull() & x["value"].isNotNull())
    return stages.select(by, F.explode(listed).alias("x")).select(by, "x.*")


def one_per_group(rows: DataFrame, group: str, key: str, seed: str, most: int) -> DataFrame:
    """The first ``most`` groups in seeded order, each with its first row in seeded order."""
    order = F.struct(draw(seed, F.col(key)).alias("draw"), F.col(key).alias("key"))
    first = rows.groupBy(group).agg(F.min(order).alias("o"))
    return first.orderBy(draw(seed, F.col(group)), group).limit(most).select(group, F.col("o.key").alias(key))


def distinct_in_order(items: Column) -> Column:
    """The distinct non-empty strings of an array, first places kept."""
    return F.array_distinct(F.filter(items, lambda x: x.isNotNull() & (x != "")))


def tagged_union(**arms: DataFrame) -> DataFrame:
    """Rows of all arms with the name of theirs as ``arm``."""
    out = None
    for name, rows in arms.items():
        part = rows.withColumn("arm", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def rolling_use(events: DataFrame, key: str, at_s: str, units: str, per_minute: int, per_day: int) -> DataFrame:
    """Every event with its key's use in the last minute and day, what is left of both budgets, and when the minute has room.

    A window is (now - length, now].
    """
    w = Window.partitionBy(key).orderBy(at_s)
    minute, day = w.rangeBetween(-59, 0), w.rangeBetween(-86_399, 0)
    used = events.select(
        key, "event_id", at_s, F.count(F.lit(1)).over(minute).alias("in_minute"), F.count(F.lit(1)).over(day).alias("in_day"),
        F.sum(units).over(day).alias("units_in_day"), F.min(at_s).over(minute).alias("oldest"),
    )
    ready = F.when(F.col("in_minute") >= per_minute, F.col("oldest") + 60).otherwise(F.col(at_s))
    return used.select(
        key, "event_id", "in_minute", "in_day", "units_in_day", F.greatest(F.lit(0), per_minute - F.col("in_minute")).alias("minute_left"),
        F.greatest(F.lit(0), per_day - F.col("in_day")).alias("day_left"), ready.alias("ready_s"),
    )


def first_loud(frames: DataFrame, key: str, level: str, relative_db: float = 35.0, floor_db: float = -55.0) -> DataFrame:
    """(key, frame): the first frame as loud as the peak less ``relative_db``, and no less than ``floor_db``; null if none."""
    peak = frames.groupBy(key).agg(F.max(level).alias("peak"))
    low = F.greatest(F.col("peak") * 10 ** (-relative_db / 20), F.lit(10 ** (floor_db / 20)))
    met = frames.join(peak, key)
    return met.groupBy(key).agg(F.min(F.when(F.col(level) >= low, F.col("frame"))).alias("frame"))
