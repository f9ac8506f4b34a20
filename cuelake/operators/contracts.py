"""Row contracts of resumable work: windows, placeholders, outcomes, signatures, warnings, shards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuelake.operators import flags
from cuelake.operators.segments import timing_stats

LEAST_WINDOW_MS = 50


def alignment_window(result_ms: Column, chunk_ms: Column, begin_ms: Column, end_ms: Column) -> Column:
    """struct(start_ms, end_ms, source): the given window within the duration; the whole chunk when it is under 50 ms.

    The duration is the result's if positive, else the chunk's.
    """
    whole = F.when(result_ms > 0, result_ms).otherwise(F.greatest(F.lit(0), chunk_ms))
    start = F.greatest(F.lit(0), F.least(begin_ms, whole))
    end = F.greatest(start, F.least(end_ms, whole))
    own = F.coalesce(end - start >= LEAST_WINDOW_MS, F.lit(False))
    pick = lambda a, b: F.when(own, a).otherwise(b)
    return F.struct(
        pick(start, F.lit(0).cast("long")).alias("start_ms"), pick(end, whole).alias("end_ms"), pick(F.lit("given"), F.lit("chunk")).alias("source")
    )


def outcomes(cues: DataFrame, words: DataFrame, chars: Column, score: Column) -> DataFrame:
    """One row per cue: word statistics (zero without words) beside the class of its alignment."""
    met = cues.join(timing_stats(words, "cue_id"), "cue_id", "left").na.fill(0, ["word_count", "no_length", "tiny"])
    quality = flags.alignment_quality(F.col("end_ms") - F.col("start_ms"), chars, score, F.col("no_length"))
    return met.select("cue_id", "word_count", "no_length", "tiny", quality.alias("quality"))


def with_placeholders(items: DataFrame, results: DataFrame, key: str, value: str) -> DataFrame:
    """Every item with its result, or an empty one marked as such."""
    met = items.join(results.select(key, F.col(value).alias("_v"), F.lit(True).alias("_hit")), key, "left")
    return met.select(*items.columns, F.coalesce("_v", F.lit("")).alias(value), F.col("_hit").isNull().alias("placeholder"))


def config_signature(settings: dict[str, Column], neutral: dict[str, object]) -> Column:
    """12 hex digits over the settings in order of name, but those with their neutral value, so that new ones do not invalidate."""
    parts = [
        F.when(F.coalesce(c.cast("string"), F.lit("")) != F.lit(str(neutral[n])) if n in neutral else F.lit(True),
               F.concat(F.lit(f"{n}="), F.coalesce(c.cast("string"), F.lit(""))))
        for n, c in sorted(settings.items())
    ]
    return F.substring(F.sha1(F.array_join(F.filter(F.array(*parts), lambda x: x.isNotNull()), "\n")), 1, 12)


def over_limits(metrics: DataFrame, key: str, limits: dict[str, float]) -> DataFrame:
    """(key, metric, value, limit): the metrics above their limits, one row each."""
    items = [F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"), F.lit(float(x)).alias("limit")) for m, x in limits.items()]
    over = F.filter(F.array(*items), lambda x: x["value"] > x["limit"])
    return metrics.select(key, F.explode(over).alias("x")).select(key, "x.*")


def is_retryable(error: Column) -> Column:
    """Whether an error text tells of a limit, a timeout or a server's fault."""
    return F.regexp_like(F.lower(error), F.lit(r"\b(429|5[0-9][0-9])\b|time[d]?[ -]?out|rate limit|connection"))


def is_timed_out(log: Column) -> Column:
    """Whether a line of a log array tells of a timeout."""
    return F.exists(log, lambda x: F.contains(x, F.lit("TIMEOUT:")))


def repetition_loop(tokens: Column, longest: int = 4, repeats: int = 3) -> Column:
    """The smallest n for which an array ends in ``repeats`` copies of one n-gram; 0 if there is none."""
    size = F.size(tokens)
    last = lambda n, k: F.slice(tokens, F.greatest(size - n * (k + 1) + 1, F.lit(1)), n)
    found = [
        F.when((size >= n * repeats) & F.array(*(last(F.lit(n), k) == last(F.lit(n), 0) for k in range(1, repeats))).eqNullSafe(F.array(*[F.lit(True)] * (repeats - 1))), n)
        for n in range(1, longest + 1)
    ]
    return F.coalesce(*found, F.lit(0))


def truncated(tokens: Column, stops: list[str], cap: Column) -> Column:
    """Whether an array of tokens reached the cap without a stop."""
    return (F.size(tokens) >= cap) & ~F.arrays_overlap(tokens, F.array(*(F.lit(s) for s in stops)))


def shard_offsets(rows: DataFrame, by: str, order: str, size: str, per_shard: int) -> DataFrame:
    """(by, order, shard, offset): shards of ``per_shard`` rows in order, and where each row begins in its own."""
    pos = F.row_number().over(Window.partitionBy(by).orderBy(order)) - 1
    numbered = rows.select(by, order, size, F.floor(pos / per_shard).alias("shard"))
    before = Window.partitionBy(by, "shard").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return numbered.select(by, order, "shard", F.coalesce(F.sum(size).over(before), F.lit(0)).alias("offset"))


def clipped(spans: DataFrame, key: str, total_ms: int) -> DataFrame:
    """(key, pos, start_ms, end_ms): spans within [0, total], empty ones left out, numbered from 0."""
    cut = spans.select(
        key, F.greatest(F.lit(0), F.least("start_ms", F.lit(total_ms))).alias("start_ms"), F.greatest(F.lit(0), F.least("end_ms", F.lit(total_ms))).alias("end_ms"), "cue_id"
    ).where("end_ms > start_ms")
    pos = F.row_number().over(Window.partitionBy(key).orderBy("start_ms", "end_ms", "cue_id")).cast("long") - 1
    return cut.select(key, pos.alias("pos"), "start_ms", "end_ms")


def containment(words: DataFrame, cores: DataFrame, key: str) -> DataFrame:
    """(key, before, inside, after): where a core's words lie; one that crosses an edge counts where its middle is."""
    met = words.join(cores.select(key, F.col("start_ms").alias("c0"), F.col("end_ms").alias("c1")), key)
    mid = F.col("start_ms") + F.col("end_ms")
    return met.groupBy(key).agg(
        F.count_if(mid < 2 * F.col("c0")).alias("before"), F.count_if((mid >= 2 * F.col("c0")) & (mid <= 2 * F.col("c1"))).alias("inside"),
        F.count_if(mid > 2 * F.col("c1")).alias("after"),
    )


def fragments(events: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """Many small rows to one a key: how many, first and last place, distinct texts and the first of them."""
    return events.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), F.min(order).alias("first"), F.max(order).alias("last"), F.countDistinct(text).alias("kinds"),
        F.min_by(text, order).alias("first_text"),
    )


def oversampled(rows: DataFrame, repeat: Column) -> DataFrame:
    """Every row as often as ``repeat`` says, with its turn from 1."""
    return rows.withColumn("turn", F.explode(F.sequence(F.lit(1), repeat)))
