"""Rules that mark cues; nothing here drops a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuelake.functions import text as tx
from cuelake.operators.windows import by_media

# The limits of the flags.
MIN_UNIQUE_RATIO, MAX_CHARS_PER_SEC, MIN_CHARS = 0.25, 14.0, 6
LONG_RUN = r"(.{1,12}?)\1{5}"  # a unit of up to 12 characters six times in a row: more than five


def named(flags: dict[str, Column]) -> Column:
    """The names of the flags that hold, in the given order."""
    return F.filter(F.array(*(F.when(c, F.lit(n)) for n, c in flags.items())), lambda x: x.isNotNull())


def postgate(cues: DataFrame, text_col: str = "src_text", score: Column | None = None, min_score: float | None = None) -> DataFrame:
    """flags, kept (always true) and the observed numbers per cue.

    empty; runaway (few distinct characters); impossible_rate; repeated_unit;
    duplicate_neighbour; unsupported (only when a threshold is set).
    """
    shown = tx.clean(F.col(text_col))
    short = tx.strip_punctuation(shown)
    key, w = tx.compact(F.col(text_col)), by_media()
    same = lambda other: F.coalesce((key != "") & (other == key), F.lit(False))
    seen = cues.select(
        "media_id",
        "cue_id",
        shown.alias("shown"),
        F.length(short).cast("long").alias("char_count"),
        tx.distinct_chars(short).alias("unique_chars"),
        (F.col("end_ms") - F.col("start_ms")).alias("duration_ms"),
        F.regexp_like(tx.compact(shown), F.lit(LONG_RUN)).alias("long_run"),
        (score if score is not None else F.lit(None).cast("double")).alias("score"),
        same(F.lag(key).over(w)).alias("prev_text_same"),
        same(F.lead(key).over(w)).alias("next_text_same"),
    )
    n, enough = F.col("char_count"), F.col("char_count") >= MIN_CHARS
    rules = {
        "empty": n == 0,
        "runaway": enough & (F.col("unique_chars") < MIN_UNIQUE_RATIO * n),
        "impossible_rate": (n > 0) & (n * 1000 > MAX_CHARS_PER_SEC * F.col("duration_ms")),
        "repeated_unit": enough & F.col("long_run"),
        "duplicate_neighbour": (F.col("shown") != "") & (F.col("prev_text_same") | F.col("next_text_same")),
    }
    if min_score is not None:
        rules["unsupported"] = F.coalesce(F.col("score") < min_score, F.lit(False))
    return seen.select(
        "media_id", "cue_id", F.array_join(named(rules), ",").alias("flags"), F.lit(True).alias("kept"), "char_count", "unique_chars"
    )


def reject_reason(rules: dict[str, Column]) -> Column:
    """The name of the first rule that holds, null when none does."""
    names = [F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items()]
    return F.coalesce(*names)


def length_mismatch(source: Column, target: Column, low: float = 0.25, high: float = 4.0) -> Column:
    """Whether the target's length is out of proportion to the source's."""
    ratio = F.length(tx.text(target)) / F.greatest(F.length(tx.text(source)), F.lit(1))
    return ~ratio.between(low, high)


def alignment_quality(duration_ms: Column, chars: Column, score: Column, overlap_ms: Column) -> Column:
    """Class of an alignment, first rule first: nonlexical, drop_or_review, partial, boundary, aligned."""
    return (
        F.when(chars == 0, "nonlexical")
        .when(duration_ms < 300, "drop_or_review")
        .when(score < 0.5, "partial")
        .when(overlap_ms > 0, "boundary")
        .otherwise("aligned")
    )


def cacheable_source(text: Column) -> Column:
    """At least three characters, more than one of them distinct."""
    return (F.length(tx.text(text)) >= 3) & (tx.distinct_chars(text) > 1)


def failure_message(error: Column, rules: list[tuple[str, str]], otherwise: str) -> Column:
    """The message of the first rule whose pattern the error text has."""
    out = F.lit(otherwise)
    for pattern, message in reversed(rules):
        out = F.when(tx.text(error).rlike(pattern), message).otherwise(out)
    return out
