"""Words, segments and the chunks they come from: joins that carry marks from one to the other.

A segment's members meet in one group; a segment is a few seconds of one medium.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuelake.functions import text as tx
from cuelake.operators.windows import by_media

BAD = ("drop_or_review", "partial")
OUTLIER_GAPS = 4  # a first or last word further off than so many median gaps is pulled in


def words(cues: DataFrame, text_col: str = "src_text") -> DataFrame:
    """(media_id, cue_id, k, word, start_ms, end_ms): the words of every cue in equal slices of its time."""
    shown = tx.clean(F.col(text_col))
    parts = cues.where(shown != "").select(
        "media_id", "cue_id", "start_ms", (F.col("end_ms") - F.col("start_ms")).alias("d"), F.split(shown, " ").alias("parts")
    )
    spread = parts.select("media_id", "cue_id", "start_ms", "d", F.size("parts").alias("n"), F.posexplode("parts").alias("k", "word"))
    at = lambda k: F.col("start_ms") + F.floor(F.col("d") * k / F.col("n"))
    return spread.select("media_id", "cue_id", "k", "word", at(F.col("k")).alias("start_ms"), at(F.col("k") + 1).alias("end_ms"))


def timing_stats(words: DataFrame, *keys: str, tiny_ms: int = 80) -> DataFrame:
    """Per key: words, those without length, tiny ones, shortest and longest."""
    d = F.col("end_ms") - F.col("start_ms")
    return words.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("word_count"), F.count_if(d <= 0).alias("no_length"), F.count_if(d <= tiny_ms).alias("tiny"),
        F.min(d).alias("min_ms"), F.max(d).alias("max_ms"),
    )


def valid_words(words: DataFrame) -> DataFrame:
    """Words that are not blank and end after they begin."""
    return words.where((F.btrim("word") != "") & (F.col("end_ms") > F.col("start_ms")))


def members(words: DataFrame, segment_ms: int) -> DataFrame:
    """(media_id, segment, cue_id, first_ms): the cues each segment of time takes words from, by their first word there."""
    segment = F.floor(F.col("start_ms") / segment_ms).alias("segment")
    return words.groupBy("media_id", segment, "cue_id").agg(F.min("start_ms").alias("first_ms"))


def segment_flags(members: DataFrame, flags: DataFrame) -> DataFrame:
    """(media_id, segment, flags): the distinct flags of a segment's members in order of their first place.

    ``flags``: (cue_id, flags), an array.
    """
    met = members.join(flags, "cue_id").select("media_id", "segment", "first_ms", "cue_id", F.posexplode("flags").alias("pos", "flag"))
    first = met.groupBy("media_id", "segment", "flag").agg(F.min(F.struct("first_ms", "cue_id", "pos")).alias("at"))
    listed = first.groupBy("media_id", "segment").agg(F.array_sort(F.collect_list(F.struct("at", "flag"))).alias("l"))
    met = members.select("media_id", "segment").distinct().join(listed, ["media_id", "segment"], "left")
    return met.select("media_id", "segment", F.coalesce(F.array_join(F.col("l.flag"), ","), F.lit("")).alias("flags"))


def segment_outcomes(members: DataFrame, outcomes: DataFrame) -> DataFrame:
    """(media_id, segment, quality, source, n): the first bad member's outcome, else the first member's.

    ``outcomes``: (cue_id, quality).  One aggregate picks it, without a window.
    """
    met = members.join(outcomes, "cue_id")
    order = F.struct((~F.col("quality").isin(*BAD)).alias("good"), "first_ms", "cue_id")
    picked = met.groupBy("media_id", "segment").agg(F.min_by(F.struct("quality", "cue_id"), order).alias("p"), F.count(F.lit(1)).alias("n"))
    return picked.select("media_id", "segment", F.col("p.quality").alias("quality"), F.col("p.cue_id").alias("source"), "n")


def segment_extent(members: DataFrame, cues: DataFrame) -> DataFrame:
    """(media_id, segment, start_ms, end_ms): the time that a segment's source cues cover."""
    met = members.join(cues.select("cue_id", "start_ms", "end_ms"), "cue_id")
    return met.groupBy("media_id", "segment").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"))


def transcript_chunks(chunks: DataFrame, results: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Chunks with the result of their place and the outcome of their place, if there is one; no chunk is lost."""
    return chunks.join(results, ["media_id", "pos"], "left").join(outcomes, ["media_id", "pos"], "left")


def relabelled(spans: DataFrame, targets: DataFrame, expected: str) -> DataFrame:
    """``spans`` (media_id, start_ms, end_ms, label) with ``was`` and the new label where a target has its exact times.

    Only spans with the expected label change.
    """
    key = ["media_id", "start_ms", "end_ms"]
    met = spans.join(targets.select(*key, F.col("label").alias("new")), key, "left")
    change = F.col("new").isNotNull() & (F.col("label") == expected)
    return met.select(*key, F.col("label").alias("was"), F.when(change, F.col("new")).otherwise(F.col("label")).alias("label"))


def without_target(spans: DataFrame, targets: DataFrame, expected: str) -> DataFrame:
    """Targets that no span of the expected label has; must be empty before labels are replaced."""
    return targets.join(spans.where(F.col("label") == expected), ["media_id", "start_ms", "end_ms"], "left_anti")


def robust_bounds(words: DataFrame, *keys: str) -> DataFrame:
    """(keys, start_ms, end_ms, trimmed): a group's extent; a first or last word dragged away is pulled back.

    Fewer than three words, or no median gap, leave the extent as it is.
    """
    w = Window.partitionBy(*keys).orderBy("start_ms", "end_ms", "k")
    gaps = words.select(
        *keys, "start_ms", "end_ms", (F.lead("start_ms").over(w) - F.col("start_ms")).alias("gap"),
        F.row_number().over(w).alias("rn"), F.lag("end_ms").over(w).alias("prev_end"), F.lead("start_ms").over(w).alias("next_start"),
    )
    order = F.struct("rn")
    per = gaps.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.percentile("gap", 0.5).alias("mid"), F.min_by("start_ms", order).alias("s0"),
        F.min_by("next_start", order).alias("s1"), F.max_by("end_ms", order).alias("e0"), F.max_by("prev_end", order).alias("e1"),
    )
    usable = (F.col("n") >= 3) & (F.col("mid") > 0)
    early = usable & (F.col("s1") - F.col("s0") > OUTLIER_GAPS * F.col("mid"))
    late = usable & (F.col("e0") - F.col("e1") > OUTLIER_GAPS * F.col("mid"))
    start = F.when(early, F.col("s1") - F.col("mid")).otherwise(F.col("s0").cast("double"))
    end = F.when(late, F.col("e1") + F.col("mid")).otherwise(F.col("e0").cast("double"))
    return per.select(*keys, start.alias("start_ms"), F.greatest(start, end).alias("end_ms"), (early | late).alias("trimmed"))


def block_window(cues: DataFrame, words: DataFrame) -> DataFrame:
    """(cue_id, start_ms, end_ms): a cue's window, begun no later than its first measured word (one with a length)."""
    anchor = valid_words(words).groupBy("cue_id").agg(F.min("start_ms").alias("anchor"))
    start = F.least("start_ms", "anchor")  # a null anchor does not count
    return cues.join(anchor, "cue_id", "left").select("cue_id", start.alias("start_ms"), F.greatest(start, F.col("end_ms")).alias("end_ms"))


def with_defaults(cues: DataFrame) -> DataFrame:
    """Acoustic and display times with their defaults, ends not before starts, and both durations."""
    s, e = F.coalesce("start_ms", F.lit(0)), F.greatest(F.coalesce("end_ms", "start_ms", F.lit(0)), F.coalesce("start_ms", F.lit(0)))
    a0, d0 = F.coalesce("acoustic_start_ms", s), F.coalesce("display_start_ms", s)
    a1, d1 = F.greatest(a0, F.coalesce("acoustic_end_ms", e)), F.greatest(d0, F.coalesce("display_end_ms", e))
    return cues.select(
        "media_id", "cue_id", a0.alias("acoustic_start_ms"), a1.alias("acoustic_end_ms"), (a1 - a0).alias("acoustic_ms"),
        d0.alias("display_start_ms"), d1.alias("display_end_ms"), (d1 - d0).alias("display_ms"),
    )


def numbered(cues: DataFrame) -> DataFrame:
    """``pos`` from 0 in order of time within a medium, ties by id."""
    return cues.withColumn("pos", F.row_number().over(by_media()).cast("long") - 1)


def repeats_in_order(rows: DataFrame, key: str, order: str, text: Column) -> DataFrame:
    """(key, n, repeats): texts that equal the one before them in list order, blanks apart."""
    before = F.lag(text).over(Window.partitionBy(key).orderBy(order))
    marked = rows.select(key, ((text != "") & (text == before)).alias("again"))
    return marked.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.count_if("again").alias("repeats"))


def first_pairs(*sources: DataFrame) -> DataFrame:
    """(source, target, origin, pos): the first occurrence of every pair, sources in the given order."""
    tagged = [s.select("source", "target", F.lit(k).alias("origin"), "pos") for k, s in enumerate(sources)]
    union = tagged[0]
    for t in tagged[1:]:
        union = union.unionByName(t)
    first = union.groupBy("source", "target").agg(F.min(F.struct("origin", "pos")).alias("at"))
    return first.select("source", "target", "at.origin", "at.pos")
