"""Quality reports per medium: one row of metrics with the warnings they raise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuelake.functions import normal as nf
from cuelake.functions import text as tx
from cuelake.operators.intervals import overlap_pairs
from cuelake.operators.windows import GAP_MS, MAX_DISPLAY_MS, MIN_DISPLAY_MS, by_media

# The limits above (below: hits) which a metric is a warning.
LIMITS = {"empty_ratio": 0.02, "repetition_ratio": 0.05, "short_ratio": 0.15, "per_min_count": 8.0}


def share(condition: Column) -> Column:
    """Share of rows for which a condition holds."""
    return F.count_if(condition) / F.count(F.lit(1))


def duration_stats(cues: DataFrame, key: str = "media_id") -> DataFrame:
    """Exact quantiles of the duration in ms, and counts under 0.8 s and 0.5 s and over 5 s."""
    d = F.greatest(F.lit(0), F.col("end_ms") - F.col("start_ms"))
    q = cues.groupBy(key).agg(
        F.percentile(d, [0.5, 0.9, 0.95]).alias("q"),
        F.max(d).alias("max_ms"),
        F.count_if(d < 800).alias("short_count"),
        F.count_if(d < 500).alias("micro_count"),
        F.count_if(d > 5000).alias("long_count"),
    )
    return q.select(
        key, *(F.col("q")[i].alias(n) for i, n in enumerate(("p50_ms", "p90_ms", "p95_ms"))),
        "max_ms", "short_count", "micro_count", "long_count",
    )


def overlap_stats(cues: DataFrame) -> DataFrame:
    """Count, sum and maximum of positive overlaps of neighbours in canonical order."""
    o = cues.select("media_id", (F.lag("end_ms").over(by_media()) - F.col("start_ms")).alias("o"))
    pos = F.when(F.col("o") > 0, F.col("o"))
    return o.groupBy("media_id").agg(
        F.count(pos).alias("overlap_count"),
        F.coalesce(F.sum(pos), F.lit(0)).alias("overlap_total_ms"),
        F.coalesce(F.max(pos), F.lit(0)).alias("overlap_max_ms"),
    )


def spec_compliance(cues: DataFrame, text_col: str = "tgt_text", line_units: int = 1600, max_cps: int = 9) -> DataFrame:
    """Counts of cues outside the display rules: duration, reading rate, line width, signs, gaps under two frames."""
    t = tx.clean(F.col(text_col))
    d = F.greatest(F.lit(0), F.col("end_ms") - F.col("start_ms"))
    gap = F.lead("start_ms").over(by_media()) - F.col("end_ms")
    rows = cues.select(
        "media_id",
        d.alias("d"),
        tx.display_units(F.replace(t, F.lit(" "), F.lit(""))).alias("units"),
        tx.display_units(t).alias("line"),
        tx.banned_punctuation(t).alias("banned"),
        gap.alias("gap"),
    )
    return rows.groupBy("media_id").agg(
        F.count_if(F.col("line") > 2 * line_units).alias("over_two_lines_count"),
        F.sum("banned").alias("banned_count"),
        F.count_if(F.col("units") * 10 > max_cps * F.greatest(F.col("d"), F.lit(1))).alias("cps_over_count"),
        F.count_if(F.col("d") > MAX_DISPLAY_MS).alias("duration_over_count"),
        F.count_if(F.col("d") < MIN_DISPLAY_MS).alias("duration_under_count"),
        F.count_if(F.col("gap").between(0, GAP_MS - 1)).alias("gap_under_count"),
    )


def report(cues: DataFrame) -> DataFrame:
    """One row per medium: ratios, rate per minute, overlap count, and warnings over the limits."""
    w = by_media()
    tgt = F.btrim(tx.text(F.col("tgt_text")))
    rows = cues.select(
        "media_id",
        "start_ms",
        "end_ms",
        tgt.alias("tgt"),
        F.lag(tgt).over(w).alias("prev"),
        (F.lag("end_ms").over(w) - F.col("start_ms")).alias("o"),
    )
    d = F.col("end_ms") - F.col("start_ms")
    agg = rows.groupBy("media_id").agg(
        F.count(F.lit(1)).alias("n_cues"),
        share(F.col("tgt") == "").alias("empty_ratio"),
        share((F.col("tgt") != "") & (F.col("tgt") == F.col("prev"))).alias("repetition_ratio"),
        share(d < 800).alias("short_ratio"),
        (F.max("end_ms") - F.min("start_ms")).alias("span_ms"),
        F.count_if(F.col("o") > 0).alias("overlap_count"),
    )
    agg = agg.withColumn("per_min_count", F.col("n_cues") * 60000.0 / F.greatest(F.col("span_ms"), F.lit(60)))
    warn = [F.when(F.col(m) > limit, F.lit(m)) for m, limit in LIMITS.items()]
    warn.append(F.when(F.col("overlap_count") > 0, F.lit("overlap_count")))
    return agg.withColumn("warnings", F.concat_ws(",", *warn))


def density(cues: DataFrame, text_col: str = "src_text", cps: int = 4) -> DataFrame:
    """Reading rates in units (times 100) per second: quantiles, maximum, and the share over a limit."""
    units = F.length(tx.compact(F.col(text_col)))
    rate = units * 100000.0 / F.greatest(F.col("end_ms") - F.col("start_ms"), F.lit(1))
    rows = cues.select("media_id", rate.alias("rate"))
    q = rows.groupBy("media_id").agg(
        F.percentile("rate", [0.9, 0.95]).alias("q"), F.max("rate").alias("max_rate"), share(F.col("rate") > cps * 100.0).alias("over_ratio")
    )
    return q.select("media_id", F.col("q")[0].alias("p90_rate"), F.col("q")[1].alias("p95_rate"), "max_rate", "over_ratio")


def density_windows(cues: DataFrame, window_ms: int = 10_000) -> DataFrame:
    """Per medium, over windows that begin with each cue: most cues, most active time, least and median gap.

    A gap is the time from a member's end to the next member's start, at least 0.
    The median is that of the windows' medians.
    """
    anchors = cues.select("media_id", F.col("cue_id").alias("anchor"), "start_ms", (F.col("start_ms") + window_ms).alias("end_ms"))
    met = overlap_pairs(anchors, cues, "media_id", "anchor", "cue_id", times=True)
    w = Window.partitionBy("media_id", "a_id").orderBy("b_start", "b_end", "b_id")
    gap = F.lead("b_start").over(w) - F.col("b_end")
    met = met.withColumn("gap", F.when(gap.isNotNull(), F.greatest(F.lit(0), gap)))
    per = met.groupBy("media_id", "a_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("overlap_ms").alias("active"), F.min("gap").alias("least"), F.percentile("gap", 0.5).alias("mid")
    )
    return per.groupBy("media_id").agg(
        F.max("n").alias("max_count"),
        F.max("active").alias("max_active_ms"),
        F.min("least").alias("min_gap_ms"),
        F.percentile("mid", 0.5).alias("median_gap_ms"),
    )


def tumbling(cues: DataFrame, window_ms: int = 30_000) -> DataFrame:
    """(media_id, window, n_cues, n_chars): fixed windows and the cues that touch them."""
    last = F.floor((F.greatest("end_ms", F.col("start_ms") + 1) - 1) / window_ms)
    spread = cues.withColumn("window", F.explode(F.sequence(F.floor(F.col("start_ms") / window_ms), last)))
    return spread.groupBy("media_id", "window").agg(
        F.count(F.lit(1)).alias("n_cues"), F.sum(F.length(tx.text(F.col("tgt_text")))).alias("n_chars")
    )


def hotspots(old: DataFrame, new: DataFrame, window_ms: int = 30_000) -> DataFrame:
    """Windows in which two versions differ: counts and characters of both, and a score."""
    names = ["media_id", "window"]
    a = tumbling(old, window_ms).withColumnsRenamed({"n_cues": "old_cues", "n_chars": "old_chars"})
    b = tumbling(new, window_ms).withColumnsRenamed({"n_cues": "new_cues", "n_chars": "new_chars"})
    both = a.join(b, names, "full").na.fill(0, ["old_cues", "old_chars", "new_cues", "new_chars"])
    score = F.abs(F.col("new_cues") - F.col("old_cues")) * 10 + F.abs(F.col("new_chars") - F.col("old_chars"))
    return both.withColumn("score", score).where("score > 0")


def glossary_hits(cues: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """(term, checks, hits): cues whose source has the term, and of these those whose target has its counterpart.

    The glossary is a short list of literals: every cue keeps the pairs it holds, no join is needed.
    """
    known = F.array(*(F.struct(F.lit(a).alias("source"), F.lit(b).alias("target")) for a, b in pairs if a and b))
    held = F.filter(known, lambda p: F.contains(tx.text(F.col("src_text")), p["source"]))
    met = cues.select(F.explode(held).alias("p"), tx.text(F.col("tgt_text")).alias("tgt"))
    return met.groupBy(F.col("p.source").alias("term")).agg(
        F.count(F.lit(1)).alias("checks"), F.count_if(F.contains("tgt", F.col("p.target"))).alias("hits")
    )


# Fixed value: kana, spaces and the signs that go with them.
KANA_ONLY = r"^[ぁ-ゟァ-ヿ\s、。！？…ー～「」『』・()（）]+$"


def full_report(cues: DataFrame, pairs: list[tuple[str, str]], short_ms: int = 800) -> DataFrame:
    """One row per medium: shares of empty, repeated (in list order), kana-only and short cues, cues a minute, glossary hits.

    A cue is kana-only when it has no target or a source of nothing else.  The hit rate is
    null when no term occurs.  The glossary is a short list of literals.
    """
    source, target = tx.text(F.col("src_text")), F.btrim(tx.text(F.col("tgt_text")))
    known = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in pairs if a and b))
    held = F.filter(known, lambda p: F.contains(source, p["a"]))
    before = F.lag(target).over(Window.partitionBy("media_id").orderBy("cue_id"))
    rows = cues.select(
        "media_id", "start_ms", "end_ms", target.alias("target"), before.alias("before"),
        F.regexp_like(F.btrim(source), F.lit(KANA_ONLY)).alias("kana"), F.size(held).alias("checks"),
        F.size(F.filter(held, lambda p: F.contains(tx.text(F.col("tgt_text")), p["b"]))).alias("hits"),
    )
    empty = F.col("target") == ""
    span = F.greatest(F.max("end_ms") - F.min("start_ms"), F.lit(60))
    return rows.groupBy("media_id").agg(
        F.count(F.lit(1)).alias("n_cues"), share(empty).alias("empty_ratio"),
        share((F.col("target") != "") & (F.col("target") == F.col("before"))).alias("repetition_ratio"), share(empty | F.col("kana")).alias("kana_only_ratio"),
        share(F.col("end_ms") - F.col("start_ms") < short_ms).alias("short_ratio"), (F.count(F.lit(1)) * 60000.0 / span).alias("per_min_count"),
        (F.sum("hits") / F.nullif(F.sum("checks"), F.lit(0))).alias("glossary_hit_rate"),
    )


def overlap_examples(cues: DataFrame, most: int = 20) -> DataFrame:
    """The first ``most`` overlaps of neighbours in every medium, with the times of both."""
    w = by_media()
    rows = cues.select(
        "media_id", "cue_id", F.lag("start_ms").over(w).alias("previous_start"), F.lag("end_ms").over(w).alias("previous_end"), "start_ms", "end_ms",
        (F.lag("end_ms").over(w) - F.col("start_ms")).alias("overlap_ms"),
    ).where("overlap_ms > 0")
    place = F.row_number().over(Window.partitionBy("media_id").orderBy("start_ms", "end_ms", "cue_id")).cast("long")
    return rows.withColumn("place", place).where(F.col("place") <= most)


def rate_extremes(cues: DataFrame, text_col: str = "tgt_text") -> DataFrame:
    """Per medium: the largest display units a second (times 100), signs banned in raw and in display form, and cues under two frames apart."""
    shown = nf.display_text(F.col(text_col))
    d = F.greatest(F.lit(1), F.col("end_ms") - F.col("start_ms"))
    gap = F.lead("start_ms").over(by_media()) - F.col("end_ms")
    rows = cues.select(
        "media_id", (tx.display_units(F.translate(shown, " \n", "")) * 1000.0 / d).alias("rate"), tx.banned_punctuation(F.col(text_col)).alias("raw"),
        tx.banned_punctuation(shown).alias("banned"), gap.between(0, GAP_MS - 1).alias("near"),
    )
    return rows.groupBy("media_id").agg(
        F.max("rate").alias("max_rate"), F.sum("raw").alias("raw_banned"), F.sum("banned").alias("banned"), F.count_if("near").alias("near_count")
    )
