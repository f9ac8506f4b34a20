"""Queries for reports: profiles, rankings, rolling use, samples and unions."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuelake.functions import text as tx
from cuelake.operators import sampling, stats
from cuelake.operators import segments as sg
from cuelake.operators import summaries as sm
from cuelake.plans.corpus import LABELLED, labelled
from cuelake.plans.media import KEY
from cuelake.plans.registry import Plans
from cuelake.plans.segments import QUALITY, WORDS
from cuelake.sources.tables import cues, table

P = Plans()


@P.add(
    "length_profile",
    """SELECT source, count(n_chars) AS n, quantile_cont(n_chars, 0.5) AS median, quantile_cont(n_chars, 0.9) AS p90, quantile_cont(n_chars, 0.99) AS p99,
              avg(n_chars) AS mean, max(n_chars) AS max FROM documents GROUP BY source""",
)
def length_profile(spark, sf):
    return sm.describe(table(spark, sf, "documents"), "source", "n_chars")


@P.add(
    "outcome_top5",
    f"""
    , r AS (SELECT {QUALITY} AS quality, cue_id, length({KEY}) AS units FROM cues),
    k AS (SELECT *, row_number() OVER (PARTITION BY quality ORDER BY units DESC, cue_id) AS rank FROM r)
    SELECT quality, cue_id, units, rank FROM k WHERE rank <= 5""",
    over_cues=True,
)
def outcome_top5(spark, sf):
    rows = cues(spark, sf).select(F.expr(QUALITY).alias("quality"), "cue_id", F.length(tx.compact(F.col("src_text"))).cast("long").alias("units"))
    return sm.top_per_group(rows, "quality", "units", "cue_id", 5)


@P.add(
    "outcome_profile",
    f"""
    , r AS (SELECT {QUALITY} AS quality, length({KEY}) AS units, end_ms - start_ms AS d FROM cues)
    SELECT quality, count(*) AS n, max(units) AS most, quantile_cont(units, 0.5) AS median, sum(d)::BIGINT AS ms,
           list_sort(list(units))[least(count(*), floor(count(*) * 0.95)::BIGINT + 1)] AS p95 FROM r GROUP BY quality""",
    over_cues=True,
)
def outcome_profile(spark, sf):
    rows = cues(spark, sf).select(
        F.expr(QUALITY).alias("quality"), F.length(tx.compact(F.col("src_text"))).cast("long").alias("units"), (F.col("end_ms") - F.col("start_ms")).alias("d")
    )
    per = rows.groupBy("quality").agg(
        F.count(F.lit(1)).alias("n"), F.max("units").alias("most"), F.percentile("units", 0.5).alias("median"), F.sum("d").alias("ms")
    )
    return per.join(stats.nearest_rank(rows, "quality", "units", 0.95).withColumnRenamed("units", "p95"), "quality")


@P.add(
    "empty_manifest",
    """SELECT media_id, count(*) AS n, count(*) FILTER (WHERE trim(coalesce(tgt_text, ''), ' ') = '') AS empty,
              round(count(*) FILTER (WHERE trim(coalesce(tgt_text, ''), ' ') = '') / greatest(count(*), 1), 6) AS empty_ratio FROM cues GROUP BY media_id""",
    over_cues=True,
)
def empty_manifest(spark, sf):
    return sm.blank_manifest(cues(spark, sf), "media_id", F.btrim(tx.text(F.col("tgt_text"))))


@P.add("quality_counts", f"SELECT media_id, {QUALITY} AS quality, count(*) AS n FROM cues GROUP BY ALL", over_cues=True)
def quality_counts(spark, sf):
    return cues(spark, sf).groupBy("media_id", F.expr(QUALITY).alias("quality")).agg(F.count(F.lit(1)).alias("n"))


BLANKS = "SELECT label, count(*) FILTER (WHERE value < 0) / count(*) AS blank_rate FROM (SELECT label, unnest(embedding) AS value FROM embeddings) GROUP BY label"


@P.add("blank_margins", f"WITH r AS ({BLANKS}) SELECT label, blank_rate, round((blank_rate - (SELECT blank_rate FROM r WHERE label = 0)) * 100, 6) AS margin_pp FROM r")
def blank_margins(spark, sf):
    frames = table(spark, sf, "embeddings").select("label", F.explode("embedding").alias("value"))
    rates = frames.groupBy("label").agg((F.count_if(F.col("value") < 0) / F.count(F.lit(1))).alias("blank_rate"))
    return sm.rate_margins(rates, "label", "blank_rate", 0)


@P.add(
    "label_totals",
    """SELECT l.label, count(e.vec_id) AS n FROM (SELECT unnest(range(15))::INTEGER AS label) l LEFT JOIN embeddings e ON e.label = l.label GROUP BY l.label""",
)
def label_totals(spark, sf):
    rows = table(spark, sf, "embeddings").select(F.col("label").cast("int").alias("label"))
    return sm.totals_with_zeros(rows, spark.range(15).select(F.col("id").cast("int").alias("label")), "label")


@P.add(
    "threshold_sweep",
    """
    , s AS (SELECT media_id, end_ms - start_ms AS d, unnest([0, 500, 1000, 2000, 4000, 8000]) AS least_ms FROM cues)
    SELECT least_ms, media_id, count(*) FILTER (WHERE d >= least_ms) AS kept, sum(CASE WHEN d >= least_ms THEN d ELSE 0 END)::BIGINT AS kept_ms, sum(d)::BIGINT AS all_ms
    FROM s GROUP BY ALL""",
    over_cues=True,
)
def threshold_sweep(spark, sf):
    return sm.sweep(cues(spark, sf), "media_id", [0, 500, 1000, 2000, 4000, 8000])


@P.add(
    "spans_by_label",
    f"""
    SELECT media_id, start_ms // 600000 AS part, {QUALITY} AS label, string_agg(start_ms || '-' || end_ms, ' ' ORDER BY start_ms, end_ms, cue_id) AS spans, count(*) AS n
    FROM cues WHERE end_ms > start_ms GROUP BY ALL""",
    over_cues=True,
)
def spans_by_label(spark, sf):
    """The valid spans of every ten minutes of a medium by label."""
    item = F.struct("start_ms", "end_ms", "cue_id", F.concat_ws("-", "start_ms", "end_ms").alias("s"))
    rows = cues(spark, sf).where(F.col("end_ms") > F.col("start_ms"))
    listed = rows.groupBy("media_id", F.floor(F.col("start_ms") / 600_000).alias("part"), F.expr(QUALITY).alias("label")).agg(F.array_sort(F.collect_list(item)).alias("l"), F.count(F.lit(1)).alias("n"))
    return listed.select("media_id", "part", "label", F.array_join(F.col("l.s"), " ").alias("spans"), "n")


@P.add(
    "arm_summary",
    """
    WITH a AS (SELECT 'toxic' AS arm, d.* FROM documents d JOIN labels l USING (doc_id) WHERE toxic = 1 UNION ALL SELECT 'plain', d.* FROM documents d JOIN labels l USING (doc_id) WHERE toxic = 0)
    SELECT arm, count(*) AS n, count(*) FILTER (WHERE lang = 'en') / count(*) AS english, sum(n_chars)::BIGINT AS chars, quantile_cont(n_chars, 0.1) AS p10,
           quantile_cont(n_chars, 0.5) AS p50, quantile_cont(n_chars, 0.9) AS p90 FROM a GROUP BY arm""",
)
def arm_summary(spark, sf):
    rows = labelled(spark, sf)
    arms = sm.tagged_union(toxic=rows.where("toxic = 1"), plain=rows.where("toxic = 0"))
    q = arms.groupBy("arm").agg(
        F.count(F.lit(1)).alias("n"), (F.count_if(F.col("lang") == "en") / F.count(F.lit(1))).alias("english"), F.sum("n_chars").alias("chars"),
        F.percentile("n_chars", [0.1, 0.5, 0.9]).alias("q"),
    )
    return q.select("arm", "n", "english", "chars", *(F.col("q")[i].alias(c) for i, c in enumerate(("p10", "p50", "p90"))))


@P.add("char_histogram", "SELECT lang, char, count(*) AS n FROM (SELECT lang, unnest(string_split(text, '')) AS char FROM documents) WHERE char <> '' GROUP BY ALL")
def char_histogram(spark, sf):
    chars = table(spark, sf, "documents").select("lang", F.explode(F.split("text", "")).alias("char"))
    return chars.where("char <> ''").groupBy("lang", "char").agg(F.count(F.lit(1)).alias("n"))


@P.add(
    "stratum_profile",
    f"""SELECT lang, source, count(*) AS items, count(DISTINCT n_chars) AS lengths, count(*) FILTER (WHERE quality = 1) AS positives, sum(n_chars)::BIGINT AS chars
        FROM ({LABELLED}) GROUP BY lang, source""",
)
def stratum_profile(spark, sf):
    return labelled(spark, sf).groupBy("lang", "source").agg(
        F.count(F.lit(1)).alias("items"), F.countDistinct("n_chars").alias("lengths"), F.count_if(F.col("quality") == 1).alias("positives"), F.sum("n_chars").alias("chars")
    )


@P.add(
    "label_minutes",
    f"SELECT media_id || '|' || {QUALITY} AS name, sum(end_ms - start_ms) / 60000.0::DOUBLE AS minutes FROM cues WHERE tgt_text <> '' GROUP BY 1",
    over_cues=True,
)
def label_minutes(spark, sf):
    """Minutes by medium and label of the cues with a translation."""
    rows = cues(spark, sf).where("tgt_text <> ''").groupBy(F.concat_ws("|", "media_id", F.expr(QUALITY)).alias("name"))
    return rows.agg((F.sum(F.col("end_ms") - F.col("start_ms")) / 60000.0).alias("minutes"))


@P.add(
    "stage_timings",
    """
    WITH u AS (SELECT user_id, sum(event_id % 100)::BIGINT AS total, sum(CASE WHEN event_type = 'click' THEN event_id % 100 END)::BIGINT AS click,
                      sum(CASE WHEN event_type = 'view' THEN event_id % 100 END)::BIGINT AS view FROM events GROUP BY user_id),
    r AS (SELECT user_id, 0 AS pos, 'click' AS stage, click AS value FROM u UNION ALL SELECT user_id, 1, 'view', view FROM u
          UNION ALL SELECT user_id, 2, 'other', total - click - view FROM u WHERE total - click - view >= 5)
    SELECT * FROM r WHERE value IS NOT NULL""",
)
def stage_timings(spark, sf):
    cost = F.col("event_id") % 100
    of = lambda kind: F.sum(F.when(F.col("event_type") == kind, cost)).alias(kind)
    per = table(spark, sf, "events").groupBy("user_id").agg(F.sum(cost).alias("total"), of("click"), of("view"))
    return sm.stage_rows(per, "user_id", "total", ["click", "view"], 5)


@P.add(
    "peak_readings",
    "SELECT vec_id, list_max(list_filter(embedding, lambda x: x > 0)) AS peak, len(list_filter(embedding, lambda x: x > 0)) AS readings FROM embeddings",
)
def peak_readings(spark, sf):
    """The largest valid reading of an array; null when there is none."""
    valid = F.filter("embedding", lambda x: x > 0)
    return table(spark, sf, "embeddings").select("vec_id", F.array_max(valid).alias("peak"), F.size(valid).cast("long").alias("readings"))


SECONDS = "epoch_us(ts) // 1000000"


@P.add(
    "key_use",
    f"""
    WITH v AS (SELECT user_id, event_id, {SECONDS} AS at_s, event_id % 50 AS units FROM events),
    m AS (SELECT *, count(*) OVER d AS in_day, sum(units) OVER d AS units_in_day, count(*) OVER m AS in_minute, min(at_s) OVER m AS oldest FROM v
          WINDOW m AS (PARTITION BY user_id ORDER BY at_s RANGE BETWEEN 59 PRECEDING AND CURRENT ROW), d AS (PARTITION BY user_id ORDER BY at_s RANGE BETWEEN 86399 PRECEDING AND CURRENT ROW))
    SELECT user_id, event_id, in_minute, in_day, units_in_day::BIGINT AS units_in_day, greatest(0, 2 - in_minute) AS minute_left, greatest(0, 20 - in_day) AS day_left,
           CASE WHEN in_minute >= 2 THEN oldest + 60 ELSE at_s END AS ready_s FROM m""",
)
def key_use(spark, sf):
    rows = table(spark, sf, "events").select(
        "user_id", "event_id", F.expr("unix_micros(cast(ts as timestamp)) div 1000000L").alias("at_s"), (F.col("event_id") % 50).alias("units")
    )
    return sm.rolling_use(rows, "user_id", "at_s", "units", 2, 20)


@P.add(
    "daily_quota",
    f"""
    WITH d AS (SELECT user_id, {SECONDS} // 86400 AS day, count(*) AS used FROM events GROUP BY ALL),
    l AS (SELECT user_id, max(day) AS day, arg_max(used, day) AS used FROM d GROUP BY user_id)
    SELECT user_id, used, greatest(0, 12 - used) AS remaining, sum(greatest(0, 12 - used)) OVER ()::BIGINT AS all_remaining FROM l""",
)
def daily_quota(spark, sf):
    """Per key what its last day leaves, and the sum over all keys (one number, joined back)."""
    day = F.expr("unix_micros(cast(ts as timestamp)) div 86400000000L").alias("day")
    used = table(spark, sf, "events").groupBy("user_id", day).agg(F.count(F.lit(1)).alias("used"))
    last = used.groupBy("user_id").agg(F.max_by("used", "day").alias("used")).withColumn("remaining", F.greatest(F.lit(0), 12 - F.col("used")))
    total = last.agg(F.sum("remaining").alias("all_remaining")).withColumn("one", F.lit(1))
    return last.withColumn("one", F.lit(1)).join(F.broadcast(total), "one").drop("one")  # one row


@P.add(
    "loud_frames",
    """
    WITH f AS (SELECT vec_id, abs(unnest(embedding)) AS level, generate_subscripts(embedding, 1) - 1 AS frame FROM embeddings),
    p AS (SELECT *, max(level) OVER (PARTITION BY vec_id) AS peak FROM f)
    SELECT vec_id, min(frame) FILTER (WHERE level >= greatest(peak * pow(10, -6.0 / 20), pow(10, -55.0 / 20))) AS frame FROM p GROUP BY vec_id""",
)
def loud_frames(spark, sf):
    frames = table(spark, sf, "embeddings").select("vec_id", F.posexplode("embedding").alias("frame", "value"))
    return sm.first_loud(frames.select("vec_id", F.col("frame").cast("long").alias("frame"), F.abs("value").alias("level")), "vec_id", "level", 6.0)


@P.add(
    "fastest_cues",
    f"SELECT cue_id, media_id, start_ms, length({KEY}) * 100000 // greatest(end_ms - start_ms, 1) AS rate FROM cues ORDER BY rate DESC, start_ms, cue_id LIMIT 20",
    over_cues=True,
)
def fastest_cues(spark, sf):
    rate = F.floor(F.length(tx.compact(F.col("src_text"))) * 100000 / F.greatest(F.col("end_ms") - F.col("start_ms"), F.lit(1)))
    return cues(spark, sf).select("cue_id", "media_id", "start_ms", rate.alias("rate")).orderBy(F.desc("rate"), "start_ms", "cue_id").limit(20)


@P.add(
    "worst_cues",
    """
    , d AS (SELECT cue_id, levenshtein(regexp_replace(coalesce(src_text, ''), '[^A-Za-z]', '', 'g'), regexp_replace(coalesce(tgt_text, ''), '[^A-Za-z]', '', 'g')) AS distance,
                   greatest(length(regexp_replace(coalesce(src_text, ''), '[^A-Za-z]', '', 'g')), 1) AS n FROM cues)
    SELECT cue_id, distance::INTEGER AS distance, distance / n AS rate FROM d ORDER BY rate DESC, distance DESC, cue_id LIMIT 25""",
    over_cues=True,
)
def worst_cues(spark, sf):
    a, b = (F.regexp_replace(tx.text(F.col(c)), "[^A-Za-z]", "") for c in ("src_text", "tgt_text"))
    d = cues(spark, sf).select("cue_id", F.levenshtein(a, b).alias("distance"), F.greatest(F.length(a), F.lit(1)).alias("n"))
    return d.select("cue_id", "distance", (F.col("distance") / F.col("n")).alias("rate")).orderBy(F.desc("rate"), F.desc("distance"), "cue_id").limit(25)


@P.add(
    "top_spots_in_order",
    """
    , t AS (SELECT cue_id, media_id, start_ms, abs(length(coalesce(src_text, '')) - length(coalesce(tgt_text, ''))) AS score FROM cues),
    k AS (SELECT * FROM t ORDER BY score DESC, cue_id LIMIT 180)
    SELECT row_number() OVER (ORDER BY start_ms, cue_id) AS place, * FROM k""",
    over_cues=True,
)
def top_spots_in_order(spark, sf):
    """The 180 largest differences, then in order of time."""
    from pyspark.sql import Window

    score = F.abs(F.length(tx.text(F.col("src_text"))) - F.length(tx.text(F.col("tgt_text")))).cast("long")
    top = cues(spark, sf).select("cue_id", "media_id", "start_ms", score.alias("score")).orderBy(F.desc("score"), "cue_id").limit(180)
    return top.select(F.row_number().over(Window.orderBy("start_ms", "cue_id")).cast("long").alias("place"), "*")


@P.add(
    "one_per_source",
    """
    WITH f AS (SELECT source, min((md5('s7:' || doc_id), doc_id))[2] AS doc_id FROM documents GROUP BY source)
    SELECT source, doc_id FROM f ORDER BY md5('s7:' || source), source LIMIT 12""",
)
def one_per_source(spark, sf):
    return sm.one_per_group(table(spark, sf, "documents").where("source is not null"), "source", "doc_id", "s7", 12)


@P.add(
    "finished_jobs",
    f"""
    WITH j AS (SELECT user_id, max({SECONDS}) AS last_s, min({SECONDS}) AS first_s, arg_max(event_type, (ts, event_id)) AS state FROM events GROUP BY user_id),
    n AS (SELECT max(last_s) AS now_s FROM j)
    SELECT user_id, state, first_s FROM j, n WHERE state = 'purchase' AND last_s >= now_s - 172800 ORDER BY first_s, user_id""",
)
def finished_jobs(spark, sf):
    """Finished jobs by their first event; those that ended 48 hours before the last event are gone."""
    s = F.expr("unix_micros(cast(ts as timestamp)) div 1000000L")
    jobs = table(spark, sf, "events").groupBy("user_id").agg(
        F.max(s).alias("last_s"), F.min(s).alias("first_s"), F.max_by("event_type", F.struct("ts", "event_id")).alias("state")
    )
    now = table(spark, sf, "events").agg(F.max(s).alias("now_s")).withColumn("one", F.lit(1))
    met = jobs.where("state = 'purchase'").withColumn("one", F.lit(1)).join(F.broadcast(now), "one")  # one row
    return met.where("last_s >= now_s - 172800").select("user_id", "state", "first_s")


@P.add(
    "distinct_marks",
    """SELECT doc_id, list_filter([coalesce(lang, ''), coalesce(source, ''), CASE WHEN doc_id % 2 = 0 THEN lang ELSE 'x' END, ''], lambda x, i: x IS NOT NULL AND x <> '' AND
              list_position([coalesce(lang, ''), coalesce(source, ''), CASE WHEN doc_id % 2 = 0 THEN lang ELSE 'x' END, ''], x) = i) AS marks FROM documents""",
)
def distinct_marks(spark, sf):
    items = F.array(tx.text(F.col("lang")), tx.text(F.col("source")), F.when(F.col("doc_id") % 2 == 0, F.col("lang")).otherwise("x"), F.lit(""))
    return table(spark, sf, "documents").select("doc_id", sm.distinct_in_order(items).alias("marks"))


@P.add(
    "seeded_subset",
    """
    WITH p AS (SELECT d.doc_id, lang, quality FROM documents d JOIN labels l USING (doc_id) WHERE lang IN ('en', 'fr') AND quality = 1)
    SELECT * FROM p ORDER BY md5('s9:' || doc_id), doc_id LIMIT 30""",
)
def seeded_subset(spark, sf):
    """Members of a partition with one provenance, the first thirty in seeded order (a sample)."""
    rows = labelled(spark, sf).where(F.col("lang").isin("en", "fr") & (F.col("quality") == 1)).select("doc_id", "lang", "quality")
    return rows.orderBy(sampling.draw("s9", F.col("doc_id")), "doc_id").limit(30)


@P.add(
    "line_summary",
    WORDS + """, l AS (SELECT media_id, cue_id, count(*) AS n, sum(end_ms - start_ms)::BIGINT AS ms FROM words GROUP BY ALL)
    SELECT media_id, count(*) AS lines, quantile_cont(n, 0.5) AS median_words, quantile_cont(ms, 0.5) AS median_ms, sum(n) * 1000.0::DOUBLE / greatest(sum(ms), 1) AS words_per_s
    FROM l GROUP BY media_id""",
    over_cues=True,
)
def line_summary(spark, sf):
    lines = sg.words(cues(spark, sf)).groupBy("media_id", "cue_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("end_ms") - F.col("start_ms")).alias("ms"))
    return lines.groupBy("media_id").agg(
        F.count(F.lit(1)).alias("lines"), F.percentile("n", 0.5).alias("median_words"), F.percentile("ms", 0.5).alias("median_ms"),
        (F.sum("n") * 1000.0 / F.greatest(F.sum("ms"), F.lit(1))).alias("words_per_s"),
    )


@P.add(
    "frame_units",
    "SELECT cue_id, start_ms * 50 // 1000 AS frame, (start_ms * 50 // 1000) * 20 AS frame_ms, ((end_ms - start_ms) * 16 + 319) // 320 AS frames FROM cues",
    over_cues=True,
)
def frame_units(spark, sf):
    """Frames of 20 ms: that of the start, its time, and how many a span needs at 16 samples a millisecond."""
    frame = F.expr("start_ms * 50 div 1000")
    return cues(spark, sf).select("cue_id", frame.alias("frame"), (frame * 20).alias("frame_ms"), F.expr("((end_ms - start_ms) * 16 + 319) div 320").alias("frames"))


@P.add(
    "skip_summary",
    """
    WITH r AS (SELECT n_chars, CASE WHEN text IS NULL OR trim(text, ' ') = '' THEN 'missing_text' WHEN length(text) < 200 THEN 'too_short' WHEN length(text) > 10000 THEN 'too_long' END AS reason FROM documents)
    SELECT coalesce(reason, 'kept') AS reason, count(*) AS n, avg(n_chars) AS mean_chars, count(*) / (SELECT count(*) FROM documents) AS share FROM r GROUP BY 1""",
)
def skip_summary(spark, sf):
    n = F.length(tx.text(F.col("text")))
    reason = F.when(F.btrim(tx.text(F.col("text"))) == "", "missing_text").when(n < 200, "too_short").when(n > 10000, "too_long").otherwise("kept")
    per = table(spark, sf, "documents").groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"), F.avg("n_chars").alias("mean_chars"))
    total = per.agg(F.sum("n").alias("all")).withColumn("one", F.lit(1))
    met = per.withColumn("one", F.lit(1)).join(F.broadcast(total), "one")  # one row
    return met.select("reason", "n", "mean_chars", (F.col("n") / F.col("all")).alias("share"))
