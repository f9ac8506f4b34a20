"""Queries that join words, segments and chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuelake.functions import normal as nf
from cuelake.functions import text as tx
from cuelake.operators import segments as sg
from cuelake.plans.media import W, _clean
from cuelake.plans.registry import Plans
from cuelake.plans.texts import _one_line, _stripped
from cuelake.sources.tables import cues, table

P = Plans()
SEGMENT_MS = 10_000
WORDS = f"""
    , c0 AS (SELECT media_id, cue_id, start_ms, end_ms - start_ms AS d, string_split({_clean("src_text")}, ' ') AS parts FROM cues WHERE {_clean("src_text")} <> ''),
    c1 AS (SELECT *, len(parts) AS n, unnest(parts) AS word, unnest(range(len(parts)))::INTEGER AS k FROM c0),
    words AS (SELECT media_id, cue_id, k, word, start_ms + d * k // n AS start_ms, start_ms + d * (k + 1) // n AS end_ms FROM c1)"""
MEMBERS = WORDS + f""",
    members AS (SELECT media_id, start_ms // {SEGMENT_MS} AS segment, cue_id, min(start_ms) AS first_ms FROM words GROUP BY ALL)"""
FLAGS = "CASE cue_id % 4 WHEN 0 THEN {a}'empty', 'rate'{b} WHEN 1 THEN {a}'rate'{b} WHEN 2 THEN {a}'run', 'empty'{b} ELSE {a}'ok'{b} END"
QUALITY = "CASE cue_id % 5 WHEN 0 THEN 'partial' WHEN 1 THEN 'boundary' WHEN 2 THEN 'drop_or_review' ELSE 'aligned' END"


def _members(spark, sf):
    return sg.members(sg.words(cues(spark, sf)), SEGMENT_MS)


@P.add("cue_words", WORDS + " SELECT * FROM words", over_cues=True)
def cue_words(spark, sf):
    return sg.words(cues(spark, sf))


@P.add(
    "word_timing_stats",
    WORDS + """ SELECT media_id, cue_id, count(*) AS word_count, count(*) FILTER (WHERE end_ms <= start_ms) AS no_length,
           count(*) FILTER (WHERE end_ms - start_ms <= 80) AS tiny, min(end_ms - start_ms) AS min_ms, max(end_ms - start_ms) AS max_ms FROM words GROUP BY ALL""",
    over_cues=True,
)
def word_timing_stats(spark, sf):
    return sg.timing_stats(sg.words(cues(spark, sf)), "media_id", "cue_id")


@P.add("valid_words", WORDS + " SELECT * FROM words WHERE trim(word, ' ') <> '' AND end_ms > start_ms", over_cues=True)
def valid_words(spark, sf):
    return sg.valid_words(sg.words(cues(spark, sf)))


@P.add(
    "segment_flags",
    MEMBERS + f""",
    f AS (SELECT m.media_id, segment, first_ms, m.cue_id, unnest(fl) AS flag, unnest(range(len(fl))) AS pos
          FROM members m JOIN (SELECT cue_id, {FLAGS.format(a="[", b="]")} AS fl FROM cues) USING (cue_id)),
    g AS (SELECT media_id, segment, flag, min((first_ms, cue_id, pos)) AS place FROM f GROUP BY ALL)
    SELECT media_id, segment, string_agg(flag, ',' ORDER BY place) AS flags FROM g GROUP BY ALL""",
    over_cues=True,
)
def segment_flags(spark, sf):
    flags = cues(spark, sf).select("cue_id", F.expr(FLAGS.format(a="array(", b=")")).alias("flags"))
    return sg.segment_flags(_members(spark, sf), flags)


@P.add(
    "segment_outcomes",
    MEMBERS + f""",
    o AS (SELECT m.*, quality, row_number() OVER (PARTITION BY m.media_id, segment ORDER BY quality NOT IN ('drop_or_review', 'partial'), first_ms, cue_id) AS rn,
                 count(*) OVER (PARTITION BY m.media_id, segment) AS n FROM members m JOIN (SELECT cue_id, {QUALITY} AS quality FROM cues) USING (cue_id))
    SELECT media_id, segment, quality, cue_id AS source, n FROM o WHERE rn = 1""",
    over_cues=True,
)
def segment_outcomes(spark, sf):
    return sg.segment_outcomes(_members(spark, sf), cues(spark, sf).select("cue_id", F.expr(QUALITY).alias("quality")))


@P.add(
    "segment_extent",
    MEMBERS + " SELECT m.media_id, segment, min(c.start_ms) AS start_ms, max(c.end_ms) AS end_ms FROM members m JOIN cues c USING (cue_id) GROUP BY ALL",
    over_cues=True,
)
def segment_extent(spark, sf):
    return sg.segment_extent(_members(spark, sf), cues(spark, sf))


NUMBERED = f", num AS (SELECT *, row_number() OVER ({W}) - 1 AS pos FROM cues)"


@P.add("cue_positions", NUMBERED + " SELECT media_id, cue_id, pos, coalesce(tgt_text, '') AS tgt_text FROM num", over_cues=True)
def cue_positions(spark, sf):
    """Cues in stable order of time with dense numbers and defaults."""
    return sg.numbered(cues(spark, sf)).select("media_id", "cue_id", "pos", tx.text(F.col("tgt_text")).alias("tgt_text"))


@P.add(
    "transcript_chunks",
    NUMBERED + f""", r AS (SELECT media_id, pos, tgt_text FROM num WHERE cue_id % 6 <> 0), o AS (SELECT media_id, pos, {QUALITY} AS quality FROM num WHERE cue_id % 3 = 0)
    SELECT num.media_id, num.pos, num.start_ms, num.end_ms, r.tgt_text, o.quality FROM num LEFT JOIN r USING (media_id, pos) LEFT JOIN o USING (media_id, pos)""",
    over_cues=True,
)
def transcript_chunks(spark, sf):
    n = sg.numbered(cues(spark, sf))
    outcomes = n.where("cue_id % 3 = 0").select("media_id", "pos", F.expr(QUALITY).alias("quality"))
    return sg.transcript_chunks(n.select("media_id", "pos", "start_ms", "end_ms"), n.where("cue_id % 6 <> 0").select("media_id", "pos", "tgt_text"), outcomes)


SPANS = ", s AS (SELECT DISTINCT media_id, start_ms, end_ms, CASE WHEN start_ms % 3 = 0 THEN 'pause' ELSE 'speech' END AS label FROM cues), t AS (SELECT media_id, start_ms, end_ms + CASE WHEN end_ms % 11 = 0 THEN 1 ELSE 0 END AS end_ms, 'word' AS label FROM s WHERE end_ms % 2 = 0)"


def _spans(spark, sf):
    label = F.when(F.col("start_ms") % 3 == 0, "pause").otherwise("speech")
    spans = cues(spark, sf).select("media_id", "start_ms", "end_ms", label.alias("label")).distinct()
    end = F.col("end_ms") + F.when(F.col("end_ms") % 11 == 0, 1).otherwise(0)
    return spans, spans.where("end_ms % 2 = 0").select("media_id", "start_ms", end.alias("end_ms"), F.lit("word").alias("label"))


@P.add(
    "relabelled_spans",
    SPANS + """ SELECT s.media_id, s.start_ms, s.end_ms, s.label AS was, CASE WHEN t.label IS NOT NULL AND s.label = 'pause' THEN t.label ELSE s.label END AS label
    FROM s LEFT JOIN t USING (media_id, start_ms, end_ms)""",
    over_cues=True,
)
def relabelled_spans(spark, sf):
    return sg.relabelled(*_spans(spark, sf), "pause")


@P.add(
    "targets_without_span",
    SPANS + " SELECT t.* FROM t WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.label = 'pause' AND s.media_id = t.media_id AND s.start_ms = t.start_ms AND s.end_ms = t.end_ms)",
    over_cues=True,
)
def targets_without_span(spark, sf):
    return sg.without_target(*_spans(spark, sf), "pause")


@P.add(
    "answered_spans",
    SPANS + " SELECT s.media_id, s.start_ms, s.end_ms, t.label FROM s JOIN t USING (media_id, start_ms, end_ms) WHERE s.label = 'pause'",
    over_cues=True,
)
def answered_spans(spark, sf):
    """Items with their answers, of one label."""
    spans, answers = _spans(spark, sf)
    return spans.where("label = 'pause'").drop("label").join(answers, ["media_id", "start_ms", "end_ms"])


@P.add(
    "held_out",
    "SELECT doc_id, lang, source FROM documents WHERE doc_id NOT IN (SELECT conv_id FROM conversations WHERE conv_id IS NOT NULL) AND source NOT IN (SELECT source FROM documents d JOIN labels l USING (doc_id) WHERE toxic = 1 AND source IS NOT NULL)",
)
def held_out(spark, sf):
    """Documents whose id no conversation holds and whose source has no toxic label: two anti joins."""
    docs = table(spark, sf, "documents").select("doc_id", "lang", "source")
    seen = table(spark, sf, "conversations").select(F.col("conv_id").alias("doc_id")).distinct()
    toxic = docs.join(table(spark, sf, "labels").where("toxic = 1"), "doc_id").select("source").distinct()
    return docs.where("source is not null").join(seen, "doc_id", "left_anti").join(toxic, "source", "left_anti").select("doc_id", "lang", "source")


@P.add(
    "media_touched",
    ", s AS (SELECT cue_id FROM cues WHERE src_text LIKE '%the%') SELECT DISTINCT media_id FROM cues SEMI JOIN s USING (cue_id)",
    over_cues=True,
)
def media_touched(spark, sf):
    c = cues(spark, sf)
    return c.join(c.where(F.contains("src_text", F.lit("the"))).select("cue_id"), "cue_id", "left_semi").select("media_id").distinct()


@P.add(
    "partition_lookup",
    "SELECT d.doc_id, d.source, l.quality FROM documents d JOIN labels l USING (doc_id) WHERE l.quality = 1 AND d.lang IN ('en', 'de')",
)
def partition_lookup(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "source", "lang").where(F.col("lang").isin("en", "de"))
    return docs.join(table(spark, sf, "labels").where("quality = 1"), "doc_id").select("doc_id", "source", "quality")


@P.add(
    "robust_bounds",
    WORDS + """, g AS (SELECT cue_id, start_ms, end_ms, row_number() OVER w AS rn, lead(start_ms) OVER w - start_ms AS gap, lag(end_ms) OVER w AS prev_end, lead(start_ms) OVER w AS next_start
          FROM words WINDOW w AS (PARTITION BY cue_id ORDER BY start_ms, end_ms, k)),
    p AS (SELECT cue_id, count(*) AS n, quantile_cont(gap, 0.5) AS mid, arg_min(start_ms, rn) AS s0, min(next_start) FILTER (WHERE rn = 1) AS s1, arg_max(end_ms, rn) AS e0,
                 arg_max(prev_end, rn) FILTER (WHERE prev_end IS NOT NULL) AS e1 FROM g GROUP BY cue_id),
    b AS (SELECT *, n >= 3 AND coalesce(mid > 0 AND s1 - s0 > 4 * mid, false) AS early, n >= 3 AND coalesce(mid > 0 AND e0 - e1 > 4 * mid, false) AS late FROM p),
    x AS (SELECT cue_id, CASE WHEN early THEN s1 - mid ELSE s0::DOUBLE END AS s, CASE WHEN late THEN e1 + mid ELSE e0::DOUBLE END AS e, early OR late AS trimmed FROM b)
    SELECT cue_id, s AS start_ms, greatest(s, e) AS end_ms, trimmed FROM x""",
    over_cues=True,
)
def robust_bounds(spark, sf):
    found = sg.robust_bounds(sg.words(cues(spark, sf)), "cue_id")
    return found.withColumn("trimmed", F.coalesce("trimmed", F.lit(False)))


@P.add(
    "block_windows",
    WORDS + """, a AS (SELECT cue_id, min(start_ms) - 40 AS anchor FROM words WHERE trim(word, ' ') <> '' AND end_ms > start_ms GROUP BY cue_id)
    SELECT cue_id, least(start_ms, coalesce(anchor, start_ms)) AS start_ms, greatest(least(start_ms, coalesce(anchor, start_ms)), end_ms) AS end_ms FROM cues LEFT JOIN a USING (cue_id)""",
    over_cues=True,
)
def block_windows(spark, sf):
    """Words measured 40 ms early pull their cue's start."""
    c = cues(spark, sf)
    early = sg.words(c).withColumns({"start_ms": F.col("start_ms") - 40, "end_ms": F.col("end_ms") - 40})
    return sg.block_window(c, early)


@P.add(
    "timeline_defaults",
    """
    , d AS (SELECT media_id, cue_id, start_ms, end_ms, CASE WHEN cue_id % 2 = 0 THEN start_ms + 50 END AS a, CASE WHEN cue_id % 3 = 0 THEN end_ms + 100 END AS b, CASE WHEN cue_id % 5 = 0 THEN start_ms - 90 END AS c FROM cues),
    d2 AS (SELECT *, coalesce(a, start_ms) AS a0, coalesce(c, start_ms) AS d0 FROM d), f AS (SELECT *, greatest(a0, end_ms) AS a1, greatest(d0, coalesce(b, end_ms)) AS d1 FROM d2)
    SELECT media_id, cue_id, a0 AS acoustic_start_ms, a1 AS acoustic_end_ms, a1 - a0 AS acoustic_ms, d0 AS display_start_ms, d1 AS display_end_ms, d1 - d0 AS display_ms FROM f""",
    over_cues=True,
)
def timeline_defaults(spark, sf):
    c = cues(spark, sf).withColumns(
        {
            "acoustic_start_ms": F.when(F.col("cue_id") % 2 == 0, F.col("start_ms") + 50), "acoustic_end_ms": F.lit(None).cast("long"),
            "display_start_ms": F.when(F.col("cue_id") % 5 == 0, F.col("start_ms") - 90), "display_end_ms": F.when(F.col("cue_id") % 3 == 0, F.col("end_ms") + 100),
        }
    )
    return sg.with_defaults(c)


@P.add(
    "repeats_in_list_order",
    """, r AS (SELECT media_id, trim(coalesce(tgt_text, ''), ' ') AS t, lag(trim(coalesce(tgt_text, ''), ' ')) OVER (PARTITION BY media_id ORDER BY cue_id) AS b FROM cues)
    SELECT media_id, count(*) AS n, count(*) FILTER (WHERE t <> '' AND t = b) AS repeats FROM r GROUP BY media_id""",
    over_cues=True,
)
def repeats_in_list_order(spark, sf):
    return sg.repeats_in_order(cues(spark, sf), "media_id", "cue_id", F.btrim(tx.text(F.col("tgt_text"))))


@P.add(
    "postprocessed_segments",
    rf"""
    , p AS (SELECT media_id, cue_id, start_ms, end_ms, {_one_line("tgt_text")} AS text FROM cues)
    SELECT media_id, row_number() OVER ({W}) - 1 AS pos, cue_id, start_ms, end_ms, text FROM p
    WHERE regexp_replace(text, '{tx.PUNCTUATION}', '', 'g') <> '' AND NOT regexp_matches(text, '{nf.LOW_VALUE}')""",
    over_cues=True,
)
def postprocessed_segments(spark, sf):
    """Cleaned texts, those of nothing but signs left out, numbered in order of time."""
    kept = cues(spark, sf).where(~nf.low_value(F.col("tgt_text"))).withColumn("text", nf.one_line(F.col("tgt_text")))
    return sg.numbered(kept).select("media_id", "pos", "cue_id", "start_ms", "end_ms", "text")


@P.add(
    "glossary_first_pairs",
    f"""
    WITH a AS (SELECT lang AS source, source AS target, 0 AS origin, doc_id AS pos FROM documents WHERE {_stripped("lang")} <> ''),
    b AS (SELECT role AS source, 's' || turn AS target, 1 AS origin, conv_id AS pos FROM conversations UNION ALL SELECT lang, source, 1, doc_id + 7 FROM documents WHERE {_stripped("lang")} NOT IN ('', 'en'))
    SELECT source, target, min((origin, pos))[1] AS origin, min((origin, pos))[2] AS pos FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY source, target""",
)
def glossary_first_pairs(spark, sf):
    docs = table(spark, sf, "documents").where(nf.stripped(F.col("lang")) != "")
    a = docs.select(F.col("lang").alias("source"), F.col("source").alias("target"), F.col("doc_id").alias("pos"))
    turns = table(spark, sf, "conversations").select(F.col("role").alias("source"), F.concat(F.lit("s"), F.col("turn")).alias("target"), F.col("conv_id").alias("pos"))
    return sg.first_pairs(a, turns.unionByName(a.where("source <> 'en'").withColumn("pos", F.col("pos") + 7)))
