"""Queries over the cue view: quality, neighbours, timelines, intervals."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuelake.functions import text as tx
from cuelake.functions import timecode as tc
from cuelake.operators import flags, intervals, quality, windows
from cuelake.plans.registry import Plans, banned_sql
from cuelake.sources.tables import cues, table

P = Plans()
W = "PARTITION BY media_id ORDER BY start_ms, end_ms, cue_id"
GLOSSARY = [("the", "th"), ("on", "er"), ("de", "la"), ("ing", "an")]
KEY = f"regexp_replace(coalesce(src_text, ''), '{tx.SEPARATORS}', '', 'g')"


def _clean(x: str) -> str:
    return rf"trim(regexp_replace(coalesce({x}, ''), '[\s\x{{3000}}]+', ' ', 'g'), ' ')"


def _units(x: str) -> str:
    alnum, plain = f"len(regexp_extract_all({x}, '[0-9A-Za-z]'))", rf"len(regexp_extract_all({x}, '[\x{{00}}-\x{{7f}}]'))"
    return f"((length({x}) - {plain}) * 100 + {alnum} * 55 + ({plain} - {alnum}) * 35)"


def _distinct(x: str) -> str:
    return f"(CASE WHEN {x} = '' THEN 0 ELSE len(list_distinct(string_split({x}, ''))) END)"


@P.add("cue_view", "SELECT * FROM cues", over_cues=True)
def cue_view(spark, sf):
    return cues(spark, sf)


@P.add(
    "quality_report",
    f"""
    , r AS (SELECT *, trim(coalesce(tgt_text, ''), ' ') AS tgt, lag(trim(coalesce(tgt_text, ''), ' ')) OVER w AS prev,
                   lag(end_ms) OVER w - start_ms AS o FROM cues WINDOW w AS ({W})),
    a AS (
      SELECT media_id, count(*) AS n_cues, count(*) FILTER (WHERE tgt = '') / count(*) AS empty_ratio,
             count(*) FILTER (WHERE tgt <> '' AND tgt = prev) / count(*) AS repetition_ratio,
             count(*) FILTER (WHERE end_ms - start_ms < 800) / count(*) AS short_ratio,
             max(end_ms) - min(start_ms) AS span_ms, count(*) FILTER (WHERE o > 0) AS overlap_count
      FROM r GROUP BY media_id),
    b AS (SELECT *, n_cues * 60000.0::DOUBLE / greatest(span_ms, 60) AS per_min_count FROM a)
    SELECT *, concat_ws(',', CASE WHEN empty_ratio > 0.02 THEN 'empty_ratio' END,
                        CASE WHEN repetition_ratio > 0.05 THEN 'repetition_ratio' END,
                        CASE WHEN short_ratio > 0.15 THEN 'short_ratio' END,
                        CASE WHEN per_min_count > 8.0 THEN 'per_min_count' END,
                        CASE WHEN overlap_count > 0 THEN 'overlap_count' END) AS warnings
    FROM b""",
    over_cues=True,
)
def quality_report(spark, sf):
    return quality.report(cues(spark, sf))


@P.add(
    "duration_stats",
    """
    , d AS (SELECT media_id, greatest(0, end_ms - start_ms) AS d FROM cues)
    SELECT media_id, quantile_cont(d, 0.5) AS p50_ms, quantile_cont(d, 0.9) AS p90_ms, quantile_cont(d, 0.95) AS p95_ms,
           max(d) AS max_ms, count(*) FILTER (WHERE d < 800) AS short_count, count(*) FILTER (WHERE d < 500) AS micro_count,
           count(*) FILTER (WHERE d > 5000) AS long_count
    FROM d GROUP BY media_id""",
    over_cues=True,
)
def duration_stats(spark, sf):
    return quality.duration_stats(cues(spark, sf))


@P.add(
    "overlap_stats",
    f"""
    , o AS (SELECT media_id, lag(end_ms) OVER ({W}) - start_ms AS o FROM cues)
    SELECT media_id, count(*) FILTER (WHERE o > 0) AS overlap_count,
           coalesce(sum(o) FILTER (WHERE o > 0), 0)::BIGINT AS overlap_total_ms,
           coalesce(max(o) FILTER (WHERE o > 0), 0) AS overlap_max_ms
    FROM o GROUP BY media_id""",
    over_cues=True,
)
def overlap_stats(spark, sf):
    return quality.overlap_stats(cues(spark, sf))


@P.add(
    "spec_compliance",
    f"""
    , t AS (SELECT media_id, greatest(0, end_ms - start_ms) AS d, {_clean("tgt_text")} AS t,
                   lead(start_ms) OVER ({W}) - end_ms AS gap FROM cues),
    u AS (SELECT *, replace(t, ' ', '') AS s FROM t)
    SELECT media_id, count(*) FILTER (WHERE {_units("t")} > 3200) AS over_two_lines_count,
           sum({banned_sql("t")})::BIGINT AS banned_count,
           count(*) FILTER (WHERE {_units("s")} * 10 > 9 * greatest(d, 1)) AS cps_over_count,
           count(*) FILTER (WHERE d > 7000) AS duration_over_count, count(*) FILTER (WHERE d < 834) AS duration_under_count,
           count(*) FILTER (WHERE gap BETWEEN 0 AND 82) AS gap_under_count
    FROM u GROUP BY media_id""",
    over_cues=True,
)
def spec_compliance(spark, sf):
    return quality.spec_compliance(cues(spark, sf))


@P.add(
    "density_stats",
    f"""
    , r AS (SELECT media_id, length({KEY}) * 100000.0::DOUBLE / greatest(end_ms - start_ms, 1) AS rate FROM cues)
    SELECT media_id, quantile_cont(rate, 0.9) AS p90_rate, quantile_cont(rate, 0.95) AS p95_rate, max(rate) AS max_rate,
           count(*) FILTER (WHERE rate > 400.0) / count(*) AS over_ratio
    FROM r GROUP BY media_id""",
    over_cues=True,
)
def density_stats(spark, sf):
    return quality.density(cues(spark, sf))


@P.add(
    "density_windows",
    """
    , m AS (
      SELECT a.media_id, a.cue_id AS anchor, b.cue_id, b.start_ms, b.end_ms,
             least(b.end_ms, a.start_ms + 10000) - greatest(b.start_ms, a.start_ms) AS o
      FROM cues a JOIN cues b ON a.media_id = b.media_id AND b.end_ms > a.start_ms AND b.start_ms < a.start_ms + 10000),
    g AS (SELECT *, greatest(0, lead(start_ms) OVER (PARTITION BY media_id, anchor ORDER BY start_ms, end_ms, cue_id) - end_ms) AS gap,
                 lead(start_ms) OVER (PARTITION BY media_id, anchor ORDER BY start_ms, end_ms, cue_id) AS nxt FROM m),
    p AS (SELECT media_id, anchor, count(*) AS n, sum(o)::BIGINT AS active, min(gap) FILTER (WHERE nxt IS NOT NULL) AS least_gap,
                 quantile_cont(gap, 0.5) FILTER (WHERE nxt IS NOT NULL) AS mid
          FROM g GROUP BY ALL)
    SELECT media_id, max(n) AS max_count, max(active) AS max_active_ms, min(least_gap) AS min_gap_ms, quantile_cont(mid, 0.5) AS median_gap_ms
    FROM p GROUP BY media_id""",
    over_cues=True,
)
def density_windows(spark, sf):
    return quality.density_windows(cues(spark, sf))


@P.add(
    "hotspots_30s",
    """
    , s AS (SELECT cue_id % 2 AS side, media_id, unnest(range(start_ms // 30000, (greatest(end_ms, start_ms + 1) - 1) // 30000 + 1)) AS "window",
                   length(coalesce(tgt_text, '')) AS c FROM cues),
    g AS (SELECT media_id, "window", count(*) FILTER (WHERE side = 0) AS old_cues, coalesce(sum(c) FILTER (WHERE side = 0), 0)::BIGINT AS old_chars,
                 count(*) FILTER (WHERE side = 1) AS new_cues, coalesce(sum(c) FILTER (WHERE side = 1), 0)::BIGINT AS new_chars
          FROM s GROUP BY ALL)
    SELECT *, abs(new_cues - old_cues) * 10 + abs(new_chars - old_chars) AS score FROM g
    WHERE abs(new_cues - old_cues) * 10 + abs(new_chars - old_chars) > 0""",
    over_cues=True,
)
def hotspots_30s(spark, sf):
    c = cues(spark, sf)
    return quality.hotspots(c.where("cue_id % 2 = 0"), c.where("cue_id % 2 = 1"))


@P.add(
    "glossary_hit_rate",
    """
    , g(source, target) AS (VALUES ('the', 'th'), ('on', 'er'), ('de', 'la'), ('ing', 'an'))
    SELECT source AS term, count(*) AS checks, count(*) FILTER (WHERE contains(coalesce(tgt_text, ''), target)) AS hits,
           count(*) FILTER (WHERE contains(coalesce(tgt_text, ''), target)) / count(*) AS hit_rate
    FROM cues JOIN g ON contains(coalesce(src_text, ''), source) GROUP BY source""",
    over_cues=True,
)
def glossary_hit_rate(spark, sf):
    return quality.glossary_hits(cues(spark, sf), GLOSSARY).withColumn("hit_rate", F.col("hits") / F.col("checks"))


@P.add(
    "neighbor_features",
    f"""
    , k AS (SELECT *, {KEY} AS key FROM cues)
    SELECT media_id, cue_id,
           CASE WHEN lag(end_ms) OVER w IS NOT NULL THEN greatest(0, start_ms - lag(end_ms) OVER w) END AS prev_gap_ms,
           CASE WHEN lead(start_ms) OVER w IS NOT NULL THEN greatest(0, lead(start_ms) OVER w - end_ms) END AS next_gap_ms,
           coalesce(key <> '' AND key = lag(key) OVER w, false) AS prev_text_same,
           coalesce(key <> '' AND key = lead(key) OVER w, false) AS next_text_same
    FROM k WINDOW w AS ({W})""",
    over_cues=True,
)
def neighbor_features(spark, sf):
    return windows.neighbours(cues(spark, sf))


@P.add(
    "same_text_runs",
    f"""
    , k AS (SELECT *, {KEY} AS key FROM cues),
    b AS (SELECT *, coalesce(lag(key) OVER w <> key OR start_ms - lag(end_ms) OVER w > 1000, true)::INT AS brk FROM k WINDOW w AS ({W})),
    i AS (SELECT *, sum(brk) OVER ({W}) AS island FROM b)
    SELECT media_id, cue_id, CASE WHEN key = '' THEN 0 ELSE count(*) OVER (PARTITION BY media_id, island) END AS run_length,
           CASE WHEN key = '' THEN 0 ELSE row_number() OVER (PARTITION BY media_id, island ORDER BY start_ms, end_ms, cue_id) - 1 END AS run_position
    FROM i""",
    over_cues=True,
)
def same_text_runs(spark, sf):
    return windows.same_text_runs(cues(spark, sf))


@P.add(
    "normalize_timeline",
    f"""
    , nx AS (SELECT *, lead(start_ms) OVER ({W}) AS nxt FROM cues)
    SELECT media_id, cue_id, start_ms,
           CASE WHEN nxt IS NOT NULL AND end_ms + 83 > nxt THEN greatest(start_ms, nxt - 83) ELSE end_ms END AS display_end_ms,
           nxt IS NOT NULL AND end_ms + 83 > nxt AND greatest(start_ms, nxt - 83) - start_ms < 834 AS too_short
    FROM nx""",
    over_cues=True,
)
def normalize_timeline(spark, sf):
    return windows.normalize_timeline(cues(spark, sf))


@P.add(
    "display_window",
    f"""
    , t AS (SELECT *, greatest(350 + floor({_units("coalesce(tgt_text, '')")} * 10 / 7.0::DOUBLE)::BIGINT, 834) AS target,
                   lead(start_ms) OVER ({W}) AS nxt FROM cues),
    l AS (SELECT *, CASE WHEN nxt IS NOT NULL THEN greatest(start_ms + 50, nxt - 83) ELSE 1000000000000 END AS lim,
                 greatest(target * 165 // 100, target + 900) AS cap FROM t),
    x AS (SELECT *, least(greatest(least(end_ms, lim, start_ms + cap), least(start_ms + target, lim)), lim) AS e FROM l)
    SELECT media_id, cue_id, start_ms, CASE WHEN e <= start_ms THEN start_ms + 50 ELSE e END AS window_end_ms FROM x""",
    over_cues=True,
)
def display_window(spark, sf):
    return windows.display_window(cues(spark, sf))


@P.add(
    "polish_timeline",
    f"""
    , nx AS (SELECT *, lead(start_ms) OVER ({W}) AS nxt, greatest(start_ms + 50, end_ms) AS e0 FROM cues),
    m AS (SELECT *, greatest(start_ms + 50, nxt - 83) AS max_end,
                 CASE WHEN greatest(0, nxt - e0) < 500 THEN greatest(start_ms + 50, nxt - 83)
                      ELSE least(e0 + 500, greatest(start_ms + 50, nxt - 500)) END AS target FROM nx)
    SELECT media_id, cue_id, start_ms,
           greatest(start_ms + 50, least(CASE WHEN nxt IS NULL THEN e0 + 500 ELSE least(greatest(e0, target), max_end) END, end_ms + 500))
             AS polished_end_ms
    FROM m""",
    over_cues=True,
)
def polish_timeline(spark, sf):
    return windows.polish_timeline(cues(spark, sf))


@P.add(
    "repair_windows",
    f"""
    , nx AS (SELECT *, lead(start_ms) OVER ({W}) AS nxt FROM cues),
    a AS (SELECT *, CASE WHEN nxt IS NULL THEN end_ms ELSE least(end_ms, greatest(start_ms, nxt)) END AS e1 FROM nx),
    b AS (SELECT *, CASE WHEN e1 - start_ms <= 100 THEN start_ms + 600 ELSE e1 END AS e2 FROM a)
    SELECT media_id, cue_id, start_ms, CASE WHEN nxt IS NULL THEN e2 ELSE least(e2, greatest(start_ms, nxt)) END AS repaired_end_ms FROM b""",
    over_cues=True,
)
def repair_windows(spark, sf):
    return windows.repair_windows(cues(spark, sf))


@P.add(
    "layout_flags",
    f"""
    , d AS (SELECT *, least(end_ms, start_ms + 7000) AS de FROM cues)
    SELECT media_id, cue_id, de AS display_end_ms, end_ms - start_ms > 7000 AS clamped, de - end_ms AS shift_end_ms,
           de - start_ms < 834 AS duration_violation,
           coalesce(lead(start_ms) OVER w - de < 83, false) OR coalesce(start_ms - lag(de) OVER w < 83, false) AS gap_violation
    FROM d WINDOW w AS ({W})""",
    over_cues=True,
)
def layout_flags(spark, sf):
    return windows.layout_flags(cues(spark, sf))


@P.add(
    "word_gap_anchors",
    f"""
    , nx AS (SELECT *, lead(start_ms) OVER ({W}) AS nxt FROM cues)
    SELECT media_id, cue_id, (end_ms + nxt) // 2 AS anchor_ms, nxt - end_ms AS gap_ms, nxt - end_ms >= 600 AS strong
    FROM nx WHERE nxt - end_ms >= 120""",
    over_cues=True,
)
def word_gap_anchors(spark, sf):
    return windows.gap_anchors(cues(spark, sf))


@P.add(
    "word_segments",
    """
    WITH b AS (SELECT *, coalesce(role <> lag(role) OVER (PARTITION BY conv_id ORDER BY turn), false)::INT AS brk FROM conversations),
    i AS (SELECT *, sum(brk) OVER (PARTITION BY conv_id ORDER BY turn) AS segment FROM b)
    SELECT conv_id AS media_id, segment::BIGINT AS segment, min(turn) AS first_pos, max(turn) AS last_pos, count(*) AS n_words,
           string_agg(text, ' ' ORDER BY turn) AS text
    FROM i GROUP BY conv_id, segment""",
)
def word_segments(spark, sf):
    turns = table(spark, sf, "conversations")
    return windows.word_segments(
        turns.select(F.col("conv_id").alias("media_id"), F.col("turn").alias("pos"), F.col("text").alias("word"), F.col("role").alias("chunk"))
    )


@P.add(
    "proportional_tokens",
    r"""
    , t AS (SELECT cue_id, start_ms, end_ms, regexp_extract_all(coalesce(src_text, ''), '[A-Za-z0-9]+|[^\sA-Za-z0-9]') AS toks FROM cues),
    x AS (SELECT cue_id, start_ms, end_ms, unnest(toks) AS token, generate_subscripts(toks, 1) - 1 AS token_index FROM t),
    y AS (SELECT *, sum(length(token)) OVER (PARTITION BY cue_id ORDER BY token_index)::BIGINT AS upto,
                 sum(length(token)) OVER (PARTITION BY cue_id)::BIGINT AS total FROM x)
    SELECT cue_id, token_index, token, start_ms + (end_ms - start_ms) * (upto - length(token)) // total AS token_start_ms,
           start_ms + (end_ms - start_ms) * upto // total AS token_end_ms
    FROM y""",
    over_cues=True,
)
def proportional_tokens(spark, sf):
    return windows.proportional_tokens(cues(spark, sf))


@P.add(
    "postgate_flags",
    f"""
    , t AS (SELECT *, {_clean("src_text")} AS shown, {KEY} AS key FROM cues),
    s AS (SELECT *, regexp_replace(shown, '{tx.PUNCTUATION}', '', 'g') AS short,
                 regexp_replace(shown, '{tx.SEPARATORS}', '', 'g') AS packed,
                 coalesce(key <> '' AND key = lag(key) OVER w, false) OR coalesce(key <> '' AND key = lead(key) OVER w, false) AS same
          FROM t WINDOW w AS ({W})),
    c AS (SELECT *, length(short) AS char_count, {_distinct("short")} AS unique_chars,
                 EXISTS (SELECT 1 FROM range(1, 13) a(u), range(1, 70) b(i)
                         WHERE length(packed) >= 6 AND i + u - 1 <= length(packed) AND contains(packed, repeat(substr(packed, i, u), 6))) AS long_run
          FROM s)
    SELECT media_id, cue_id,
           concat_ws(',', CASE WHEN char_count = 0 THEN 'empty' END,
                     CASE WHEN char_count >= 6 AND unique_chars < 0.25 * char_count THEN 'runaway' END,
                     CASE WHEN char_count > 0 AND char_count * 1000 > 14.0 * (end_ms - start_ms) THEN 'impossible_rate' END,
                     CASE WHEN char_count >= 6 AND long_run THEN 'repeated_unit' END,
                     CASE WHEN shown <> '' AND same THEN 'duplicate_neighbour' END) AS flags,
           true AS kept, char_count, unique_chars
    FROM c""",
    over_cues=True,
)
def postgate_flags(spark, sf):
    return flags.postgate(cues(spark, sf))


@P.add("postgate_summary", P.oracles["postgate_flags"].replace("SELECT media_id, cue_id,\n           concat_ws", ", f AS (SELECT media_id, cue_id,\n           concat_ws")
       + ") SELECT flag, count(*) AS n FROM (SELECT unnest(string_split(flags, ',')) AS flag FROM f) WHERE flag <> '' GROUP BY flag")
def postgate_summary(spark, sf):
    found = flags.postgate(cues(spark, sf))
    return found.select(F.explode(F.split("flags", ",")).alias("flag")).where("flag <> ''").groupBy("flag").agg(F.count(F.lit(1)).alias("n"))


SPAN = "0, 400000"
MERGED = """
    {name}_r AS (SELECT media_id, start_ms, end_ms, max(end_ms) OVER (PARTITION BY media_id ORDER BY start_ms, end_ms
                        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM {source}),
    {name}_i AS (SELECT *, sum(coalesce(start_ms - reach > {gap}, true)::INT) OVER (PARTITION BY media_id ORDER BY start_ms, end_ms) AS island
                 FROM {name}_r),
    {name} AS (SELECT media_id, min(start_ms) AS start_ms, max(end_ms) AS end_ms, count(*) AS n FROM {name}_i GROUP BY media_id, island)"""
GAPS = """
    {name}_c AS (SELECT media_id, greatest(start_ms, 0) AS start_ms, least(end_ms, 400000) AS end_ms FROM {source}
                 WHERE least(end_ms, 400000) > greatest(start_ms, 0)),
    {merged},
    {name} AS (
      SELECT * FROM (
        SELECT media_id, coalesce(lag(end_ms) OVER (PARTITION BY media_id ORDER BY start_ms), 0) AS start_ms, start_ms AS end_ms FROM {name}_m
        UNION ALL SELECT media_id, max(end_ms), 400000 FROM {name}_m GROUP BY media_id)
      WHERE end_ms > start_ms)"""


def _gaps(name: str, source: str) -> str:
    return GAPS.format(name=name, source=source, merged=MERGED.format(name=f"{name}_m", source=f"{name}_c", gap=0))


@P.add("merge_intervals", ", " + MERGED.format(name="m", source="cues", gap=400) + " SELECT * FROM m", over_cues=True)
def merge_intervals(spark, sf):
    return intervals.merge(cues(spark, sf), "media_id", 400)


@P.add("complement_gaps", ", " + _gaps("g", "cues") + " SELECT * FROM g", over_cues=True)
def complement_gaps(spark, sf):
    return intervals.gaps(cues(spark, sf), "media_id", 0, 400_000)


@P.add(
    "speech_regions",
    ", " + _gaps("g", "cues") + ", " + MERGED.format(name="j", source="g", gap=400)
    + """, p AS (SELECT media_id, greatest(0, start_ms - 150) AS start_ms, least(400000, end_ms + 150) AS end_ms FROM j WHERE end_ms - start_ms >= 1000), """
    + MERGED.format(name="q", source="p", gap=0)
    + """, c AS (SELECT *, ceil((end_ms - start_ms) / 20000)::BIGINT AS k FROM q),
    z AS (SELECT *, unnest(range(k)) AS piece FROM c)
    SELECT media_id, start_ms, end_ms, piece, start_ms + (end_ms - start_ms) * piece // k AS piece_start_ms,
           start_ms + (end_ms - start_ms) * (piece + 1) // k AS piece_end_ms FROM z""",
    over_cues=True,
)
def speech_regions(spark, sf):
    return intervals.speech_regions(cues(spark, sf), "media_id", 0, 400_000)


@P.add(
    "overlap_join",
    """
    SELECT a.media_id, a.cue_id AS a_id, b.cue_id AS b_id, least(a.end_ms, b.end_ms) - greatest(a.start_ms, b.start_ms) AS overlap_ms
    FROM cues a JOIN cues b ON a.media_id = b.media_id AND a.cue_id % 2 = 0 AND b.cue_id % 2 = 1
     AND least(a.end_ms, b.end_ms) - greatest(a.start_ms, b.start_ms) >= 100""",
    over_cues=True,
)
def overlap_join(spark, sf):
    c = cues(spark, sf)
    return intervals.overlap_pairs(c.where("cue_id % 2 = 0"), c.where("cue_id % 2 = 1"), "media_id", "cue_id", "cue_id", 100)


@P.add(
    "unsupported_cues",
    """
    SELECT media_id, cue_id, start_ms, end_ms FROM cues b WHERE cue_id % 2 = 1 AND NOT EXISTS (
      SELECT 1 FROM cues a WHERE a.media_id = b.media_id AND a.cue_id % 2 = 0
       AND least(a.end_ms, b.end_ms) - greatest(a.start_ms, b.start_ms) >= 100)""",
    over_cues=True,
)
def unsupported_cues(spark, sf):
    c = cues(spark, sf)
    new = c.where("cue_id % 2 = 1")
    met = intervals.overlap_pairs(c.where("cue_id % 2 = 0"), new, "media_id", "cue_id", "cue_id", 100)
    found = met.select(F.col("b_id").alias("cue_id")).distinct()
    return new.join(found, "cue_id", "left_anti").select("media_id", "cue_id", "start_ms", "end_ms")


@P.add(
    "covered_seconds",
    ", o AS (SELECT * FROM cues WHERE cue_id % 2 = 1), " + MERGED.format(name="m", source="o", gap=0)
    + """ SELECT a.media_id, a.cue_id, coalesce(sum(least(a.end_ms, m.end_ms) - greatest(a.start_ms, m.start_ms)) FILTER (WHERE m.start_ms IS NOT NULL), 0)::BIGINT AS covered_ms
    FROM cues a LEFT JOIN m ON a.media_id = m.media_id AND m.start_ms < a.end_ms AND m.end_ms > a.start_ms
    WHERE a.cue_id % 2 = 0 GROUP BY a.media_id, a.cue_id""",
    over_cues=True,
)
def covered_seconds(spark, sf):
    c = cues(spark, sf)
    return intervals.covered(c.where("cue_id % 2 = 0"), c.where("cue_id % 2 = 1"), "media_id", "cue_id")


@P.add(
    "nearest_anchor",
    f"""
    , nx AS (SELECT *, lead(start_ms) OVER ({W}) AS nxt FROM cues),
    a AS (SELECT media_id, (end_ms + nxt) // 2 AS anchor_ms, nxt - end_ms >= 600 AS strong FROM nx WHERE nxt - end_ms >= 120),
    r AS (SELECT c.media_id, c.cue_id, a.anchor_ms, abs(a.anchor_ms - c.start_ms) AS off_ms, a.strong,
                 row_number() OVER (PARTITION BY c.cue_id ORDER BY abs(a.anchor_ms - c.start_ms), NOT a.strong, a.anchor_ms) AS rn
          FROM cues c JOIN a ON c.media_id = a.media_id AND abs(a.anchor_ms - c.start_ms) <= 5000)
    SELECT media_id, cue_id, anchor_ms, off_ms, strong FROM r WHERE rn = 1""",
    over_cues=True,
)
def nearest_anchor(spark, sf):
    c = cues(spark, sf)
    return intervals.nearest(c, windows.gap_anchors(c), "media_id", "cue_id", "start_ms", 5000)


@P.add(
    "point_in_interval",
    """
    SELECT a.media_id, a.cue_id, a.start_ms, b.cue_id AS span_id FROM cues a
    JOIN cues b ON a.media_id = b.media_id AND b.start_ms <= a.start_ms AND a.start_ms < b.end_ms""",
    over_cues=True,
)
def point_in_interval(spark, sf):
    c = cues(spark, sf)
    spans = c.withColumnRenamed("cue_id", "span_id")
    return intervals.at_point(c.select("media_id", "cue_id", "start_ms"), spans, "media_id", "start_ms", "span_id")


@P.add(
    "head_windows",
    """
    WITH w AS (SELECT i AS "window", i * 26000 AS start_ms, least(i * 26000 + 30000, 400000) AS end_ms FROM range(0, 16) t(i)),
    u AS (SELECT *, CASE WHEN lead(start_ms) OVER (ORDER BY start_ms) IS NULL THEN end_ms ELSE end_ms - 2000 END AS until FROM w)
    SELECT 'all' AS media_id, "window", greatest(start_ms, coalesce(max(until) OVER (ORDER BY start_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS keep_from_ms,
           until AS keep_to_ms FROM u""",
)
def head_windows(spark, sf):
    w = intervals.fixed_windows(400_000, 30_000, 2_000, spark).withColumn("media_id", F.lit("all"))
    return intervals.keep_slices(w, 2_000, "media_id")


@P.add(
    "alignment_quality",
    f"""
    , o AS (SELECT *, lag(end_ms) OVER ({W}) - start_ms AS o FROM cues)
    SELECT media_id, cue_id, CASE WHEN length({KEY}) = 0 THEN 'nonlexical' WHEN end_ms - start_ms < 300 THEN 'drop_or_review'
             WHEN (cue_id * 37 % 100) / 100.0::DOUBLE < 0.5 THEN 'partial' WHEN o > 0 THEN 'boundary' ELSE 'aligned' END AS quality
    FROM o""",
    over_cues=True,
)
def alignment_quality(spark, sf):
    c = cues(spark, sf).withColumn("o", F.lag("end_ms").over(windows.by_media()) - F.col("start_ms"))
    score = (F.col("cue_id") * 37 % 100) / 100.0
    found = flags.alignment_quality(F.col("end_ms") - F.col("start_ms"), F.length(tx.compact(F.col("src_text"))), score, F.col("o"))
    return c.select("media_id", "cue_id", found.alias("quality"))


_T = lambda x: f"printf('%02d:%02d:%02d,%03d', {x} // 3600000, {x} // 60000 % 60, {x} // 1000 % 60, {x} % 1000)"


@P.add(
    "srt_lines",
    f"""
    , k AS (SELECT *, greatest(end_ms, start_ms + 50) AS e FROM cues WHERE trim(coalesce(tgt_text, ''), ' ') <> '')
    SELECT media_id, cue_id, row_number() OVER ({W}) AS number,
           row_number() OVER ({W}) || chr(10) || {_T("start_ms")} || ' --> ' || {_T("e")} || chr(10) || tgt_text || chr(10) AS block
    FROM k""",
    over_cues=True,
)
def srt_lines(spark, sf):
    from cuelake.sources.sinks import srt_blocks

    return srt_blocks(cues(spark, sf), "tgt_text")


@P.add(
    "timestamp_roundtrip",
    f"""SELECT cue_id, start_ms, {_T("start_ms")} AS shown, start_ms AS parsed_ms,
    printf('%02d:%02d.%03d', start_ms // 60000, start_ms // 1000 % 60, start_ms % 1000) AS mmss, start_ms AS mmss_ms FROM cues""",
    over_cues=True,
)
def timestamp_roundtrip(spark, sf):
    c = cues(spark, sf)
    shown, mmss = tc.srt_time(F.col("start_ms")), tc.mmss_time(F.col("start_ms"))
    return c.select("cue_id", "start_ms", shown.alias("shown"), tc.parse_time(shown).alias("parsed_ms"), mmss.alias("mmss"), tc.parse_mmss(mmss).alias("mmss_ms"))


@P.add(
    "length_mismatch",
    """
    SELECT media_id, cue_id, length(coalesce(src_text, '')) AS src_chars, length(coalesce(tgt_text, '')) AS tgt_chars FROM cues
    WHERE NOT (length(coalesce(tgt_text, '')) / greatest(length(coalesce(src_text, '')), 1) BETWEEN 0.25 AND 4.0)""",
    over_cues=True,
)
def length_mismatch(spark, sf):
    c = cues(spark, sf)
    return c.where(flags.length_mismatch(F.col("src_text"), F.col("tgt_text"))).select(
        "media_id", "cue_id", F.length(tx.text(F.col("src_text"))).alias("src_chars"), F.length(tx.text(F.col("tgt_text"))).alias("tgt_chars")
    )


@P.add(
    "repair_context",
    f"""
    , p AS (SELECT *, row_number() OVER ({W}) AS pos FROM cues),
    r AS (SELECT media_id, pos FROM p WHERE NOT (length(coalesce(tgt_text, '')) / greatest(length(coalesce(src_text, '')), 1) BETWEEN 0.25 AND 4.0)),
    x AS (SELECT DISTINCT media_id, pos + d AS pos FROM r, (VALUES (-2), (-1), (0), (1), (2)) t(d))
    SELECT p.media_id, p.cue_id, p.pos, CASE WHEN r.pos IS NOT NULL THEN 'repair' ELSE 'context' END AS role
    FROM p JOIN x USING (media_id, pos) LEFT JOIN r USING (media_id, pos)""",
    over_cues=True,
)
def repair_context(spark, sf):
    pos = F.row_number().over(windows.by_media()).cast("long")
    bad = flags.length_mismatch(F.col("src_text"), F.col("tgt_text"))
    p = cues(spark, sf).select("media_id", "cue_id", pos.alias("pos"), bad.alias("bad"))
    band = p.where("bad").select("media_id", F.explode(F.sequence(F.col("pos") - 2, F.col("pos") + 2)).alias("pos")).distinct()
    return p.join(band, ["media_id", "pos"]).select(
        "media_id", "cue_id", "pos", F.when(F.col("bad"), "repair").otherwise("context").alias("role")
    )
