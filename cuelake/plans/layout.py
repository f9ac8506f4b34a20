"""Queries of the display layout: long cues in pieces, wrapped lines, the whole chain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuelake.functions import normal
from cuelake.operators import layout
from cuelake.plans.registry import Plans
from cuelake.plans.texts import WS
from cuelake.sources.tables import cues

P = Plans()


def first_places(text: Column) -> Column:
    """Where the words between spaces begin, from 1; null without any text."""
    blank = lambda i: F.substring(text, i, F.lit(1)).isin(*" \t\n\x0b\x0c\r")
    return F.filter(F.when(F.length(text) > 0, F.sequence(F.lit(1), F.length(text))), lambda i: ~blank(i) & ((i == 1) | blank(i - 1)))


def spoken_words(first: Column, text: Column, cue_id: Column, start: Column, end: Column) -> Column:
    """Words at the places ``first``, at their share of the cue's time, followed by silences of 0 to 800 ms; of every seventh cue not aligned."""
    at = lambda i: start + F.floor((end - start) * (i - 1) / F.length(text))
    nxt = lambda k: F.coalesce(at(F.get(first, k + 1)), end)
    gap = lambda k: (cue_id * 31 + k * 17) % 9 * 100
    word = lambda i: F.regexp_extract(F.substring(text, i, F.length(text)), r"^\S+", 0)
    return F.transform(
        first,
        lambda i, k: F.struct(
            at(i).alias("start_ms"), F.greatest(at(i), nxt(k) - gap(k)).alias("end_ms"), word(i).alias("word"), (cue_id % 7 != 0).alias("aligned")
        ),
    )


def spoken(spark, sf) -> DataFrame:
    # The places are a column of their own: inside the lambda they would be sought again for every word.
    rows = cues(spark, sf).withColumn("first", first_places(F.col("src_text")))
    words = spoken_words(F.col("first"), F.col("src_text"), F.col("cue_id"), F.col("start_ms"), F.col("end_ms"))
    return rows.withColumn("words", words).drop("first")


SPOKEN_SQL = rf"""
    , wp AS (SELECT cue_id, start_ms, end_ms, src_text, unnest(range(1, length(src_text) + 1)) AS i FROM cues),
    wf AS (SELECT *, row_number() OVER o - 1 AS k, lead(i) OVER o AS i2 FROM wp
           WHERE substr(src_text, i, 1) NOT IN (' ', chr(9), chr(10), chr(11), chr(12), chr(13))
             AND (i = 1 OR substr(src_text, i - 1, 1) IN (' ', chr(9), chr(10), chr(11), chr(12), chr(13)))
           WINDOW o AS (PARTITION BY cue_id ORDER BY i)),
    wt AS (SELECT *, start_ms + (end_ms - start_ms) * (i - 1) // length(src_text) AS s,
                  coalesce(start_ms + (end_ms - start_ms) * (i2 - 1) // length(src_text), end_ms) AS n FROM wf),
    ww AS (SELECT cue_id, list({{'start_ms': s, 'end_ms': greatest(s, n - (cue_id * 31 + k * 17) % 9 * 100),
                                 'word': regexp_extract(substr(src_text, i), '^\S+'), 'aligned': cue_id % 7 <> 0}} ORDER BY k) AS words
           FROM wt GROUP BY cue_id),
    spoken AS (SELECT cues.*, words FROM cues LEFT JOIN ww USING (cue_id))"""


def _width(x: str) -> str:
    """Display width in hundredths, white space aside."""
    s = rf"regexp_replace({x}, '\s', '', 'g')"
    return (
        f"(100 * length({s}) - 45 * length(regexp_replace({s}, '[^0-9A-Za-z]', '', 'g'))"
        rf" - 65 * length(regexp_replace({s}, '[^\x00-\x7f]|[0-9A-Za-z]', '', 'g')))"
    )


def _place(length: str, share: str) -> str:
    return f"greatest(1, least({length} - 1, round_even({length} * ({share}), 0)))::BIGINT"


def _score(text: str, p: str) -> str:
    c = f"substr({text}, {p}, 1)"
    return (
        f"CASE WHEN contains('。！？!?…', {c}) THEN 0e0 WHEN contains('；;，、,', {c}) THEN 0.15e0 "
        f"WHEN trim({c}, {WS}) = '' THEN 0.35e0 ELSE 0.75e0 END"
    )


def _by_share(p: str, col: str) -> str:
    """Pieces of ``col`` as a list, cut at the positions of the timing text or near the shares of its width."""
    return f"""
    {p}_{col}p AS (SELECT rid, list(DISTINCT q) AS qs FROM (
        SELECT r.rid, CASE WHEN c.{col} = c.t THEN n.position
                           WHEN length(c.{col}) > 1 THEN {_place(f"length(c.{col})", "n.u::DOUBLE / greatest(c.total, 1)")} END AS q, length(c.{col}) AS len
        FROM {p}_r r JOIN {p}_n n USING (rid, j) JOIN {p}_l c USING (rid)) WHERE q > 0 AND q < len GROUP BY rid),
    {p}_{col}q AS (SELECT c.rid, c.{col}, list_sort(list_concat([0], coalesce(qs, []), [length(c.{col})])) AS qs
                   FROM {p}_l c LEFT JOIN {p}_{col}p USING (rid)),"""


def split_sql(p: str, source: str) -> str:
    """CTEs that end with ``{p}_out``: rows of ``source`` (rid, ...), cut as ``layout.split_long`` cuts them; needs WITH RECURSIVE."""
    return rf"""
    {p}_l AS MATERIALIZED (
      SELECT *, {_width("t")} AS total FROM (
        SELECT *, CASE WHEN coalesce(src_text, '') <> '' THEN src_text ELSE coalesce(tgt_text, '') END AS t FROM {source})
      WHERE end_ms - start_ms > 7000 AND trim(t, {WS}) <> '' AND length(t) > 1),
    {p}_w AS MATERIALIZED (
      SELECT rid, t, w.start_ms AS s, w.end_ms AS e, w.word AS word, row_number() OVER (PARTITION BY rid ORDER BY w.start_ms, w.end_ms) AS k
      FROM (SELECT rid, t, unnest(words) AS w FROM {p}_l) WHERE w.aligned AND w.end_ms >= w.start_ms),
    {p}_f(rid, k, hit, cursor) AS (
      SELECT rid, 0::BIGINT, NULL::BIGINT, 0::BIGINT FROM {p}_l
      UNION ALL
      SELECT w.rid, w.k, CASE WHEN h > 0 THEN f.cursor + h - 1 END, CASE WHEN h > 0 THEN f.cursor + h - 1 + length(w.word) ELSE f.cursor END
      FROM {p}_f f JOIN (SELECT * FROM {p}_w) w ON w.rid = f.rid AND w.k = f.k + 1,
           LATERAL (SELECT instr(substr(w.t, f.cursor + 1), w.word) AS h)),
    {p}_g AS MATERIALIZED (
      SELECT w.*, f.hit, lag(w.e) OVER (PARTITION BY w.rid ORDER BY w.k) AS e0 FROM {p}_w w JOIN {p}_f f ON f.rid = w.rid AND f.k = w.k),
    {p}_a AS MATERIALIZED (
      SELECT g.rid, e0 + (s - e0) / 2e0 AS time, s - e0 >= 600 AS strong, least((s - e0) / 600e0, 1e0) AS strength,
             CASE WHEN hit > 0 AND hit < length(g.t) THEN hit END AS position
      FROM {p}_g g JOIN {p}_l l USING (rid)
      WHERE s - e0 >= 120 AND e0 + (s - e0) / 2e0 > l.start_ms AND e0 + (s - e0) / 2e0 < l.end_ms),
    {p}_p AS (
      SELECT rid, q FROM (SELECT rid, t, unnest(range(1, length(t))) AS q FROM {p}_l)
      WHERE trim(substr(t, q + 1, 1), {WS}) = '' OR regexp_matches(substr(t, 1, q), '[。！？!?…；;，、,]\s*$')
      UNION SELECT rid, hit FROM {p}_g WHERE k > 1 AND hit > 0 AND hit < length(t)
      UNION SELECT rid, {_place("length(t)", "k / (more + 1)::DOUBLE")}
            FROM (SELECT *, unnest(range(1, more + 1)) AS k FROM (SELECT *, greatest(1, (end_ms - start_ms + 6999) // 7000 - 1) AS more FROM {p}_l))),
    {p}_t AS MATERIALIZED (
      SELECT l.rid, l.t, q, u, start_ms + (end_ms - start_ms) * (CASE WHEN total > 0 THEN u::DOUBLE / total ELSE 0e0 END) AS target
      FROM {p}_l l JOIN {p}_p USING (rid), LATERAL (SELECT {_width("substr(l.t, 1, q)")} AS u)),
    {p}_near AS (
      SELECT t.rid, t.q, a.time, a.strong, a.strength, abs(a.time - t.target) AS off FROM {p}_t t JOIN {p}_a a ON a.rid = t.rid AND abs(a.time - t.target) <= 600
      QUALIFY row_number() OVER (PARTITION BY t.rid, t.q ORDER BY abs(a.time - t.target), a.strong DESC, a.strength DESC) = 1),
    {p}_own AS (
      SELECT a.rid, coalesce(a.position, t.q) AS q, a.time, a.strong, a.strength, CASE WHEN a.position IS NULL THEN abs(a.time - t.target) ELSE 0e0 END AS off
      FROM {p}_a a JOIN {p}_t t ON t.rid = a.rid AND (a.position IS NULL OR a.position = t.q)
      QUALIFY row_number() OVER (PARTITION BY a.rid, a.time ORDER BY abs(t.target - a.time), {_score("t.t", "t.q")}, t.q) = 1),
    {p}_m AS (
      SELECT rid, 0 AS position, start_ms::DOUBLE AS time, 3 AS source, 0e0 AS strength, 0e0 AS off, false AS of_gap, 0 AS ord FROM {p}_l
      UNION ALL SELECT t.rid, t.q, coalesce(n.time, t.target), CASE WHEN n.time IS NULL THEN 0 WHEN n.strong THEN 2 ELSE 1 END,
                       coalesce(n.strength, 0e0), coalesce(n.off, 0e0), false, 1 FROM {p}_t t LEFT JOIN {p}_near n USING (rid, q)
      UNION ALL SELECT rid, q, time, CASE WHEN strong THEN 2 ELSE 1 END, strength, off, true, 2 FROM {p}_own
      UNION ALL SELECT rid, length(t), end_ms::DOUBLE, 3, 0e0, 0e0, false, 3 FROM {p}_l),
    {p}_n AS MATERIALIZED (
      SELECT m.*, l.t, {_width("substr(l.t, 1, m.position)")} AS u, m.ord = 3 AS is_last,
             row_number() OVER (PARTITION BY m.rid ORDER BY m.position, m.time, m.ord) - 1 AS j FROM {p}_m m JOIN {p}_l l USING (rid)),
    {p}_e AS MATERIALIZED (
      SELECT b.rid, b.j, list(CASE WHEN b.time - a.time > 0 AND b.time - a.time <= 7000.001e0 AND sized > 0 THEN
               1e0 + greatest(0e0, 834 - (b.time - a.time)) / 1000e0 * 6e0 + greatest(0, sized - 16) / 16e0 +
               CASE WHEN b.is_last THEN 0e0 ELSE {_score("b.t", "b.position")} + least(1e0, b.off / 600e0) * 0.15e0
                 - CASE b.source WHEN 2 THEN 1.2e0 + least(0.3e0, b.strength * 0.05e0) WHEN 1 THEN 0.95e0 + least(0.25e0, b.strength * 0.05e0) ELSE 0e0 END END
             END ORDER BY a.j) AS costs
      FROM {p}_n a JOIN {p}_n b ON a.rid = b.rid AND a.j < b.j,
           LATERAL (SELECT length(trim(substr(a.t, a.position + 1, b.position - a.position), {WS})) AS sized)
      GROUP BY b.rid, b.j),
    {p}_d(rid, j, best, came) AS (
      SELECT rid, 0::BIGINT, [0e0], [-1::BIGINT] FROM {p}_l
      UNION ALL
      SELECT rid, j, list_append(best, list_min(v)), list_append(came, list_position(v, list_min(v)) - 1)
      FROM (SELECT d.rid, e.j, d.best, d.came, list_transform(list_zip(d.best, e.costs), lambda z: z[1] + z[2]) AS v
            FROM {p}_d d JOIN {p}_e e ON e.rid = d.rid AND e.j = d.j + 1)),
    {p}_z AS MATERIALIZED (SELECT d.* FROM {p}_d d JOIN {p}_n n ON n.rid = d.rid AND n.j = d.j AND n.is_last WHERE d.best[-1] IS NOT NULL),
    {p}_b(rid, j, came) AS (
      SELECT rid, came[j + 1], came FROM {p}_z UNION ALL SELECT rid, came[j + 1], came FROM {p}_b WHERE j > 0),
    {p}_r AS MATERIALIZED (SELECT rid, j, row_number() OVER (PARTITION BY rid ORDER BY j) AS k FROM {p}_b WHERE j > 0),
    {p}_c AS MATERIALIZED (
      SELECT r.rid, list(n.time ORDER BY r.j) AS times, list(n.source ORDER BY r.j) AS sources, list(n.off ORDER BY r.j) AS offs,
             bool_or(n.of_gap) AS has_gap, bool_or(n.source <> 0) AS has_anchor, any_value(z.best[-1]) AS path_cost
      FROM {p}_r r JOIN {p}_n n USING (rid, j) JOIN {p}_z z USING (rid) GROUP BY r.rid),
    {_by_share(p, "src_text")}
    {_by_share(p, "tgt_text")}
    {p}_k AS (
      SELECT l.*, x.*, a.qs AS aq, b.qs AS bq, unnest(range(0, len(x.times) + 1)) AS n
      FROM {p}_l l JOIN {p}_c x USING (rid) JOIN {p}_src_textq a USING (rid) JOIN {p}_tgt_textq b USING (rid)),
    {p}_out AS MATERIALIZED (
      SELECT rid, media_id, cue_id, place, n AS piece, a AS start_ms, greatest(a + 50, b) AS end_ms,
             CASE WHEN src_text IS NOT NULL THEN CASE WHEN n + 2 <= len(aq) THEN trim(substr(src_text, aq[n + 1] + 1, aq[n + 2] - aq[n + 1]), {WS}) ELSE '' END END AS src_text,
             CASE WHEN tgt_text IS NOT NULL THEN CASE WHEN n + 2 <= len(bq) THEN trim(substr(tgt_text, bq[n + 1] + 1, bq[n + 2] - bq[n + 1]), {WS}) ELSE '' END END AS tgt_text,
             list_filter(words, lambda w: w.start_ms >= a AND w.start_ms < greatest(a + 50, b)) AS words,
             a AS spoken_start_ms, greatest(a + 50, b) AS spoken_end_ms, n > 0 OR continues_before AS continues_before,
             n < len(times) OR continues_after AS continues_after,
             CASE WHEN has_gap THEN 'word_gap_dp' WHEN has_anchor THEN 'acoustic_anchor_dp' ELSE 'proportional_text_dp' END AS split_source,
             CASE coalesce(sources[n + 1], 3) WHEN 1 THEN 'weak_cut' WHEN 2 THEN 'primary_cut' ELSE '' END AS anchor,
             coalesce(offs[n + 1], 0e0) AS off_ms, path_cost AS score
      FROM (SELECT *, CASE WHEN n = 0 THEN start_ms ELSE trunc(times[n])::BIGINT END AS a,
                   CASE WHEN n = len(times) THEN end_ms ELSE trunc(times[n + 1])::BIGINT END AS b FROM {p}_k)
      UNION ALL
      SELECT rid, media_id, cue_id, place, 0, start_ms, end_ms, src_text, tgt_text, words, spoken_start_ms, spoken_end_ms, continues_before,
             continues_after, split_source, anchor, off_ms, score
      FROM {source} WHERE rid NOT IN (SELECT rid FROM {p}_c)),"""


HEAD = """
    , s0 AS (SELECT cue_id AS rid, cue_id AS place, *, start_ms AS spoken_start_ms, end_ms AS spoken_end_ms, false AS continues_before,
                    false AS continues_after, NULL::VARCHAR AS split_source, '' AS anchor, 0e0 AS off_ms, NULL::DOUBLE AS score FROM spoken),"""
ORDER = "PARTITION BY media_id ORDER BY start_ms, end_ms, place, piece"


def _placed_sql(name: str, source: str) -> str:
    return f"""
    {name}_x AS (SELECT * REPLACE (least(start_ms, coalesce(list_min(list_transform(list_filter(words, lambda w: w.aligned AND w.end_ms > w.start_ms),
                                                                      lambda w: w.start_ms)), start_ms)) AS start_ms) FROM {source}),
    {name} AS MATERIALIZED (SELECT * EXCLUDE (pl) REPLACE (0 AS piece, pl AS place, pl * 10000000 + media_id AS rid) FROM (
        SELECT *, row_number() OVER ({ORDER}) AS pl FROM (SELECT * REPLACE (greatest(start_ms, end_ms) AS end_ms) FROM {name}_x))),"""


def _ends_sql(name: str, source: str, end: str) -> str:
    return f"""
    {name} AS MATERIALIZED (SELECT * EXCLUDE (nxt) REPLACE ({end} AS end_ms) FROM (SELECT *, lead(start_ms) OVER ({ORDER}) AS nxt FROM {source})),"""


BEFORE_NEXT = "CASE WHEN end_ms + 83 > nxt THEN greatest(start_ms, nxt - 83) ELSE end_ms END"
LEAST = """CASE WHEN nxt IS NULL THEN greatest(end_ms, start_ms + 834)
           ELSE least(greatest(least(end_ms, greatest(start_ms + 50, nxt - 83)), start_ms + 834), greatest(start_ms + 50, nxt - 83)) END"""
FULL = """CASE WHEN nxt IS NULL THEN greatest(start_ms + 50, end_ms) + 500
          ELSE least(greatest(greatest(start_ms + 50, end_ms),
                              CASE WHEN greatest(0, nxt - greatest(start_ms + 50, end_ms)) < 500 THEN greatest(start_ms + 50, nxt - 83)
                                   ELSE least(greatest(start_ms + 50, end_ms) + 500, greatest(start_ms + 50, nxt - 500)) END),
                     greatest(start_ms + 50, nxt - 83)) END"""
POLISHED = f"greatest(start_ms + 50, least({FULL}, spoken_end_ms + 500))"
SHOWN = "cue_id, {} start_ms, end_ms, src_text, tgt_text, {} AS n_words, continues_before, continues_after, split_source, anchor, round(off_ms, 3) AS off_ms, round(score, 6) AS score"


def _recursive(sql: str) -> str:
    """The query with the cue view in front, as a recursive WITH list."""
    from cuelake.sources.tables import CUES_SQL

    return CUES_SQL.replace("WITH", "WITH RECURSIVE", 1) + sql


def plain_split_sql(shown: str, source: str) -> str:
    """Cues of ``source`` cut by their text alone."""
    kind = "STRUCT(start_ms BIGINT, end_ms BIGINT, word VARCHAR, aligned BOOLEAN)[]"
    head = f", spoken AS (SELECT *, NULL::{kind} AS words FROM ({source}))" + HEAD
    return _recursive(head + split_sql("q", "s0").rstrip(",") + f" SELECT {shown} FROM q_out")


@P.add(
    "display_split",
    _recursive(
        SPOKEN_SQL + HEAD + split_sql("q", "s0").rstrip(",")
        + f" SELECT {SHOWN.format('media_id, piece,', 'coalesce(len(words), 0)')} FROM q_out"
    ),
)
def display_split(spark, sf):
    rows = layout.split_long(spoken(spark, sf))
    return rows.select(
        "cue_id", "media_id", F.col("piece").cast("long").alias("piece"), "start_ms", "end_ms", "src_text", "tgt_text",
        F.coalesce(F.size("words"), F.lit(0)).cast("long").alias("n_words"), "continues_before", "continues_after", "split_source", "anchor",
        F.round("off_ms", 3).alias("off_ms"), F.round("score", 6).alias("score"),
    )


CHAIN_SQL = (
    SPOKEN_SQL + HEAD.replace("place, *,", "place, 0 AS piece, *,")
    + _placed_sql("c1", "s0") + _ends_sql("c2", "c1", BEFORE_NEXT) + _ends_sql("c3", "c2", f"greatest({LEAST}, start_ms + CASE WHEN {LEAST} <= start_ms THEN 50 ELSE 0 END)")
    + split_sql("q", "c3") + _placed_sql("c4", "q_out") + _ends_sql("c5", "c4", POLISHED)
    + split_sql("r", "c5") + _placed_sql("c6", "r_out") + _ends_sql("c7", "c6", BEFORE_NEXT)
    + f"""
    c8 AS (SELECT *, end_ms - start_ms > 7000 AS clamped, least(end_ms, start_ms + 7000) AS e FROM c7)
    SELECT media_id, cue_id, place, start_ms, e AS end_ms, src_text, tgt_text, continues_before, continues_after, split_source, clamped,
           start_ms - spoken_start_ms AS shift_start_ms, e - spoken_end_ms AS shift_end_ms, e - start_ms < 834 AS duration_violation,
           coalesce(lead(start_ms) OVER ({ORDER}) - e < 83, false) OR coalesce(start_ms - lag(e) OVER ({ORDER}) < 83, false) AS gap_violation
    FROM c8"""
)


@P.add("display_cues", _recursive(CHAIN_SQL))
def display_cues(spark, sf):
    return layout.display_cues(spoken(spark, sf)).select(
        "media_id", "cue_id", F.col("place").cast("long").alias("place"), "start_ms", "end_ms", "src_text", "tgt_text", "continues_before",
        "continues_after", "split_source", "clamped", "shift_start_ms", "shift_end_ms", "duration_violation", "gap_violation",
    )


def _full_width(x: str) -> str:
    """Display width in hundredths, white space included."""
    return (
        f"(100 * length({x}) - 45 * length(regexp_replace({x}, '[^0-9A-Za-z]', '', 'g'))"
        rf" - 65 * length(regexp_replace({x}, '[^\x00-\x7f]|[0-9A-Za-z]', '', 'g')))"
    )


TWO_LINES_SQL = rf"""
    , f AS (SELECT cue_id, trim(regexp_replace(replace(replace(coalesce(x, ''), '\n', chr(10)), chr(10), ' '), '[ \t　]+', ' ', 'g'), {WS}) AS t FROM src),
    i AS (SELECT cue_id, t, {_full_width("t")} AS total, unnest(range(1, length(t))) AS i FROM f WHERE {_full_width("t")} > 1600),
    u AS (SELECT *, {_full_width("substr(t, 1, i)")} AS top, substr(t, i, 1) AS a, substr(t, i + 1, 1) AS b FROM i),
    k AS (SELECT *, total - top AS low,
            CASE WHEN contains('！？…、”》」』ー～', b) THEN 8000
                 WHEN regexp_matches(a, '[0-9A-Za-z]') AND regexp_matches(b, '[0-9A-Za-z]') THEN 12000
                 WHEN contains('！？…、”》」』', a) THEN 0 WHEN trim(a, {WS}) = '' THEN 200
                 WHEN regexp_matches(a, '[ぁ-ゟ]') AND regexp_matches(b, '[一-鿿]') THEN 1000 ELSE 2000 END AS own FROM u),
    r AS (SELECT cue_id, t, i FROM k QUALIFY row_number() OVER (PARTITION BY cue_id ORDER BY
            own + CASE WHEN top > low THEN (top - low) * 12 ELSE (low - top) * 3 END + CASE WHEN least(top, low) <= 200 THEN 16000 ELSE 0 END
            + 60 * (greatest(0, top - 1600) + greatest(0, low - 1600)), i) = 1),
    z AS (SELECT f.cue_id, f.t, trim(substr(f.t, 1, r.i), {WS}) AS a, trim(substr(f.t, r.i + 1), {WS}) AS b FROM f LEFT JOIN r USING (cue_id))
    SELECT cue_id, CASE WHEN a <> '' AND b <> '' THEN a || chr(10) || b ELSE t END AS lines FROM z"""


def _mixed_script(text: Column) -> Column:
    """Latin vowels and some consonants as kana and Han, so that script borders and wide signs occur."""
    return F.translate(text, "aeioustnr", "あえ火おう水と人ー")


MIXED_SQL = ", src AS (SELECT cue_id, {} AS x FROM cues)"
MIXED = "translate(tgt_text || ' ' || src_text, 'aeioustnr', 'あえ火おう水と人ー')"


def _bilingual(spark, sf) -> DataFrame:
    return cues(spark, sf).select("cue_id", F.concat("tgt_text", F.lit(" "), "src_text").alias("x"))


@P.add("two_line_display", MIXED_SQL.format(MIXED) + TWO_LINES_SQL, over_cues=True)
def two_line_display(spark, sf):
    rows = _bilingual(spark, sf)
    return rows.select("cue_id", layout.two_lines(_mixed_script(F.col("x"))).alias("lines"))


@P.add(
    "rendered_display",
    rf""", nn AS (SELECT cue_id, translate({MIXED}, '?!０１２３４５６７８９', '？！0123456789') AS x FROM cues),
    o AS (SELECT cue_id, regexp_replace(regexp_replace(x, '([…⋯‥]|\.{{3,}}|。{{2,}}|・{{3,}}|·{{3,}})+', '…', 'g'), '([？！])[？！]+', '\1', 'g') AS x FROM nn),
    m AS (SELECT cue_id, regexp_replace(regexp_replace(x, '([0-9]),([0-9])', '\1' || chr(1) || '\2', 'g'), '([0-9]),([0-9])', '\1' || chr(1) || '\2', 'g') AS x FROM o),
    p AS (SELECT cue_id, string_split(regexp_replace(replace(regexp_replace(x, '[，,。]', ' ', 'g'), chr(1), ','), '"([^"\n]*)"', '“\1”', 'g'), chr(10)) AS ls FROM m),
    src AS (SELECT cue_id, array_to_string(list_filter(list_transform(ls, lambda l:
              trim(regexp_replace(trim(regexp_replace(l, '[ \t　]+', ' ', 'g')), '、+$', ''))), lambda l: l <> ''), chr(10)) AS x FROM p)"""
    + TWO_LINES_SQL,
    over_cues=True,
)
def rendered_display(spark, sf):
    rows = _bilingual(spark, sf)
    return rows.select("cue_id", layout.two_lines(normal.display_text(_mixed_script(F.col("x")))).alias("lines"))


@P.add(
    "greedy_display",
    _recursive(
        MIXED_SQL.format(f"replace({MIXED}, 'd', '、')")
        + rf""",
    l AS (SELECT cue_id, unnest(string_split(replace(x, '\n', chr(10)), chr(10))) AS line, generate_subscripts(string_split(replace(x, '\n', chr(10)), chr(10)), 1) AS k FROM src),
    g(cue_id, k, step, head, rest) AS (
      SELECT cue_id, k, 0, '', trim(line, {WS}) FROM l
      UNION ALL
      SELECT cue_id, k, step + 1, trim(substr(rest, 1, cut), {WS}), trim(substr(rest, cut + 1), {WS}) FROM (
        SELECT *, CASE WHEN length(s) > 0 THEN length(s) WHEN length(b) > 0 THEN length(b) ELSE 16 END AS cut FROM (
          SELECT *, regexp_extract(rest, '(?s)^.{{1,16}}[，、。！？…]') AS s, regexp_extract(rest, '(?s)^(.{{0,14}}[ぁ-ゟ])[一-鿿]', 1) AS b
          FROM g WHERE length(rest) > 16))),
    o AS (SELECT cue_id, k, step, head AS part FROM g WHERE step > 0
          UNION ALL SELECT cue_id, k, step + 1, rest FROM g WHERE length(rest) <= 16)
    SELECT cue_id, coalesce(string_agg(part, chr(10) ORDER BY k, step) FILTER (WHERE part <> ''), '') AS lines FROM o GROUP BY cue_id"""
    ),
)
def greedy_display(spark, sf):
    rows = _bilingual(spark, sf)
    return rows.select("cue_id", layout.greedy_lines(F.translate(_mixed_script(F.col("x")), "d", "、")).alias("lines"))
