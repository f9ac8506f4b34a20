"""Queries with dynamic programming, ordered state, frames and evaluation."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from cuelake.functions import kernels
from cuelake.operators import evaluation, intervals, layout, sequences
from cuelake.plans.layout import plain_split_sql
from cuelake.plans.media import MERGED
from cuelake.plans.registry import Plans
from cuelake.plans.texts import WS
from cuelake.sources.tables import cues, table

P = Plans()
ASCII = "regexp_replace(coalesce({}, ''), '[^A-Za-z]', '', 'g')"


@P.add(
    "timeline_metrics",
    """, ra AS (SELECT * FROM cues WHERE cue_id % 2 = 0), pb AS (SELECT * FROM cues WHERE cue_id % 2 = 1), """
    + MERGED.format(name="x", source="ra", gap=0) + ", " + MERGED.format(name="y", source="pb", gap=0)
    + """, xs AS (SELECT media_id, sum(end_ms - start_ms)::BIGINT AS ref_ms FROM x GROUP BY 1),
    ys AS (SELECT media_id, sum(end_ms - start_ms)::BIGINT AS pred_ms FROM y GROUP BY 1),
    sh AS (SELECT x.media_id, sum(least(x.end_ms, y.end_ms) - greatest(x.start_ms, y.start_ms))::BIGINT AS shared_ms
          FROM x JOIN y ON x.media_id = y.media_id AND x.start_ms < y.end_ms AND y.start_ms < x.end_ms GROUP BY 1),
    al AS (SELECT coalesce(xs.media_id, ys.media_id) AS media_id, coalesce(ref_ms, 0) AS ref_ms, coalesce(pred_ms, 0) AS pred_ms
          FROM xs FULL JOIN ys ON xs.media_id = ys.media_id)
    SELECT media_id, ref_ms, pred_ms, coalesce(shared_ms, 0) AS shared_ms, coalesce(shared_ms, 0) / nullif(ref_ms, 0) AS recall,
           coalesce(shared_ms, 0) / nullif(pred_ms, 0) AS precision FROM al LEFT JOIN sh USING (media_id)""",
    over_cues=True,
)
def timeline_metrics(spark, sf):
    c = cues(spark, sf)
    return evaluation.timeline_metrics(c.where("cue_id % 2 = 0"), c.where("cue_id % 2 = 1"))


@P.add(
    "matched_texts",
    """
    SELECT a.media_id, a.cue_id, coalesce(a.tgt_text, '') AS ref_text, coalesce(string_agg(coalesce(b.tgt_text, ''), '' ORDER BY b.start_ms, b.end_ms, b.cue_id), '') AS pred_text
    FROM cues a LEFT JOIN cues b ON a.media_id = b.media_id AND b.cue_id % 2 = 1
     AND least(a.end_ms, b.end_ms) - greatest(a.start_ms, b.start_ms) >= 100 AND a.start_ms < b.end_ms
    WHERE a.cue_id % 2 = 0 GROUP BY ALL""",
    over_cues=True,
)
def matched_texts(spark, sf):
    c = cues(spark, sf)
    return evaluation.matched_texts(c.where("cue_id % 2 = 0"), c.where("cue_id % 2 = 1"), "tgt_text")


@P.add("character_errors")
def character_errors(spark, sf):
    c = cues(spark, sf)
    return evaluation.character_errors(evaluation.matched_texts(c.where("cue_id % 2 = 0"), c.where("cue_id % 2 = 1"), "tgt_text"))


@P.add(
    "edit_distance",
    f"SELECT cue_id, levenshtein({ASCII.format('src_text')}, {ASCII.format('tgt_text')})::INT AS distance, length({ASCII.format('src_text')}) AS chars FROM cues",
    over_cues=True,
)
def edit_distance(spark, sf):
    a, b = (F.regexp_replace(F.coalesce(c, F.lit("")), "[^A-Za-z]", "") for c in ("src_text", "tgt_text"))
    rows = cues(spark, sf).select("cue_id", a.alias("a"), b.alias("b"))
    return rows.select("cue_id", F.levenshtein("a", "b").alias("distance"), F.length("a").alias("chars"))


@P.add("edit_counts")
def edit_counts(spark, sf):
    return cues(spark, sf).select("cue_id", sequences.edit_counts(F.col("src_text"), F.col("tgt_text")).alias("e")).select("cue_id", "e.*")


@P.add("common_subsequence")
def common_subsequence(spark, sf):
    return cues(spark, sf).select("cue_id", sequences.common_subsequence(F.col("src_text"), F.col("tgt_text")).alias("lcs"))


@P.add("tandem_repeat")
def tandem_repeat(spark, sf):
    return cues(spark, sf).select("cue_id", sequences.tandem_repeat(F.col("src_text")).alias("r")).select("cue_id", "r.*")


@P.add(
    "wrapped_lines",
    f"""
    , t AS (SELECT cue_id, coalesce(tgt_text, '') AS t FROM cues),
    i AS (SELECT cue_id, t, unnest(range(1, length(t)))::INTEGER AS i FROM t WHERE length(t) > 20),
    p AS (SELECT cue_id, t, i, rtrim(substr(t, 1, i), {WS}) AS a, ltrim(substr(t, i + 1), {WS}) AS b FROM i),
    k AS (SELECT *, row_number() OVER (PARTITION BY cue_id ORDER BY greatest(0, length(a) - 20) + greatest(0, length(b) - 20), NOT contains(substr(t, i, 2), ' '),
                 abs(length(a) - length(b)) + (length(a) > length(b))::INTEGER, i) AS rn FROM p)
    SELECT cue_id, a || chr(10) || b AS lines FROM k WHERE rn = 1 UNION ALL SELECT cue_id, t FROM t WHERE length(t) <= 20""",
    over_cues=True,
)
def wrapped_lines(spark, sf):
    return cues(spark, sf).select("cue_id", sequences.wrapped(F.col("tgt_text"), 20).alias("lines"))


@P.add(
    "long_display_split",
    plain_split_sql(
        "media_id, cue_id, piece::INTEGER AS piece, src_text AS text, start_ms AS piece_start_ms, end_ms AS piece_end_ms, continues_before AS continues",
        "SELECT * FROM cues WHERE end_ms - start_ms > 7000",
    ),
)
def long_display_split(spark, sf):
    """The pieces of cues longer than seven seconds, by their text alone."""
    long = cues(spark, sf).where("end_ms - start_ms > 7000")
    return layout.split_long(long).select(
        "media_id", "cue_id", "piece", F.col("src_text").alias("text"), F.col("start_ms").alias("piece_start_ms"),
        F.col("end_ms").alias("piece_end_ms"), F.col("continues_before").alias("continues"),
    )


@P.add("cut_at_pauses")
def cut_at_pauses(spark, sf):
    pauses = intervals.gaps(cues(spark, sf), "media_id", 0, 400_000)
    return sequences.cut_at_pauses(pauses, "media_id", 400_000)


@P.add(
    "shard_plan",
    """
    WITH RECURSIVE d AS (SELECT source, doc_id, coalesce(length(text), 0) AS size, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents),
    r AS (SELECT source, doc_id, rn, 0 AS shard, size AS used FROM d WHERE rn = 1
          UNION ALL SELECT d.source, d.doc_id, d.rn, CASE WHEN r.used > 0 AND r.used + d.size > 20000 THEN r.shard + 1 ELSE r.shard END,
                           CASE WHEN r.used > 0 AND r.used + d.size > 20000 THEN d.size ELSE r.used + d.size END
          FROM r JOIN d ON d.source IS NOT DISTINCT FROM r.source AND d.rn = r.rn + 1)
    SELECT source, doc_id, shard FROM r""",
)
def shard_plan(spark, sf):
    rows = table(spark, sf, "documents").select("source", "doc_id", F.length("text").alias("size"))
    return sequences.shard_plan(rows, "source", "doc_id", "size", 20_000)


@P.add(
    "balanced_split",
    """
    WITH RECURSIVE g AS (SELECT source, sum(toxic)::BIGINT AS p, count(*) AS s FROM documents JOIN labels USING (doc_id) GROUP BY source),
    o AS (SELECT *, row_number() OVER (ORDER BY p DESC, s DESC, sha256('s4:' || source)) AS rn FROM g),
    r AS (SELECT source, rn, 0 AS part, p AS p0, s AS s0, 0::BIGINT AS p1, 0::BIGINT AS s1, 0::BIGINT AS p2, 0::BIGINT AS s2 FROM o WHERE rn = 1
          UNION ALL SELECT source, rn, k, p0 + CASE WHEN k = 0 THEN p ELSE 0 END, s0 + CASE WHEN k = 0 THEN s ELSE 0 END, p1 + CASE WHEN k = 1 THEN p ELSE 0 END,
                           s1 + CASE WHEN k = 1 THEN s ELSE 0 END, p2 + CASE WHEN k = 2 THEN p ELSE 0 END, s2 + CASE WHEN k = 2 THEN s ELSE 0 END
          FROM (SELECT o.*, p0, s0, p1, s1, p2, s2, CASE WHEN row(p0, s0) <= row(p1, s1) AND row(p0, s0) <= row(p2, s2) THEN 0 WHEN row(p1, s1) <= row(p2, s2) THEN 1 ELSE 2 END AS k
                FROM r JOIN o ON o.rn = r.rn + 1))
    SELECT source, part FROM r""",
)
def balanced_split(spark, sf):
    docs = table(spark, sf, "documents").drop("text").join(table(spark, sf, "labels"), "doc_id")
    groups = docs.groupBy("source").agg(F.sum("toxic").alias("positives"), F.count(F.lit(1)).alias("size"))
    return sequences.balanced_split(groups, "source", "positives", "size", 3, "s4")


FRAMES = "WITH f AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS frame, unnest(embedding) AS value FROM embeddings)"


def _frames(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("frame", "value"))


@P.add(
    "blank_runs",
    FRAMES + """, b AS (SELECT vec_id, frame, frame - row_number() OVER (PARTITION BY vec_id ORDER BY frame) AS island FROM f WHERE value < 0)
    SELECT vec_id, min(frame) AS start_frame, max(frame) + 1 AS end_frame FROM b GROUP BY vec_id, island HAVING count(*) >= 3""",
)
def blank_runs(spark, sf):
    return sequences.blank_runs(_frames(spark, sf), "vec_id", F.col("value") < 0, 3)


@P.add(
    "frame_fill",
    FRAMES + """, k AS (SELECT vec_id, frame, CASE WHEN value >= 0 THEN frame END AS known FROM f)
    SELECT vec_id, frame, coalesce(last_value(known IGNORE NULLS) OVER (PARTITION BY vec_id ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
           first_value(known IGNORE NULLS) OVER (PARTITION BY vec_id ORDER BY frame ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS filled FROM k""",
)
def frame_fill(spark, sf):
    known = _frames(spark, sf).select("vec_id", "frame", F.when(F.col("value") >= 0, F.col("frame")).alias("known"))
    return known.select("vec_id", "frame", sequences.filled(known, "vec_id", "known").alias("filled"))


@P.add(
    "blank_confusion",
    """
    WITH f AS (SELECT label, unnest(embedding) AS value FROM embeddings)
    SELECT label, count(*) FILTER (WHERE value < 0) AS blank, count(*) FILTER (WHERE value >= 0) AS speech,
           count(*) FILTER (WHERE value < 0) / count(*) AS blank_rate FROM f GROUP BY label""",
)
def blank_confusion(spark, sf):
    blank = F.col("value") < 0
    return _frames(spark, sf).groupBy("label").agg(
        F.count_if(blank).alias("blank"), F.count_if(~blank).alias("speech"), (F.count_if(blank) / F.count(F.lit(1))).alias("blank_rate")
    )


@P.add(
    "frame_labels",
    """
    , s AS (SELECT media_id, cue_id AS pos, start_ms, end_ms, CASE WHEN cue_id % 3 = 0 THEN 'pause' ELSE 'speech' END AS label FROM cues),
    x AS (SELECT media_id, pos, label, unnest(range(start_ms // 1000, least((end_ms + 999) // 1000, 400))) AS frame FROM s WHERE start_ms < 400000),
    t AS (SELECT media_id, frame, arg_max(label, pos) AS label FROM x GROUP BY ALL)
    SELECT g.media_id, g.frame, coalesce(t.label, 'unsure') AS label
    FROM (SELECT media_id, unnest(range(400)) AS frame FROM (SELECT DISTINCT media_id FROM s)) g LEFT JOIN t USING (media_id, frame)""",
    over_cues=True,
)
def frame_labels(spark, sf):
    label = F.when(F.col("cue_id") % 3 == 0, "pause").otherwise("speech")
    spans = cues(spark, sf).select("media_id", F.col("cue_id").alias("pos"), "start_ms", "end_ms", label.alias("label"))
    return sequences.frame_labels(spans, "media_id", "label", 1000, 400)


@P.add("forced_align")
def forced_align(spark, sf):
    """Targets 1-3 by label against four log-probabilities per frame taken from the vector."""

    @F.arrow_udf("array<struct<first int, stop int, score double>>")
    def run(vectors: pa.Array, labels: pa.Array) -> pa.Array:
        out = []
        for v, k in zip(vectors, labels, strict=True):
            x = np.array(v.as_py(), float).reshape(-1, 4)
            logp = x - np.log(np.exp(x).sum(axis=1, keepdims=True))
            found = kernels.forced_align(logp, [1 + k.as_py() % 3, 2, 2, 3])
            out.append([{"first": a, "stop": b, "score": s} for a, b, s in found or []])
        return pa.array(out, pa.list_(pa.struct([("first", pa.int32()), ("stop", pa.int32()), ("score", pa.float64())])))

    spans = run(F.col("embedding"), F.col("label"))
    return table(spark, sf, "embeddings").select("vec_id", F.posexplode(spans).alias("k", "s")).select("vec_id", "k", "s.*")
