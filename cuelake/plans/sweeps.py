"""Parameter sweeps over interval algebra, and sizes found by bisection."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuelake.operators import intervals, sweeps
from cuelake.plans.media import MERGED, _gaps
from cuelake.plans.registry import Plans
from cuelake.sources.tables import cues, table
from cuelake.streaming import jobs, sizes

P = Plans()

CONFIGS = ", ".join(
    f"('{n}', {', '.join(str({**sweeps.DEFAULT, **c}[k]) for k in sweeps.DEFAULT)})" for n, c in sweeps.SWEEP.items()
)
SPANS_SQL = """
    SELECT media_id, cue_id AS span_id, CASE cue_id % 4 WHEN 0 THEN 'unsure' WHEN 1 THEN 'non_vocal' ELSE 'speech' END AS label,
           start_ms + 300 AS start_ms, least(end_ms + 700, 400000) AS end_ms FROM cues"""


def _of(field: str) -> str:
    """A setting of the configuration that a combined key begins with."""
    whens = " ".join(f"WHEN '{n}' THEN {({**sweeps.DEFAULT, **c})[field]}" for n, c in sweeps.SWEEP.items())
    return f"(CASE split_part(media_id, '|', 1) {whens} END)"


@P.add(
    "pregate_sweep",
    f"""
    , sp AS ({SPANS_SQL}), cf AS (SELECT * FROM (VALUES {CONFIGS}) t(config, {", ".join(sweeps.DEFAULT)})), """
    + _gaps("pz", "cues")
    + """, kp AS (SELECT config || '|' || media_id AS media_id, start_ms, end_ms FROM pz, cf WHERE end_ms - start_ms >= min_blank_ms), """
    + _gaps("bt", "kp")
    + """, al AS (SELECT media_id, start_ms, end_ms FROM bt UNION ALL
          SELECT k, 0, 400000 FROM (SELECT DISTINCT config || '|' || media_id AS k FROM sp, cf) WHERE k NOT IN (SELECT media_id FROM bt_c)), """
    + MERGED.format(name="jn", source="al", gap=_of("merge_gap_ms"))
    + f""", pd AS (SELECT media_id, greatest(0, start_ms - {_of("pad_ms")}) AS start_ms, least(400000, end_ms + {_of("pad_ms")}) AS end_ms
          FROM jn WHERE end_ms - start_ms >= {_of("min_speech_ms")}), """
    + MERGED.format(name="rg", source="pd", gap=0)
    + """, r AS (SELECT split_part(media_id, '|', 1) AS config, split_part(media_id, '|', 2)::BIGINT AS media_id, start_ms, end_ms FROM rg),
    d AS (SELECT config, sum(end_ms - start_ms)::BIGINT AS decoded_ms FROM r GROUP BY 1),
    g AS (SELECT * FROM sp WHERE end_ms > start_ms),
    l AS (SELECT label, sum(end_ms - start_ms)::BIGINT AS labelled_ms FROM g GROUP BY 1),
    k AS (SELECT config, label, sum(least(g.end_ms, r.end_ms) - greatest(g.start_ms, r.start_ms))::BIGINT AS kept_ms
          FROM g JOIN r ON r.media_id = g.media_id AND g.start_ms < r.end_ms AND r.start_ms < g.end_ms GROUP BY ALL)
    SELECT cf.config, l.label, labelled_ms, coalesce(kept_ms, 0) AS kept_ms, greatest(0, labelled_ms - coalesce(kept_ms, 0)) AS lost_ms,
           coalesce(kept_ms, 0) / labelled_ms AS recall, coalesce(decoded_ms, 0) AS decoded_ms,
           coalesce(decoded_ms, 0) / ((SELECT count(DISTINCT media_id) FROM sp) * 400000) AS decode_fraction
    FROM cf CROSS JOIN l LEFT JOIN k ON k.config = cf.config AND k.label = l.label LEFT JOIN d ON d.config = cf.config""",
    over_cues=True,
)
def pregate_sweep(spark, sf):
    """Gaps between cues are the pauses; spans a little later than the cues carry the labels."""
    c = cues(spark, sf)
    spans = c.select(
        "media_id", F.col("cue_id").alias("span_id"), F.expr("CASE cue_id % 4 WHEN 0 THEN 'unsure' WHEN 1 THEN 'non_vocal' ELSE 'speech' END").alias("label"),
        (F.col("start_ms") + 300).alias("start_ms"), F.least(F.col("end_ms") + 700, F.lit(400_000)).alias("end_ms"),
    )
    return sweeps.pregate_sweep(intervals.gaps(c, "media_id", 0, 400_000), spans, "media_id", 400_000)


@P.add(
    "safe_sizes",
    """
    WITH RECURSIVE e AS (SELECT user_id::VARCHAR AS key, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn, 1 + (event_id * 7) % 64 AS size,
                                CASE WHEN (event_id * 7) % 64 > 20 + user_id % 30 THEN 'oom' ELSE 'success' END AS kind, 100.0 + (event_id * 13) % 900 AS peak FROM events),
    r(key, rn, safe, unsafe, recommended, last_size, last_kind) AS (
      SELECT DISTINCT key, 0::BIGINT, 0::BIGINT, NULL::BIGINT, 1::BIGINT, 0::BIGINT, '' FROM e
      UNION ALL
      SELECT key, rn, s, u, greatest(1, least(most, CASE WHEN kind = 'success' THEN CASE WHEN u IS NULL THEN t ELSE least(t, greatest(1, u - 1)) END
                                                         ELSE least(t, greatest(1, u - 1)) END)), size, kind
      FROM (SELECT *, CASE WHEN kind = 'success' THEN CASE WHEN peak / 1000 < 0.8 AND coalesce(u, most + 1) - s > 1 THEN (s + coalesce(u, most + 1)) // 2 ELSE s END
                           WHEN s = 0 THEN greatest(1, size // 2) WHEN u - s > 1 THEN (s + u) // 2 ELSE s END AS t
            FROM (SELECT *, CASE WHEN kind = 'success' THEN greatest(safe, size) ELSE least(safe, greatest(0, u - 1)) END AS s
                  FROM (SELECT e.key, e.rn, e.size, e.kind, e.peak, r.safe, greatest(e.size, 48) AS most,
                               CASE WHEN e.kind = 'success' THEN CASE WHEN e.size >= r.unsafe THEN NULL ELSE r.unsafe END ELSE least(e.size, coalesce(r.unsafe, e.size)) END AS u
                        FROM r JOIN (SELECT * FROM e) e ON e.key = r.key AND e.rn = r.rn + 1))))
    SELECT key, safe, unsafe, recommended, last_size, last_kind, rn AS n FROM r QUALIFY row_number() OVER (PARTITION BY key ORDER BY rn DESC) = 1""",
)
def safe_sizes(spark, sf):
    """Every event is a try of some size by its user; sizes beyond the user's limit fail."""
    return sizes.profiles(as_tries(table(spark, sf, "events")))


def as_tries(events):
    """Events as tries (key, seq, kind, size, peak, budget, maximum)."""
    return events.select(
        F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("seq"),
        F.expr("CASE WHEN (event_id * 7) % 64 > 20 + user_id % 30 THEN 'oom' ELSE 'success' END").alias("kind"),
        F.expr("1 + (event_id * 7) % 64").alias("size"), F.expr("cast(100 + (event_id * 13) % 900 as double)").alias("peak"),
        F.lit(1000.0).alias("budget"), F.lit(48).cast("long").alias("maximum"),
    )


COMMANDS = ("create", "start", "finish", "fail", "cancel", "retry", "remove", "start", "create")


def as_commands(events):
    """Events as commands (job, seq, ts, command) to forty jobs of their user."""
    kinds = F.array(*(F.lit(c) for c in COMMANDS))
    return events.select(
        F.concat_ws("-", F.col("user_id"), F.col("event_id") % 5).alias("job"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"),
        F.element_at(kinds, (F.expr("(event_id * 31 + event_id div 5 * 7) % 9") + 1).cast("int")).alias("command"),
    )


@P.add(
    "job_lives",
    f"""
    WITH RECURSIVE e AS (SELECT user_id || '-' || event_id % 5 AS job, event_id AS seq, row_number() OVER (PARTITION BY user_id, event_id % 5 ORDER BY event_id) AS rn,
                                {list(COMMANDS)}[1 + (event_id * 31 + event_id // 5 * 7) % 9] AS c FROM events),
    r(job, rn, status, n, seq) AS (
      SELECT DISTINCT job, 0::BIGINT, '', 0::BIGINT, -1::BIGINT FROM e
      UNION ALL
      SELECT job, rn, s, CASE WHEN c = 'create' AND status = '' THEN 1 WHEN c = 'retry' AND status IN ('failed', 'cancelled') THEN n + 1 WHEN s = '' THEN 0 ELSE n END, seq
      FROM (SELECT e.job, e.rn, e.seq, e.c, r.status, r.n,
              CASE WHEN c = 'create' AND status = '' THEN 'queued' WHEN c = 'start' AND status = 'queued' THEN 'running' WHEN c = 'finish' AND status = 'running' THEN 'done'
                   WHEN c = 'fail' AND status = 'running' THEN 'failed' WHEN c IN ('cancel', 'remove') AND status IN ('queued', 'running') THEN 'cancelled'
                   WHEN c = 'retry' AND status IN ('failed', 'cancelled') THEN 'queued' WHEN c = 'remove' AND status IN ('done', 'failed', 'cancelled') THEN '' ELSE status END AS s
            FROM r JOIN (SELECT * FROM e) e ON e.job = r.job AND e.rn = r.rn + 1))
    SELECT job, CASE WHEN status = '' THEN 'removed' ELSE status END AS status, n AS n_attempts, seq AS last_seq
    FROM r QUALIFY row_number() OVER (PARTITION BY job ORDER BY rn DESC) = 1""",
)
def job_lives(spark, sf):
    return jobs.final_lives(as_commands(table(spark, sf, "events")))
