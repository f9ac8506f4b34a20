"""Queries over the event table: progress, ledgers, JSON, calendars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuelake.functions import timecode as tc
from cuelake.operators import flags
from cuelake.plans.registry import Plans
from cuelake.sources.tables import table
from cuelake.streaming import progress

P = Plans()
PHASE = {"purchase": "done", "click": "translating", "view": "thinking"}
EVENTS = """
    WITH v AS (SELECT user_id AS job, event_id % 4 AS batch, event_id AS seq, try_cast(json_extract_string(props, '$.k') AS BIGINT) AS amount, ts,
                 CASE event_type WHEN 'purchase' THEN 'done' WHEN 'click' THEN 'translating' WHEN 'view' THEN 'thinking' ELSE 'reset' END AS phase
          FROM events)"""


def as_progress(events: DataFrame) -> DataFrame:
    """(job, batch, seq, amount, ts, phase) from the event table."""
    phase = F.lit("reset")
    for kind, name in PHASE.items():
        phase = F.when(F.col("event_type") == kind, name).otherwise(phase)
    return events.select(
        F.col("user_id").alias("job"), (F.col("event_id") % 4).alias("batch"), F.col("event_id").alias("seq"),
        F.get_json_object("props", "$.k").try_cast("long").alias("amount"), F.col("ts").cast("timestamp").alias("ts"), phase.alias("phase"),
    )


@P.add(
    "progress_rollup",
    EVENTS + """, l AS (SELECT job, batch, arg_max(phase, seq) AS phase, arg_max(amount, seq) AS amount FROM v GROUP BY ALL),
    p AS (SELECT job, count(*) AS batches, count(*) FILTER (WHERE phase = 'done') AS d, count(*) FILTER (WHERE phase = 'translating') AS t,
                 count(*) FILTER (WHERE phase = 'thinking') AS k, coalesce(sum(amount) FILTER (WHERE phase IN ('translating', 'done')), 0)::BIGINT AS moved,
                 max(amount) AS top, sum(amount)::BIGINT AS total FROM l GROUP BY job)
    SELECT job, CASE WHEN d = batches THEN 'done' WHEN t > 0 THEN 'translating' WHEN k > 0 THEN 'thinking' ELSE 'reset' END AS phase,
           CASE WHEN d = batches THEN total WHEN t > 0 THEN moved ELSE top END AS amount, batches FROM p""",
)
def progress_rollup(spark, sf):
    return progress.rollup(as_progress(table(spark, sf, "events")))


@P.add(
    "job_state",
    EVENTS + """, e AS (SELECT *, min(seq) FILTER (WHERE phase = 'done') OVER (PARTITION BY job) AS stop FROM v)
    SELECT job, CASE WHEN arg_max(phase, seq) = 'done' THEN 'finished' ELSE 'running' END AS status, arg_max(phase, seq) AS last_phase,
           max(seq) AS last_seq, count(*) AS n_events FROM e WHERE stop IS NULL OR seq <= stop GROUP BY job""",
)
def job_state(spark, sf):
    return progress.job_states(as_progress(table(spark, sf, "events")))


@P.add(
    "rolling_ledger",
    EVENTS + """, u AS (SELECT job, seq, amount, epoch_us(ts) AS us FROM v)
    SELECT job, seq, amount, us, count(*) OVER m AS n_60s, sum(amount) OVER m::BIGINT AS amount_60s, count(*) OVER d AS n_24h, sum(amount) OVER d::BIGINT AS amount_24h
    FROM u WINDOW m AS (PARTITION BY job ORDER BY us RANGE BETWEEN 60000000 PRECEDING AND CURRENT ROW),
                  d AS (PARTITION BY job ORDER BY us RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW)""".replace("OVER m::BIGINT", "OVER m").replace("OVER d::BIGINT", "OVER d"),
)
def rolling_ledger(spark, sf):
    rows = as_progress(table(spark, sf, "events")).select("job", "seq", "amount", F.unix_micros("ts").alias("us"))
    return progress.rolling_ledger(rows, "job", "us", "amount")


@P.add(
    "windowed_counts",
    EVENTS + """ SELECT epoch_us(ts) // 3600000000 * 3600000000 AS window_us, phase, count(*) AS n, sum(amount)::BIGINT AS amount FROM v GROUP BY ALL""",
)
def windowed_counts(spark, sf):
    return progress.windowed_counts(as_progress(table(spark, sf, "events")), "ts")


@P.add("json_extract_props", "SELECT event_id, try_cast(json_extract_string(props, '$.k') AS BIGINT) AS k, json_extract_string(props, '$.none') AS missing FROM events")
def json_extract_props(spark, sf):
    return table(spark, sf, "events").select(
        "event_id", F.get_json_object("props", "$.k").try_cast("long").alias("k"), F.get_json_object("props", "$.none").alias("missing")
    )


@P.add(
    "business_day_bucket",
    "SELECT ((ts + INTERVAL 8 HOUR - INTERVAL 16 HOUR)::DATE)::VARCHAR AS day, count(*) AS n, sum(value) AS total FROM (SELECT ts, floor(value * 100)::BIGINT AS value FROM events) GROUP BY 1".replace("sum(value)", "sum(value)::BIGINT"),
)
def business_day_bucket(spark, sf):
    e = table(spark, sf, "events").select(tc.quota_day(F.col("ts").cast("timestamp")).cast("string").alias("day"), F.expr("0L") + F.floor(F.col("value") * 100).alias("v"))
    return e.toDF("day", "v").groupBy("day").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("total"))


@P.add(
    "stage_peaks",
    EVENTS + """, b AS (SELECT *, coalesce(phase <> lag(phase) OVER (PARTITION BY job ORDER BY seq), true)::INT AS brk FROM v),
    i AS (SELECT *, sum(brk) OVER (PARTITION BY job ORDER BY seq) AS stage FROM b)
    SELECT job, stage::BIGINT AS stage, any_value(phase) AS phase, max(amount) AS peak, count(*) AS n FROM i GROUP BY job, stage""",
)
def stage_peaks(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("job").orderBy("seq")
    rows = as_progress(table(spark, sf, "events"))
    brk = F.coalesce(F.col("phase") != F.lag("phase").over(w), F.lit(True)).cast("long")
    staged = rows.withColumn("brk", brk).withColumn("stage", F.sum("brk").over(w))
    return staged.groupBy("job", "stage").agg(F.first("phase").alias("phase"), F.max("amount").alias("peak"), F.count(F.lit(1)).alias("n"))


@P.add(
    "marker_counts",
    EVENTS + """, t AS (SELECT job, string_agg(phase, '' ORDER BY seq) AS text FROM v GROUP BY job)
    SELECT job, (length(text) - length(replace(text, 'gre', ''))) // 3 AS n_markers FROM t""",
)
def marker_counts(spark, sf):
    rows = as_progress(table(spark, sf, "events")).select("job", "seq", F.col("phase").alias("piece"))
    return progress.marker_counts(rows, "gre")


@P.add(
    "stage_log_parse",
    EVENTS + """ SELECT seq, 's' || batch AS stage, phase, CASE WHEN amount IS NOT NULL THEN amount::VARCHAR END AS amount FROM v""",
)
def stage_log_parse(spark, sf):
    rows = as_progress(table(spark, sf, "events"))
    line = F.concat(F.lit("[s"), F.col("batch").cast("string"), F.lit("] "), F.col("phase"), F.coalesce(F.concat(F.lit(" amount="), F.col("amount").cast("string")), F.lit("")))
    parsed = progress.stage_events(rows.select("seq", line.alias("line")), "line")
    return parsed.select("seq", "stage", "phase", F.try_element_at("extra", F.lit("amount")).alias("amount"))


@P.add(
    "failure_messages",
    """SELECT event_type, CASE WHEN regexp_matches(event_type, '^p') THEN 'paid' WHEN regexp_matches(event_type, 'i') THEN 'seen' ELSE 'other' END AS message,
    count(*) AS n FROM events GROUP BY ALL""",
)
def failure_messages(spark, sf):
    message = flags.failure_message(F.col("event_type"), [("^p", "paid"), ("i", "seen")], "other")
    return table(spark, sf, "events").groupBy("event_type", message.alias("message")).agg(F.count(F.lit(1)).alias("n"))


@P.add("backoff_delays", "SELECT DISTINCT event_id % 8 AS attempt, least(20.0::DOUBLE, 1.5::DOUBLE * pow(2.0::DOUBLE, event_id % 8)) AS delay FROM events")
def backoff_delays(spark, sf):
    n = F.col("event_id") % 8
    return table(spark, sf, "events").select(n.alias("attempt"), F.least(F.lit(20.0), 1.5 * F.pow(F.lit(2.0), n)).alias("delay")).distinct()
