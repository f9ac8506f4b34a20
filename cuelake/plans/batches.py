"""Queries that send rows in batches through a fallible function, and look for JSON values in free text."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuelake.functions import payload
from cuelake.operators import batchmap, caching
from cuelake.plans.registry import Plans
from cuelake.sources.tables import table

P = Plans()


def _picky(items: list[tuple[int, str]]) -> dict[int, str]:
    """Answers in brackets; leaves out texts whose size and the number of asked ones add up to a multiple of three; cannot read seven."""
    if len(items) == 7:
        raise ValueError("seven")
    return {i: f"<{t}>" for i, t in items if (len(t) + len(items)) % 3}


LADDER_SQL = """
    WITH RECURSIVE t AS (SELECT conv_id % 7 AS job, row_number() OVER (PARTITION BY conv_id % 7 ORDER BY conv_id, turn) - 1 AS id, coalesce(text, '') AS text FROM conversations),
    b AS (SELECT job, id // 8 AS batch, list({'id': id, 'n': length(text)} ORDER BY id) AS items FROM t GROUP BY ALL),
    r(job, batch, pending, failed, lim, requests, stop) AS (
      SELECT job, batch, items, 0, 3, 0, false FROM b
      UNION ALL
      SELECT job, batch, rest, CASE WHEN len(pending) = 7 THEN failed + 1 WHEN len(rest) = 0 OR len(rest) < len(pending) THEN 0 ELSE failed + 1 END,
             CASE WHEN len(pending) <> 7 AND len(rest) > 0 AND len(rest) < len(pending) THEN 2 ELSE lim END, requests + 1, false
      FROM (SELECT *, CASE WHEN len(pending) = 7 THEN pending ELSE list_filter(pending, lambda x: (x.n + len(pending)) % 3 = 0) END AS rest FROM r
            WHERE len(pending) > 0 AND requests < 6 AND failed < lim)),
    f AS (SELECT job, batch, pending, requests FROM r QUALIFY row_number() OVER (PARTITION BY job, batch ORDER BY requests DESC) = 1)"""


@P.add(
    "batch_answers",
    LADDER_SQL
    + """ SELECT t.job::VARCHAR AS job, t.id // 8 AS batch, t.id, CASE WHEN NOT list_contains(list_transform(f.pending, lambda x: x.id), t.id) THEN '<' || text || '>' END AS answer,
           f.requests, list_contains(list_transform(f.pending, lambda x: x.id), t.id) AS given_up
    FROM t JOIN f ON f.job = t.job AND f.batch = t.id // 8""",
)
def batch_answers(spark, sf):
    """Every turn's answer after the retries of its batch of eight, with the number of requests."""
    turns = table(spark, sf, "conversations").select((F.col("conv_id") % 7).alias("job"), F.struct("conv_id", "turn").alias("pos"), "text")
    ladder = batchmap.Ladder(size=8, most=6)
    found = batchmap.answered(batchmap.in_batches(turns, ladder.size), _picky, ladder)
    return found.select("job", "batch", "id", "answer", "requests", F.col("error").isNotNull().alias("given_up"))


@P.add(
    "routed_results",
    """
    WITH c AS (SELECT DISTINCT sha1(coalesce(text, '')) AS key, 'c' || length(text) AS value FROM conversations WHERE conv_id % 3 = 0),
    r AS (SELECT conv_id * 1000 + turn AS id, CASE WHEN turn % 5 = 4 THEN ' ' ELSE text END AS text FROM conversations)
    SELECT r.id, CASE WHEN trim(coalesce(text, '')) = '' THEN '-' ELSE coalesce(c.value, CASE WHEN r.id % 2 = 0 THEN 'f' || length(text) END, '-') END AS value,
           CASE WHEN trim(coalesce(text, '')) = '' THEN 'empty' WHEN c.value IS NOT NULL THEN 'cached' WHEN r.id % 2 = 0 THEN 'finalized' ELSE 'missing' END AS route
    FROM r LEFT JOIN c ON c.key = sha1(coalesce(text, ''))""",
)
def routed_results(spark, sf):
    """Turns by three routes: blank ones, those whose text a third of the conversations knows, and the rest, half of which gets a value."""
    turns = table(spark, sf, "conversations")
    key = caching.text_key(F.col("text"))
    cache = turns.where("conv_id % 3 = 0").select(key.alias("key"), F.expr("concat('c', length(text))").alias("value")).distinct()
    text = F.when(F.col("turn") % 5 == 4, " ").otherwise(F.col("text"))
    rows = turns.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), text.alias("text")).withColumn("key", key)
    return batchmap.routed(rows, cache, lambda r: r.where("id % 2 = 0").select("id", F.expr("concat('f', length(text))").alias("value")), "-")


WRAPS = ("{}", "```json\n{}\n```", "Sure {{here}} it is: {} and [1, 2] more", 'it\'s "quoted {{" then {} }}', "[3] before {} after", "{} {{\"k\": 99}}")


@P.add(
    "json_in_text",
    "SELECT event_id, json_extract(props, '$.k')::BIGINT AS k, event_id % 7 <> 6 AS found FROM events WHERE event_id % 7 <> 6"
    " UNION ALL SELECT event_id, NULL, false FROM events WHERE event_id % 7 = 6",
)
def json_in_text(spark, sf):
    """The properties of every event inside a text of one of six kinds, or no object at all."""
    props = F.col("props")
    around = [w.split("{}") for w in (x.replace("{{", "\u0001").replace("}}", "\u0002") for x in WRAPS)]
    texts = [F.concat(F.lit(a.replace("\u0001", "{").replace("\u0002", "}")), props, F.lit(b.replace("\u0001", "{").replace("\u0002", "}"))) for a, b in around]
    text = F.coalesce(F.get(F.array(*texts), (F.col("event_id") % 7).cast("int")), F.concat(F.lit("none: "), F.replace(props, F.lit("}"), F.lit(""))))
    value = payload.json_value(text, need_object=True)
    rows = table(spark, sf, "events").select("event_id", value.alias("v"))
    return rows.select("event_id", F.get_json_object("v", "$.k").cast("long").alias("k"), F.col("v").isNotNull().alias("found"))
