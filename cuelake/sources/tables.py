"""Reading the tables of a folder, and the cue view over events and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cue_id, media_id, start_ms, end_ms, src_text, tgt_text.

    Every event is a cue of its user's medium; a month is compressed to an hour.
    Texts are slices of two documents.  Only the first 70 characters of a document
    travel through the joins.
    """
    docs = table(spark, sf_dir, "documents")
    n_docs = docs.agg(F.count(F.lit(1))).scalar()
    heads = docs.select("doc_id", F.substring("text", 1, 70).alias("head"))
    e = table(spark, sf_dir, "events").select(
        "event_id",
        F.col("user_id").alias("media_id"),
        F.expr("(unix_micros(cast(ts as timestamp)) % 2592000000000L) div 7200000L").alias("start_ms"),
        F.expr("200 + (event_id * 7919) % 9000").alias("dur_ms"),
        F.expr("case when event_id % 11 = 0 then user_id else event_id end").alias("k"),
    )
    a, b = heads.toDF("a_id", "a_head"), heads.toDF("b_id", "b_head")
    e = e.withColumns({"a_id": F.col("k") % n_docs, "b_id": (F.col("k") + 1) % n_docs}).join(a, "a_id").join(b, "b_id")
    return e.select(
        F.col("event_id").alias("cue_id"),
        "media_id",
        "start_ms",
        (F.col("start_ms") + F.col("dur_ms")).alias("end_ms"),
        F.expr("substring(a_head, cast(1 + event_id % 5 as int), cast(4 + (k * 13) % 60 as int))").alias("src_text"),
        F.expr(
            "case when event_id % 23 = 0 then '' else substring(b_head, 1, cast(3 + (event_id * 7) % 40 as int)) end"
        ).alias("tgt_text"),
    )


#: The same view for DuckDB, as the head of a WITH list.
CUES_SQL = """
WITH n AS (SELECT count(*) AS n_docs FROM documents),
e AS (SELECT event_id, user_id AS media_id, epoch_us(ts) % 2592000000000 // 7200000 AS start_ms,
             200 + (event_id * 7919) % 9000 AS dur_ms,
             CASE WHEN event_id % 11 = 0 THEN user_id ELSE event_id END AS k FROM events),
cues AS (
  SELECT event_id AS cue_id, media_id, start_ms, start_ms + dur_ms AS end_ms,
         substr(a.text, cast(1 + event_id % 5 AS int), cast(4 + (k * 13) % 60 AS int)) AS src_text,
         CASE WHEN event_id % 23 = 0 THEN ''
              ELSE substr(b.text, 1, cast(3 + (event_id * 7) % 40 AS int)) END AS tgt_text
  FROM e CROSS JOIN n
  JOIN documents a ON a.doc_id = e.k % n.n_docs
  JOIN documents b ON b.doc_id = (e.k + 1) % n.n_docs)
"""
