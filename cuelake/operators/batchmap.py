"""Batches of rows through a function that may fail, answer in part, or be interrupted.

``call`` gets [(id, text), ...] and returns {id: answer}; it raises ``ValueError`` for
an answer it cannot read.  It runs in tasks, batch by batch; answers and attempts are
tables, so a run that was killed goes on where its last wave ended.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cuelake.functions import normal
from cuelake.operators import caching

Call = Callable[[list[tuple[int, str]]], dict[int, str]]
ANSWERS = "job string, batch long, id long, answer string, requests int, error string"
STORED = "row_key string, batch_key string, job string, batch long, id long, answer string, requests int, error string, signature string"


@dataclass(frozen=True)
class Ladder:
    """How often a batch is asked: ``tries`` failures in a row, ``repairs`` after a partial answer, ``most`` requests in all."""

    size: int = 16
    tries: int = 3
    repairs: int = 2
    most: int = 8
    partial: bool = True


def ask(items: list[tuple[int, str]], call: Call, ladder: Ladder) -> tuple[dict[int, str], int, str | None]:
    """(answers, requests, error).  Missing ids are asked again alone; empty answers count as missing.

    A partial answer begins a new count of ``repairs`` failures where ``partial``
    holds.  The error says why the batch was given up, with what is missing.
    """
    got: dict[int, str] = {}
    left, failed, limit, requests, why = list(items), 0, ladder.tries, 0, ""
    while left:
        if requests >= ladder.most or failed >= limit:
            ids = [i for i, _ in left]
            return got, requests, f"{'request cap' if requests >= ladder.most else 'no complete answer'}: {len(ids)} missing, ids {ids[:50]}; {why}"
        requests += 1
        try:
            answer = call(left)
        except ValueError as e:
            failed, why = failed + 1, str(e)
            continue
        before = len(left)
        got |= {i: answer[i] for i, _ in left if answer.get(i)}
        left = [(i, t) for i, t in left if i not in got]
        if left and len(left) < before and ladder.partial:
            failed, limit, why = 0, ladder.repairs, "partial answer"
        elif left:
            failed, why = failed + 1, "nothing new"
    return got, requests, None


def in_batches(rows: DataFrame, size: int) -> DataFrame:
    """``rows`` (job, pos, text, ...) with id (place in the job, from 0) and batch."""
    place = F.row_number().over(Window.partitionBy("job").orderBy("pos")).cast("long") - 1
    return rows.withColumn("id", place).withColumn("batch", F.floor(F.col("id") / size))


def answered(rows: DataFrame, call: Call, ladder: Ladder = Ladder()) -> DataFrame:
    """(job, batch, id, answer, requests, error) of all ``rows`` (job, batch, id, text); what was given up has no answer.

    A batch is a list of at most ``ladder.size`` rows, the unit of a task's work.
    """

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            out = []
            for r in part.to_pylist():
                got, requests, error = ask([(i["id"], i["text"] or "") for i in r["items"]], call, ladder)
                out += [(r["job"], r["batch"], i["id"], got.get(i["id"]), requests, None if i["id"] in got else error) for i in r["items"]]
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[k] for x in out], t) for k, t in enumerate(kinds)], ["job", "batch", "id", "answer", "requests", "error"]
            )

    items = F.array_sort(F.collect_list(F.struct("id", "text")))
    grouped = rows.groupBy(F.col("job").cast("string").alias("job"), "batch").agg(items.alias("items"))
    return grouped.mapInArrow(run, ANSWERS)


def keyed(rows: DataFrame, signature: Column) -> DataFrame:
    """``rows`` with row_key (settings and the text in normal form) and batch_key (settings, place and texts of the batch)."""
    row = caching.row_key(signature, normal.joined_lines(F.col("text")))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", F.coalesce("text", F.lit("")).alias("t")))), lambda x: x["t"]), "\u0001")
    batch = rows.groupBy("job", "batch").agg(whole.alias("texts")).withColumn("batch_key", caching.row_key(signature, F.col("batch"), F.col("texts")))
    return rows.join(batch.drop("texts"), ["job", "batch"]).withColumn("row_key", row)


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def stored_answers(spark: SparkSession, store: str, signature: str) -> DataFrame:
    """What earlier runs with these settings answered, one row per row_key; empty if nothing is stored."""
    if not _exists(spark, f"{store}/answers"):
        return spark.createDataFrame([], "row_key string, answer string")
    rows = spark.read.schema(STORED).parquet(f"{store}/answers").where((F.col("signature") == signature) & F.col("answer").isNotNull())
    return rows.groupBy("row_key").agg(F.min("answer").alias("answer"))


def run_batched(
    rows: DataFrame, call: Call, store: str, settings: dict[str, object], ladder: Ladder = Ladder(), waves: int = 4, allow_failures: bool = False
) -> DataFrame:
    """(job, id, text, answer, level) of all ``rows`` (job, pos, text), asked for only what ``store`` does not know.

    ``store`` is a folder that all nodes see; its ``answers`` are partitioned by the
    signature of ``settings``, so other settings never meet these answers.  Rows
    with empty texts are answered with an empty text.  Batches are asked in ``waves``
    chosen by their keys; each wave's answers and failures are committed before the
    next, so a killed run loses one wave at most, and rows repeated in several jobs
    may be asked several times within a wave, never after it.  Unless ``allow_failures``,
    rows without an answer fail the run at its end, after everything else is stored.
    """
    spark, sig = rows.sparkSession, caching.signature(**settings)
    signature = rows.sparkSession.range(1).select(sig).first()[0]
    all_rows = keyed(in_batches(rows.select(F.col("job").cast("string").alias("job"), "pos", "text"), ladder.size), F.lit(signature))
    filled = F.col("text").isNotNull() & (normal.stripped(F.col("text")) != "")
    for wave in range(waves):
        known = stored_answers(spark, store, signature)
        mine = all_rows.where(filled & (F.pmod(F.xxhash64("batch_key"), F.lit(waves)) == wave))
        todo = caching.pending(mine, known, "row_key")
        if todo.isEmpty():
            continue
        found = answered(todo, call, ladder).join(todo.select("job", "batch", "id", "row_key", "batch_key"), ["job", "batch", "id"])
        found.select(*(c.split()[0] for c in STORED.split(", ") if "signature" not in c), F.lit(signature).alias("signature")).write.mode(
            "append"
        ).partitionBy("signature").parquet(f"{store}/answers")
    known = stored_answers(spark, store, signature)
    out = all_rows.join(known, "row_key", "left").select(
        "job", "id", "text", F.when(filled, F.col("answer")).otherwise("").alias("answer"), F.when(~filled, "empty").otherwise("answered").alias("level")
    )
    missing = out.where("answer IS NULL")
    if not allow_failures and (first := missing.orderBy("job", "id").first()) is not None:
        raise RuntimeError(f"{missing.count()} rows without an answer; first: job {first['job']}, id {first['id']}")
    return out.withColumn("level", F.when(F.col("answer").isNull(), "failed").otherwise(F.col("level")))


def resumable_map(
    items: DataFrame, call: Callable[[str, str], str], store: str, settings: dict[str, object], attempts: int = 3, limit: int | None = None
) -> DataFrame:
    """(item_id, result, settings...) of all ``items`` (item_id, payload), calling only for those without a result of these settings.

    A result counts when its id and every setting are equal.  ``limit`` takes the
    first so many pending ids.  Results, and every attempt with its error, are
    appended to tables in ``store``; if an item failed all its attempts, the run
    fails at its end and keeps the others' results.
    """
    spark = items.sparkSession
    named = {k: F.lit("" if v is None else str(v)) for k, v in settings.items()}
    kind = "item_id string, result string, " + ", ".join(f"{k} string" for k in named)
    path = f"{store}/results"
    done = spark.read.schema(kind).parquet(path) if _exists(spark, path) else spark.createDataFrame([], kind)
    tagged = items.select(F.col("item_id").cast("string").alias("item_id"), "payload", *(v.alias(k) for k, v in named.items()))
    todo = caching.pending(tagged, done, "item_id", *named).dropDuplicates(["item_id"])
    if limit is not None:
        todo = todo.orderBy("item_id").limit(limit)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            out = []
            for r in part.to_pylist():
                for attempt in range(1, attempts + 1):
                    try:
                        out.append((r["item_id"], attempt, call(r["item_id"], r["payload"]), None))
                        break
                    except Exception as e:  # noqa: BLE001  an item's failure is a row, not the task's
                        out.append((r["item_id"], attempt, None, repr(e)))
            kinds = [pa.string(), pa.int32(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate(kinds)], ["item_id", "attempt", "result", "error"])

    # One attempts table per run: results are read from what was committed, never asked again.
    tries = f"{store}/attempts/run={1 + _runs(spark, store)}"
    todo.select("item_id", "payload").mapInArrow(run, "item_id string, attempt int, result string, error string").write.parquet(tries)
    made = spark.read.parquet(tries)
    made.where("error IS NULL").select("item_id", "result", *(v.alias(k) for k, v in named.items())).write.mode("append").parquet(path)
    failed = made.groupBy("item_id").agg(F.count_if(F.col("error").isNull()).alias("ok"), F.max_by("error", "attempt").alias("error")).where("ok = 0")
    if (first := failed.orderBy("item_id").first()) is not None:
        raise RuntimeError(f"{failed.count()} items failed; first: {first['item_id']}: {first['error']}")
    return spark.read.schema(kind).parquet(path).join(tagged.select("item_id", *named).distinct(), ["item_id", *named], "left_semi")


def _runs(spark: SparkSession, store: str) -> int:
    """How many runs have their attempts in the store."""
    if not _exists(spark, f"{store}/attempts"):
        return 0
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{store}/attempts")
    return len(at.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(at))


def routed(rows: DataFrame, cache: DataFrame, finalize: Callable[[DataFrame], DataFrame], placeholder: str = "") -> DataFrame:
    """(id, value, route) of all ``rows`` (id, text, key): empty texts get the placeholder, cached keys their value, the rest what ``finalize`` gives.

    ``cache`` is (key, value) with unique keys, ``finalize`` maps (id, text, key) to
    (id, value); rows that it leaves out get the placeholder, as route ``missing``.
    """
    empty = normal.stripped(F.col("text")) == ""
    met = rows.withColumn("empty", empty).join(cache.select("key", F.col("value").alias("held")), "key", "left")
    rest = met.where(~F.col("empty") & F.col("held").isNull()).select("id", "text", "key")
    made = finalize(rest).select("id", F.col("value").alias("made"))
    out = met.join(made, "id", "left")
    route = F.when(F.col("empty"), "empty").when(F.col("held").isNotNull(), "cached").when(F.col("made").isNotNull(), "finalized").otherwise("missing")
    value = F.when(F.col("empty"), F.lit(placeholder)).otherwise(F.coalesce("held", "made", F.lit(placeholder)))
    return out.select("id", value.alias("value"), route.alias("route"))
