"""Events to several sinks at once, and the life of jobs as keyed state with a deadline.

Events are (job, seq, stage, phase, extra: map of strings).  Commands are (job, seq,
command): create, start, finish, fail, cancel, retry, remove.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# What of an event's extra fields becomes progress, and the stage that carries none.
PROGRESS = ("translated", "expected", "content_chars", "reasoning_chars", "current", "total", "attempt")
SILENT = "timing_summary"
FINISHED, RETRYABLE = ("done", "failed", "cancelled"), ("failed", "cancelled")
LIFE = "job string, status string, n_attempts long, last_seq long"
STATE = "status string, n_attempts long, last_seq long"


def progress_of(events: DataFrame) -> DataFrame:
    """(job, seq, stage, phase, and a column for every progress field): events of named jobs, timing summaries aside."""
    named = events.where((F.coalesce("job", F.lit("")) != "") & (F.coalesce("stage", F.lit("")) != SILENT))
    return named.select("job", "seq", "stage", "phase", *(F.try_element_at("extra", F.lit(k)).alias(k) for k in PROGRESS))


def of_job(events: DataFrame, job: str | Column) -> DataFrame:
    """The events that a listener to one job sees: its own, and those of no job at all."""
    return events.where((F.col("job") == job) | (F.coalesce("job", F.lit("")) == ""))


def _has(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def fan_out(events: DataFrame, sinks: dict[str, Callable[[DataFrame], DataFrame]], folder: str, checkpoint: str, name: str | None = None) -> StreamingQuery:
    """Write what each sink makes of a micro-batch to ``folder``/sink/batch=N, once.

    Nothing is dropped when a reader is slow: sinks are tables.  A sink's part of a
    batch is committed by its ``_SUCCESS`` file; a batch that is replayed after a
    failure writes only the parts that are not committed yet.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        held = batch.persist()
        try:
            for sink, make in sinks.items():
                path = f"{folder}/{sink}/batch={number}"
                if not _has(spark, f"{path}/_SUCCESS"):
                    make(held).write.mode("overwrite").parquet(path)
        finally:
            held.unpersist()

    out = events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    return (out.queryName(name) if name else out).start()


def step(status: str, attempts: int, command: str) -> tuple[str, int]:
    """(status, attempts) after a command; one that does not fit the status changes nothing.

    '' is no job.  Only a queued job starts, only a running one finishes or fails;
    finished jobs cannot be cancelled, only failed and cancelled ones go round again,
    and removing a live job cancels it.
    """
    live = status not in ("", *FINISHED)
    if command == "create" and status == "":
        return "queued", 1
    if command == "start" and status == "queued":
        return "running", attempts
    if command in ("finish", "fail") and status == "running":
        return ("done" if command == "finish" else "failed"), attempts
    if command in ("cancel", "remove") and live:
        return "cancelled", attempts
    if command == "retry" and status in RETRYABLE:
        return "queued", attempts + 1
    if command == "remove" and status in FINISHED:
        return "", 0
    return status, attempts


def job_lives(commands: DataFrame, expire_ms: int | None = None) -> DataFrame:
    """(job, status, n_attempts, last_seq) of a stream of commands (job, seq, ts, command), a row per job and micro-batch.

    Commands of a job apply in the order of ``seq``; one that was seen already, by
    its ``seq``, changes nothing, so a removed job (``removed``) keeps its last ``seq``.
    With ``expire_ms`` a job without commands for so long, by the watermark on ``ts``,
    shows as ``expired`` and is forgotten: that is what bounds the state.
    """

    def run(key: tuple[Any, ...], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            status, attempts, seq = state.get
            state.remove()
            yield pd.DataFrame({"job": [key[0]], "status": ["expired"], "n_attempts": [attempts], "last_seq": [seq]})
            return
        status, attempts, last = state.get if state.exists else ("", 0, -1)
        rows = pd.concat(list(frames)).sort_values("seq")
        latest = 0
        for seq, command, ts in zip(rows["seq"], rows["command"], rows["ts"], strict=True):
            latest = max(latest, int(ts.timestamp() * 1000))
            if seq > last:
                (status, attempts), last = step(status, attempts, command), int(seq)
        state.update((status, attempts, last))
        if expire_ms is not None:
            state.setTimeoutTimestamp(max(latest, state.getCurrentWatermarkMs()) + expire_ms)
        yield pd.DataFrame({"job": [key[0]], "status": [status or "removed"], "n_attempts": [attempts], "last_seq": [last]})

    timeout = GroupStateTimeout.NoTimeout if expire_ms is None else GroupStateTimeout.EventTimeTimeout
    return commands.groupBy("job").applyInPandasWithState(run, LIFE, STATE, "update", timeout)


def final_lives(commands: DataFrame) -> DataFrame:
    """The same for a table of all commands, as a fold over each job's ordered commands; a job has few of them."""
    ordered = commands.groupBy("job").agg(F.array_sort(F.collect_list(F.struct("seq", "command"))).alias("c"))
    start = F.struct(F.lit("").alias("status"), F.lit(0).cast("long").alias("n"), F.lit(-1).cast("long").alias("seq"))

    def after(s: Column, x: Column) -> Column:
        status, n, c = s["status"], s["n"], x["command"]
        live = ~status.isin("", *FINISHED)
        new = (
            F.when((c == "create") & (status == ""), "queued").when((c == "start") & (status == "queued"), "running")
            .when((c == "finish") & (status == "running"), "done").when((c == "fail") & (status == "running"), "failed")
            .when(c.isin("cancel", "remove") & live, "cancelled").when((c == "retry") & status.isin(*RETRYABLE), "queued")
            .when((c == "remove") & status.isin(*FINISHED), "").otherwise(status)
        )
        more = F.when((c == "create") & (status == ""), F.lit(1)).when((c == "retry") & status.isin(*RETRYABLE), n + 1).when(new == "", F.lit(0)).otherwise(n)
        moved = F.struct(new.alias("status"), more.cast("long").alias("n"), x["seq"].cast("long").alias("seq"))
        return F.when(x["seq"] > s["seq"], moved).otherwise(s)

    folded = ordered.withColumn("s", F.aggregate("c", start, after))
    status = F.when(F.col("s.status") == "", "removed").otherwise(F.col("s.status"))
    return folded.select("job", status.alias("status"), F.col("s.n").alias("n_attempts"), F.col("s.seq").alias("last_seq"))
