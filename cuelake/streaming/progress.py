"""Progress events as a stream, and the same results in batch form.

Events are (job, batch, seq, phase, amount); ``seq`` is the order of arrival.
The streaming forms keep one small state per key and emit the latest result of
every key that a micro-batch touched; after all input their last rows equal the
batch forms.  State can go after ``TTL_MS`` without events.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

TTL_MS = 48 * 3600 * 1000
PHASES = {"done": 4, "translating": 3, "thinking": 2, "reset": 1}
ROLLUP = "job long, phase string, amount long, batches long"
JOB = "job long, status string, last_phase string, last_seq long, n_events long"


def rollup(events: DataFrame) -> DataFrame:
    """(job, phase, amount, batches) from the latest event of every batch of a job.

    done when all are done (sum), else translating if any (sum over translating
    and done), else thinking (largest), else reset (largest).
    """
    latest = events.groupBy("job", "batch").agg(F.max(F.struct("seq", "phase", "amount")).alias("last")).select("job", "last.*")
    has = lambda p: F.count_if(F.col("phase") == p)
    moved = F.sum(F.when(F.col("phase").isin("translating", "done"), F.col("amount")).otherwise(0))
    per = latest.groupBy("job").agg(
        F.count(F.lit(1)).alias("batches"), has("done").alias("done"), has("translating").alias("translating"),
        has("thinking").alias("thinking"), moved.alias("moved"), F.max("amount").alias("top"), F.sum("amount").alias("total"),
    )
    phase = (
        F.when(F.col("done") == F.col("batches"), "done").when(F.col("translating") > 0, "translating")
        .when(F.col("thinking") > 0, "thinking").otherwise("reset")
    )
    amount = F.when(phase == "done", F.col("total")).when(phase == "translating", F.col("moved")).otherwise(F.col("top"))
    return per.select("job", phase.alias("phase"), amount.alias("amount"), "batches")


def _rolled(states: dict[int, tuple[int, str, int]]) -> tuple[str, int, int]:
    phases = [p for _, p, _ in states.values()]
    amounts = [(p, a) for _, p, a in states.values()]
    if all(p == "done" for p in phases):
        return "done", sum(a for _, a in amounts), len(states)
    if "translating" in phases:
        return "translating", sum(a for p, a in amounts if p in ("translating", "done")), len(states)
    return ("thinking" if "thinking" in phases else "reset"), max(a for _, a in amounts), len(states)


def stream_rollup(events: DataFrame) -> DataFrame:
    """``rollup`` over a stream: a row for each job whenever it changes."""

    def step(key: tuple[Any, ...], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        seqs, phases, amounts, batches = ([], [], [], []) if not state.exists else map(list, state.get)
        known = {b: (s, p, a) for b, s, p, a in zip(batches, seqs, phases, amounts, strict=True)}
        for f in frames:
            for b, s, p, a in zip(f["batch"], f["seq"], f["phase"], f["amount"], strict=True):
                if b not in known or known[b][0] < s:
                    known[int(b)] = (int(s), str(p), int(a))
        state.update(tuple(map(list, (*zip(*known.values(), strict=True), known.keys()))))
        state.setTimeoutDuration(TTL_MS)
        phase, amount, n = _rolled(known)
        yield pd.DataFrame({"job": [key[0]], "phase": [phase], "amount": [amount], "batches": [n]})

    return events.groupBy("job").applyInPandasWithState(
        step, ROLLUP, "seqs array<long>, phases array<string>, amounts array<long>, batches array<long>", "update",
        GroupStateTimeout.ProcessingTimeTimeout,
    )


def job_states(events: DataFrame, terminal: str = "done") -> DataFrame:
    """(job, status, last_phase, last_seq, n_events): events after the first terminal one no longer count."""
    end = F.min(F.when(F.col("phase") == terminal, F.col("seq"))).over(Window.partitionBy("job"))
    live = events.withColumn("end", end).where("end is null or seq <= end")
    per = live.groupBy("job").agg(F.max(F.struct("seq", "phase")).alias("last"), F.count(F.lit(1)).alias("n_events"))
    status = F.when(F.col("last.phase") == terminal, "finished").otherwise("running")
    return per.select("job", status.alias("status"), F.col("last.phase").alias("last_phase"), F.col("last.seq").alias("last_seq"), "n_events")


def stream_job_states(events: DataFrame, terminal: str = "done") -> DataFrame:
    """``job_states`` over a stream whose events arrive in order within a job."""

    def step(key: tuple[Any, ...], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        phase, seq, n = state.get if state.exists else ("", -1, 0)
        rows = pd.concat(list(frames)).sort_values("seq")
        for s, p in zip(rows["seq"], rows["phase"], strict=True):
            if phase == terminal:
                break
            phase, seq, n = str(p), int(s), n + 1
        state.update((phase, seq, n))
        state.setTimeoutDuration(TTL_MS)
        status = "finished" if phase == terminal else "running"
        yield pd.DataFrame({"job": [key[0]], "status": [status], "last_phase": [phase], "last_seq": [seq], "n_events": [n]})

    return events.groupBy("job").applyInPandasWithState(
        step, JOB, "phase string, seq long, n long", "update", GroupStateTimeout.ProcessingTimeTimeout
    )


def _markers(tail: str, text: str, marker: str) -> tuple[int, str]:
    """(markers that end in ``text``, what of it may begin another): a marker may span pieces."""
    text = tail + text
    rest = text[text.rfind(marker) + len(marker) :] if marker in text else text
    return text.count(marker), rest[max(0, len(rest) - len(marker) + 1) :]


def marker_counts(pieces: DataFrame, marker: str) -> DataFrame:
    """(job, n_markers) in the pieces of a job put together in order; a marker may span pieces.

    Sorted pieces stream through with a tail shorter than the marker; a job's text is
    never put together, so a job of any size needs no memory.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        job: tuple | None = None
        tail, n = "", 0
        kind = None
        for b in batches:
            done, kind = [], b.schema.field(0).type
            for j, piece in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if (j,) != job:
                    if job is not None:
                        done.append((job[0], n))
                    job, tail, n = (j,), "", 0
                found, tail = _markers(tail, piece or "", marker)
                n += found
            columns = list(zip(*done, strict=True)) or [(), ()]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], kind), pa.array(columns[1], pa.int64())], ["job", "n_markers"])
        if job is not None:
            yield pa.RecordBatch.from_arrays([pa.array([job[0]], kind), pa.array([n], pa.int64())], ["job", "n_markers"])

    dealt = pieces.select("job", "seq", "piece").repartition("job").sortWithinPartitions("job", "seq")
    return dealt.select("job", "piece").mapInArrow(run, f"job {pieces.schema['job'].dataType.simpleString()}, n_markers long")


def stream_marker_counts(pieces: DataFrame, marker: str) -> DataFrame:
    """``marker_counts`` over a stream: the state is the count and a tail shorter than the marker, dropped after ``TTL_MS`` of silence."""

    def step(key: tuple[Any, ...], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        tail, n = state.get if state.exists else ("", 0)
        rows = pd.concat(list(frames)).sort_values("seq")
        found, tail = _markers(tail, "".join(rows["piece"]), marker)
        state.update((tail, n + found))
        state.setTimeoutDuration(TTL_MS)
        yield pd.DataFrame({"job": [key[0]], "n_markers": [n + found]})

    return pieces.groupBy("job").applyInPandasWithState(
        step, "job long, n_markers long", "tail string, n long", "update", GroupStateTimeout.ProcessingTimeTimeout
    )


def rolling_ledger(requests: DataFrame, key: str, ts_us: str, amount: str) -> DataFrame:
    """Per request: count and amount of its key in the last 60 seconds and 24 hours, itself included."""
    w = Window.partitionBy(key).orderBy(ts_us)
    minute, day = w.rangeBetween(-60_000_000, 0), w.rangeBetween(-86_400_000_000, 0)
    return requests.select(
        "*",
        F.count(F.lit(1)).over(minute).alias("n_60s"), F.sum(amount).over(minute).alias("amount_60s"),
        F.count(F.lit(1)).over(day).alias("n_24h"), F.sum(amount).over(day).alias("amount_24h"),
    )


def stage_events(lines: DataFrame, line: str) -> DataFrame:
    """(stage, phase, extra) of log lines like ``[stage] phase k=v k=v``; others go."""
    pattern = r"^\[(\w+)\] (\w+)((?: \w+=\S+)*)\s*$"
    part = lambda k: F.regexp_extract(line, pattern, k)
    extra = F.when(part(3) != "", F.str_to_map(F.btrim(part(3)), F.lit(" "), F.lit("=")))
    return lines.where(F.col(line).rlike(pattern)).select("*", part(1).alias("stage"), part(2).alias("phase"), extra.alias("extra"))


def windowed_counts(events: DataFrame, ts: str, minutes: int = 60) -> DataFrame:
    """Event-time tumbling counts with a watermark; works on streams and tables."""
    timed = events.withWatermark(ts, "10 minutes") if events.isStreaming else events
    per = timed.groupBy(F.window(ts, f"{minutes} minutes").alias("w"), "phase").agg(F.count(F.lit(1)).alias("n"), F.sum("amount").alias("amount"))
    return per.select(F.unix_micros("w.start").alias("window_us"), "phase", "n", "amount")
