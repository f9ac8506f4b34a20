"""Streams end where the batch forms are."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from cuelake.plans.events import as_progress
from cuelake.streaming import progress


@pytest.fixture(scope="module")
def replay(spark, sf_dir, tmp_path_factory):
    """The events as three files, in order, and a stream over them one file at a time."""
    folder = str(tmp_path_factory.mktemp("replay"))
    rows = as_progress(spark.read.parquet(f"{sf_dir}/events.parquet"))
    for part in range(3):
        rows.where(F.floor(F.col("seq") * 3 / 1000) == part).coalesce(1).write.mode("append").parquet(folder)
    return rows, lambda: spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def last_rows(spark, frame, name, order):
    q = frame.writeStream.outputMode("update").format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination(120)
    seen = {}
    for r in spark.table(name).collect():
        if r["job"] not in seen or order(r) >= order(seen[r["job"]]):
            seen[r["job"]] = r
    return {k: tuple(v) for k, v in seen.items()}


def test_job_states(spark, replay):
    rows, stream = replay
    expected = {r["job"]: tuple(r) for r in progress.job_states(rows).collect()}
    assert last_rows(spark, progress.stream_job_states(stream()), "job_states", lambda r: r["n_events"]) == expected


def test_marker_counts(spark, replay):
    rows, stream = replay
    pieces = lambda f: f.select("job", "seq", F.col("phase").alias("piece"))
    expected = {r["job"]: tuple(r) for r in progress.marker_counts(pieces(rows), "gre").collect()}
    assert last_rows(spark, progress.stream_marker_counts(pieces(stream()), "gre"), "markers", lambda r: r["n_markers"]) == expected


def test_rollup(spark, replay):
    rows, stream = replay
    expected = {r["job"]: tuple(r) for r in progress.rollup(rows).collect()}
    got = {}

    def keep(batch, _):
        got.update({r["job"]: tuple(r) for r in batch.collect()})

    q = progress.stream_rollup(stream()).writeStream.outputMode("update").foreachBatch(keep).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert got == expected


def test_windowed_counts_stream(spark, replay):
    rows, stream = replay
    expected = {tuple(r) for r in progress.windowed_counts(rows, "ts").collect()}
    q = progress.windowed_counts(stream(), "ts").writeStream.outputMode("complete").format("memory").queryName("wc").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {tuple(r) for r in spark.table("wc").collect()} <= expected
