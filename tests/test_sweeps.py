"""Sweeps against plain Python, sizes by bisection in batch form and as a stream, job life cycles and sinks."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from cuelake.operators import intervals, sweeps
from cuelake.plans.sweeps import as_tries
from cuelake.streaming import sizes


def slow_kept(pauses, total, c):
    """Milliseconds that a configuration keeps, as a set."""
    cut = set()
    for a, b in pauses:
        if b - a >= c["min_blank_ms"]:
            cut |= set(range(max(a, 0), min(b, total)))
    runs, at = [], None
    for t in [*range(total), None]:
        free = t is not None and t not in cut
        if free and at is None:
            at = t
        elif not free and at is not None:
            runs.append([at, total if t is None else t])
            at = None
    joined = []
    for a, b in runs:
        if joined and a - joined[-1][1] <= c["merge_gap_ms"]:
            joined[-1][1] = b
        else:
            joined.append([a, b])
    kept = set()
    for a, b in joined:
        if b - a >= c["min_speech_ms"]:
            kept |= set(range(max(0, a - c["pad_ms"]), min(total, b + c["pad_ms"])))
    return kept


def test_sweep(spark):
    rng = random.Random(2)
    total = 300
    configs = {"all": {"min_blank_ms": 10**6, "min_speech_ms": 0}, "a": {"min_blank_ms": 10, "min_speech_ms": 20, "merge_gap_ms": 5, "pad_ms": 3}, "b": {"min_blank_ms": 4, "min_speech_ms": 0, "merge_gap_ms": 30, "pad_ms": 0}}
    pauses = {m: [(s := rng.randrange(-20, 310), s + rng.randrange(0, 40)) for _ in range(8)] for m in "xyz"} | {"w": [], "v": [(-5, 400)]}
    spans = [(m, i, rng.choice(["speech", "noise"]), s := rng.randrange(0, 280), min(total, s + rng.randrange(0, 30))) for m in pauses for i in range(6)]
    p = spark.createDataFrame([(m, a, b) for m, ps in pauses.items() for a, b in ps], "media string, start_ms long, end_ms long")
    s = spark.createDataFrame(spans, "media string, span_id long, label string, start_ms long, end_ms long")
    got = {(r["config"], r["label"]): r for r in sweeps.pregate_sweep(p, s, "media", total, configs).collect()}
    for name, c in configs.items():
        kept = {m: slow_kept(ps, total, {**sweeps.DEFAULT, **c}) for m, ps in pauses.items()}
        for label in ("speech", "noise"):
            mine = [(m, a, b) for m, _, k, a, b in spans if k == label]
            r = got[name, label]
            assert r["labelled_ms"] == sum(b - a for _, a, b in mine)
            assert r["kept_ms"] == sum(len(kept[m] & set(range(a, b))) for m, a, b in mine)
            assert r["decoded_ms"] == sum(map(len, kept.values())) and r["lost_ms"] == r["labelled_ms"] - r["kept_ms"]
    assert got["all", "speech"]["lost_ms"] == 0 and got["all", "speech"]["decode_fraction"] == 1.0


def test_size_after_each_event():
    p = sizes.Profile()
    steps = [
        (("success", 8, 100.0, 1000.0, 32), (8, None, 20)),  # room: midway to 33
        (("oom", 20, 0.0, 0.0, 32), (8, 20, 14)),
        (("success", 14, 900.0, 1000.0, 32), (14, 20, 14)),  # no room: stay
        (("success", 14, 100.0, 1000.0, 32), (14, 20, 17)),
        (("oom", 10, 0.0, 0.0, 32), (9, 10, 9)),  # a failure takes back what lies above
        (("success", 10, 0.0, 0.0, 32), (10, None, 10)),  # no budget: no growth
        (("oom", 1, 0.0, 0.0, 32), (0, 1, 1)),
        (("success", 64, 1.0, 1000.0, 32), (64, None, 64)),
    ]
    for n, (event, expected) in enumerate(steps, 1):
        p = sizes.after(p, *event)
        assert (p.safe, p.unsafe, p.recommended, p.n) == (*expected, n)


def test_sizes_as_a_stream(spark, sf_dir, tmp_path):
    events = as_tries(spark.read.parquet(f"{sf_dir}/events.parquet"))
    for part in range(3):
        events.where(F.floor(F.col("seq") * 3 / 1000) == part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = sizes.stream_profiles(stream).writeStream.outputMode("update").format("memory").queryName("sizes").trigger(availableNow=True).start()
    q.awaitTermination(120)
    last = {}
    for r in spark.table("sizes").collect():
        if r["key"] not in last or r["n"] > last[r["key"]]["n"]:
            last[r["key"]] = r
    batch = {r["key"]: tuple(r) for r in sizes.profiles(events).collect()}
    assert {k: tuple(r) for k, r in last.items()} == batch and len(batch) > 5
    known = spark.createDataFrame([("a", 40), ("b", 7), ("c", 0)], "key string, recommended long")
    rows = spark.createDataFrame([("a",), ("b",), ("c",), ("d",), (None,)], "key string")
    found = sizes.recommended(rows, known, F.lit(4), F.lit(16)).collect()
    assert {r["key"]: r["recommended"] for r in found} == {"a": 16, "b": 7, "c": 1, "d": 4, None: 4}


@pytest.mark.parametrize("rows", [[], [("a", 1, "oom", 0, 0.0, 0.0, 8)]])
def test_sizes_of_few_events(spark, rows):
    events = spark.createDataFrame(rows, "key string, seq long, kind string, size long, peak double, budget double, maximum long")
    assert [tuple(r) for r in sizes.profiles(events).collect()] == [("a", 0, 1, 1, 1, "oom", 1) for _ in rows]


def test_lives_as_a_stream(spark, sf_dir, tmp_path):
    from cuelake.plans.sweeps import as_commands
    from cuelake.streaming import jobs

    commands = as_commands(spark.read.parquet(f"{sf_dir}/events.parquet"))
    for part in range(3):
        commands.where(F.floor(F.col("seq") * 3 / 1000) == part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    commands.where("seq < 100").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))  # seen already
    stream = spark.readStream.schema(commands.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = jobs.job_lives(stream).writeStream.outputMode("update").format("memory").queryName("lives").trigger(availableNow=True).start()
    q.awaitTermination(120)
    last = {}
    for r in spark.table("lives").collect():
        if r["last_seq"] >= last.get(r["job"], (0, 0, 0, -2))[3]:
            last[r["job"]] = tuple(r)
    batch = {r["job"]: tuple(r) for r in jobs.final_lives(commands).collect()}
    assert last == batch and len({v[1] for v in batch.values()}) > 1


def test_steps_of_a_life():
    from cuelake.streaming.jobs import step

    path = [("create", "queued", 1), ("finish", "queued", 1), ("start", "running", 1), ("create", "running", 1), ("fail", "failed", 1), ("cancel", "failed", 1),
            ("retry", "queued", 2), ("remove", "cancelled", 2), ("retry", "queued", 3), ("start", "running", 3), ("finish", "done", 3), ("retry", "done", 3), ("remove", "", 0), ("cancel", "", 0)]
    status, n = "", 0
    for command, expected, attempts in path:
        status, n = step(status, n, command)
        assert (status, n) == (expected, attempts), command


def test_fan_out_writes_once(spark, tmp_path):
    from cuelake.streaming import jobs

    schema = "job string, seq long, stage string, phase string, extra map<string,string>"
    rows = [("a", 1, "asr", "start", {"current": "1", "other": "x"}), ("a", 2, "timing_summary", "end", {}), (None, 3, "asr", "x", None), ("b", 4, None, "y", {"total": "9"})]
    for k, r in enumerate(rows):
        spark.createDataFrame([r], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    fails = [True]

    def progress(batch):
        if fails.pop() if fails else False:
            raise OSError("down")
        return jobs.progress_of(batch)

    sinks = {"all": lambda b: b.select("job", "seq"), "progress": progress, "of_a": lambda b: jobs.of_job(b, "a").select("seq")}
    args = (sinks, str(tmp_path / "out"), str(tmp_path / "ck"))
    q = jobs.fan_out(stream(), *args)
    with pytest.raises(Exception, match="down"):
        q.awaitTermination(60)
    first = {str(p): p.stat().st_mtime_ns for p in (tmp_path / "out" / "all").rglob("part-*")}
    assert first and not (tmp_path / "out" / "progress").exists()
    jobs.fan_out(stream(), *args).awaitTermination(60)  # the batch is replayed: its committed part stays
    assert all(p in first.keys() or "batch=0" not in p for p in map(str, (tmp_path / "out" / "all").rglob("part-*")))
    read = lambda sink: spark.read.parquet(str(tmp_path / "out" / sink))
    assert sorted(r["seq"] for r in read("all").collect()) == [1, 2, 3, 4] and sorted(r["seq"] for r in read("of_a").collect()) == [1, 2, 3]
    found = {r["seq"]: (r["job"], r["current"], r["total"]) for r in read("progress").collect()}
    assert found == {1: ("a", "1", None), 4: ("b", None, "9")}


def test_sweep_reads_its_input_few_times(spark):
    """The gaps are one pass, a medium without pauses is known by an empty span, spans are not repeated for every configuration."""
    pauses = spark.createDataFrame([(1, 1000, 9000), (1, 20000, 21000)], "m long, start_ms long, end_ms long")
    spans = spark.createDataFrame([(1, 1, "a", 0, 5000), (2, 2, "b", 100, 40000)], "m long, span_id long, label string, start_ms long, end_ms long")
    found = sweeps.pregate_sweep(pauses, spans, "m", 40_000)
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("Window ") <= 14 and plan.count("Join") <= 4
    got = {(r["config"], r["label"]): (r["kept_ms"], r["lost_ms"]) for r in found.collect()}
    assert got["keep_everything", "a"] == (5000, 0) and got["default", "b"] == (39900, 0) and got["default", "a"] == (1150, 3850)


def test_holes_of_whole_and_empty_keys(spark):
    rows = spark.createDataFrame([("a", 100, 100), ("b", 0, 100), ("b", 100, 100), ("c", 10, 20), ("c", 15, 30)], "k string, start_ms long, end_ms long")
    assert sorted(map(tuple, intervals.holes(rows, "k", 0, 100).collect())) == [("a", 0, 100), ("c", 0, 10), ("c", 30, 100)]
