"""The batch map: its ladder of requests, runs that were killed, other settings; the resumable map; three routes."""

from __future__ import annotations

import os

import pytest

from cuelake.operators import batchmap
from cuelake.operators.batchmap import Ladder, ask

ITEMS = [(i, f"t{i}") for i in range(5)]


def script(*answers):
    """A call that gives these answers one after the other, and remembers what it was asked."""
    asked, left = [], list(answers)

    def call(items):
        asked.append([i for i, _ in items])
        answer = left.pop(0)
        if isinstance(answer, str):
            raise ValueError(answer)
        return {i: f"a{i}" for i in answer}

    call.asked = asked
    return call


def test_ladder():
    call = script([0, 1, 2], "unreadable", [3, 9], [4])
    assert ask(ITEMS, call, Ladder()) == ({i: f"a{i}" for i in range(5)}, 4, None)
    assert call.asked == [[0, 1, 2, 3, 4], [3, 4], [3, 4], [4]]
    # Failures in a row give up; a partial answer begins a shorter count.
    got, n, error = ask(ITEMS, script("x", "y", "z"), Ladder())
    assert (got, n) == ({}, 3) and "5 missing" in error and "z" in error
    got, n, error = ask(ITEMS, script([0], [0], [1], [], []), Ladder())
    assert (sorted(got), n) == ([0, 1], 5) and error.startswith("no complete answer: 3 missing, ids [2, 3, 4]")
    got, n, error = ask(ITEMS, script([0], [0], []), Ladder(partial=False))
    assert (sorted(got), n) == ([0], 3)
    got, n, error = ask(ITEMS, script([0], [1], [2]), Ladder(most=3))
    assert n == 3 and error.startswith("request cap: 2 missing")
    assert ask([], script(), Ladder()) == ({}, 0, None)
    # An empty answer is a missing one.
    assert ask([(1, "a")], lambda items: {1: ""}, Ladder(tries=2))[1:] == (2, "no complete answer: 1 missing, ids [1]; nothing new")


def table(spark, n=60):
    rows = [(f"job{i % 3}", i, None if i == 7 else " " if i == 8 else f"text {i % 40}") for i in range(n)]
    return spark.createDataFrame(rows, "job string, pos int, text string")


def counted(folder, broken=None):
    """Answers in capitals, and leaves a file for every text answered; fails for ``broken``."""

    def call(items):
        if broken in [t for _, t in items]:
            raise ValueError("broken")
        for _, t in items:
            with open(os.path.join(folder, t.replace(" ", "_")), "a") as f:
                f.write("x")
        return {i: t.upper() for i, t in items}

    return call


def asked(folder):
    return {name: os.path.getsize(os.path.join(folder, name)) for name in os.listdir(folder)}


def result(frame):
    return sorted(map(tuple, frame.select("job", "id", "text", "answer", "level").collect()), key=str)


def test_rerun_after_a_failure_gives_the_same_table(spark, tmp_path):
    for name in ("a", "b", "calls", "other"):
        (tmp_path / name).mkdir()
    rows, ladder, settings = table(spark), Ladder(size=4, tries=1), {"model": "m", "target": "de"}
    whole = result(batchmap.run_batched(rows, counted(tmp_path / "a"), str(tmp_path / "s1"), settings, ladder))
    assert {r[4] for r in whole} == {"empty", "answered"} and all(r[3] == (r[2] or "").strip().upper() for r in whole)
    with pytest.raises(RuntimeError, match="rows without an answer; first: job"):
        batchmap.run_batched(rows, counted(tmp_path / "b", broken="text 5"), str(tmp_path / "s2"), settings, ladder)
    done = asked(tmp_path / "b")
    assert 0 < len(done) < 40
    again = batchmap.run_batched(rows, counted(tmp_path / "calls"), str(tmp_path / "s2"), settings, ladder)
    assert result(again) == whole
    assert not set(asked(tmp_path / "calls")) & set(done)  # what was answered is not asked again
    third = batchmap.run_batched(rows, counted(tmp_path / "other", broken="text 5"), str(tmp_path / "s2"), settings, ladder)
    assert result(third) == whole and asked(tmp_path / "other") == {}
    other = batchmap.run_batched(rows, counted(tmp_path / "other"), str(tmp_path / "s2"), {**settings, "target": "fr"}, ladder)
    assert result(other) == whole and len(asked(tmp_path / "other")) == 40
    failed = batchmap.run_batched(rows, counted(tmp_path / "a", broken="text 5"), str(tmp_path / "s3"), settings, ladder, allow_failures=True)
    assert {r[4] for r in result(failed)} == {"empty", "answered", "failed"}
    assert batchmap.run_batched(rows.limit(0), counted(tmp_path / "a"), str(tmp_path / "s4"), settings).collect() == []


def test_resumable_map(spark, tmp_path):
    items = spark.createDataFrame([(i, f"p{i}") for i in range(6)] + [(2, "p2")], "item_id long, payload string")
    settings = {"model": "m", "effort": None, "budget": 5}
    store = str(tmp_path / "store")
    (tmp_path / "log").mkdir()

    def call(broken):
        folder = str(tmp_path / "log")

        def run(item, payload):
            with open(os.path.join(folder, item), "a") as f:
                f.write("x")
            if item == broken:
                raise KeyError(item)
            return payload.upper()

        return run

    with pytest.raises(RuntimeError, match="1 items failed; first: 4: KeyError"):
        batchmap.resumable_map(items, call("4"), store, settings)
    assert asked(tmp_path / "log") == {"0": 1, "1": 1, "2": 1, "3": 1, "4": 3, "5": 1}
    found = batchmap.resumable_map(items, call(None), store, settings)
    assert sorted((r["item_id"], r["result"]) for r in found.collect()) == [(str(i), f"P{i}") for i in range(6)]
    assert asked(tmp_path / "log")["4"] == 4 and asked(tmp_path / "log")["1"] == 1
    assert spark.read.parquet(f"{store}/attempts").count() == 5 + 3 + 1
    # One setting differs: all are pending again, the first two are taken.
    found = batchmap.resumable_map(items, call(None), store, {**settings, "budget": 6}, limit=2)
    assert sorted(r["item_id"] for r in found.collect()) == ["0", "1"]


def test_routes(spark):
    rows = spark.createDataFrame([(1, "", "k1"), (2, None, "k1"), (3, "a", "k1"), (4, "b", "k2"), (5, "c", "k3"), (6, "d", None)], "id long, text string, key string")
    cache = spark.createDataFrame([("k1", "cached")], "key string, value string")
    found = batchmap.routed(rows, cache, lambda r: r.where("id <> 5").selectExpr("id", "concat('made ', text) AS value"), "none")
    assert sorted(map(tuple, found.collect())) == [
        (1, "none", "empty"), (2, "none", "empty"), (3, "cached", "cached"), (4, "made b", "finalized"), (5, "none", "missing"), (6, "made d", "finalized"),
    ]
