"""Every registered query against DuckDB, or for a stable schema where SQL has no equivalent."""

from __future__ import annotations

import oracle
import pytest

from cuelake import catalog


@pytest.fixture(scope="module")
def con(sf_dir):
    return oracle.connect(sf_dir)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_equals_duckdb(spark, sf_dir, con, name):
    oracle.check(con, catalog.QUERIES[name](spark, sf_dir), catalog.ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_runs(spark, sf_dir, name):
    frame = catalog.QUERIES[name](spark, sf_dir)
    assert frame.count() > 0
    assert frame.schema == catalog.QUERIES[name](spark, sf_dir).schema


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_whole_texts_are_encoded(spark, sf_dir):
    from cuelake.sources.tables import cues

    ids = {r["char"]: r["id"] for r in catalog.QUERIES["vocab_topk"](spark, sf_dir).collect()}
    texts = {r["cue_id"]: r["src_text"] for r in cues(spark, sf_dir).where("src_text <> ''").collect()}
    got = {r["cue_id"]: r["ids"] for r in catalog.QUERIES["vocab_encode_whole"](spark, sf_dir).collect()}
    assert got == {k: [ids.get(c, 1) for c in t] for k, t in texts.items()}
    assert max(map(len, got.values())) > 5 and len({i for x in got.values() for i in x}) > 4


def test_nearest_rank_orders_distinct_values(spark):
    from cuelake.operators import stats

    values = {"a": [3, 1, 1, None, 2, 2, 2], "b": [5], "c": [None, None], None: [7, 7, 4, 9]}
    rows = spark.createDataFrame([(k, v) for k, vs in values.items() for v in vs], "lang string, n_chars long")
    for q in (0.0, 0.3, 0.5, 0.95, 1.0):
        found = stats.nearest_rank(rows, "lang", "n_chars", q)
        known = {k: sorted(v for v in vs if v is not None) for k, vs in values.items()}
        assert sorted(map(tuple, found.collect()), key=str) == sorted(
            ((k, vs[min(len(vs) - 1, int(len(vs) * q))] if vs else None) for k, vs in known.items()), key=str
        )
    assert "collect_list" not in found._jdf.queryExecution().toString()


def test_shard_plan(spark):
    """A new shard when the next row does not fit; keys apart, nulls as a key and as size 0."""
    from cuelake.operators import sequences

    sizes = {"a": [5, 5, 5, 20, 1], "b": [11, 1, None, 9, 1], None: [3, 3, 4, 1]}
    rows = spark.createDataFrame([(k, i, n) for k, ns in sizes.items() for i, n in enumerate(ns)], "by string, pos long, size long")
    got = {(r["by"], r["pos"]): r["shard"] for r in sequences.shard_plan(rows, "by", "pos", "size", 10).collect()}
    assert [got["a", i] for i in range(5)] == [0, 0, 1, 2, 3]
    assert [got["b", i] for i in range(5)] == [0, 1, 1, 1, 2]
    assert [got[None, i] for i in range(4)] == [0, 0, 0, 1]


def test_markers_span_pieces(spark):
    from cuelake.streaming import progress

    texts = {1: ["ab", "c", "", "abcab", "c"], 2: ["a", "b", "a", "b", "c"], 3: [None, "xx"], None: ["abc", "abc"]}
    rows = spark.createDataFrame([(k, i, t) for k, ts in texts.items() for i, t in enumerate(ts)], "job long, seq long, piece string")
    got = {r["job"]: r["n_markers"] for r in progress.marker_counts(rows, "abc").collect()}
    assert got == {k: "".join(t or "" for t in ts).count("abc") for k, ts in texts.items()}


def test_first_and_last_rows(spark):
    from cuelake.operators import caching

    rows = spark.createDataFrame([("a", 1, "x"), ("a", 3, None), (None, 2, "z"), (None, 5, "y")], "key string, pos long, value string")
    assert sorted(map(tuple, caching.last_writer(rows, "key", "pos").collect()), key=str) == [("a", 3, None), (None, 5, "y")]
    assert sorted(map(tuple, caching.first_occurrence(rows, ["key"], "pos").collect()), key=str) == [("a", 1, "x"), (None, 2, "z")]


def test_proportional_tokens_stay_in_their_row(spark):
    """No shuffle, no sort; cues without tokens give no rows, also between others and in slices of a batch."""
    from cuelake.operators import windows

    rows = spark.createDataFrame([(1, 0, 10, "ab 漢c"), (2, 0, 9, None), (3, 0, 9, " "), (4, 5, 8, "xyz")], "cue_id long, start_ms long, end_ms long, src_text string")
    found = windows.proportional_tokens(rows)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan and plan.count("ArrowEvalPython") == 1
    assert sorted(map(tuple, found.collect())) == [
        (1, 0, "ab", 0, 5), (1, 1, "漢", 5, 7), (1, 2, "c", 7, 10), (4, 0, "xyz", 5, 8),
    ]
