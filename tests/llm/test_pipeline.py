"""Registered queries against DuckDB, and the pipeline stage by stage."""

from __future__ import annotations

import oracle
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from cuelake.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_equals_duckdb(spark, sf_dir, name):
    oracle.check(oracle.connect(sf_dir), queries.QUERIES[name](spark, sf_dir), queries.ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE_SQL)))
def test_runs(spark, sf_dir, name):
    assert queries.QUERIES[name](spark, sf_dir).count() > 0


def test_registered():
    names = entry.queries()
    assert {n.split("_")[0] for n in names if n.startswith("op")} >= {f"op{k}" for k in range(1, 14)}
    assert "pipeline" in names and len(corpus_pipeline.STAGES) == 5


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    quality = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    before, kept = docs, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, sf_dir).cache()
        assert after.columns == docs.columns
        assert after.select("doc_id").distinct().join(before, "doc_id", "left_anti").isEmpty()
        kept.append({r["doc_id"] for r in after.select("doc_id").collect()})
        before = after
    good = {i for i, q in quality.items() if q == 1}
    assert len(kept[0] & good) > 0.95 * len(good)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    seen = [texts[i].lower() for i in kept[1]]
    assert len(set(seen)) == len(seen) and {texts[i].lower() for i in kept[0]} == set(seen)
    last = corpus_pipeline.STAGES[-1][1](spark, before, sf_dir)
    assert last.count() == before.count()
