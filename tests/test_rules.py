"""Fixed rules by hand: what display text must not hold, glossary terms, context lines, noise."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from cuelake.functions import normal
from cuelake.functions import text as tx
from cuelake.operators import context
from cuelake.plans.texts import noise_segments


def values(spark, texts, expression):
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return [r[0] for r in frame.orderBy("i").select(expression(F.col("t"))).collect()]


def test_banned_punctuation(spark):
    golden = {
        "甲，乙。": 2, "a.b": 0, "a?b": 1, "停！": 0, "停？！": 1, "停?!": 2, "嗯…": 0, "嗯……": 1, "嗯⋯": 1, "嗯‥": 1, "嗯...": 1, "嗯..": 0,
        "1,000": 0, "1,000,000": 0, "1, 2": 1, "a,1": 1, ",": 1, "a;b:c": 0, "<i>轻</i>": 2, "</ I >": 1, "<b>": 0, "": 0, None: 0, "１,０": 0,
    }
    assert values(spark, list(golden), tx.banned_punctuation) == list(golden.values())


def test_usable_terms(spark):
    golden = {"what?": False, "what": True, " 姓名 ": True, "姓，名": False, "a b": False, "": False, None: False, "12345678": True, "123456789": False, "誰？": False, "、": False}
    assert values(spark, list(golden), normal.term_is_usable) == list(golden.values())


def test_glossary_pairs_and_lines(spark):
    rows = [(1, i, f"s{i}", f"t{i}") for i in range(20)] + [(2, 0, "long source", "x"), (2, 1, "a", "b?"), (2, 2, " a ", "b"), (2, 3, "a", "c"), (2, 4, "肉", "x")]
    pairs = spark.createDataFrame(rows, "doc long, pos long, source string, target string")
    usable = context.usable_pairs(pairs, "doc", "pos")
    assert sorted(r["pos"] for r in usable.where("doc = 1").collect()) == list(range(15))
    known = spark.createDataFrame([("s3",), ("s3",), ("肉棒",)], "source string")
    found = {r["doc"]: r["terms"].split("\n") for r in context.formatted_terms(usable, "doc", "pos", known).collect()}
    assert found == {1: [f"s{i}-t{i}" for i in range(15) if i != 3], 2: ["a-b", "肉-x"]}


def test_glossary_files_in_order(spark, tmp_path):
    pair = lambda a, b: {"ja": a, "zh": b}
    files = {
        "film.translation_global_glossary.json": {"terms": [pair("own", " 1 "), pair("", "x")]}, "translation_global_glossary.json": [pair("common", "2")],
        "translation_global_glossary.b.json": {"terms": [pair("b", "3")]}, "translation_global_glossary.a.json": {"terms": [pair("a", "4")]},
        "other.translation_global_glossary.json": {"terms": [pair("other", "5")]}, "translation_global_glossary.c.json": {"no": "terms"},
    }
    for name, payload in files.items():
        (tmp_path / name).write_text(json.dumps(payload))
    (tmp_path / "translation_global_glossary.z.json").write_text("{broken")
    found = context.read_glossaries(spark, str(tmp_path), "film").orderBy("place", "pos").collect()
    assert [(r["source"], r["target"]) for r in found] == [("own", "1"), ("common", "2"), ("a", "4"), ("b", "3")]


@pytest.mark.parametrize("most", [5, 60, 100_000])
def test_context_lines(spark, most):
    rows = [(1, i, 1000 * i + 5, 1000 * i + 994, ["one", " \n", "three  words\n here", None][i % 4]) for i in range(700)] + [(2, 1, 0, 1, "")]
    cues = spark.createDataFrame(rows, "media_id long, cue_id long, start_ms long, end_ms long, text string")
    lines = [f"{i:04d} [{i}.01->{i}.99] {['one', '', 'three words here'][i % 4]}" for i in range(700) if i % 4 in (0, 2)]
    ((media, text),) = context.context_lines(cues, "text", most).collect()
    assert (media, text) == (1, "\n".join(lines)[:most])


def test_noise_is_limited_by_medium(spark, sf_dir):
    found = noise_segments(spark, sf_dir)
    assert found.groupBy("media_id").count().agg(F.max("count")).first()[0] <= 50 and found.select("media_id").distinct().count() > 1
