"""Small tables with nulls, ties, repeats, long texts and clashing column names."""

from __future__ import annotations

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, r string, h long, sha string, suspect boolean"
LINE = "this very line is found in many documents"


def rows():
    base = [
        (1, "Alpha beta gamma delta epsilon zeta eta theta"), (2, "ALPHA beta gamma delta epsilon zeta eta theta"),
        (3, None), (4, ""), (5, "   \n\t "), (6, "Ünïcode ÉÀ text"), (7, "ünïcode éà text"), (8, f"first\n{LINE}\nlast"),
        (9, f"{LINE.upper()}  \nmore"), (10, f"\n  {LINE}\n{LINE}"), (10, f"\n  {LINE}\n{LINE}"), (None, "null id text"), (None, "null id text"),
        (11, "word " * 30_000), (12, "x" * 50_000), (13, "one\x0btwo\x1cthree four"), (14, "null id TEXT"), (15, f"{LINE}\n{LINE}\nend"),
    ]
    return [(i, t, None if i == 6 else "en", None if i == 7 else f"src{(i or 0) % 3}", None, "r", 5, "sha", True) for i, t in base]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(rows(), SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/labels.parquet")
