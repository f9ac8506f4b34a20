"""Report sinks: relative paths, Markdown, replacement as a whole, the hard fail."""

from __future__ import annotations

import json
import os

import pytest
from pyspark.sql import functions as F

from cuelake.sources import reports

SCHEMA = "video string, path string, nested struct<at:string,n:int>, all array<string>, ratio double, n long, warnings array<string>"
ROWS = [
    ("a", "/p/root/x/y", ("/p/root", 1), ["/p/root/1", "/p/rooted", "other"], 0.25, 3, ["too long"]), ("b", None, None, None, None, None, []), ("c", "z", (None, None), [], 1.0, 0, None),
]


def lines_of(folder, key):
    (name,) = [n for n in os.listdir(f"{folder}/markdown/video={key}") if n.endswith(".txt")]
    with open(f"{folder}/markdown/video={key}/{name}") as f:
        return f.read().split("\n")


def test_relative_paths(spark):
    found = reports.relative_paths(spark.createDataFrame(ROWS, SCHEMA), "/p/root/").orderBy("video").collect()
    assert (found[0]["path"], found[0]["nested"]["at"], found[0]["all"]) == ("x/y", ".", ["1", "/p/rooted", "other"])
    assert (found[1]["path"], found[1]["nested"], found[1]["all"]) == (None, None, None) and found[2]["path"] == "z"


def test_reports_are_written_and_replaced(spark, tmp_path):
    folder = str(tmp_path / "reports")
    frame = spark.createDataFrame(ROWS, SCHEMA)
    reports.write_reports(frame, folder, "video", ["ratio", "n"], root="/p/root")
    assert lines_of(folder, "a") == [
        "# Quality Report: a", "", "## Summary", "", "| Metric | Value |", "| --- | ---: |", "| `ratio` | 0.25 |", "| `n` | 3 |", "", "## Warnings", "", "- too long", "", "",
    ]
    assert lines_of(folder, "b")[6:12] == ["| `ratio` | N/A |", "| `n` | N/A |", "", "## Warnings", "", "- None"] and "| `ratio` | 1 |" in lines_of(folder, "c")
    with pytest.raises(RuntimeError, match="1 reports with warnings; first: a"):
        reports.write_reports(frame.withColumn("n", F.lit(9).cast("long")), folder, "video", ["ratio", "n"], hard_fail=True)
    assert "| `n` | 9 |" in lines_of(folder, "b")
    assert sorted(os.listdir(folder)) == ["json", "markdown"] or all(n.startswith((".", "json", "markdown")) and ".new-" not in n for n in os.listdir(folder))


def test_a_failed_write_leaves_the_old_one(spark, tmp_path):
    folder = str(tmp_path / "out")
    frame = spark.createDataFrame(ROWS, SCHEMA)
    reports.write_json(frame.select("video"), folder)
    broken = frame.select(F.when(F.col("video") == "c", F.raise_error(F.lit("no"))).otherwise(F.col("video")).alias("video"))
    with pytest.raises(Exception, match="no"):
        reports.write_json(broken, folder)
    assert [n for n in os.listdir(tmp_path) if "new-" in n and not n.startswith(".")] == []
    held = [json.loads(x) for n in os.listdir(folder) if n.endswith(".json") for x in open(f"{folder}/{n}")]
    assert sorted(r["video"] for r in held) == ["a", "b", "c"]
