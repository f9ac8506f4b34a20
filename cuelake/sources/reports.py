"""Reports as JSON and Markdown, one file set per key, put in place as a whole."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StringType, StructType


def _relative(value: Column, kind: DataType, root: str) -> Column:
    """A value with the strings in it, at any depth, taken relative to ``root``."""
    if isinstance(kind, StringType):
        inside = F.startswith(value, F.lit(f"{root}/"))
        return F.when(value == root, F.lit(".")).when(inside, F.substring(value, F.lit(len(root) + 2), F.length(value))).otherwise(value)
    if isinstance(kind, ArrayType):
        return F.transform(value, lambda x: _relative(x, kind.elementType, root))
    if isinstance(kind, StructType):
        fields = F.struct(*(_relative(value.getField(f.name), f.dataType, root).alias(f.name) for f in kind.fields))
        return F.when(value.isNotNull(), fields)
    return value


def relative_paths(rows: DataFrame, root: str) -> DataFrame:
    """``rows`` with every path below ``root`` relative to it, in nested fields and arrays too; other strings stay."""
    root = root.rstrip("/")
    return rows.select(*(_relative(F.col(f"`{f.name}`"), f.dataType, root).alias(f.name) for f in rows.schema.fields))


def shown(value: Column, kind: DataType) -> Column:
    """A metric as a table cell: null as N/A, fractions with up to four digits, halves up."""
    if kind.typeName() in ("double", "float"):
        text = F.regexp_replace(F.format_string("%.4f", F.round(value.cast("double"), 4)), r"\.?0+$", "")
    else:
        text = value.cast("string")
    return F.when(value.isNull(), F.lit("N/A")).otherwise(text)


def markdown(reports: DataFrame, key: str, metrics: list[str], title: str = "Quality Report") -> DataFrame:
    """(key, pos, line): each report's lines - title, table of the metrics, warnings.

    ``reports`` has one row per key, with the metrics and ``warnings`` (array of
    strings; null or empty: none).
    """
    kinds = {f.name: f.dataType for f in reports.schema.fields}
    head = [F.concat(F.lit(f"# {title}: "), F.col(key).cast("string")), *map(F.lit, ("", "## Summary", "", "| Metric | Value |", "| --- | ---: |"))]
    cells = [F.concat(F.lit(f"| `{m}` | "), shown(F.col(f"`{m}`"), kinds[m]), F.lit(" |")) for m in metrics]
    listed = F.transform("warnings", lambda w: F.concat(F.lit("- "), w))
    warnings = F.when(F.size("warnings") > 0, listed).otherwise(F.array(F.lit("- None")))
    lines = F.concat(F.array(*head, *cells, *map(F.lit, ("", "## Warnings", ""))), warnings, F.array(F.lit("")))
    return reports.select(key, F.posexplode(lines).alias("pos", "line"))


def put(spark: SparkSession, target: str, write: Callable[[str], None]) -> None:
    """Let ``write`` fill a new folder beside ``target`` and then take its place.

    A failed write leaves the old folder as it was and nothing of the new one.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path
    new, old = path(f"{target}.new-{uuid.uuid4().hex}"), path(f"{target}.old-{uuid.uuid4().hex}")
    fs = new.getFileSystem(spark._jsc.hadoopConfiguration())
    try:
        write(new.toString())
    except BaseException:
        fs.delete(new, True)
        raise
    if fs.exists(path(target)):
        fs.rename(path(target), old)
    fs.rename(new, path(target))
    fs.delete(old, True)


def write_json(rows: DataFrame, folder: str, root: str | None = None) -> None:
    """Line-delimited JSON in ``folder``, replaced as a whole; paths relative to ``root`` if given."""
    out = rows if root is None else relative_paths(rows, root)
    put(rows.sparkSession, folder, lambda p: out.write.json(p))


def write_reports(reports: DataFrame, folder: str, key: str, metrics: list[str], root: str | None = None, hard_fail: bool = False) -> None:
    """``folder``/json and ``folder``/markdown, the latter with one folder per key, lines in order.

    With ``hard_fail`` reports with warnings fail the run, after all are written.
    """
    reports = reports if root is None else relative_paths(reports, root)
    lines = markdown(reports, key, metrics).repartition(key).sortWithinPartitions(key, "pos")
    put(reports.sparkSession, f"{folder}/json", lambda p: reports.write.json(p))
    put(reports.sparkSession, f"{folder}/markdown", lambda p: lines.select(key, F.col("line").alias("value")).write.partitionBy(key).text(p))
    if hard_fail:
        bad = reports.where(F.size("warnings") > 0).orderBy(key)
        if (first := bad.first()) is not None:
            raise RuntimeError(f"{bad.count()} reports with warnings; first: {first[key]}: {first['warnings']}")
