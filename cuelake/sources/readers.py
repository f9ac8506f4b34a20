"""Readers for subtitle files, line-delimited JSON, manifests and audio headers.

A file is one row of Spark's text or binary source; its parts are found with
column expressions, so any number of files is read in parallel.  Malformed parts
are left out, never raised.
"""

from __future__ import annotations

import struct

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cuelake.functions import timecode as tc

# The encodings of subtitle files, in the order in which they are tried.
ENCODINGS = ("utf-8-sig", "utf-16", "gb18030", "cp932")
NON_DIALOGUE = "(?i)(title|note|staff|sign|credit|op|ed|karaoke)"


def _files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """(path, content) of every file below ``path`` whose name fits."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return found.select("path", "modificationTime", "length", "content")


def decoded(content: Column, marker: str) -> Column:
    """Text of bytes in the first encoding that reads them and shows ``marker``; null if none does."""

    @F.arrow_udf("string")
    def run(data: pa.Array) -> pa.Array:
        out = []
        for d in data:
            text = None
            for encoding in ENCODINGS:
                try:
                    found = (d.as_py() or b"").decode(encoding)
                except UnicodeError:
                    continue
                if marker in found:
                    text = found
                    break
            out.append(text)
        return pa.array(out, pa.string())

    return run(content)


def _lines_normalised(text: Column) -> Column:
    return F.regexp_replace(text, "\r\n?", "\n")


def read_srt(spark: SparkSession, path: str) -> DataFrame:
    """(path, number, start_ms, end_ms, text) of SRT files; blocks without times, text or length go."""
    text = _lines_normalised(decoded(F.col("content"), "-->"))
    blocks = _files(spark, path, "*.srt").select("path", F.posexplode(F.split(text, r"\n[ \t]*\n+")).alias("at", "block"))
    return _timed(blocks)


def read_vtt(spark: SparkSession, path: str) -> DataFrame:
    """As ``read_srt`` for WebVTT."""
    text = _lines_normalised(decoded(F.col("content"), "WEBVTT"))
    blocks = _files(spark, path, "*.vtt").select("path", F.posexplode(F.split(text, r"\n[ \t]*\n+")).alias("at", "block"))
    return _timed(blocks)


def _timed(blocks: DataFrame) -> DataFrame:
    pattern = r"(?s)(?:^|\n)[ \t]*(\d+:\d\d:\d\d[.,]\d{1,3})[ \t]*-->[ \t]*(\d+:\d\d:\d\d[.,]\d{1,3})[^\n]*\n(.*)"
    part = lambda k: F.regexp_extract("block", pattern, k)
    rows = blocks.select(
        "path", "at", tc.parse_time(part(1)).alias("start_ms"), tc.parse_time(part(2)).alias("end_ms"), F.btrim(part(3), F.lit(" \t\n")).alias("text")
    ).where("end_ms > start_ms and text <> ''")
    number = F.row_number().over(Window.partitionBy("path").orderBy("at")).cast("long")
    return rows.select("path", number.alias("number"), "start_ms", "end_ms", "text")


def ass_time(text: Column) -> Column:
    """Milliseconds of H:MM:SS.cc."""
    return tc.parse_time(F.btrim(text))


def read_ass(spark: SparkSession, path: str, excluded_styles: str = NON_DIALOGUE) -> DataFrame:
    """(path, start_ms, end_ms, style, text): dialogue of ASS files.

    The ``Format:`` line of ``[Events]`` names the columns; the last takes the
    rest of the line.  Styles that fit ``excluded_styles`` go.
    """
    text = _lines_normalised(decoded(F.col("content"), "[Events]"))
    events = F.regexp_extract(text, r"(?s)\[Events\]\s*\n(.*?)(?:\n\[|\z)", 1)
    lines = _files(spark, path, "*.ass").select("path", events.alias("events"))
    names = F.transform(F.split(F.regexp_extract("events", r"(?m)^Format:\s*(.*)$", 1), ","), lambda x: F.lower(F.btrim(x)))
    rows = lines.withColumn("names", names).select("path", "names", F.explode(F.split("events", "\n")).alias("line"))
    rows = rows.where(F.col("line").startswith("Dialogue:")).select(
        "path", "names", F.regexp_replace("line", r"^Dialogue:\s*", "").alias("line")
    )
    fields = rows.withColumn("values", F.expr("split(line, ',', size(names))"))
    get = lambda n: F.try_element_at("values", F.array_position("names", F.lit(n)).cast("int"))
    has = lambda n: F.array_contains("names", n)
    rows = fields.where(has("start") & has("end") & has("text") & has("style"))
    clean = F.btrim(F.regexp_replace(F.regexp_replace(get("text"), r"\{[^}]*\}", ""), r"\\[Nnh]", " "))
    out = rows.select("path", ass_time(get("start")).alias("start_ms"), ass_time(get("end")).alias("end_ms"), F.btrim(get("style")).alias("style"), clean.alias("text"))
    return out.where((F.col("end_ms") > F.col("start_ms")) & (F.col("text") != "") & ~F.col("style").rlike(f"^{excluded_styles}$"))


def read_subtitles(spark: SparkSession, path: str) -> DataFrame:
    """(path, start_ms, end_ms, text) of all SRT, VTT and ASS files below a folder."""
    columns = ["path", "start_ms", "end_ms", "text"]
    return read_srt(spark, path).select(columns).union(read_vtt(spark, path).select(columns)).union(read_ass(spark, path).select(columns))


def read_bilingual_json(spark: SparkSession, path: str) -> DataFrame:
    """(path, start_ms, end_ms, text) of JSON documents with ``blocks`` of start, end (seconds) and zh or text."""
    schema = "blocks array<struct<start string, end string, zh string, text string>>"
    rows = spark.read.schema(schema).json(path, multiLine=True).select(F.col("_metadata.file_path").alias("path"), F.explode("blocks").alias("b"))
    ms = lambda c: F.expr("0L") + F.round(F.col(c).try_cast("double") * 1000).try_cast("long")
    text = F.btrim(F.coalesce(F.nullif(F.col("b.zh"), F.lit("")), F.col("b.text")))
    return rows.select("path", ms("b.start").alias("start_ms"), ms("b.end").alias("end_ms"), text.alias("text")).where(
        "start_ms is not null and end_ms is not null and text <> ''"
    )


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Line-delimited JSON with a fixed schema; corrupt lines go, the file stays as ``source_file``."""
    full = T.StructType.fromDDL(schema).add("_corrupt", T.StringType())
    rows = spark.read.schema(full).option("columnNameOfCorruptRecord", "_corrupt").json(path)
    return rows.select("*", F.col("_metadata.file_path").alias("source_file")).where("_corrupt is null").drop("_corrupt")


def read_keyed(spark: SparkSession, path: str) -> DataFrame:
    """(key, value) of an append-only cache of one file per writer: the last line of a key counts.

    Lines are ordered by file name and place; corrupt lines and null keys go.
    """
    lines = spark.read.text(path).select(
        F.from_json("value", "key string, value string").alias("kv"),
        F.struct(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i")).alias("at"),
    )
    known = lines.where("kv.key is not null and kv.value is not null")
    return known.groupBy(F.col("kv.key").alias("key")).agg(F.max(F.struct("at", F.col("kv.value").alias("v"))).alias("last")).select("key", F.col("last.v").alias("value"))


def read_manifest(spark: SparkSession, *paths: str) -> DataFrame:
    """(manifest, text, duration_s, source): manifests of many files, field names coalesced, bad numbers as null."""
    schema = "text string, sentence string, transcription string, duration_s string, duration string, source string"
    rows = spark.read.schema(schema).json(list(paths))
    first = lambda *names: F.coalesce(*(F.nullif(F.btrim(n), F.lit("")) for n in names))
    return rows.select(
        F.col("_metadata.file_path").alias("manifest"), first("text", "sentence", "transcription").alias("text"),
        F.coalesce(*(F.col(n).try_cast("double") for n in ("duration_s", "duration"))).alias("duration_s"), first("source").alias("source"),
    )


def newest_files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """(folder, path): the newest file of every folder."""
    found = _files(spark, path, pattern).select(F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("folder"), "path", "modificationTime")
    return found.groupBy("folder").agg(F.max(F.struct("modificationTime", "path")).alias("last")).select("folder", "last.path")


def read_wav_durations(spark: SparkSession, path: str) -> DataFrame:
    """(path, duration_ms) of WAV files from their headers; null when the header is broken.

    Spark reads whole files; only a header's 4 KB reach Python.
    """

    @F.arrow_udf("struct<rate long, data_at long, data_size long>")
    def header(heads: pa.Array) -> pa.Array:
        out = []
        for h in heads:
            out.append(_wav_header(h.as_py() or b""))
        return pa.array(out, pa.struct([("rate", pa.int64()), ("data_at", pa.int64()), ("data_size", pa.int64())]))

    rows = _files(spark, path, "*.wav").select("path", "length", header(F.substring("content", 1, 4096)).alias("h"))
    size = F.least("h.data_size", F.col("length") - F.col("h.data_at"))
    return rows.select("path", F.floor(size * 1000 / F.col("h.rate")).alias("duration_ms"))


def _wav_header(head: bytes) -> dict[str, int] | None:
    if head[:4] != b"RIFF" or head[8:12] != b"WAVE":
        return None
    at, rate = 12, 0
    while at + 8 <= len(head):
        name, size = head[at : at + 4], struct.unpack("<I", head[at + 4 : at + 8])[0]
        if name == b"fmt " and at + 20 <= len(head):
            rate = struct.unpack("<I", head[at + 16 : at + 20])[0]
        if name == b"data":
            return {"rate": rate, "data_at": at + 8, "data_size": size} if rate else None
        at += 8 + size + size % 2
    return None
