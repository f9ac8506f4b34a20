"""Files of media and of references under a folder, and the index of which belongs to which."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelake.operators import matching

# Suffixes of media and of references, and the header fields that name a medium.
MEDIA = ("mp4", "mkv", "mov", "avi", "webm")
REFERENCES = ("ass", "srt")
HEADER_FIELDS = ("video file", "audio uri", "audio file")
INDEX = "cases array<struct<case_id string, video_path string, reference_path string, ass_path string, match_reason string, match_score double>>"


def listing(spark: SparkSession, root: str, suffixes: tuple[str, ...]) -> DataFrame:
    """(path, folder, name) of all files below ``root`` with one of the suffixes, any case.

    Contents are not read.  Spark lists no file without bytes.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path")
    suffix = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    rows = files.where(suffix.isin(*suffixes))
    return rows.select("path", F.regexp_replace("path", "/[^/]*$", "").alias("folder"), matching.base_name(F.col("path")).alias("name"))


def header_refs(text: Column) -> Column:
    """File names that a styled subtitle's header gives as its media, each once, in order."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), r"\r\n?|\n"), lambda x: F.contains(x, F.lit(":")))
    value = lambda x: F.btrim(F.regexp_replace(x, "(?s)^[^:]*:", ""))
    named = F.filter(
        lines, lambda x: F.lower(F.btrim(F.substring_index(x, ":", 1))).isin(*HEADER_FIELDS) & ~value(x).isin("", "?video")
    )
    return F.array_distinct(F.transform(named, lambda x: matching.base_name(value(x))))


def discover_cases(spark: SparkSession, root: str) -> DataFrame:
    """(case_id, video_path, reference_path, match_reason, match_score): media with the best reference of their folder.

    Only styled subtitles are opened, for their headers.  A folder without media or
    without references gives no rows, an empty one an empty frame.
    """
    media, refs = listing(spark, root, MEDIA), listing(spark, root, REFERENCES)
    styled = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[aA][sS][sS]").load(root)
    heads = styled.select("path", header_refs(F.decode("content", "UTF-8")).alias("refs"))
    refs = refs.join(heads, "path", "left").select("folder", "name", F.coalesce("refs", F.array().cast("array<string>")).alias("refs"))
    found = matching.best_references(media, refs)
    at = lambda c: F.concat_ws("/", "folder", c)
    return found.select(
        F.sha2(at("medium"), 256).substr(1, 16).alias("case_id"), at("medium").alias("video_path"), at("reference").alias("reference_path"),
        F.col("reason").alias("match_reason"), F.col("score").alias("match_score"),
    )


def load_index(spark: SparkSession, path: str) -> DataFrame:
    """The cases of an index file; a reference may stand under its old name ``ass_path``.

    A case without one of its paths, or an index without cases, fails the read.
    """
    rows = spark.read.schema(INDEX).json(path, multiLine=True)
    cases = rows.select(F.explode(F.coalesce("cases", F.raise_error(F.lit("the index has no list of cases")))).alias("c")).select("c.*")
    need = lambda c: F.coalesce(F.nullif(F.btrim(c), F.lit("")), F.raise_error(F.lit("a case lacks one of its paths")).cast("string"))
    video, reference = need(F.col("video_path")), need(F.coalesce(F.nullif(F.btrim("reference_path"), F.lit("")), "ass_path"))
    return cases.select(
        F.coalesce("case_id", F.sha2("video_path", 256).substr(1, 16)).alias("case_id"), video.alias("video_path"), reference.alias("reference_path"),
        F.coalesce("match_reason", F.lit("index")).alias("match_reason"), F.coalesce("match_score", F.lit(100.0)).alias("match_score"),
    )


def write_index(cases: DataFrame, folder: str) -> None:
    """The index as one JSON row with a list of cases, in a folder of its own; committed as a whole."""
    order = ["video_path", "reference_path", "case_id", "match_reason", "match_score"]
    listed = F.sort_array(F.collect_list(F.struct(*order)))
    cases.agg(F.lit(1).alias("version"), F.count(F.lit(1)).alias("case_count"), listed.alias("cases")).coalesce(1).write.mode("overwrite").json(folder)


def load_or_discover(spark: SparkSession, root: str, index: str | None = None) -> DataFrame:
    """The index's cases if there is one, else what ``discover_cases`` finds."""
    if index is not None:
        at = spark._jvm.org.apache.hadoop.fs.Path(index)
        if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
            return load_index(spark, index)
    return discover_cases(spark, root)
