"""What a translator is told beside the lines: the whole text in short, and glossary terms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cuelake.functions import normal
from cuelake.operators.windows import by_media

TERMS = "terms array<struct<ja string, zh string>>"


def _seconds(ms: Column) -> Column:
    """Seconds with two digits, halves up."""
    c = F.floor((ms + 5) / 10)
    return F.concat(F.floor(c / 100).cast("string"), F.lit("."), F.lpad((c % 100).cast("string"), 2, "0"))


def context_lines(cues: DataFrame, text_col: str, max_chars: int) -> DataFrame:
    """(media_id, context): a medium's lines ``0007 [1.20->3.45] text`` in order, cut at ``max_chars``.

    Numbers count all cues; blank ones give no line.  Only the cues that reach into
    the first ``max_chars`` characters are put together.
    """
    line = F.format_string("%04d [%s->%s] %s", "rn", _seconds(F.col("start_ms")), _seconds(F.col("end_ms")), "text")
    rows = cues.withColumn("rn", F.row_number().over(by_media()) - 1).withColumn("text", normal.one_line(F.col(text_col)))
    rows = rows.where("text <> ''").select("media_id", "rn", line.alias("line"))
    w = Window.partitionBy("media_id").orderBy("rn").rowsBetween(Window.unboundedPreceding, -1)
    near = rows.withColumn("before", F.coalesce(F.sum(F.length("line") + 1).over(w), F.lit(0))).where(F.col("before") <= max_chars)
    # No more lines than characters, a bounded list; the line right behind the cut is what its line feed comes from.
    joined = near.groupBy("media_id").agg(F.array_sort(F.collect_list(F.struct("rn", "line"))).alias("l"))
    return joined.select("media_id", F.left(F.array_join(F.col("l.line"), "\n"), F.lit(max_chars)).alias("context"))


def usable_pairs(pairs: DataFrame, key: str, order: str, most: int = 15) -> DataFrame:
    """(key, order, source, target): each key's first ``most`` pairs whose two sides are short terms without signs."""
    good = pairs.where(normal.term_is_usable(F.col("source")) & normal.term_is_usable(F.col("target")))
    ranked = good.withColumn("rn", F.row_number().over(Window.partitionBy(key).orderBy(order, "source", "target"))).where(F.col("rn") <= most)
    return ranked.select(key, order, *(normal.stripped(F.col(c)).alias(c) for c in ("source", "target")))


def formatted_terms(pairs: DataFrame, key: str, order: str, known: DataFrame) -> DataFrame:
    """(key, terms): lines ``source-target`` in order, each source once, without those in ``known`` (source), whole terms compared.

    ``pairs`` as ``usable_pairs`` gives them: a bounded number a key.
    """
    fresh = pairs.join(known.select("source").distinct(), "source", "left_anti")
    first = fresh.groupBy(key, "source").agg(F.min(F.struct(order, "target")).alias("f"))
    lines = first.select(key, F.struct(F.col(f"f.{order}").alias("o"), "source", F.col("f.target").alias("target")).alias("r"))
    listed = lines.groupBy(key).agg(F.array_sort(F.collect_list("r")).alias("r"))
    return listed.select(key, F.array_join(F.transform("r", lambda x: F.concat(x["source"], F.lit("-"), x["target"])), "\n").alias("terms"))


def read_glossaries(spark: SparkSession, folder: str, stem: str) -> DataFrame:
    """(place, pos, source, target): the pairs of a folder's glossary files, the medium's own file first, then the common one, then others by name.

    A file that is no JSON object or list of terms counts as empty; pairs with an
    empty side are left out.
    """
    own, common = f"{stem}.translation_global_glossary.json", "translation_global_glossary.json"
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*translation_global_glossary*.json").load(folder)
    name = F.regexp_replace("path", "(?s)^.*/", "")
    text = F.decode("content", "UTF-8")
    rank = F.when(name == own, 0).when(name == common, 1).when(F.startswith(name, F.lit("translation_global_glossary.")), 2)
    kinds = [F.from_json(text, TERMS)["terms"], F.from_json(text, "array<struct<ja string, zh string>>")]
    rows = files.select(rank.alias("rank"), name.alias("name"), F.coalesce(*kinds).alias("terms")).where("rank is not null")
    items = rows.select("rank", "name", F.posexplode("terms").alias("pos", "t"))
    pairs = items.select("rank", "name", "pos", normal.stripped(F.col("t.ja")).alias("source"), normal.stripped(F.col("t.zh")).alias("target"))
    return pairs.where("source <> '' and target <> ''").select(F.struct("rank", "name").alias("place"), "pos", "source", "target")
