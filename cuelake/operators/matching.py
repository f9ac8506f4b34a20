"""Which reference file belongs to a medium: exact names by equi joins, the rest by similarity inside a folder."""

from __future__ import annotations

from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuelake.functions import normal

# Scores of the ways in which names match, and what containment adds.
METADATA, STEM, KEY, ONLY, FUZZY, CONTAINED = 100.0, 96.0, 92.0, 70.0, 65.0, 0.08


def stem(name: Column) -> Column:
    """A file name without its last suffix."""
    return F.regexp_replace(name, r"(?s)(?<=.)\.[^./]+$", "")


def base_name(path: Column) -> Column:
    """What follows the last slash."""
    return F.regexp_replace(path, "(?s)^.*/", "")


def block_ratio(a: Column, b: Column) -> Column:
    """Twice the characters in matching blocks over all characters: longest common block first, then left and right of it."""

    @F.arrow_udf("double")
    def run(x: pa.Array, y: pa.Array) -> pa.Array:
        out = []
        for p, q in zip(x.to_pylist(), y.to_pylist(), strict=True):
            out.append(SequenceMatcher(None, p or "", q or "").ratio())
        return pa.array(out, pa.float64())

    return run(a, b)


def best_references(media: DataFrame, references: DataFrame) -> DataFrame:
    """(folder, medium, reference, score, reason): the best reference in each medium's folder.

    ``media`` has (folder, name), ``references`` (folder, name, refs: array of file
    names that it names as its own).  A reference that names the medium scores 100, an
    equal stem 96, an equal normal form 92, the only reference of a folder 70; else 65
    times the best block ratio of the normal forms of its stem and refs, with 0.08 more
    where one contains the other.  Ties go to the first name.  Folders without
    references give no rows.

    Names that match exactly are found by equi joins and aggregates; only the media
    left over are held against the references of their folder, and the pairs are as
    many as a folder's files allow.
    """
    m = media.select("folder", F.col("name").alias("medium"), stem(F.col("name")).alias("m_stem")).distinct()
    m = m.withColumn("m_key", normal.match_key(F.col("m_stem")))
    r = references.select("folder", F.col("name").alias("reference"), stem(F.col("name")).alias("r_stem"), "refs")
    r = r.withColumn("r_key", normal.match_key(F.col("r_stem")))
    named = r.select("folder", F.explode("refs").alias("medium"), "reference")
    tiers = [
        (m.join(named, ["folder", "medium"]), METADATA, "reference_metadata_exact"),
        (m.join(r, [m["folder"] == r["folder"], m["m_stem"] == r["r_stem"]]).select(m["folder"], "medium", "reference"), STEM, "stem_exact"),
        (
            m.where("m_key <> ''").join(r, [m["folder"] == r["folder"], m["m_key"] == r["r_key"]]).select(m["folder"], "medium", "reference"),
            KEY, "normalized_stem_exact",
        ),
    ]
    found = None
    for rows, score, reason in tiers:
        rows = rows.select("folder", "medium", "reference", F.lit(score).alias("score"), F.lit(reason).alias("reason"))
        found = rows if found is None else found.unionByName(rows)
    exact = _best(found)
    rest = m.join(exact, ["folder", "medium"], "left_anti")
    # A folder with one reference needs no comparison.
    alone = r.groupBy("folder").agg(F.count(F.lit(1)).alias("n"), F.min("reference").alias("reference"))
    single = rest.join(alone.where("n = 1"), "folder").select(
        "folder", "medium", "reference", F.lit(ONLY).alias("score"), F.lit("only_reference_in_directory").alias("reason")
    )
    names = r.join(alone.where("n > 1").select("folder"), "folder").select(
        "folder", "reference", F.explode(F.concat(F.array("r_stem"), F.coalesce("refs", F.array().cast("array<string>")))).alias("candidate")
    )
    keys = names.select("folder", "reference", normal.match_key(stem(base_name(F.col("candidate")))).alias("key"))
    pairs = rest.join(keys.distinct(), "folder")
    ratio = block_ratio(F.col("m_key"), F.col("key")) + F.when(
        F.contains("m_key", "key") | F.contains("key", "m_key"), CONTAINED
    ).otherwise(0.0)
    ratio = F.when((F.col("m_key") != "") & (F.col("key") != ""), F.least(F.lit(1.0), ratio)).otherwise(0.0)
    fuzzy = pairs.groupBy("folder", "medium", "reference").agg((F.max(ratio) * FUZZY).alias("score"))
    fuzzy = _best(fuzzy.withColumn("reason", F.lit("fuzzy_name")))
    return exact.unionByName(single).unionByName(fuzzy).select("folder", "medium", "reference", F.round("score", 3).alias("score"), "reason")


def _best(scored: DataFrame) -> DataFrame:
    """The highest score of every medium, the first name of equal ones."""
    top = F.min(F.struct((-F.col("score")).alias("s"), "reference", "reason")).alias("t")
    return scored.groupBy("folder", "medium").agg(top).select(
        "folder", "medium", "t.reference", (-F.col("t.s")).alias("score"), "t.reason"
    )
