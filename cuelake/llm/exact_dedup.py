"""Exact dedup by two-pass Bloom filtering, in DataFrame operations only.

Pass one adds every text's 64-bit hash to a counting Bloom filter of fixed cells
(``filters.twice``), of which the positions that two rows own stay.  Pass two
probes it: a row whose positions are both set may be repeated and shuffles for an
exact comparison of SHA-256 digests; every other row is unique for certain and
passes straight through.  Both passes run over a stored table of digests, so a text
is read once to judge and, where whole rows are wanted, once more to deliver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuelake.llm import filters
from cuelake.llm.tables import ascii_lower, column, stored, whole


def _digests(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    norm = ascii_lower(whole(column(text_col)))
    return docs.select(column(id_col).alias("id"), norm.alias("norm")).select(
        "id",
        F.monotonically_increasing_id().alias("rid"),
        F.xxhash64("norm").alias("h"),
        F.sha2("norm", 256).alias("sha"),
    )


def _probed(digests: DataFrame) -> DataFrame:
    return filters.probe(digests, filters.twice(digests.select("h"), digests.count()))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; null counts as empty.
    The row with the largest id of a group stays; of rows that repeat that id
    too, exactly one.  Null ids sort below all others; a group of null ids only
    has a null ``keep_id``.  Empty input gives an empty frame.  Other columns of
    ``docs`` are not read, whatever their names.
    """
    probed = _probed(stored(_digests(docs, id_col, text_col), "digests"))
    alone = probed.where(~F.col("suspect")).select(
        "id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "sha"
    )
    suspects = probed.where("suspect").select("id", "rid", "sha")
    groups = suspects.groupBy("sha").agg(F.max(F.struct("id", "rid")).alias("keep"), F.count(F.lit(1)).alias("group_size"))
    # Both sides are plain scans: the adaptive skew join can split a hot digest.
    confirmed = suspects.join(stored(groups, "groups"), "sha").select(
        "id", F.col("keep.id").alias("keep_id"), "group_size", (F.col("rid") == F.col("keep.rid")).alias("kept"), "sha"
    )
    return alone.union(confirmed).select(
        F.col("id").alias(id_col), "keep_id", "group_size", "kept", F.col("sha").alias("text_sha256")
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, all columns as they came.

    Same rules as ``exact_duplicates``.  Suspects are confirmed by their digests
    alone.  A second filter, of the hashes confirmed as repeated, then parts the
    whole rows: those it clears never shuffle, the others meet the list of rows that
    stay on (digest, id), so a group of any size is spread over the cluster.
    """
    digests = stored(_digests(docs, id_col, text_col), "digests")
    suspects = _probed(digests).where("suspect")
    groups = suspects.groupBy("sha", "h").agg(F.max("id").alias("id"), F.count(F.lit(1)).alias("n"))
    keepers = stored(groups.where("n > 1").select("sha", "h", "id"), "keepers")
    repeated = filters.members(keepers.select("h"), keepers.count())
    # A few texts of one row pass that filter by chance: they stay, too.
    stray = filters.probe(digests, repeated).where("suspect").join(keepers.select("sha"), "sha", "left_anti")
    stay = keepers.select("sha", "id").union(stray.select("sha", "id"))
    stay = stored(stay.select(F.col("sha").alias("stay_sha"), F.col("id").alias("stay_id")), "stay")
    norm = ascii_lower(whole(F.col(f"r.`{text_col}`")))
    rows = docs.select(F.struct(*(column(c) for c in docs.columns)).alias("r")).select(
        "r", F.xxhash64(norm).alias("h"), F.sha2(norm, 256).alias("sha")
    )
    parted = filters.probe(rows, repeated)
    met = parted.where("suspect").join(
        stay, (F.col("sha") == F.col("stay_sha")) & F.col(f"r.`{id_col}`").eqNullSafe(F.col("stay_id"))
    )
    kept = met.dropDuplicates(["stay_sha", "stay_id"]).select("r")
    return parted.where(~F.col("suspect")).select("r").union(kept).select("r.*")
