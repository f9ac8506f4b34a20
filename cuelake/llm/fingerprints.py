"""Canonical exact digests of documents.

The canonical form of a text is NFKC, case-folded, NFKC again, with every run of
Unicode white space made one space and none at the ends.  Its XXH3-128 is the
fingerprint.  Rows whose hash is met only once are settled; the others shuffle
on the hash and compare bytes with the row of the smallest id of their bucket,
so that two texts share a fingerprint only if their canonical bytes are equal:
what differs inside a bucket gets an ordinal behind the hash.  The fingerprint of
an edited text, which is no row of the table, is the plain hash; whether it equals
the row's own is decided by comparing bytes.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator
from unicodedata import normalize

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuelake.llm import filters
from cuelake.llm.tables import column, stored

BUCKETS_PER_PARTITION, ROWS_PER_BUCKET, SAMPLED_PER_BUCKET = 4, 1 << 16, 16


def canonical(text: str | None) -> bytes:
    """The canonical form of a text in UTF-8; null gives the empty form."""
    folded = normalize("NFKC", normalize("NFKC", text or "").casefold())
    return " ".join(folded.split()).encode("utf-8", "surrogatepass")


def digest(canon: bytes) -> str:
    """Fingerprint of a canonical form, 32 hex digits."""
    return xxhash.xxh3_128_hexdigest(canon)


def _canon_rows(docs: DataFrame, id_col: str, text_col: str, with_text: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            forms = [canonical(t.as_py()) for t in b.column(1)]
            cols = [b.column(0), pa.array([digest(c) for c in forms], pa.string())]
            if with_text:
                cols.append(pa.array(forms, pa.binary()))
            yield pa.RecordBatch.from_arrays(cols, ["id", "fp", "canon"][: len(cols)])

    kind = docs.schema[id_col].dataType.simpleString()
    return (
        docs.select(column(id_col).alias("id"), column(text_col).alias("text"))
        .mapInArrow(run, f"id {kind}, fp string" + ", canon binary" * with_text)
        .withColumn("h", F.xxhash64("fp"))
    )


def collided(docs: DataFrame, fps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, ordinal >= 1): rows whose bytes differ from the first form of their bucket.

    ``fps`` (fp, ...) are the hashes of all rows of ``docs``, stored.
    """
    repeated = filters.twice(fps.select(F.xxhash64("fp").alias("h")), fps.count())
    members = filters.probe(_canon_rows(docs, id_col, text_col, True), repeated).where("suspect").select("id", "fp", "canon")
    found, ordinal = None, 0
    while True:
        first = stored(members.groupBy("fp").agg(F.min(F.struct("id", "canon")).alias("first")), "first")
        unlike = stored(
            members.join(first, "fp").where(F.col("canon") != F.col("first.canon")).select("id", "fp", "canon"), "unlike"
        )
        if found is None:
            found = unlike.select("id", "fp", F.lit(1).alias("ordinal"))
        if unlike.isEmpty():
            return found
        ordinal += 1
        here = unlike.select("id", "fp", F.lit(ordinal).alias("ordinal"))
        found = here if ordinal == 1 else found.where(F.col("ordinal") < ordinal).union(here)
        # A row that differs again in the next round takes the later ordinal.
        found = found.groupBy("id", "fp").agg(F.max("ordinal").alias("ordinal"))
        members = unlike


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint) of every row.

    Null texts count as empty; empty texts share one fingerprint.  Null ids,
    repeated rows and repeated ids are kept as they are; other columns are not
    read.  An empty table gives an empty frame.
    """
    plain = stored(_canon_rows(docs, id_col, text_col, False).select("id", "fp"), "fps")
    return _with_ordinals(plain, collided(docs, plain, id_col, text_col)).select(
        F.col("id").alias(id_col), F.col("fp").alias("fingerprint")
    )


def _with_ordinals(rows: DataFrame, found: DataFrame) -> DataFrame:
    other = found.select(F.col("id").alias("_id"), F.col("fp").alias("_fp"), "ordinal")
    met = rows.join(other, rows.id.eqNullSafe(F.col("_id")) & (rows.fp == F.col("_fp")), "left")
    return met.withColumn("fp", F.concat("fp", F.coalesce(F.concat(F.lit("-"), "ordinal"), F.lit("")))).drop(
        "_id", "_fp", "ordinal"
    )


def _neighbours(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, int]:
    """(bucket, guest, id, text): rows by bucket of the id, each bucket with the row after its last as a guest.

    Buckets are ranges of the id, whatever its type, between quantiles of a sample
    in hash order.  The driver sees that sample and each bucket's largest id: about
    one id in 4,096, no text.  Whole texts move once.  Also the number of buckets.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(column(id_col).alias("id"), column(text_col).alias("text"))
    known = rows.select("id").where("id is not null")
    n = max(BUCKETS_PER_PARTITION * parts, known.count() // ROWS_PER_BUCKET)
    drawn = known.orderBy(F.xxhash64("id"), "id").limit(n * SAMPLED_PER_BUCKET)
    drawn = [r["id"] for r in drawn.orderBy("id").collect()]
    bounds = sorted(set(drawn[SAMPLED_PER_BUCKET::SAMPLED_PER_BUCKET]))

    @F.arrow_udf("int")
    def bucket(ids: pa.Array) -> pa.Array:
        """Place among the bounds; null ids come after all others."""
        return pa.array((-1 if i is None else bisect_left(bounds, i) for i in ids.to_pylist()), pa.int32())

    def bucketed(frame: DataFrame) -> DataFrame:
        return frame.withColumn("bucket", bucket("id"))

    heads = sorted(bucketed(rows.select("id")).groupBy("bucket").agg(F.max("id")).collect(), reverse=True)
    buckets = bucketed(rows).select("bucket", "id", "text")
    own = buckets.select("bucket", F.lit(0).alias("guest"), "id", "text")
    if not heads:
        return own, n
    hosts = [heads[-1], *heads[:-1]]  # after the last bucket comes the first
    pairs = [(h[1], t[0]) for h, t in zip(heads, hosts, strict=True)]
    kind = docs.schema[id_col].dataType.simpleString()
    sent = F.broadcast(spark.createDataFrame(pairs, f"head {kind}, host int"))
    guests = buckets.join(sent, F.col("id").eqNullSafe(F.col("head")))
    return own.union(guests.select(F.col("host"), F.lit(1), "id", "text")), n


def edited(text: str, following: str) -> str:
    """The last third of a text replaced by as much of the start of the one that follows."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


def edit_comparison(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row with its fingerprint, that of its edited text, and how alike they are.

    Columns: id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next.  Documents follow each other by descending id, nulls
    last, rows that share an id by descending text, and the first follows the
    last.  Likeness is 1.0 for equal canonical bytes and 0.0 otherwise.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # the row that waits for the one after it
        for b in batches:
            out: list[tuple] = []
            cols = [b.column(i) for i in range(3)]
            for i, text in enumerate(b.column(3)):
                bucket, guest, key = (c[i].as_py() for c in cols)
                text = text.as_py() or ""
                form = canonical(text)
                if held is not None and held[0] == bucket:
                    out.append(_compare(held, text, form))
                held = None if guest else (bucket, key, text, form)
            columns = list(zip(*out, strict=True)) or [()] * 7
            kinds = [b.schema.field(2).type, pa.int64(), *[pa.string()] * 3, pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                ["id", "n_chars", "edited_sha256", "fp", "edited_fingerprint", "near_edited", "near_next"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    buckets, n = _neighbours(docs, id_col, text_col)
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), n // BUCKETS_PER_PARTITION)
    dealt = buckets.repartition(parts, "bucket").sortWithinPartitions("bucket", "guest", F.desc("id"), F.desc("text"))
    rows = dealt.mapInArrow(
        run,
        f"id {kind}, n_chars long, edited_sha256 string, fp string, edited_fingerprint string, "
        "near_edited double, near_next double",
    )
    rows = stored(rows, "edits")
    found = _with_ordinals(rows, collided(docs, rows.select("fp"), id_col, text_col))
    return found.select(
        F.col("id").alias(id_col),
        "n_chars",
        "edited_sha256",
        F.col("fp").alias("fingerprint"),
        "edited_fingerprint",
        "near_edited",
        "near_next",
    )


def _compare(held: tuple, following: str, form: bytes) -> tuple:
    _, key, text, own = held
    other = edited(text, following)
    changed = canonical(other)
    return (
        key,
        len(text),
        hashlib.sha256(other.encode("utf-8", "surrogatepass")).hexdigest(),
        digest(own),
        digest(changed),
        float(own == changed),
        float(own == form),
    )
