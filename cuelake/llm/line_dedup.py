"""Line dedup with Bloom filters for once-seen and twice-seen line hashes.

A line's key is the line without ASCII white space at its ends, A-Z lower-cased.
Tasks send the filter positions of their documents' distinct keys, met once and met
again; a region of the bitmap is folded into two Bloom filters, of positions seen
once and of positions seen twice (``filters.once_and_twice``), of which the second
is kept.  Only keys it suspects shuffle, to be confirmed by SHA-256 digest and
counted by document.  Documents that lose a line are found through another filter,
over ids; the others pass straight through.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuelake.llm import filters
from cuelake.llm.tables import ascii_lower, column, stored, whole

SPACE = " \t\n\x0b\x0c\r"
MIN_CHARS, MIN_DOCS = 20, 3


def line_key(line: Column) -> Column:
    """A line without ASCII white space at its ends, A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(SPACE)))


def _keys(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """(id, key): the distinct keys of every document with an id."""
    long = F.filter(F.split(whole(column(text_col)), "\n", -1), lambda x: F.length(x) >= min_chars)
    keys = F.array_distinct(F.transform(long, line_key))
    return (
        docs.where(column(id_col).isNotNull())
        .select(column(id_col).alias("id"), F.explode(keys).alias("key"))
        .where(F.length("key") >= min_chars)
    )


def repeated_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS
) -> DataFrame:
    """(id, sha): the keys that a document loses, by the SHA-256 digest of the key."""
    if min_docs < 2:
        raise ValueError("min_docs must be at least 2: the filters tell once from twice")
    keys = _keys(docs, id_col, text_col, min_chars)
    hashed = stored(keys.select(F.xxhash64("key").alias("h"), "id", F.sha2("key", 256).alias("sha")), "lines")
    probed = filters.probe(hashed, filters.once_and_twice(hashed.select("h"), hashed.count()))
    suspects = stored(probed.where("suspect").select("id", "sha").distinct(), "suspects")
    confirmed = suspects.groupBy("sha").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("keep"))
    confirmed = stored(confirmed.where(F.col("n") >= min_docs).select("sha", "keep"), "confirmed")
    return suspects.join(confirmed, "sha").where("id <> keep").select("id", "sha")


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts, dropped = [], []
        for t, d in zip(b.column(1), b.column(2), strict=True):
            gone, lines = set(d.as_py()), t.as_py().split("\n")
            kept = [
                x
                for x in lines
                if hashlib.sha256(x.strip(SPACE).encode("utf-8", "surrogatepass").lower()).hexdigest() not in gone
            ]
            texts.append("\n".join(kept))
            dropped.append(len(lines) - len(kept))
        yield pa.RecordBatch.from_arrays(
            [b.column(0), pa.array(texts, pa.string()), pa.array(dropped, pa.int64())], ["r", "text", "n_dropped"]
        )


def drop_repeated_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_chars: int = MIN_CHARS,
    min_docs: int = MIN_DOCS,
    carry: tuple[str, ...] | None = None,
) -> DataFrame:
    """(r, text, n_lines, n_dropped): every row with the text that stays.

    Keys of at least ``min_chars`` code points in at least ``min_docs``
    documents lose all their lines, except in the document with the largest id
    that holds them.  ``r`` has the columns ``carry`` as they came, ``text`` the
    remaining lines joined by a line feed.  Null texts count as one empty line.
    Rows that share an id are one document.  Rows with a null id neither count
    nor lose lines.  A document may lose every line and then has the empty text.
    """
    carry = tuple(docs.columns) if carry is None else carry
    gone = repeated_lines(docs, id_col, text_col, min_chars, min_docs)
    # A document's own lines bound its list.
    gone = stored(gone.groupBy("id").agg(F.collect_set("sha").alias("gone")), "gone")
    losers = filters.members(gone.select(F.xxhash64("id").alias("h")), gone.count())
    rows = docs.select(
        F.struct(*(column(c) for c in carry)).alias("r"),
        column(id_col).alias("id"),
        whole(column(text_col)).alias("text"),
        F.xxhash64(column(id_col)).alias("h"),
    )
    lines = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    rows = filters.probe(rows.withColumn("n_lines", lines.cast("long")), losers)
    clean = rows.where(~F.col("suspect")).select("r", "text", "n_lines", F.lit(0).cast("long").alias("n_dropped"))
    met = (
        rows.where("suspect")
        .join(gone, "id", "left")
        .select(F.struct("r", "n_lines").alias("r"), "text", F.coalesce("gone", F.array().cast("array<string>")).alias("gone"))
    )
    kind = met.schema["r"].dataType.simpleString()
    cut = met.mapInArrow(_without, f"r {kind}, text string, n_dropped long")
    return clean.union(cut.select("r.r", "text", "r.n_lines", "n_dropped"))
