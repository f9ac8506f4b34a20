"""Bloom filters over 64-bit hashes, as tables that a probe broadcasts piece by piece.

A filter has a power of two of words of 16 positions, at least one word a row.  A
hash owns one word (its top bits) and two different positions there (its lowest
bits): it is in the filter when both are set.  The bitmap is a table (shard,
bucket, words) of 4 KB buckets; a shard is at most ``2 ** WORDS_LOG2`` words (128
MB), the most that is broadcast at once.  More rows make more shards, each probed
by the rows whose hash lies in it, so a filter keeps its share of false positives
(about 2 % of unique hashes) at every size.

``twice`` and ``members`` use DataFrame operations only.  ``twice`` adds up a word's
16 four-bit counters in one 64-bit sum with map-side combining: what shuffles is at
most one small record per word and task, never a row.  A word of more than 15 rows
may overflow and counts as full.

``once_and_twice`` gives the same table from two bitmaps per region, one of positions
seen and one of positions seen again, which tasks send as sorted offsets.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuelake.llm.tables import stored

SLOTS, BUCKET_LOG2, WORDS_LOG2 = 16, 11, 26  # positions a word; words a bucket and a shard, log2
REGION_LOG2, CHUNK = 20, 1 << 21  # positions a region, log2; positions sorted at once
ABOVE_ONE = -0x1111111111111112  # every four-bit counter but its lowest bit


@dataclass(frozen=True)
class Filter:
    """A stored bitmap (shard, bucket, words) of ``2 ** log2`` words."""

    bitmap: DataFrame
    log2: int

    @property
    def shards(self) -> int:
        return 1 << max(0, self.log2 - WORDS_LOG2)


def size_log2(rows: int) -> int:
    """Words for so many rows, log2: one a row or more, one bucket at least."""
    return max(BUCKET_LOG2, (max(rows, 1) - 1).bit_length())


def _word(log2: int) -> Column:
    return F.shiftrightunsigned("h", 64 - log2)


def _slots() -> tuple[Column, Column]:
    first = F.col("h").bitwiseAND(F.lit(15))
    step = F.shiftright("h", 4).bitwiseAND(F.lit(0xFFFF)) % 15
    return first, (first + 1 + step).bitwiseAND(F.lit(15))


def _power(exponent: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), exponent.cast("int"))


def _bitmap(positions: DataFrame, log2: int) -> Filter:
    """The filter with these positions (pos) set."""
    at = F.col("pos").bitwiseAND(F.lit((SLOTS << BUCKET_LOG2) - 1))
    # A 64-bit word is read from its bytes in descending order: 56 turns the byte within it round.
    grouped = positions.groupBy(F.shiftright("pos", BUCKET_LOG2 + 4).alias("bucket")).agg(
        F.bitmap_construct_agg(at.bitwiseXOR(F.lit(56))).alias("bits")
    )
    words = F.expr("transform(sequence(0, 511), i -> cast(conv(hex(substring(bits, i * 8 + 1, 8)), 16, -10) as long))")
    shard = F.shiftright("bucket", WORDS_LOG2 - BUCKET_LOG2)
    return Filter(stored(grouped.select(shard.alias("shard"), "bucket", words.alias("words")), "bitmap"), log2)


def twice(hashes: DataFrame, rows: int) -> Filter:
    """The positions that at least two rows of ``hashes`` (h) own; null hashes do not count."""
    log2 = size_log2(rows)
    a, b = _slots()
    adds = _power(a * 4) + _power(b * 4)
    counted = hashes.where("h is not null").select(_word(log2).alias("word"), adds.alias("adds"))
    counted = counted.groupBy("word").agg(F.try_sum("adds").alias("sums"), F.count(F.lit(1)).alias("n"))
    full = (F.col("n") > 15) | F.col("sums").isNull()
    again = counted.where(full | (F.col("sums").bitwiseAND(F.lit(ABOVE_ONE)) != 0))
    slots = F.filter(
        F.sequence(F.lit(0), F.lit(SLOTS - 1)),
        lambda i: full | (F.call_function("shiftright", F.col("sums"), i * 4).bitwiseAND(F.lit(15)) > 1),
    )
    own = F.transform(slots, lambda i: F.col("word") * SLOTS + i)
    return _bitmap(again.select(F.explode(own).alias("pos")), log2)


def members(hashes: DataFrame, rows: int) -> Filter:
    """The positions of all ``hashes`` (h)."""
    log2 = size_log2(rows)
    own = F.explode(F.array(*(_word(log2) * SLOTS + s for s in _slots())))
    return _bitmap(hashes.where("h is not null").select(own.alias("pos")), log2)


def _offsets(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Per region of the bitmap the sorted offsets met, and those met more than once."""
    at, n = np.unique(np.concatenate(held), return_counts=True)
    region = at >> REGION_LOG2
    starts = np.flatnonzero(np.concatenate(([True], region[1:] != region[:-1])))
    ends = np.concatenate((starts[1:], [len(at)]))
    offset = (at & ((1 << REGION_LOG2) - 1)).astype("<u4")
    rows = [(int(region[s]), offset[s:e].tobytes(), offset[s:e][n[s:e] > 1].tobytes()) for s, e in zip(starts, ends, strict=True)]
    columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.binary(), pa.binary()), strict=True)]
    yield pa.RecordBatch.from_arrays(columns, ["region", "once", "again"])


def _positions_by_region(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, n = [], 0
    for b in batches:
        held += [c.to_numpy(zero_copy_only=False) for c in b.columns]
        n += 2 * b.num_rows
        if n >= CHUNK:
            yield from _offsets(held)
            held, n = [], 0
    if n:
        yield from _offsets(held)


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Two bitmaps per region, seen once and seen twice; what leaves is the second."""
    region, seen, again = None, np.zeros(1 << REGION_LOG2, bool), np.zeros(1 << REGION_LOG2, bool)

    def done() -> pa.RecordBatch:
        size = SLOTS << BUCKET_LOG2
        packed = np.packbits(again, bitorder="little").view("<i8").reshape(-1, size // 64)
        hit = np.flatnonzero(packed.any(axis=1))
        buckets = region * (len(again) // size) + hit
        words = pa.array(list(packed[hit]), pa.list_(pa.int64()))
        seen[:] = False
        again[:] = False
        return pa.RecordBatch.from_arrays([pa.array(buckets, pa.int64()), words], ["bucket", "words"])

    for b in batches:
        for r, once, more in zip(*b.columns, strict=True):
            if region is not None and r.as_py() != region:
                yield done()
            region = r.as_py()
            offsets = np.frombuffer(once.as_py(), "<u4")
            again[offsets[seen[offsets]]] = True
            seen[offsets] = True
            again[np.frombuffer(more.as_py(), "<u4")] = True
    if region is not None:
        yield done()


def once_and_twice(hashes: DataFrame, rows: int) -> Filter:
    """What ``twice`` gives, from a bitmap of positions seen once and one of positions seen twice."""
    log2 = size_log2(rows)
    own = hashes.where("h is not null").select(*((_word(log2) * SLOTS + s).alias(f"p{k}") for k, s in enumerate(_slots())))
    sent = own.mapInArrow(_positions_by_region, "region long, once binary, again binary")
    dealt = sent.repartition("region").sortWithinPartitions("region")
    folded = dealt.mapInArrow(_fold, "bucket long, words array<long>")
    shard = F.shiftright("bucket", WORDS_LOG2 - BUCKET_LOG2)
    return Filter(stored(folded.select(shard.alias("shard"), "bucket", "words"), "bitmap"), log2)


def probe(rows: DataFrame, found: Filter) -> DataFrame:
    """``rows`` with ``suspect``: whether both positions of ``h`` are set.

    Every shard is broadcast by itself and meets only the rows of its hashes.
    """
    bucket = F.shiftright(_word(found.log2), BUCKET_LOG2)
    a, b = _slots()
    base = _word(found.log2).bitwiseAND(F.lit(3)) * SLOTS
    mask = _power(base + a).bitwiseOR(_power(base + b))
    index = F.shiftright(_word(found.log2).bitwiseAND(F.lit((1 << BUCKET_LOG2) - 1)), 2)
    parts = []
    for s in range(found.shards):
        mine = rows
        if found.shards > 1:
            mine = rows.where(F.shiftright(bucket, WORDS_LOG2 - BUCKET_LOG2) == s)
        words = F.broadcast(found.bitmap.where(F.col("shard") == s).select(F.col("bucket").alias("_b"), F.col("words").alias("_w")))
        met = mine.join(words, bucket == F.col("_b"), "left")
        parts.append(met.withColumn("suspect", F.coalesce(F.get("_w", index).bitwiseAND(mask) == mask, F.lit(False))).drop("_b", "_w"))
    return reduce(DataFrame.union, parts)
