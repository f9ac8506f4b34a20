"""SimHash near-dedup by meet-in-the-middle ball hashing.

A fingerprint has 64 bits; two link at ``RADIUS`` = 3 or fewer differing bits.
The bits are cut into ``BLOCKS`` blocks.  Of two linked but different
fingerprints at least one differing bit falls into some block; with that block
masked they differ in at most two bits, so the balls of half that radius (one
bit) around each meet in a common variant.  Every fingerprint therefore emits,
per masked block, itself and all one-bit variants of the rest (131 keys with
three blocks) instead of the 2,081 keys of a full two-bit ball.  Rows shuffle on
the variant; pairs that collide are verified on all 64 bits, so the result is
exact.  Within a variant only a spanning forest of the verified links is
emitted, never all pairs.

Equal fingerprints are one class before any of this: a fingerprint is the node of
all rows that have it, whatever the type of their ids.  Connected components run
over classes by alternating large-star and small-star steps whose edges are written
to the shared folder each round.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuelake.llm.tables import column, stored

RADIUS, BLOCKS, SHINGLE, SEED = 3, 3, 3, 42
_CHUNK = 1 << 14
CLASSES_PER_TASK, VARIANTS_PER_TASK = 1 << 18, 1 << 25
_PAIR_CELLS = 1 << 22
GONE_BROADCAST = 1 << 19  # ids, some tens of MB


def fingerprint(text: str | None, words: int = SHINGLE) -> int:
    """SimHash of one text: 64 bits, unsigned; 0 when it has no word.

    A-Z are lower-cased, words are runs without ASCII white space, shingles of
    ``words`` words count as often as they occur, fewer words give one shingle.
    A bit is set when it is set in over half of the shingles' XXH64 values.
    """
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return 0
    joined = memoryview(b" ".join(tokens))
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(words, len(tokens))
    starts, ends = starts[: len(tokens) - k + 1].tolist(), ends[k - 1 :].tolist()
    counts, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for at in range(0, len(starts), _CHUNK):
        part = [digest(joined[a:b], SEED) for a, b in zip(starts[at : at + _CHUNK], ends[at : at + _CHUNK], strict=True)]
        bits = np.unpackbits(np.array(part, "<u8").view(np.uint8), bitorder="little").reshape(-1, 64)
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(sum(1 << i for i in np.flatnonzero(2 * counts > len(starts)).tolist()))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE) -> DataFrame:
    """(id, fp): the fingerprint of every row as a signed 64-bit integer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((fingerprint(t.as_py(), words) for t in b.column(1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], ["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(column(id_col).alias("id"), column(text_col).alias("text")).mapInArrow(run, f"id {kind}, fp long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def variant_masks(blocks: int = BLOCKS) -> list[tuple[int, list[int]]]:
    """Per masked block: the mask of the kept bits and the patterns to flip.

    The lowest bits of the masked block, free now, name the block.
    """
    cuts = [64 * b // blocks for b in range(blocks + 1)]
    out = []
    for b in range(blocks):
        masked = range(cuts[b], cuts[b + 1])
        kept = [i for i in range(64) if i not in masked]
        tag = (b + 1) << cuts[b]
        keep = sum(1 << i for i in kept)
        out.append((_signed(keep), [_signed(tag), *(_signed(tag | 1 << i) for i in kept)]))
    return out


def variants(classes: DataFrame, blocks: int = BLOCKS) -> DataFrame:
    """(key, fp) for every variant of every class (fp)."""
    keys = [F.col("fp").bitwiseAND(F.lit(keep)).bitwiseXOR(F.lit(p)) for keep, flips in variant_masks(blocks) for p in flips]
    return classes.select(F.explode(F.array(*keys)).alias("key"), "fp")


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x.view(np.uint64))


def _forest(fp: np.ndarray, radius: int) -> list[np.ndarray]:
    """Spanning forest of the links among one variant's fingerprints, as rows (root, member)."""
    left, out = np.sort(fp), []
    while left.size:
        root, front, left = left[0], left[:1], left[1:]
        while front.size and left.size:
            hit = np.zeros(left.size, bool)
            step = max(1, _PAIR_CELLS // left.size)
            for at in range(0, front.size, step):
                hit |= (_popcount(front[at : at + step, None] ^ left[None]) <= radius).any(axis=0)
            front, left = left[hit], left[~hit]
            out.append(np.stack((np.full(front.size, root), front), axis=1))
    return out


def _links(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []  # the last key's rows, which may go on
        for b in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in b.columns]
            if not len(cols[0]):
                continue
            if held and held[-1][0][0] == cols[0][-1]:  # a key longer than a batch: join its parts once
                held.append(cols)
                continue
            cols = [np.concatenate(x) for x in zip(*held, cols, strict=True)]
            last = np.searchsorted(cols[0], cols[0][-1])
            held = [[c[last:] for c in cols]]
            yield from _linked([c[:last] for c in cols], radius)
        if held:
            yield from _linked([np.concatenate(x) for x in zip(*held, strict=True)], radius)

    return run


def _linked(cols: list[np.ndarray], radius: int) -> Iterator[pa.RecordBatch]:
    """Links of complete, sorted runs of keys."""
    key, fp = cols
    if len(key) < 2:
        return
    begins = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    sizes = np.diff(np.concatenate((begins, [len(key)])))
    two = begins[sizes == 2]
    near = two[_popcount(fp[two] ^ fp[two + 1]) <= radius]
    pairs = [np.stack((fp[near], fp[near + 1]), axis=1)]
    for at, n in zip(begins[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
        pairs += _forest(fp[at : at + n], radius)
    e = np.unique(np.sort(np.concatenate(pairs), axis=1), axis=0)
    if len(e):
        yield pa.RecordBatch.from_arrays([pa.array(e[:, 1]), pa.array(e[:, 0])], ["u", "v"])


def links(classes: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """(u, v), u > v: links between fingerprints (fp, each once) that connect what is in reach.

    The numbers of tasks follow the number of classes: variants are many times
    larger than what they come from.
    """
    parts, n = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions")), classes.count()
    spread = classes.select("fp").repartition(max(parts, n // CLASSES_PER_TASK), "fp")
    tasks = max(parts, n * 2 * 64 // VARIANTS_PER_TASK)
    dealt = variants(spread, blocks).repartition(tasks, "key").sortWithinPartitions("key")
    return dealt.mapInArrow(_links(radius), "u long, v long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node in reach of every node with an edge.

    ``edges`` has u > v.  Large-star and small-star steps alternate until the
    edges are stars around their smallest node.  The minima of each step are
    stored before they meet the edges, so that a hub's rows can be split.
    """
    edges, before = stored(edges, "edges"), None
    while True:
        both = edges.union(edges.select(F.col("v"), F.col("u"))).toDF("a", "b")
        least = stored(both.groupBy("a").agg(F.min("b").alias("m")), "least")
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("u"), F.least("a", "m").alias("v"))
        large = stored(large.where("u <> v").distinct(), "large")
        least = stored(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
        edges = stored(small.where("u <> v").distinct(), "small")
        state = edges.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.expr("count(distinct v)")
        ).first()
        if tuple(state) == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        before = tuple(state)


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE, radius: int = RADIUS
) -> DataFrame:
    """(id, fp, component): every row with its fingerprint and its group.

    ``component`` is the smallest id in reach over links, the row's own
    included.  Null texts count as empty; texts without words share the
    fingerprint zero and link like others.  Rows with a null id get the
    component of their fingerprint, null if all ids there are null.  Repeated
    rows and ids stay as they are.  Empty input gives an empty frame.
    """
    fps = stored(fingerprints(docs, id_col, text_col, words), "fps")
    classes = stored(fps.groupBy("fp").agg(F.min("id").alias("least")), "classes")
    found = components(links(classes.where("least is not null"), radius))
    roots = classes.join(found.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", F.coalesce("component", "fp").alias("root"), "least"
    )
    roots = stored(roots, "roots")
    named = roots.join(roots.groupBy("root").agg(F.min("least").alias("component")), "root").select("fp", "component")
    return fps.join(stored(named, "named"), "fp").select(F.col("id").alias(id_col), "fp", "component")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with the smallest id of their group, columns as they came.

    Of rows that repeat such an id all stay: they are one document.  Rows with a
    null id stay.  Up to ``GONE_BROADCAST`` ids of rows that go are broadcast, so that no
    text is shuffled; beyond that the documents meet them in one shuffle on the id.
    """
    found = near_duplicates(docs, id_col, text_col)
    gone = stored(found.where(column(id_col) != F.col("component")).select(column(id_col).alias("_gone")).distinct(), "gone")
    gone = gone.hint("broadcast" if gone.count() <= GONE_BROADCAST else "shuffle_hash")
    return docs.join(gone, docs[f"`{id_col}`"] == F.col("_gone"), "left_anti")
