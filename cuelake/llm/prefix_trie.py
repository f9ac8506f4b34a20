"""The trie of shared conversation prefixes, by leaf peeling with messages.

A node is a distinct sequence of first turns.  Turns get digests, and a sequence
the sum of its turns' (position, digest) hashes, 128 bits wide: sums give every
prefix, and the prefix one turn shorter, without a walk along the conversation.

Peeling works on stretches.  A member's label is a one-to-one scramble of its id;
a node belongs to the smallest label among its members.  The nodes of one label
lie below each other, so a label is a stretch of the trie that hangs off one node
of another stretch.  Stretches hold the number of stretches that still hang off
them; those at zero send their subtree's totals to their parent and are done, until
only the root's is left.  Labels being scrambled, a path meets about ln(members)
of them, so that is how many rounds there are, however deep the trie is.

Running sums go over blocks of ``BLOCK`` positions, then over the blocks, so the
turns of one endless conversation are dealt out too.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuelake.llm.tables import column, stored, whole

BLOCK_LOG2, IDS_LOG2 = 10, 8
NO_TURN = -(1 << 62)  # block of null turns: before all others
NODE = ("depth", "k1", "k2")
KIND = "depth long, k1 long, k2 long, ends_sha256 string"
LOW = 0xFFFFFFFF


def _earlier(rows: DataFrame, keys: list[str], block: str, sums: dict[str, Column], after: bool = False) -> DataFrame:
    """Per (keys, block): the sums over all earlier (``after``: later) blocks, as ``before_`` columns."""
    per = rows.groupBy(*keys, block).agg(*(F.sum(v).alias(f"before_{k}") for k, v in sums.items()))
    order = F.col(block).desc() if after else F.col(block).asc()
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return per.select(
        *keys, block, *(F.coalesce(F.sum(f"before_{k}").over(w), F.lit(0)).alias(f"before_{k}") for k in sums)
    )


def numbered(
    rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """(c, pos, sha, bytes): every turn's place in its conversation, digest and text size.

    Turns go by ``turn_col``, null first; ties by role, then by digest.  Null
    roles and texts count as empty.  Repeated rows are turns of their own.  Rows
    without a conversation id belong to none and are left out.
    """
    role, text = whole(column(role_col).cast("string")), whole(column(text_col).cast("string"))
    turns = rows.where(column(conv_col).isNotNull()).select(
        column(conv_col).cast("long").alias("c"),
        column(turn_col).cast("long").alias("turn"),
        role.alias("role"),
        F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)).alias("sha"),
        F.octet_length(text).cast("long").alias("bytes"),
    )
    turns = turns.withColumn("block", F.coalesce(F.shiftright("turn", BLOCK_LOG2), F.lit(NO_TURN)))
    w = Window.partitionBy("c", "block").orderBy(F.col("turn").asc_nulls_first(), "role", "sha")
    placed = turns.withColumn("pos", F.row_number().over(w).cast("long"))
    earlier = _earlier(turns, ["c"], "block", {"n": F.lit(1)})
    return placed.join(earlier, ["c", "block"]).select("c", (F.col("pos") + F.col("before_n")).alias("pos"), "sha", "bytes")


def as_they_are(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns, members) for ``trie`` from numbered turns."""
    return turns.withColumnRenamed("pos", "depth"), turns.groupBy("c").agg(F.count(F.lit(1)).alias("length"))


def spliced(turns: DataFrame, group: int = 5, most: int = 8) -> tuple[DataFrame, DataFrame]:
    """(turns, members) of conversations whose beginning comes from their group's first one.

    Conversation c takes the first h turns of conversation c - c % ``group`` (all
    it has if fewer, none if it is absent), then its own turns after its first h;
    h is the CRC-32 of c in decimal, modulo ``most`` + 1.  A conversation may end up
    without turns.
    """
    convs = turns.groupBy("c").agg(F.count(F.lit(1)).alias("n"))
    convs = convs.withColumn("b", F.col("c") - F.col("c") % group).withColumn(
        "h", F.crc32(F.col("c").cast("string").cast("binary")) % (most + 1)
    )
    base = convs.select(F.col("c").alias("b"), F.col("n").alias("base_n"))
    convs = convs.join(base, "b", "left").withColumn("taken", F.least("h", F.coalesce("base_n", F.lit(0))))
    length = F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))
    convs = stored(convs.select("c", "b", "h", "taken", length.alias("length")), "members")
    heads = turns.where(F.col("pos") <= most).withColumnRenamed("c", "b").join(convs, "b").where("pos <= h")
    own = turns.join(convs, "c").where("pos > h")
    return heads.select("c", F.col("pos").alias("depth"), "sha", "bytes").unionByName(
        own.select("c", (F.col("taken") + F.col("pos") - F.col("h")).alias("depth"), "sha", "bytes")
    ), convs.select("c", "length")


def _packed(parts: list[Column]) -> list[Column]:
    """Four sums, modulo 2 ** 32 each, as two 64-bit keys."""
    a, b, c, d = (p.bitwiseAND(F.lit(LOW)) for p in parts)
    return [F.shiftleft(a, 32).bitwiseOR(b).alias("k1"), F.shiftleft(c, 32).bitwiseOR(d).alias("k2")]


def _prefixes(turns: DataFrame) -> DataFrame:
    """(c, depth, k1, k2, p1, p2, bytes): keys of the prefix that ends here and of the one before."""
    h1, h2 = F.xxhash64("depth", "sha"), F.xxhash64("sha", "depth")
    halves = [F.shiftrightunsigned(h1, 32), h1.bitwiseAND(F.lit(LOW)), F.shiftrightunsigned(h2, 32), h2.bitwiseAND(F.lit(LOW))]
    names = ["m0", "m1", "m2", "m3"]
    rows = turns.select(
        "c", "depth", "bytes", F.shiftright("depth", BLOCK_LOG2).alias("block"), *(h.alias(m) for h, m in zip(halves, names, strict=True))
    )
    w = Window.partitionBy("c", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    inside = rows.select("*", *(F.sum(m).over(w).alias(f"in_{m}") for m in names))
    both = inside.join(_earlier(rows, ["c"], "block", {m: F.col(m) for m in names}), ["c", "block"])
    here = [F.col(f"in_{m}") + F.col(f"before_{m}") for m in names]
    (p1, p2) = _packed([x - F.col(m) for x, m in zip(here, names, strict=True)])
    return both.select("c", "depth", *_packed(here), p1.alias("p1"), p2.alias("p2"), "bytes")


def _nodes(prefixes: DataFrame, members: DataFrame) -> DataFrame:
    """One row per node with its members, label, own cost, children, and its parent's id and label."""
    label = F.xxhash64("c")
    found = prefixes.groupBy(*NODE).agg(
        F.min("c").alias("conv_id"), F.min(label).alias("label"), F.count(F.lit(1)).alias("n_convs"),
        F.min("p1").alias("p1"), F.min("p2").alias("p2"), F.min("bytes").alias("bytes"),
    )
    root = members.agg(F.min("c").alias("conv_id"), F.min(label).alias("label"), F.count(F.lit(1)).alias("n_convs"))
    zero = F.lit(0).cast("long")
    root = root.where("n_convs > 0").select(
        *(zero.alias(k) for k in NODE), "conv_id", "label", "n_convs", *(zero.alias(k) for k in ("p1", "p2", "bytes"))
    )
    nodes = stored(found.unionByName(root), "nodes")
    up = (F.col("depth") - 1).alias("depth")
    kids = nodes.where("depth > 0").select(up, F.col("p1").alias("k1"), F.col("p2").alias("k2"))
    kids = kids.groupBy(*NODE).agg(F.count(F.lit(1)).alias("n_children"))
    above = nodes.select(up.alias("at"), "k1", "k2", F.col("conv_id").alias("parent_conv_id"), F.col("label").alias("parent"))
    above = above.select((F.col("at") + 2).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), "parent_conv_id", "parent")
    # The root, parent of every first turn, is one row: it goes to them.
    first = nodes.where("depth = 1").join(F.broadcast(above.where("depth = 1")), ["depth", "p1", "p2"], "left")
    deep = nodes.where("depth > 1").join(above.where("depth > 1"), ["depth", "p1", "p2"], "left")
    top = nodes.where("depth = 0").withColumns({k: F.lit(None).cast("long") for k in ("parent_conv_id", "parent")})
    linked = deep.unionByName(first).unionByName(top).join(kids, list(NODE), "left")
    return stored(
        linked.select(
            *NODE, "conv_id", "label", "parent_conv_id", "parent", "n_convs",
            F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"),
            ((F.col("n_convs") - 1) * F.col("bytes")).alias("cost"),
        ),
        "linked",
    )


def _peeled(nodes: DataFrame) -> DataFrame:
    """(label, parent, parent_depth, leaves, saved): every stretch with its subtree's totals."""
    stretches = nodes.groupBy("label").agg(
        F.max(F.when(F.col("parent") != F.col("label"), F.col("parent"))).alias("parent"),
        (F.min("depth") - 1).alias("parent_depth"),
        F.sum(F.when(F.col("n_children") == 0, 1).otherwise(0)).alias("leaves"),
        F.sum("cost").alias("saved"),
    )
    stretches = stored(stretches, "stretches")
    hanging = stretches.where("parent is not null").groupBy("parent").agg(F.count(F.lit(1)).alias("waiting"))
    state = stretches.join(hanging.withColumnRenamed("parent", "label"), "label", "left")
    state = stored(state.withColumn("waiting", F.coalesce("waiting", F.lit(0))), "waiting")
    done = []
    while True:
        ready = state.where("waiting = 0")
        done.append(ready.drop("waiting"))
        sent = ready.where("parent is not null").groupBy(F.col("parent").alias("label")).agg(
            F.count(F.lit(1)).alias("came"), F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved")
        )
        zero = F.lit(0)
        state = stored(
            state.where("waiting > 0").join(sent, "label", "left").select(
                "label", "parent", "parent_depth",
                (F.col("leaves") + F.coalesce("more_leaves", zero)).alias("leaves"),
                (F.col("saved") + F.coalesce("more_saved", zero)).alias("saved"),
                (F.col("waiting") - F.coalesce("came", zero)).alias("waiting"),
            ),
            "waiting",
        )
        if state.isEmpty():
            return reduce(DataFrame.unionByName, done)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's list, whose pieces come in order; the state is one running hash."""
    key, running = None, None
    for b in batches:
        cols = [b.column(i).to_pylist() for i in range(4)]
        out = []
        for *node, piece in zip(*cols, strict=True):
            if node != key:
                if key is not None:
                    out.append((*key, running.hexdigest()))
                key, running = node, hashlib.sha256()
            else:
                running.update(b",")
            running.update(piece.encode())
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in out], pa.string() if i == 3 else pa.int64()) for i in range(4)], [*NODE, "ends_sha256"]
        )
    if key is not None:
        yield pa.RecordBatch.from_arrays(
            [*(pa.array([k], pa.int64()) for k in key), pa.array([running.hexdigest()])], [*NODE, "ends_sha256"]
        )


def _ends(prefixes: DataFrame, members: DataFrame) -> DataFrame:
    """(node, ends_sha256) of nodes where a member ends.

    Ids are joined in pieces of ``2 ** IDS_LOG2`` consecutive numbers where they
    are; one running hash then reads a node's pieces in order, as SHA-256 must.
    """
    last = prefixes.join(members.select("c", F.col("length").alias("depth")), ["c", "depth"]).select(*NODE, "c")
    zero = F.lit(0).cast("long")
    last = last.unionByName(members.where("length = 0").select(*(zero.alias(k) for k in NODE), "c"))
    ids = F.transform(F.sort_array(F.collect_list("c")), lambda x: x.cast("string"))
    pieces = last.groupBy(*NODE, F.shiftright("c", IDS_LOG2).alias("part")).agg(F.array_join(ids, ",").alias("piece"))
    dealt = pieces.repartition(*NODE).sortWithinPartitions(*NODE, "part")
    return dealt.select(*NODE, "piece").mapInArrow(_digests, KIND)


def trie(turns: DataFrame, members: DataFrame) -> DataFrame:
    """One row per node of the trie of all prefixes, the textless root included.

    ``turns`` has (c, depth from 1 without gaps, sha, bytes), ``members`` every
    conversation as (c, length), turnless ones too.  Result: conv_id (smallest
    member), depth, parent_conv_id (null at the root), n_convs, n_children,
    n_leaves (childless nodes of the subtree), saved_tokens (over the subtree, each
    node's (n_convs - 1) times the bytes of its last text), ends_sha256 (of the ids
    of members that end here, ascending, comma-joined; of the empty text if none).
    Without members there is no node.
    """
    prefixes = stored(_prefixes(turns), "prefixes")
    nodes = _nodes(prefixes, members)
    hung = _peeled(nodes).where("parent is not null").groupBy(F.col("parent").alias("label"), F.col("parent_depth").alias("depth"))
    hung = hung.agg(F.sum("leaves").alias("hung_leaves"), F.sum("saved").alias("hung_saved"))
    zero = F.lit(0)
    both = nodes.join(hung, ["label", "depth"], "left").select(
        *NODE, "label", "conv_id", "parent_conv_id", "n_convs", "n_children", F.shiftright("depth", BLOCK_LOG2).alias("block"),
        (F.when(F.col("n_children") == 0, 1).otherwise(0) + F.coalesce("hung_leaves", zero)).alias("leaves"),
        (F.col("cost") + F.coalesce("hung_saved", zero)).alias("saved"),
    )
    both = stored(both, "summed")
    below = _earlier(both, ["label"], "block", {"leaves": F.col("leaves"), "saved": F.col("saved")}, after=True)
    w = Window.partitionBy("label", "block").orderBy(F.col("depth").desc()).rowsBetween(Window.unboundedPreceding, 0)
    inside = both.withColumns({"leaves": F.sum("leaves").over(w), "saved": F.sum("saved").over(w)})
    found = inside.join(below, ["label", "block"]).join(_ends(prefixes, members), list(NODE), "left")
    return found.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children",
        (F.col("leaves") + F.col("before_leaves")).cast("long").alias("n_leaves"),
        (F.col("saved") + F.col("before_saved")).cast("long").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )


def prefix_trie(rows: DataFrame, rebuild: bool = False) -> DataFrame:
    """The trie (``trie``) of a table of (conv_id, turn, role, text), other columns aside.

    ``rebuild``: of conversations put together by ``spliced``.  Nulls, ties and
    repeats as ``numbered`` says; an empty table gives an empty frame.
    """
    turns = stored(numbered(rows), "turns")
    return trie(*(spliced if rebuild else as_they_are)(turns))
