"""Lloyd's k-means on integer vectors by dual trees: exact, with most distances pruned.

Every task cuts its vectors into blocks of at most ``block`` rows and builds a cover
tree over each: the children of a node lie within its radius and further than half
of its scale from each other, equal vectors share one leaf.  The blocks are stored
once.  A round sends the centroids (k vectors) and a small tree over them to the
blocks; pairs of a vector node and a centroid node go down both trees, breadth
first, whole levels as arrays.  A pair goes when its least distance lies above the
largest one of some other pair of the same vectors; vectors left with one centroid
add their sum at once; leaf pairs are compared in exact integers, ties to the smaller number.
Tasks return k sums; the driver sees k rows a round.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cuelake.llm.tables import column, stored

BLOCK = 1024
SCALE = 1024
LIMIT = 1 << 27  # of a scaled component: squared distances of 64 of them fit a long
SLACK = 1e-9  # relative slack of float bounds
NODE_FIELDS = ("center", "lo", "hi", "first", "n_kids", "radius")
BLOCK_KIND = "n long, points binary, " + ", ".join(f"{f} binary" for f in NODE_FIELDS)


@dataclass
class Tree:
    """Points in depth-first order; a node has the points lo .. hi-1 and the children first .. first+n_kids-1."""

    points: np.ndarray
    center: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    first: np.ndarray
    n_kids: np.ndarray
    radius: np.ndarray


def _distances(x: np.ndarray) -> np.ndarray:
    """All pairwise distances of float rows, rounding errors cut at zero."""
    sq = np.einsum("ij,ij->i", x, x)
    return np.sqrt(np.maximum(sq[:, None] + sq[None] - 2 * (x @ x.T), 0))


def build_tree(points: np.ndarray) -> tuple[Tree, np.ndarray]:
    """The cover tree of some integer vectors, and the order in which it holds them."""
    distinct, back = np.unique(points, axis=0, return_inverse=True)
    back = back.ravel()
    rows_of = np.split(np.argsort(back, kind="stable"), np.cumsum(np.bincount(back, minlength=len(distinct)))[:-1])
    counts = np.bincount(back, minlength=len(distinct))
    dist = _distances((distinct - distinct[0]).astype(float))
    # Breadth-first numbers, so that children are consecutive; places follow from counts, parents first.
    center, size, kids, groups = [0], [len(points)], [(0, 0)], [np.arange(len(distinct))]
    radius, place, scale = [float(dist[0].max())], [0], [float(dist[0].max())]
    at = 0
    order = np.empty(len(points), np.int64)
    while at < len(center):
        group, c, here = groups[at], center[at], place[at]
        groups[at] = None
        if len(group) == 1:
            order[here : here + size[at]] = rows_of[group[0]]
            at += 1
            continue
        reach = scale[at] / 2
        near = dist[c, group]
        reach = min(reach, float(near.max()) / 2)
        kids[at] = (len(center), 0)
        left, pick = group, c
        while left.size:
            d = dist[pick, left]
            inside = (d <= reach) | (left == pick)
            mine, left = left[inside], left[~inside]
            center.append(int(pick))
            groups.append(mine)
            size.append(int(counts[mine].sum()))
            radius.append(float(d[inside].max()))
            scale.append(reach)
            place.append(here)
            kids.append((0, 0))
            here += size[-1]
            pick = left[0] if left.size else pick
        kids[at] = (kids[at][0], len(center) - kids[at][0])
        at += 1
    lo = np.array(place)
    top = float(np.abs(distinct - distinct[0]).max(initial=0)) * math.sqrt(points.shape[1])
    # Errors of the distance formula grow with the square root of what cancels.
    widened = np.array(radius) + np.where(np.array([k[1] for k in kids]) > 0, top * 1e-7, 0.0)
    ordered = points[order]
    return Tree(
        ordered, distinct[np.array(center)], lo, lo + np.array(size), np.array([k[0] for k in kids]), np.array([k[1] for k in kids]), widened
    ), order


def build_centroid_tree(centroids: np.ndarray) -> Tree:
    """A binary tree over the centroids: halves along the widest axis; leaves hold one each."""
    ids = np.arange(len(centroids))
    groups, center, first, n_kids, radius, at = [ids], [], [], [], [], 0
    while at < len(groups):
        g = groups[at]
        x = centroids[g].astype(float)
        mid = x.mean(axis=0)
        center.append(mid if len(g) > 1 else x[0])
        radius.append(float(np.sqrt(((x - mid) ** 2).sum(axis=1)).max()) * (1 + SLACK) if len(g) > 1 else 0.0)
        first.append(len(groups))
        n_kids.append(2 if len(g) > 1 else 0)
        if len(g) > 1:
            axis = int(np.argmax(x.max(axis=0) - x.min(axis=0)))
            g = g[np.argsort(x[:, axis], kind="stable")]
            groups += [g[: len(g) // 2], g[len(g) // 2 :]]
        at += 1
    number = np.array([g[0] if len(g) == 1 else -1 for g in groups])
    return Tree(centroids, np.array(center), number, number, np.array(first), np.array(n_kids), np.array(radius))


def _children(nodes: np.ndarray, tree: Tree) -> tuple[np.ndarray, np.ndarray]:
    """(index of the parent in ``nodes``, child) for every child."""
    n = tree.n_kids[nodes]
    up = np.repeat(np.arange(len(nodes)), n)
    step = np.arange(len(up)) - np.repeat(np.cumsum(n) - n, n)
    return up, tree.first[nodes][up] + step


def _exact(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances of paired integer rows."""
    gap = points - centroids
    return np.einsum("ij,ij->i", gap, gap)


def dual_assign(tree: Tree, centroids: np.ndarray, cents: Tree) -> tuple[np.ndarray, np.ndarray]:
    """(node, centroid): every point of the block lies in exactly one of the nodes, its nearest centroid beside it."""
    q, r = np.zeros(1, np.int64), np.zeros(1, np.int64)
    out_q, out_r = [], []
    centers = tree.center.astype(float)
    while q.size:
        gap = centers[q] - cents.center[r]
        d = np.sqrt(np.einsum("ij,ij->i", gap, gap))
        spread = tree.radius[q] + cents.radius[r]
        slack = SLACK * (d + spread + 1)
        most = np.full(len(centers), np.inf)
        np.minimum.at(most, q, d + spread + slack)
        keep = d - spread - slack <= most[q]
        q, r = q[keep], r[keep]
        alone = np.bincount(q, minlength=len(centers))[q] == 1
        settled = alone & (cents.n_kids[r] == 0)
        out_q.append(q[settled])
        out_r.append(cents.lo[r[settled]])
        q, r = q[~settled], r[~settled]
        if not q.size:
            break
        q_leaf, r_leaf = tree.n_kids[q] == 0, cents.n_kids[r] == 0
        if np.all(q_leaf & r_leaf):
            number = cents.lo[r]
            exact = _exact(tree.center[q], centroids[number])
            best = np.lexsort((number, exact, q))
            first = np.concatenate(([True], q[best][1:] != q[best][:-1]))
            out_q.append(q[best][first])
            out_r.append(number[best][first])
            break
        # Both sides go down; a side that is a leaf stays as it is.
        up, kid = _children(r, cents)
        q, r = np.concatenate((q[r_leaf], q[up])), np.concatenate((r[r_leaf], kid))
        up, kid = _children(q, tree)
        leaf = tree.n_kids[q] == 0
        q, r = np.concatenate((q[leaf], kid)), np.concatenate((r[leaf], r[up]))
    return np.concatenate(out_q), np.concatenate(out_r)


def _rows_of(raw: pa.RecordBatch, dims: int) -> Iterator[Tree]:
    """The trees of stored blocks."""
    cols = {name: raw.column(i) for i, name in enumerate(raw.schema.names)}
    for k in range(raw.num_rows):
        ints = [np.frombuffer(cols[f][k].as_py(), "<i4").astype(np.int64) for f in NODE_FIELDS[:-1]]
        points = np.frombuffer(cols["points"][k].as_py(), "<i4").reshape(-1, dims).astype(np.int64)
        center = points[ints[0]]
        yield Tree(points, center, *ints[1:], np.frombuffer(cols["radius"][k].as_py(), "<f8"))


def kept_vectors(rows: DataFrame, id_col: str, vector_col: str, dims: int) -> DataFrame:
    """(id, v): vectors of exactly ``dims`` finite components, each as floor(``SCALE`` * x).

    Vectors with a null, NaN or infinite component go, and those with a scaled
    component of ``LIMIT`` or more either way: their distances need not fit a long.
    """
    x = F.col("x")
    ints = F.transform(x, lambda e: F.floor(e.cast("double") * SCALE))
    fine = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e.cast("double")) & (F.abs(e.cast("double")) < LIMIT / SCALE))
    named = rows.select(column(id_col).alias("id"), column(vector_col).alias("x"))
    return named.where((F.size("x") == dims) & fine).select("id", ints.cast("array<int>").alias("v"))


def blocks(vectors: DataFrame, dims: int, block: int = BLOCK) -> DataFrame:
    """(ids, tree) of every block of (id, v), stored: ``ids`` are the row's ids in the tree's order."""
    kind = vectors.schema["id"].dataType.simpleString()

    def made(ids: pa.Array, flat: np.ndarray) -> pa.RecordBatch:
        tree, order = build_tree(flat)
        # A node's center as the place of one of its points.
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        at = {tuple(p): i for i, p in reversed(list(enumerate(map(tuple, tree.points.tolist()))))}
        centers = np.array([at[tuple(c)] for c in tree.center.tolist()])
        fields = [x.astype("<i4").tobytes() for x in (centers, tree.lo, tree.hi, tree.first, tree.n_kids)]
        taken = ids.take(pa.array(order))
        cols = [
            pa.ListArray.from_arrays(pa.array([0, len(taken)], pa.int32()), taken), pa.array([len(order)], pa.int64()),
            pa.array([tree.points.astype("<i4").tobytes()]), *(pa.array([f], pa.binary()) for f in fields),
            pa.array([tree.radius.astype("<f8").tobytes()]),
        ]
        return pa.RecordBatch.from_arrays(cols, ["ids", "n", "points", *NODE_FIELDS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_ids, held, n = [], [], 0
        for b in batches:
            for at in range(0, b.num_rows, block):
                part = b.slice(at, block)
                held_ids.append(part.column(0))
                held.append(part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims).astype(np.int64))
                n += part.num_rows
                if n >= block:
                    ids, flat = pa.concat_arrays(held_ids), np.concatenate(held)
                    yield made(ids[:block], flat[:block])
                    held_ids, held, n = [ids[block:]], [flat[block:]], n - block
        if n:
            yield made(pa.concat_arrays(held_ids), np.concatenate(held))

    return stored(vectors.select("id", "v").mapInArrow(run, f"ids array<{kind}>, {BLOCK_KIND}"), "blocks")


def _sums(centroids: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Per task and centroid: how many vectors are nearest to it, and their sum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, dims = centroids.shape
        cents = build_centroid_tree(centroids)
        n, total = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for b in batches:
            for tree in _rows_of(b, dims):
                nodes, number = dual_assign(tree, centroids, cents)
                running = np.concatenate((np.zeros((1, dims), np.int64), np.cumsum(tree.points, axis=0)))
                lo, hi = tree.lo[nodes], tree.hi[nodes]
                np.add.at(n, number, hi - lo)
                np.add.at(total, number, running[hi] - running[lo])
        live = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays(
            [pa.array(live.astype(np.int32)), pa.array(n[live]), pa.array(total[live].tolist(), pa.list_(pa.int64()))],
            ["cluster", "n", "total"],
        )

    return run


def _labels(centroids: np.ndarray, kind: pa.DataType | None = None):
    """(id, cluster, distance) of every vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cents = build_centroid_tree(centroids)
        for b in batches:
            for k, tree in enumerate(_rows_of(b, centroids.shape[1])):
                nodes, number = dual_assign(tree, centroids, cents)
                cluster = np.empty(len(tree.points), np.int64)
                order = np.argsort(tree.lo[nodes])
                cluster[:] = np.repeat(number[order], (tree.hi - tree.lo)[nodes][order])
                ids = b.column(0)[k].values
                distance = _exact(tree.points, centroids[cluster])
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(cluster.astype(np.int32)), pa.array(distance)], ["id", "cluster", "distance"]
                )

    return run


def lloyd(stored_blocks: DataFrame, start: np.ndarray, rounds: int) -> np.ndarray:
    """The centroids after so many rounds; empty ones stay.  Means are exact floors."""
    centroids, dims = start, start.shape[1]
    for _ in range(rounds):
        per = stored_blocks.drop("ids").mapInArrow(_sums(centroids), "cluster int, n long, total array<long>")
        wide = "decimal(38,0)"
        sums = [F.sum(F.col("total")[i].cast(wide)) for i in range(dims)]
        centroids = centroids.copy()
        for row in per.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*sums).alias("s")).collect():
            centroids[row["cluster"]] = [int(s) // row["n"] for s in row["s"]]
    return centroids


def first_centroids(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The ``k`` vectors with the smallest SHA-256 of "seed:id", ties by the vector; null ids aside."""
    named = vectors.where("id is not null").select(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256).alias("h"), "v")
    return np.array([r["v"] for r in named.orderBy("h", "v").limit(k).collect()], np.int64)


def cluster(
    rows: DataFrame, k: int = 8, rounds: int = 10, seed: int = 3, dims: int = 64,
    id_col: str = "vec_id", vector_col: str = "embedding", block: int = BLOCK,
) -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every kept vector.

    ``kept_vectors`` says which are kept.  Distances are squared.  Repeated rows
    are vectors of their own; rows with a null id are clustered, but no centroid
    starts at them.  With fewer than ``k`` vectors there are fewer centroids;
    without any that can start one the result is empty.
    """
    vectors = kept_vectors(rows, id_col, vector_col, dims)
    start = first_centroids(vectors, k, seed)
    spark = rows.sparkSession
    if not len(start):
        kind = rows.schema[id_col].dataType.simpleString()
        schema = f"id {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
        return spark.createDataFrame([], schema).withColumnRenamed("id", id_col)
    held = blocks(vectors, dims, block)
    centroids = lloyd(held, start, rounds)
    kind = rows.schema[id_col].dataType.simpleString()
    found = held.mapInArrow(_labels(centroids), f"id {kind}, cluster int, distance long")
    found = stored(found, "assigned")
    # One row per centroid, k in all.
    sums = found.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    sums = sums.withColumn("inertia", F.sum("cluster_inertia").over(Window.partitionBy()))
    texts = [(i, ",".join(map(str, c))) for i, c in enumerate(centroids.tolist())]
    named = spark.createDataFrame(texts, "cluster int, c string").select("cluster", F.sha2("c", 256).alias("centroid_sha256"))
    about = F.broadcast(sums.join(F.broadcast(named), "cluster"))
    return found.join(about, "cluster").select(
        F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )
