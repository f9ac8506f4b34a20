"""Prefix trie, clustering and token counts against plain Python, on odd tables too."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from cuelake.llm import dual_tree, prefix_trie, token_counts
from cuelake.llm.queries import COUNTED_BPE, TOKENIZERS

PATH = f"{TOKENIZERS}/{COUNTED_BPE}"
TURNS = "conv_id long, turn long, role string, text string, c long, depth string, label string, block int, sha string"


def slow_trie(rows, rebuild):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            sha = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
            convs[c].append((turn is not None, turn or 0, role, sha, text))
    seqs = {}
    for c in convs:
        h = zlib.crc32(str(c).encode()) % 9 if rebuild else 0
        base = sorted(convs.get(c - int(math.fmod(c, 5)), []))
        seqs[c] = tuple((r, x) for _, _, r, _, x in base[:h] + sorted(convs[c])[h:])
    members, kids = defaultdict(list), defaultdict(list)
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
    for s in members:
        if s:
            kids[s[:-1]].append(s)
    leaves, saved, out = {}, {}, []
    for s in sorted(members, key=len, reverse=True):
        own = (len(members[s]) - 1) * len(s[-1][1].encode()) if s else 0
        leaves[s] = sum(leaves[k] for k in kids[s]) or 1
        saved[s] = own + sum(saved[k] for k in kids[s])
        ends = ",".join(str(c) for c in sorted(members[s]) if len(seqs[c]) == len(s))
        up = min(members[s[:-1]]) if s else None
        sha = hashlib.sha256(ends.encode()).hexdigest()
        out.append((min(members[s]), len(s), up, len(members[s]), len(kids[s]), leaves[s], saved[s], sha))
    return sorted(out, key=lambda r: r[:2])


def found_trie(spark, rows, rebuild):
    frame = spark.createDataFrame([(*r, 1, "d", "l", 2, "s") for r in rows], TURNS)
    got = prefix_trie.prefix_trie(frame, rebuild).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"
    )
    return sorted((tuple(r) for r in got.collect()), key=lambda r: r[:2])


def odd_turns():
    out = [(0, None, None, None), (0, 1, "user", ""), (0, 1, "user", ""), (0, 2, "a", "x" * 40_000), (None, 0, "user", "no one")]
    out += [(7, t, "user", f"t{t}") for t in (3, 1, 2, None)] + [(5, 1, "user", "t1"), (5, 1, None, "t1"), (-3, 4, "user", "t1")]
    out += [(c, t, "user", "same words") for c in range(100, 400) for t in range(3)]
    return out


@pytest.mark.parametrize("rebuild", [False, True])
def test_trie_of_odd_turns(spark, rebuild):
    assert found_trie(spark, odd_turns(), rebuild) == slow_trie(odd_turns(), rebuild)


def test_trie_of_a_caterpillar_and_a_long_conversation(spark, monkeypatch):
    """Conversation k leaves the one before at depth k; blocks of 8 turns."""
    monkeypatch.setattr(prefix_trie, "BLOCK_LOG2", 3)
    monkeypatch.setattr(prefix_trie, "IDS_LOG2", 2)
    rows = [(k, t, "u", f"main {t}" if t < k else f"own {k}") for k in range(60) for t in range(k + 1)]
    rows += [(1000, t * 5, "u", f"main {t}") for t in range(300)]
    random.Random(1).shuffle(rows)
    assert found_trie(spark, rows, False) == slow_trie(rows, False)


def test_trie_without_rows(spark):
    assert found_trie(spark, [], True) == []


def test_trie_of_the_table(spark, sf_dir):
    frame = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    rows = [tuple(r) for r in frame.collect()]
    assert found_trie(spark, rows, True) == slow_trie(rows, True)


def slow_lloyd(rows, k, rounds, seed, dims):
    kept = [
        (i, [math.floor(1024 * x) for x in v])
        for i, v in rows
        if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) and abs(x) < 1 << 17 for x in v)
    ]
    order = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    cents = [list(v) for _, v in order[:k]]
    for r in range(rounds + 1):
        near = [min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(cents)) for _, v in kept]
        for j in range(len(cents) if r < rounds else 0):
            mine = [v for (_, v), (_, n) in zip(kept, near, strict=True) if n == j]
            if mine:
                cents[j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    shas = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    total = sum(d for d, _ in near)
    rows = [(i, j, d, sum(e for e, n in near if n == j), total, shas[j]) for (i, _), (d, j) in zip(kept, near, strict=True)]
    return sorted(rows, key=str)


def odd_vectors():
    rng = random.Random(5)
    mids = [[rng.uniform(-9, 9) for _ in range(6)] for _ in range(4)]
    rows = [(i, [m + rng.gauss(0, 0.3) for m in rng.choice(mids)]) for i in range(300)]
    rows += [(1000 + i, [1.5] * 6) for i in range(150)] + [(1000, [1.5] * 6), (None, [0.1] * 6), (None, [0.1] * 6)]
    bad = [None, [], [1.0] * 5, [1.0] * 7, [None] * 6, [math.nan] * 6, [1.0] * 5 + [math.inf], [1e30] * 6, [-131072.0] * 6]
    rows += [(2000 + i, v) for i, v in enumerate(bad)] + [(3000, [131071.9] * 6), (3001, [-131071.9] * 6), (3002, [-0.0001] * 6)]
    return rows


@pytest.mark.parametrize("block", [7, 1024])
def test_clusters_of_odd_vectors(spark, block):
    frame = spark.createDataFrame([(*r, 1, "v", 2) for r in odd_vectors()], "vec_id long, embedding array<double>, cluster int, ids string, n int")
    got = dual_tree.cluster(frame, k=5, rounds=6, dims=6, block=block)
    got = got.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
    assert sorted((tuple(r) for r in got.collect()), key=str) == slow_lloyd(odd_vectors(), 5, 6, 3, 6)


def test_few_vectors_give_few_centroids(spark):
    rows = [(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, [5.0, 5.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = dual_tree.cluster(frame, dims=2)
    assert sorted((tuple(r) for r in got.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()), key=str) == slow_lloyd(rows, 8, 10, 3, 2)
    assert dual_tree.cluster(frame.limit(0), dims=2).collect() == []
    assert dual_tree.cluster(frame).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 60), st.integers(1, 9), st.integers(1, 5), st.sampled_from([1, 4, 1000]))
def test_pruned_pairs_lose_nothing(seed, n, k, dims, width):
    rng = np.random.default_rng(seed)
    points, cents = rng.integers(-width, width + 1, (n, dims)), rng.integers(-width, width + 1, (k, dims))
    tree, order = dual_tree.build_tree(points)
    nodes, number = dual_tree.dual_assign(tree, cents, dual_tree.build_centroid_tree(cents))
    got = np.full(n, -1)
    for q, r in zip(nodes, number, strict=True):
        assert (got[order[tree.lo[q] : tree.hi[q]]] == -1).all()
        got[order[tree.lo[q] : tree.hi[q]]] = r
    assert (got == ((points[:, None] - cents[None]) ** 2).sum(axis=2).argmin(axis=1)).all()


def test_cover_tree_holds_its_bounds():
    """Children lie within their parent's radius, apart from each other; groups far from all but one centroid settle at once."""
    rng = np.random.default_rng(3)
    points = np.concatenate([rng.integers(-5, 6, (200, 3)) + m for m in (0, 1000, 5000)])
    tree, _ = dual_tree.build_tree(points)
    for q in range(len(tree.lo)):
        gap = np.sqrt(((tree.points[tree.lo[q] : tree.hi[q]] - tree.center[q]) ** 2).sum(axis=1))
        assert gap.max() <= tree.radius[q] + 1e-6
        kids = tree.center[tree.first[q] : tree.first[q] + tree.n_kids[q]].astype(float)
        if len(kids) > 1:
            apart = np.sqrt(((kids[:, None] - kids[None]) ** 2).sum(axis=2))[~np.eye(len(kids), dtype=bool)]
            assert apart.min() > 0
    cents = np.array([[0, 0, 0], [1000, 1000, 1000], [5000, 5000, 5000]])
    nodes, _ = dual_tree.dual_assign(tree, cents, dual_tree.build_centroid_tree(cents))
    assert len(nodes) <= 12


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def expected_counts(library, rows, limit=1024):
    out = [(i, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in rows]
    return sorted(((*r, r[2] > limit) for r in out), key=str)


@pytest.mark.parametrize("name", ["odd", "docs", "empty"])
@pytest.mark.parametrize("most", [0, 1 << 26])
def test_counts_equal_the_library(request, library, tmp_path, monkeypatch, name, most):
    monkeypatch.setattr(token_counts, "MOST_BROADCAST", most)
    frame = request.getfixturevalue(name)
    rows = [tuple(r) for r in frame.select("doc_id", "text").collect()]
    for _ in range(2):
        got = token_counts.count_tokens(frame, PATH, str(tmp_path / "cache"))
        assert sorted((tuple(r) for r in got.collect()), key=str) == expected_counts(library, rows)


def test_only_misses_are_encoded(spark, library, tmp_path):
    cache = str(tmp_path / "cache")
    rows = [(1, "one text"), (2, "one text"), (3, "other <|endoftext|> text"), (4, None), (5, "")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    token_counts.count_tokens(frame, PATH, cache).collect()
    assert spark.read.parquet(cache).count() == 3
    # Counts that are stored are used, right or wrong; a digest stored twice counts once; only the new text is added.
    spark.read.parquet(cache).withColumn("n_tokens", token_counts.F.lit(77).cast("long")).write.partitionBy("version").mode("append").parquet(cache)
    more = spark.createDataFrame([*rows, (6, "something new")], "doc_id long, text string")
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts.count_tokens(more, PATH, cache).collect()}
    assert got == {**dict.fromkeys(range(1, 6), 77), 6: len(library.encode("something new", add_special_tokens=False).ids)}
    assert spark.read.parquet(cache).count() == 7
    # Another tokenizer does not meet these counts.
    pieces = f"{TOKENIZERS}/piece_bpe_32k.model"
    other = {r["doc_id"]: r["n_tokens"] for r in token_counts.count_tokens(frame, pieces, cache).collect()}
    assert other[4] == other[5] == 0 and 0 < other[1] == other[2] < 20
