"""Exact, line and SimHash dedup and canonical digests against brute force."""

from __future__ import annotations

import hashlib
import string
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from cuelake.llm import exact_dedup, filters, fingerprints, line_dedup, simhash

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def norm(t):
    return (t or "").translate(LOWER)


def pairs(frame):
    return [(r["doc_id"], r["text"]) for r in frame.select("doc_id", "text").collect()]


@pytest.mark.parametrize("name", ["odd", "docs", "empty"])
def test_exact_duplicates(request, name):
    frame = request.getfixturevalue(name)
    groups = defaultdict(list)
    for i, t in pairs(frame):
        groups[norm(t)].append(i)
    expected = Counter()
    for i, t in pairs(frame):
        g = groups[norm(t)]
        expected[i, max((x for x in g if x is not None), default=None), len(g), hashlib.sha256(norm(t).encode()).hexdigest()] += 1
    got = exact_dedup.exact_duplicates(frame).collect()
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == expected
    kept = Counter(r["text_sha256"] for r in got if r["kept"])
    assert set(kept.values()) <= {1} and len(kept) == len(groups)
    assert all(r["doc_id"] == r["keep_id"] for r in got if r["kept"])


@pytest.mark.parametrize("name", ["odd", "docs", "empty"])
def test_drop_exact_duplicates(request, name):
    frame = request.getfixturevalue(name)
    left = exact_dedup.drop_exact_duplicates(frame)
    assert left.columns == frame.columns
    best = {}
    for i, t in pairs(frame):
        best[norm(t)] = max(best.get(norm(t), -1), -1 if i is None else i)
    assert Counter((-1 if i is None else i, norm(t)) for i, t in pairs(left)) == Counter((i, t) for t, i in best.items())


def test_filters_grow_with_the_rows():
    assert filters.size_log2(0) == filters.BUCKET_LOG2
    for rows in (10**6, 10**9, 10**11):
        assert rows <= 1 << filters.size_log2(rows) < 2 * rows
        found = filters.Filter(None, filters.size_log2(rows))
        assert found.shards << filters.WORDS_LOG2 >= rows


@pytest.mark.parametrize("words_log2", [26, 12])
@pytest.mark.parametrize("build", [filters.twice, filters.once_and_twice])
def test_twice_seen(spark, monkeypatch, build, words_log2):
    """No repeated hash is missed, few others are suspected, with one shard and with eight."""
    monkeypatch.setattr(filters, "WORDS_LOG2", words_log2)
    hashes = spark.range(20_000).select(F.xxhash64(F.col("id") % 19_000).alias("h"))
    hashes = hashes.union(spark.range(3000).select(F.lit(-7).cast("long").alias("h"))).union(spark.sql("select cast(null as bigint) as h"))
    found = build(hashes, hashes.count())
    assert found.shards == (1 if words_log2 == 26 else 8)
    got = filters.probe(hashes.where("h is not null"), found).collect()
    times = Counter(r["h"] for r in got)
    assert len(got) == 23_000 and all(r["suspect"] for r in got if times[r["h"]] > 1)
    alone = [r["suspect"] for r in got if times[r["h"]] == 1]
    assert sum(alone) < 0.05 * len(alone)


def test_both_builds_agree(spark):
    hashes = spark.range(5000).select(F.xxhash64(F.col("id") % 4000).alias("h"))
    rows = lambda f: sorted((r["bucket"], r["words"]) for r in f.bitmap.collect())
    assert rows(filters.twice(hashes, 5000)) == rows(filters.once_and_twice(hashes, 5000))


def test_sharded_dedup(docs, monkeypatch):
    """Results past the bound of one bitmap are the same."""
    expected = Counter(map(tuple, exact_dedup.exact_duplicates(docs).collect()))
    left = Counter(map(tuple, exact_dedup.drop_exact_duplicates(docs).collect()))
    lines = Counter(map(tuple, line_dedup.repeated_lines(docs).collect()))
    monkeypatch.setattr(filters, "WORDS_LOG2", 11)
    monkeypatch.setattr(filters, "size_log2", lambda rows: 13)
    assert filters.Filter(None, 13).shards == 4
    assert Counter(map(tuple, exact_dedup.exact_duplicates(docs).collect())) == expected
    assert Counter(map(tuple, exact_dedup.drop_exact_duplicates(docs).collect())) == left
    assert Counter(map(tuple, line_dedup.repeated_lines(docs).collect())) == lines


def test_only_suspects_shuffle(docs):
    """Rows that the filter clears reach the output without an exchange."""
    plan = exact_dedup.drop_exact_duplicates(docs)._jdf.queryExecution().executedPlan().toString()
    clear = plan.split("Union")[1].split("SortAggregate")[0]
    assert "BroadcastHashJoin" in clear and "Exchange hashpartitioning" not in clear.split(":-")[1]


SPACE = " \t\n\x0b\x0c\r"


def slow_lines(frame, least=3):
    where = defaultdict(set)
    for i, t in pairs(frame):
        for x in (t or "").split("\n"):
            key = norm(x.strip(SPACE))
            if i is not None and len(key) >= 20:
                where[key].add(i)
    gone = {k: max(v) for k, v in where.items() if len(v) >= least}
    for i, t in pairs(frame):
        lines = (t or "").split("\n")
        keep = [x for x in lines if i is None or gone.get(norm(x.strip(SPACE)), i) == i]
        yield i, len(lines), len(lines) - len(keep), "\n".join(keep)


@pytest.mark.parametrize("name", ["odd", "docs", "empty"])
def test_line_dedup(request, name):
    frame = request.getfixturevalue(name)
    got = line_dedup.drop_repeated_lines(frame).collect()
    assert Counter((r["r"]["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in got) == Counter(slow_lines(frame))
    assert name != "odd" or sum(r["n_dropped"] for r in got) >= 5


def slow_components(fps):
    parent = {i: i for i, _ in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, (i, a) in enumerate(fps):
        for j, b in fps[n + 1 :]:
            if (a ^ b).bit_count() <= 3:
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i, _ in fps}


def slow_fingerprint(text):
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("name", ["odd", "docs"])
def test_near_duplicates(request, name):
    frame = request.getfixturevalue(name)
    got = simhash.near_duplicates(frame).collect()
    known = {(r["doc_id"], r["fp"] % 2**64): r["component"] for r in got}
    assert len(got) == frame.count()
    fps = sorted({(i, slow_fingerprint(t)) for i, t in pairs(frame) if i is not None})
    assert {k for k in known if k[0] is not None} == set(fps)
    expected = slow_components(fps)
    assert all(known[i, f] == expected[i] for i, f in fps)


def test_near_links_at_each_distance(spark):
    """Planted fingerprints at distances 1 to 4, in every block, some over a chain."""
    base = 0x0123456789ABCDEF
    fps = [(0, base), (1, base ^ 1), (2, base ^ 1 << 63 ^ 1 << 30 ^ 1), (3, base ^ 0b1111 << 40), (4, base ^ 0b111 << 20), (5, ~base & 2**64 - 1)]
    fps += [(10 + b, 0xF0F0F0F0F0F0F0F0 ^ 1 << b ^ 1 << (b + 21) % 64 ^ 1 << (b + 43) % 64) for b in range(0, 64, 9)] + [(9, 0xF0F0F0F0F0F0F0F0)]
    signed = {i: f - 2**64 if f >= 2**63 else f for i, f in fps}
    frame = spark.createDataFrame([(f,) for f in signed.values()], "fp long")
    found = {r["node"]: r["component"] for r in simhash.components(simhash.links(frame)).collect()}
    root = {i: found.get(f, f) for i, f in signed.items()}
    expected = slow_components(sorted(fps))
    assert {i: min(j for j in root if root[j] == root[i]) for i in root} == expected


@pytest.mark.parametrize("size", [1, 7, 10_000])
def test_keys_longer_than_a_batch(size):
    """Runs of one key are whole, however batches cut them."""
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(3)
    key = np.sort(rng.integers(0, 6, 400))
    fp = rng.integers(0, 1 << 9, 400)
    whole = pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp)], ["key", "fp"])
    batches = [whole.slice(at, size) for at in range(0, 400, size)]
    got = {tuple(r.values()) for b in simhash._links(3)(iter(batches)) for r in b.to_pylist()}
    expected = {tuple(r.values()) for b in simhash._links(3)(iter([whole])) for r in b.to_pylist()}
    assert got == expected and all(0 < (u ^ v).bit_count() for u, v in got)


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(1, 60)] + [(101, 100)], "u long, v long")
    found = {r["node"]: r["component"] for r in simhash.components(edges).collect()}
    assert found == {**{i: 1 for i in range(2, 61)}, 101: 100}


@pytest.mark.parametrize("name", ["docs", "odd"])
def test_dropping_by_broadcast_and_by_shuffle(request, monkeypatch, name):
    """Few ids that go are broadcast, many are met in a shuffle: the same rows stay."""
    frame = request.getfixturevalue(name)
    kept = lambda: sorted((tuple(r) for r in simhash.drop_near_duplicates(frame).collect()), key=str)
    few = kept()
    assert "BroadcastHashJoin" in simhash.drop_near_duplicates(frame)._jdf.queryExecution().toString()
    monkeypatch.setattr(simhash, "GONE_BROADCAST", -1)
    assert kept() == few and len(few) <= frame.count()
    found = simhash.near_duplicates(frame).collect()
    stay = sorted((r["doc_id"] for r in found if r["doc_id"] is None or r["doc_id"] == r["component"]), key=str)
    assert sorted((r[0] for r in few), key=str) == stay


def test_drop_near_duplicates(docs, empty):
    left = simhash.drop_near_duplicates(docs)
    assert left.columns == docs.columns
    found = simhash.near_duplicates(docs).collect()
    assert {r["doc_id"] for r in left.select("doc_id").collect()} == {r["component"] for r in found}
    assert simhash.near_duplicates(empty).count() == 0


def slow_edits(frame):
    order = sorted(pairs(frame), key=lambda p: (p[0] is not None, p[0] or 0, p[1] is not None, p[1] or ""), reverse=True)
    for k, (i, t) in enumerate(order):
        t, following = t or "", order[(k + 1) % len(order)][1] or ""
        n = len(t) // 3
        other = t[: len(t) - n] + following[:n]
        a, b, c = map(fingerprints.canonical, (t, other, following))
        yield i, len(t), hashlib.sha256(other.encode()).hexdigest(), fingerprints.digest(a), fingerprints.digest(b), float(a == b), float(a == c)


@pytest.mark.parametrize("name", ["odd", "docs", "empty"])
def test_edit_comparison(request, name):
    frame = request.getfixturevalue(name)
    assert Counter(map(tuple, fingerprints.edit_comparison(frame).collect())) == Counter(slow_edits(frame))


def test_edit_comparison_of_few_rows(odd):
    """One document follows itself; null ids follow each other."""
    for few in (odd.where("doc_id = 1"), odd.where("doc_id is null"), odd.where("doc_id in (1, 2)")):
        assert Counter(map(tuple, fingerprints.edit_comparison(few).collect())) == Counter(slow_edits(few))


def test_canonical():
    assert fingerprints.canonical("  Straße\t\nＡＢＣ ﬁ ") == fingerprints.canonical("STRASSE abc FI")
    assert fingerprints.canonical("a b") != fingerprints.canonical("ab")
    assert fingerprints.canonical(None) == b""


@pytest.mark.parametrize("name", ["odd", "empty"])
def test_fingerprints_have_no_collisions(request, name):
    frame = request.getfixturevalue(name)
    got = {(r["doc_id"], r["fingerprint"]) for r in fingerprints.fingerprints(frame).collect()}
    assert got == {(i, fingerprints.digest(fingerprints.canonical(t))) for i, t in pairs(frame)}


@pytest.mark.parametrize("kind", ["string", "date"])
def test_ids_of_other_types(docs, kind):
    """Ids that are not numbers; names with a dot."""
    named = F.concat(F.lit("doc-"), F.col("doc_id")) if kind == "string" else F.date_add(F.lit("2020-01-01"), F.col("doc_id").cast("int"))
    frame = docs.select(named.alias("the.id"), F.col("text").alias("the.text"))
    order = sorted(((r[0], r[1]) for r in frame.collect()), reverse=True)
    following = {i: order[(k + 1) % len(order)][1] for k, (i, _) in enumerate(order)}
    for r in fingerprints.edit_comparison(frame, "the.id", "the.text").collect():
        text = dict(order)[r["the.id"]]
        assert r["edited_sha256"] == hashlib.sha256(fingerprints.edited(text, following[r["the.id"]]).encode()).hexdigest()
    assert line_dedup.repeated_lines(frame, "the.id", "the.text").count() > 0
    assert exact_dedup.drop_exact_duplicates(frame, "the.id", "the.text").count() < frame.count()
    assert simhash.near_duplicates(frame, "the.id", "the.text").count() == frame.count()
    assert simhash.drop_near_duplicates(frame, "the.id", "the.text").columns == frame.columns


def test_colliding_rows_get_ordinals(spark):
    """Rows that share a hash but not their bytes are told apart round by round."""
    rows = spark.createDataFrame([(1, "f"), (2, "f"), (3, "g")], "id long, fp string")
    other = spark.createDataFrame([(2, "f", 1)], "id long, fp string, ordinal int")
    assert {tuple(r) for r in fingerprints._with_ordinals(rows, other).collect()} == {(1, "f"), (2, "f-1"), (3, "g")}
