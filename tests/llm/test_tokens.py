"""BPE against the tokenizers library, and packing by exact round trips."""

from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from cuelake.llm import bpe, packing
from cuelake.llm.queries import BYTE_BPE, TOKENIZERS, WORD_BPE

PATH, BYTES = f"{TOKENIZERS}/{WORD_BPE}", f"{TOKENIZERS}/{BYTE_BPE}"


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def ids(raw):
    return np.frombuffer(raw, "<u4").tolist()


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60) | st.text("aAbeé'stréÖßİΣσ日本́ \x1c\x85\n 12²½_-!<|>", max_size=60))
def test_encode_equals_library(text):
    t = test_encode_equals_library.library = getattr(test_encode_equals_library, "library", None) or Tokenizer.from_file(PATH)
    coder = bpe.loaded(PATH)
    raw = coder.encode_batch([text])[0]
    expected = t.encode(text, add_special_tokens=False).ids
    assert ids(raw) == expected
    assert coder.decode(raw) == t.decode(expected, skip_special_tokens=False)


@pytest.mark.parametrize("text", ["<|endoftext|>", "a<|startoftext|>b <|endoftext|>", "<|endoftext|", "İstanbul ΣΑΣ", "it's we'll'd", "x" * 3000])
def test_special_cases(library, text):
    assert ids(bpe.loaded(PATH).encode_batch([text])[0]) == library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("name", ["odd", "docs", "empty"])
def test_encode_documents(request, library, name):
    frame = request.getfixturevalue(name)
    texts = defaultdict(list)
    for r in frame.select("doc_id", "text").collect():
        texts[r["doc_id"]].append(library.encode(r["text"] or "", add_special_tokens=False).ids)
    got = defaultdict(list)
    for r in bpe.encode(frame, PATH, decoded=True).collect():
        got[r["doc_id"]].append(ids(r["ids"]))
        assert r["decoded"] == library.decode(ids(r["ids"]), skip_special_tokens=False)
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in texts.items()}


def test_small_caches_change_nothing(docs, monkeypatch):
    texts = [r["text"] for r in docs.select("text").limit(20).collect()]
    expected = bpe.loaded(PATH).encode_batch(texts)
    monkeypatch.setattr(bpe, "MAX_CACHED", 5)
    coder = bpe.WordBPE(PATH)
    assert [coder.encode_batch([t])[0] for t in texts] == expected


def slow_best_fit(lengths, capacity):
    free, rows = [], []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        fits = [f for f in free if f >= lengths[i]]
        if fits:
            row = free.index(min(fits))
        else:
            row = len(free)
            free.append(capacity)
            rows.append([])
        free[row] -= lengths[i]
        rows[row].append(i)
    return free, rows


def test_best_fit():
    rng = random.Random(5)
    for _ in range(40):
        lengths = [rng.randint(1, 50) for _ in range(rng.randint(0, 60))]
        got, (free, _) = packing.best_fit(lengths, 50), slow_best_fit(lengths, 50)
        assert sorted(i for row in got for i in row) == list(range(len(lengths)))
        assert sorted(50 - sum(lengths[i] for i in row) for row in got) == sorted(free)


@pytest.mark.parametrize(("name", "size"), [("odd", 64), ("docs", 2048), ("empty", 64)])
def test_pack_round_trip(request, name, size):
    frame = request.getfixturevalue(name)
    packed = packing.pack(frame, BYTES, row_tokens=size)
    rows = packed.collect()
    assert len({(r["part"], r["row"]) for r in rows}) == len(rows)
    for r in rows:
        cum, positions, matrix = r["cu_seqlens"], ids(r["positions"]), ids(r["ids"])
        assert len(matrix) == len(positions) == size and cum[0] == 0 and cum[-1] <= size
        assert all(positions[a:b] == list(range(b - a)) for a, b in zip(cum, cum[1:], strict=False))
        assert set(matrix[cum[-1] :]) | set(positions[cum[-1] :]) <= {0}
    pieces = defaultdict(list)
    for r in packing.unpack(packed).collect():
        pieces[r["doc"]].append((r["offset"], ids(r["ids"])))
    coder, expected = packing.loaded(BYTES), defaultdict(list)
    for r in frame.select("doc_id", "text").collect():
        if r["text"]:
            expected[r["doc_id"]].append(r["text"])
    assert set(pieces) == set(expected)
    for key, texts in expected.items():
        if len(texts) == 1:
            tokens = [t for _, p in sorted(pieces[key]) for t in p]
            assert coder.decode(tokens) == texts[0] and tokens == coder.encode(texts[0])
        else:  # rows that repeat an id
            assert sum(len(p) for _, p in pieces[key]) == sum(len(coder.encode(t)) for t in texts)


def spaced(text):
    """The ids by the pattern itself, for runs that it can take."""
    return packing.loaded(BYTES)._pieces.encode_ordinary(text)


@pytest.mark.parametrize("run", [" " * 600, "\n" * 600, " \n" * 400, "\u3000" * 512, "\t" * 511 + " ", " " * 599 + "\n", "\x85 " * 300])
@pytest.mark.parametrize("parts", [("", ""), ("a", ""), ("", "b"), ("a b", "'s c"), ("1", "2"), ("x\x1c", "\x1cy"), ("a", "!"), (" a ", " b ")])
def test_long_white_space_splits_as_the_pattern(run, parts):
    text = run.join(parts)
    assert packing.loaded(BYTES).encode(text) == spaced(text)


def test_a_million_spaces(spark):
    texts = {1: " " * 1_000_000, 2: "a" + "\n" * 1_000_000 + "b", 3: "x" * 200_000}
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    pieces = defaultdict(list)
    for r in packing.unpack(packing.pack(frame, BYTES)).collect():
        pieces[r["doc"]].append((r["offset"], ids(r["ids"])))
    for key, text in texts.items():
        assert packing.loaded(BYTES).decode([t for _, p in sorted(pieces[key]) for t in p]) == text


def test_written_rows_come_back(docs, tmp_path):
    packed = packing.pack(docs, BYTES)
    packing.write_packed(packed, f"{tmp_path}/packed")
    back = docs.sparkSession.read.parquet(f"{tmp_path}/packed")
    assert sorted(map(str, back.collect())) == sorted(map(str, packed.collect()))
