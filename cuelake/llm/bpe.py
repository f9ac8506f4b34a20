"""BPE encoding by depth-first traversal of a trie of distinct words, and decoding.

For a vocabulary of merges, the encoding of a prefix is settled by its last
token alone: the last token of ``p`` is the one suffix ``t`` for which the last
token ``u`` of the rest makes ``u, t`` a pair that BPE itself leaves alone.
Distinct new words of a batch go into a trie and one depth-first walk gives each
node its last token, so a prefix that many words share is encoded once.  The
last symbol of a word carries the end-of-word mark and is a leaf of its own.

Documents are encoded where they are: no shuffle, one pass.  A task keeps the
encodings of words that it has met, up to ``MAX_CACHED`` words, then starts over; so it does with
the pairs and path ends that it has looked at.
"""

from __future__ import annotations

import gc
import json
import re
from collections.abc import Iterator
from functools import cache, lru_cache
from unicodedata import normalize

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from cuelake.llm.tables import column

MAX_CACHED, MAX_PAIRS, MAX_STATES = 400_000, 800_000, 150_000
LONGEST_CACHED = 64
ODD_SPACE = re.compile("[\x1c-\x1f]")
# Fixed value: the split pattern of the vocabulary files that this encoder reads.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
ASCII_SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+", re.A)
CONTRACTION = re.compile("'(?:s|t|re|ve|m|ll|d)")
KIND = re.compile("a+|0|[.]+")
# Letters, numbers and capitals that Unicode 16 and 17 added and Python does not know yet.
NEW_LETTERS = re.compile(
    "[\u1c89\u1c8a\ua7cb-\ua7cd\ua7da-\ua7dc\U000105c0-\U000105f3\U00010d4a-\U00010d65\U00010d6f-\U00010d85"
    "\U00010ec2-\U00010ec4\U00011380-\U00011389\U0001138b\U0001138e\U00011390-\U000113b5\U000113b7\U000113d1"
    "\U000113d3\U00011bc0-\U00011be0\U00013460-\U000143fa\U00016100-\U0001611d\U00016d40-\U00016d6c\U00018cff"
    "\U0001e5d0-\U0001e5ed\U0001e5f0]"
)
NEW_NUMBERS = re.compile(
    "[\U00010d40-\U00010d49\U000116d0-\U000116e3\U00011bf0-\U00011bf9\U00016130-\U00016139\U00016d70-\U00016d79"
    "\U0001ccf0-\U0001ccf9\U0001e5f1-\U0001e5fa]"
)
NEW_CAPITALS = {
    0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B
}
NEW_CAPITALS |= {0x10D50 + i: 0x10D70 + i for i in range(22)} | {0x16EA0 + i: 0x16EBB + i for i in range(25)}


@cache
def byte_symbols() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies.

    Printable bytes stand for themselves, the others for 256, 257, ...
    """
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = (b for b in range(256) if b not in set(kept))
    table = {b: chr(b) for b in kept} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return [table[b] for b in range(256)]


BYTE_TABLE = dict(enumerate(byte_symbols()))


@lru_cache(1 << 16)
def _kind(c: str) -> str:
    """a: letter, 0: number, space, or . for any other sign."""
    if c.isalpha() or NEW_LETTERS.match(c):
        return "a"
    if c.isnumeric() or NEW_NUMBERS.match(c):
        return "0"
    return " " if c.isspace() and not "\x1c" <= c <= "\x1f" else "."


def split_words(text: str) -> list[str]:
    """``SPLIT`` on a lower-case text: contractions, runs of letters, single numbers, runs of other signs."""
    if text.isascii():
        return ASCII_SPLIT.findall(text)
    kinds = "".join(map(_kind, text))
    out, at = [], 0
    while at < len(text):
        m = (CONTRACTION.match(text, at) if text[at] == "'" else None) or KIND.match(kinds, at)
        if m:
            out.append(text[at : m.end()])
        at = m.end() if m else at + 1
    return out


class WordBPE:
    """Encoder and decoder of a word-end BPE vocabulary file (tokenizers' JSON)."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        self.mark: str = model["end_of_word_suffix"]
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        if split["pattern"]["Regex"] != SPLIT:
            raise ValueError("the vocabulary splits words in another way")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_split = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        self.names = [""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for name, i in [*vocab.items(), *self.special.items()]:
            self.names[i] = name
        self.name_table = np.array(self.names, dtype=object)
        self.inner = {t: i for t, i in vocab.items() if not t.endswith(self.mark)}
        self.final = {t[: -len(self.mark)]: i for t, i in vocab.items() if t.endswith(self.mark)}
        self.ranks: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.ranks[vocab[a], vocab[b]] = rank, vocab[a + b]
        self.symbols = {i: [self.inner[c] for c in t] for t, i in self.inner.items()}
        self.symbols |= {i: [*(self.inner[c] for c in t[:-1]), self.final[t[-1]]] for t, i in self.final.items() if t}
        self.made = {new: (rank, *pair) for pair, (rank, new) in self.ranks.items()}
        self.begins = {t[:k] for t in [*self.inner, *self.final] for k in range(1, len(t) + 1)}
        self.follow: dict[str, tuple[str, list[tuple[int, int]], list[tuple[int, int]]]] = {}
        self.good: dict[int, bool] = {}  # by u * 2 ** 20 + t
        self.cached: dict[str, bytes] = {}

    def merge(self, ids: list[int]) -> list[int]:
        """Plain BPE: apply the lowest-ranked adjacent pair until none is left."""
        ids, ranks = list(ids), self.ranks
        while len(ids) > 1:
            best = min(
                ((r[0], i) for i, p in enumerate(zip(ids, ids[1:], strict=False)) if (r := ranks.get(p))), default=None
            )
            if best is None:
                break
            i = best[1]
            ids[i : i + 2] = [ranks[ids[i], ids[i + 1]][1]]
        return ids

    def stays(self, u: int, t: int) -> bool:
        """Whether BPE leaves ``u, t`` as they are; u = -1: whether t stands alone."""
        known = self.good.get((u << 20) + t)
        if known is None:
            alone = u < 0
            known = self.good[(u << 20) + t] = self.merge(self.symbols[t]) == [t] if alone else not self._crossed(u, t)
        return known

    def _crossed(self, x: int, y: int) -> bool:
        """Whether some merge crosses the border while BPE builds ``x`` and ``y`` side by side.

        Goes back in time: the younger of the two at the border is undone first.
        A pair at the border merges if its rank comes before both are used up
        by their own merges; of equal ranks the one further left goes first.
        """
        never = (-1, -1, -1)
        x_used = y_used = len(self.ranks)
        while True:
            r = self.ranks.get((x, y))
            if r is not None and r[0] < x_used and r[0] <= y_used:
                return True
            mx, my = self.made.get(x, never), self.made.get(y, never)
            if mx[0] < 0 and my[0] < 0:
                return False
            if mx[0] > my[0]:
                x_used, x = mx[0], mx[2]
            else:
                y_used, y = my[0], my[1]

    def _follow(self, path: str) -> tuple[str, list[tuple[int, int]], list[tuple[int, int]]]:
        """What the end of a path allows: the longest end that begins some token, and (token, size) of
        the tokens that end here inside a word and at its end, large first.

        ``path`` need only be the longest end of the path before that begins a
        token, and one more symbol.
        """
        found = self.follow.get(path)
        if found is None:
            ends = [path[k:] for k in range(len(path))]
            found = self.follow[path] = (
                next((e for e in ends if e in self.begins), ""),
                [(self.inner[e], len(e)) for e in ends if e in self.inner],
                [(self.final[e], len(e)) for e in ends if e in self.final],
            )
        return found

    def _last(self, tokens: list[int], choices: list[tuple[int, int]]) -> tuple[int, int]:
        """The choice that BPE makes after ``tokens``, the last tokens of all shorter prefixes."""
        n, known = len(tokens), self.good.get
        for t, size in choices:
            u = tokens[n - size]
            ok = known((u << 20) + t)
            if ok is None:
                ok = self.stays(u, t)
            if ok:
                return t, size
        raise ValueError("no token ends here")

    def encode_words(self, words: set[str]) -> dict[str, list[int]]:
        """Ids of every word (strings of byte symbols), by one walk over their trie."""
        root: dict = {}
        for w in words:
            node = root
            for c in w[:-1]:
                below = node.get(c)
                if below is None:
                    below = node[c] = {}
                node = below
            node[w[-1] + self.mark] = w
        out: dict[str, list[int]] = {}
        tokens = [-1]  # tokens[k]: the last token of the first k symbols of the path
        sizes = [0]
        follow, good = self.follow.get, self._last
        stack = [("", root, 0)]  # the end of the path that begins a token
        while stack:
            path, node, depth = stack.pop()
            del tokens[depth or 1 :], sizes[depth or 1 :]
            if depth:
                end, inside, _ = follow(path) or self._follow(path)
                t, size = good(tokens, inside)
                tokens.append(t)
                sizes.append(size)
            else:
                end = ""
            for c, below in node.items():
                if below.__class__ is dict:
                    stack.append((end + c, below, depth + 1))
                    continue
                last = end + c[0]
                t, size = good(tokens, (follow(last) or self._follow(last))[2])
                ids, at = [t], depth + 1 - size
                while at:
                    ids.append(tokens[at])
                    at -= sizes[at]
                ids.reverse()
                out[below] = ids
        return out

    def _words(self, chunk: str) -> list[str | int]:
        """The words of a text without white space, as byte symbols; ids of special tokens."""
        if chunk.isascii() and chunk.isalpha():
            return [chunk.lower()]
        out: list[str | int] = []
        for part in self.special_split.split(chunk) if "<|" in chunk else [chunk]:
            if part in self.special:
                out.append(self.special[part])
            elif part:
                plain = normalize("NFC", part).replace("Σ", "σ").lower()
                if not plain.isascii():
                    plain = plain.translate(NEW_CAPITALS)
                words = [plain] if plain.isascii() and plain.isalpha() else split_words(plain)
                out += [w if w.isascii() and w.isprintable() else w.encode().decode("latin-1").translate(BYTE_TABLE) for w in words]
        return out

    def _chunks(self, text: str) -> list[str]:
        # str.split also splits at 1C-1F, which the vocabulary's pattern takes for signs.
        if ODD_SPACE.search(text):
            return [x for x in re.split(r"[^\S\x1c-\x1f]+", text) if x]
        return text.split()

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        """Ids of every text, as little-endian unsigned 32-bit integers."""
        split = [self._chunks(t or "") for t in texts]
        if len(self.cached) > MAX_CACHED:
            self.cached.clear()
        if len(self.good) > MAX_PAIRS:
            self.good.clear()
        if len(self.follow) > MAX_STATES:
            self.follow.clear()
        fresh = {c: self._words(c) for c in set().union(*split).difference(self.cached)}
        collecting = gc.isenabled()
        gc.disable()  # a trie has no cycles, only many small dicts to scan in vain
        try:
            found = self.encode_words({w for ws in fresh.values() for w in ws if isinstance(w, str)})
        finally:
            if collecting:
                gc.enable()
        long: dict[str, bytes] = {}
        for c, ws in fresh.items():
            ids = [i for w in ws for i in (found[w] if isinstance(w, str) else (w,))]
            (self.cached if len(c) <= LONGEST_CACHED else long)[c] = np.array(ids, "<u4").tobytes()
        get = self.cached.__getitem__
        if long:
            return [b"".join([self.cached[c] if c in self.cached else long[c] for c in s]) for s in split]
        return [b"".join(map(get, s)) for s in split]

    def decode(self, ids: bytes) -> str:
        """Token strings joined by spaces: the vocabulary file names no decoder."""
        return " ".join(self.name_table[np.frombuffer(ids, "<u4")])


@cache
def loaded(path: str) -> WordBPE:
    """One encoder per worker process and file."""
    return WordBPE(path)


def slices(texts: list[str | None], most: int = 1 << 21) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``most`` characters each, so that memory stays bounded."""
    at = size = 0
    for i, t in enumerate(texts):
        size += len(t or "") + 16
        if size >= most:
            yield at, i + 1
            at, size = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


def encode(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False
) -> DataFrame:
    """(id, ids binary[, decoded string]): little-endian 32-bit ids of every whole text.

    ``path``: the vocabulary file, on every node.  Null texts count as empty and
    give no ids.  Repeated rows and null ids come out as they came in; other
    columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = loaded(path)
        for b in batches:
            texts = b.column(1).to_pylist()
            for at, end in slices(texts):
                ids = coder.encode_batch(texts[at:end])
                cols = [b.column(0)[at:end], pa.array(ids, pa.binary())]
                if decoded:
                    cols.append(pa.array([coder.decode(x) for x in ids], pa.string()))
                yield pa.RecordBatch.from_arrays(cols, ["id", "ids", "decoded"][: len(cols)])

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(column(id_col).alias("id"), column(text_col).alias("text")).mapInArrow(
        run, f"id {kind}, ids binary" + ", decoded string" * decoded
    )
    return out.withColumnRenamed("id", id_col)
