"""Hashed word n-grams of many texts at once."""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np

TOKEN = re.compile(r"\w+|[^\w\s]+")
_MOST = 250_000


class Hashes(dict):
    """Word -> CRC-32 of its UTF-8 bytes; starts over when it grows large."""

    def __missing__(self, word: str) -> int:
        if len(self) >= _MOST:
            self.clear()
        h = self[word] = crc32(word.encode("utf-8", "surrogatepass"))
        return h


_hashes = Hashes()


def token_hashes(text: str) -> np.ndarray:
    """32-bit hashes of the words and signs of a text, lower-cased."""
    words = TOKEN.findall(text.lower())
    return np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))


def bins(tokens: np.ndarray, size: int) -> np.ndarray:
    """Bins (0 .. size-1, a power of two) of all unigrams, then all bigrams."""
    mixed = [tokens * np.uint64(0x9E3779B97F4A7C15)]
    if len(tokens) > 1:
        pair = tokens[:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + tokens[1:] * np.uint64(0x165667B19E3779F9)
        mixed.append(pair ^ (pair >> np.uint64(29)))
    x = np.concatenate(mixed)
    return ((x >> np.uint64(33)) & np.uint64(size - 1)).astype(np.int64)


def pieces(tokens: np.ndarray, size: int, step: int = 1 << 16) -> Iterator[np.ndarray]:
    """``bins`` of a long text piece by piece, each n-gram once."""
    for at in range(0, max(len(tokens), 1), step):
        part = bins(tokens[at : at + step + 1], size)
        # The last token of a piece is the first of the next: count it there.
        yield part if at + step >= len(tokens) else np.delete(part, step)
