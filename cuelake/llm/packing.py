"""Token-id output: best-fit-decreasing packing into rows of fixed length.

A task encodes its documents, cuts those longer than a row into row-sized
pieces and a rest, and packs groups of about ``GROUP_TOKENS`` tokens: pieces in
order of decreasing length, each into the fullest row that still has room.  A
segment tree over free space finds that row in logarithmic time.  Groups are
bounded, so memory is, and no document is shuffled.

A packed row holds its ids as one row of the matrix (padded), the cumulative
lengths of its segments, the position of every token (starting anew with each
segment), and for each segment its document and offset there, from which
``unpack`` restores every document.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROW_TOKENS, GROUP_TOKENS, PAD = 2048, 1 << 20, 0
# Fixed value: how byte-level vocabularies split a text before they merge.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


# Fixed value: what the pattern above calls white space.
SPACES = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
LONG_SPACE = re.compile(f"[{SPACES}]{{512,}}")


class Coder:
    """A byte-level vocabulary.

    The pattern's look-ahead takes stack in proportion to a run of white space, so
    long runs are cut out by the rule it stands for: a run is one piece without
    its last character, which belongs to what follows; at the end of a text the
    whole run is one piece.
    """

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self._pieces = tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        self._whole = tiktoken.Encoding("whole", pat_str="(?s:.+)", mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> list[int]:
        """The ids of a whole text."""
        out: list[int] = []
        at = 0
        for run in LONG_SPACE.finditer(text):
            end = run.end() - (run.end() < len(text))
            out += self._pieces.encode_ordinary(text[at : run.start()])
            out += self._whole.encode_ordinary(text[run.start() : end])
            at = end
        return out + self._pieces.encode_ordinary(text[at:])

    def decode(self, ids: list[int]) -> str:
        """The text of whole ids."""
        return self._pieces.decode(ids)


@cache
def loaded(path: str) -> Coder:
    """The vocabulary of a file of ranks; one per worker process."""
    return Coder(path)


class FreeSpace:
    """Rows by free space: a segment tree over 0 .. capacity that counts open rows."""

    def __init__(self, capacity: int) -> None:
        self.size = 1 << max(1, capacity.bit_length())
        self.tree = [0] * (2 * self.size)
        self.rows: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _add(self, free: int, n: int) -> None:
        at = self.size + free
        while at:
            self.tree[at] += n
            at //= 2

    def put(self, row: int, free: int) -> None:
        """Record a row with so much free space."""
        self.rows[free].append(row)
        self._add(free, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """Remove and return (row, free) with the least free space >= need; None if there is none."""
        at = self.size + need
        if not self.tree[at]:
            while at > 1 and (at % 2 or not self.tree[at + 1]):
                at //= 2
            if at <= 1:
                return None
            at += 1
            while at < self.size:
                at = 2 * at if self.tree[2 * at] else 2 * at + 1
        free = at - self.size
        self._add(free, -1)
        return self.rows[free].pop(), free


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Rows of indexes: best-fit-decreasing; every length is 1 .. capacity."""
    space, rows = FreeSpace(capacity), []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        found = space.take(lengths[i])
        row, free = found if found else (len(rows), capacity)
        if not found:
            rows.append([])
        rows[row].append(i)
        if free > lengths[i]:
            space.put(row, free - lengths[i])
    return rows


def _packed(group: list[tuple], capacity: int, task: int, at: int) -> list[dict]:
    out = []
    for k, row in enumerate(best_fit([len(p[2]) for p in group], capacity)):
        ids, positions, cum = np.full(capacity, PAD, "<u4"), np.zeros(capacity, "<u4"), [0]
        for i in row:
            piece = group[i][2]
            ids[cum[-1] : cum[-1] + len(piece)] = piece
            positions[cum[-1] : cum[-1] + len(piece)] = np.arange(len(piece))
            cum.append(cum[-1] + len(piece))
        out.append(
            {
                "part": task, "row": at + k, "ids": ids.tobytes(), "cu_seqlens": cum, "positions": positions.tobytes(),
                "docs": [group[i][0] for i in row], "offsets": [group[i][1] for i in row],
            }
        )
    return out


def write_packed(packed: DataFrame, path: str) -> None:
    """Store packed rows as Parquet at ``path``, which must not exist: a file per task, committed when its task ends.

    ``ids`` and ``positions`` are rows of fixed width in stored order: a reader maps a
    file's column to a matrix of ``row_tokens`` columns without any parsing.
    """
    packed.write.option("parquet.enable.dictionary", "false").parquet(path)


def pack(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", row_tokens: int = ROW_TOKENS
) -> DataFrame:
    """(part, row, ids, cu_seqlens, positions, docs, offsets): the packed rows.

    ``ids`` and ``positions`` are ``row_tokens`` little-endian unsigned 32-bit
    integers; beyond ``cu_seqlens[-1]`` both are zero.  ``docs`` and ``offsets``
    name each segment's document and its first token there.  ``path``: a file of
    byte-level ranks, on every node; bytes make the ids lossless.  Null and empty
    texts have no tokens and take part in no row.  Repeated ids and null ids
    are packed like others, each row of ``docs`` on its own.  (part, row) is
    unique.  Empty input gives an empty frame.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    schema = (
        f"part int, row long, ids binary, cu_seqlens array<int>, positions binary, docs array<{kind}>, offsets array<long>"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, coder, group, tokens, at = TaskContext.get().partitionId(), loaded(path), [], 0, 0
        target = None
        for b in batches:
            target = pa.schema(
                [
                    ("part", pa.int32()), ("row", pa.int64()), ("ids", pa.binary()), ("cu_seqlens", pa.list_(pa.int32())),
                    ("positions", pa.binary()), ("docs", pa.list_(b.schema.field(0).type)), ("offsets", pa.list_(pa.int64())),
                ]
            )
            for key, text in zip(b.column(0), b.column(1), strict=True):
                ids = np.array(coder.encode(text.as_py() or ""), "<u4")
                group += [(key.as_py(), o, ids[o : o + row_tokens]) for o in range(0, len(ids), row_tokens)]
                tokens += len(ids)
                if tokens >= GROUP_TOKENS:
                    rows = _packed(group, row_tokens, task, at)
                    yield pa.RecordBatch.from_pylist(rows, target)
                    group, tokens, at = [], 0, at + len(rows)
        if group:
            yield pa.RecordBatch.from_pylist(_packed(group, row_tokens, task, at), target)

    return docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(run, schema)


def unpack(packed: DataFrame) -> DataFrame:
    """(doc, offset, ids): the segments of packed rows; a document is its segments by offset."""
    segments = packed.select("ids", "cu_seqlens", F.posexplode(F.arrays_zip("docs", "offsets")).alias("k", "s"))
    begin, end = F.expr("cu_seqlens[k]"), F.expr("cu_seqlens[k + 1]")
    return segments.select(
        F.col("s.docs").alias("doc"), F.col("s.offsets").alias("offset"), F.substring("ids", begin * 4 + 1, (end - begin) * 4).alias("ids")
    )
