"""Word times from measured characters, on the axis of cumulative character widths.

``segments`` has (seg_id, text, start_ms, end_ms, extent_start_ms, extent_end_ms),
``spans`` one row per character of the text's normal form: (seg_id, pos from 0,
start_ms, end_ms, score).  An aligner gives a segment's characters together: then
they stay an array ``chars`` in the segment's row.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuelake.functions import normal

# An edge character further off than so many median gaps is drawn in; how far sound may widen an edge.
OUTLIER_GAPS, ONSET_MS, CODA_MS = 4.0, 300, 400
ALIGNED, SYNTHETIC, MISMATCH = "ctc_forced_alignment", "synthetic_proportional", "char_span_count_mismatch"
_TOKENS, _WHOLE = re.compile(r"[A-Za-z0-9]+|[^\sA-Za-z0-9]", re.ASCII), re.compile(r"\S+", re.ASCII)
CHARS = "array<struct<pos:long,start_ms:double,end_ms:double,score:double>>"
WORDS = "array<struct<k:int,word:string,start_ms:double,end_ms:double,score:double,measured:boolean>>"


def _bounds(starts: list, ends: list) -> tuple[float | None, float | None]:
    """A segment's extent from its characters in order, a first or last one far off drawn in.

    Fewer than three characters, or a median gap of no length, leave the raw extent.
    """
    n, s0, e1 = len(starts), starts[0], ends[-1]
    gaps = [b - a if a is not None and b is not None else None for a, b in pairwise(starts)]
    known = sorted(gaps if None not in gaps else [g for g in gaps if g is not None])
    mid = (known[len(known) // 2] + known[(len(known) - 1) // 2]) / 2 if known else 0.0
    if n < 3 or mid <= 0:
        return s0, e1
    start = s0 + gaps[0] - mid if gaps[0] is not None and gaps[0] > OUTLIER_GAPS * mid else s0
    end = ends[-2] + mid if e1 is not None and ends[-2] is not None and e1 - ends[-2] > OUTLIER_GAPS * mid else e1
    return start, _most(start, end)


def _most(a: float | None, b: float | None) -> float | None:
    return b if a is None or (b is not None and b > a) else a


def _least(a: float | None, b: float | None) -> float | None:
    return b if a is None or (b is not None and b < a) else a


def _width(token: str) -> int:
    """Characters of a token after NFKC, white space aside."""
    return len(token) if token.isascii() else len("".join(unicodedata.normalize("NFKC", token).split()))


def _measured(tokens: list[str], widths: list[int], extent: tuple, pos: list, starts: list, ends: list, scores: list) -> list[tuple]:
    """(k, word, start, end, score) of the tokens that have characters; ``pos`` ascends."""
    b0, b1 = _bounds(starts, ends)
    x0, x1 = extent
    lo, hi = b0, b1
    if x0 is not None and x1 is not None:
        # Sound may only push an edge outwards.
        lo = _most(None if b0 is None else b0 - ONSET_MS, _least(b0, x0))
        hi = _most(lo, _least(None if b1 is None else b1 + CODA_MS, _most(b1, x1)))
    edged = (lo is not None and b0 is not None and lo < b0) or (hi is not None and b1 is not None and hi > b1)
    out, at, upto = [], bisect_left(pos, 0), 0
    for k, (word, width) in enumerate(zip(tokens, widths, strict=True)):
        upto, first = upto + width, at
        at = bisect_left(pos, upto, at)
        if at > first:
            told = scores[first:at]
            if None in told:
                told = [x for x in told if x is not None]
            s = _least(_most(starts[first], lo), hi)
            e = _least(_most(ends[at - 1], s), hi)
            out.append([k, word, s, e, sum(told) / len(told) if told else None])
    if edged and out:
        out[0][2], out[-1][3] = _least(out[0][2], lo), _most(out[-1][3], hi)
    return out


def _shared(text: str, start: float | None, end: float | None) -> list[tuple]:
    """Whole tokens at their share of the segment's time, where characters and text do not match."""
    if start is None or end is None or end <= start:
        return []
    tokens, upto, out = _WHOLE.findall(text), 0, []
    total = sum(map(len, tokens))
    for k, word in enumerate(tokens):
        before, upto = upto, upto + len(word)
        out.append((k, word, start + (end - start) * (before / total), start + (end - start) * (upto / total), None))
    return out


def _timed(*columns: Column) -> Column:
    """Words of every segment: text, start, end, extent's start and end, characters by position."""

    @F.arrow_udf(WORDS)
    def run(text: pa.Array, start: pa.Array, end: pa.Array, x0: pa.Array, x1: pa.Array, spans: pa.Array) -> pa.Array:
        plain = lambda c: c.to_pylist() if c.null_count else c.to_numpy(zero_copy_only=False).tolist()
        pos, starts, ends, scores = map(plain, spans.values.flatten())
        cuts, sizes, rows, measured = spans.offsets.to_pylist(), [0], [], []
        for i, (t, a, b, *extent) in enumerate(zip(*(c.to_pylist() for c in (text, start, end, x0, x1)), strict=True)):
            own = slice(cuts[i], cuts[i + 1])
            tokens = _TOKENS.findall(t)
            widths = [*map(len, tokens)] if t.isascii() else [*map(_width, tokens)]
            same = bool(tokens) and sum(widths) == own.stop - own.start
            found = _measured(tokens, widths, extent, pos[own], starts[own], ends[own], scores[own]) if same else _shared(t, a, b)
            rows += found
            measured += [same] * len(found)
            sizes.append(len(rows))
        k, word, s, e, score = zip(*rows, strict=True) if rows else ((),) * 5
        kinds = (pa.int32(), pa.string(), pa.float64(), pa.float64(), pa.float64(), pa.bool_())
        fields = [pa.array(c, kind) for c, kind in zip((k, word, s, e, score, measured), kinds, strict=True)]
        return pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.StructArray.from_arrays(fields, ["k", "word", "start_ms", "end_ms", "score", "measured"]))

    return run(*columns)


def aligned_words(segments: DataFrame, spans: DataFrame) -> DataFrame:
    """(seg_id, k, word, start_ms, end_ms, kind, score, reason): every segment's words in order.

    ASCII words and single other characters take the characters under them: the
    first one's start, the last one's end, the mean score, clamped to the trusted
    bounds.  Where sound reaches further (the extent, by at most 300 and 400 ms), the
    first and the last word go with it.  If the characters are not as many as the
    text has, whole tokens share the segment's time by length instead, without a
    score and with the reason.  Segments without words or, then, without time give
    no rows; spans of unknown segments are ignored.

    A segment's characters become one array, so only segments are joined.  The grouping
    sorts the characters; where they come as arrays, ``words_from_arrays`` needs none.
    """
    char = F.struct(F.col("pos").cast("long").alias("pos"), *(F.col(c).cast("double").alias(c) for c in ("start_ms", "end_ms", "score")))
    packed = spans.where("seg_id IS NOT NULL AND pos IS NOT NULL").groupBy("seg_id").agg(F.sort_array(F.collect_list(char)).alias("chars"))
    return words_from_arrays(segments.join(packed, "seg_id", "left"))


def words_from_arrays(segments: DataFrame) -> DataFrame:
    """``aligned_words`` of segments that hold their characters: no join, no grouping, no shuffle.

    ``chars`` is an array of (pos long, start_ms, end_ms, score double) in the order of
    ``pos``, which is never null; a null array has no characters.
    """
    times = (F.col(c).cast("double") for c in ("start_ms", "end_ms", "extent_start_ms", "extent_end_ms"))
    none = F.array().cast(CHARS)
    words = segments.select("seg_id", _timed(normal.one_line(F.col("text")), *times, F.coalesce("chars", none)).alias("words"))
    # The outer form, or Spark adds a filter on the array's size, for which Python would run a second time.
    w = words.select("seg_id", F.explode_outer("words").alias("w")).where("w IS NOT NULL").select("seg_id", "w.*")
    return w.select(
        "seg_id", "k", "word", "start_ms", "end_ms", F.when(F.col("measured"), ALIGNED).otherwise(SYNTHETIC).alias("kind"),
        F.round("score", 4).alias("score"), F.when(~F.col("measured"), MISMATCH).alias("reason"),
    )


def segment_scores(words: DataFrame) -> DataFrame:
    """(seg_id, n_words, alignment_score): the mean of the words' scores to four digits, halves up; null without measured words."""
    points = F.sum(F.round(F.col("score") * 10_000).cast("long"))
    n = F.count("score")
    mean = F.expr("(2 * points + n) div (2 * n)") / 10_000
    sums = words.groupBy("seg_id").agg(F.count(F.lit(1)).alias("n_words"), points.alias("points"), n.alias("n"))
    return sums.select("seg_id", "n_words", F.when(F.col("n") > 0, mean).alias("alignment_score"))
