"""Display layout: long cues cut in pieces, wrapped lines, and the whole chain from spoken cues to display cues.

A cue has (media_id, cue_id, start_ms, end_ms, src_text, tgt_text) and may have
``words`` (array of struct start_ms, end_ms, word, aligned) and ``cuts`` (array of
struct time_ms, strong, strength).  Everything happens inside a medium, which holds
a few thousand cues.  Windows share an exchange by medium until rows have been
through Python, whose plan node forgets the partitioning: the chain has three.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuelake.functions import layout as kernel
from cuelake.operators.windows import GAP_MS, LINGER_MS, MAX_DISPLAY_MS, MIN_DISPLAY_MS, SHORT_GAP_MS

PIECE = (
    "start_ms long, end_ms long, src_text string, tgt_text string, anchor string, off_ms double, of_gap boolean"
)
PLAN = f"struct<score:double,source:string,pieces:array<struct<{PIECE.replace(' ', ':').replace(',:', ',')}>>>"
WORDS = "array<struct<start_ms:long,end_ms:long,word:string,aligned:boolean>>"
CUTS = "array<struct<time_ms:double,strong:boolean,strength:double>>"


def two_lines(text: Column, units: int = 16) -> Column:
    """At most two lines of about ``units`` display units, cut where it hurts least; null is empty."""

    @F.arrow_udf("string")
    def run(x: pa.Array) -> pa.Array:
        return pa.array([kernel.two_lines(t, units) for t in x.to_pylist()], pa.string())

    return run(text)


def greedy_lines(text: Column, most: int = 16) -> Column:
    """Lines of about ``most`` characters, each cut as late as it may be; null is empty."""

    @F.arrow_udf("string")
    def run(x: pa.Array) -> pa.Array:
        return pa.array([kernel.greedy_lines(t, most) for t in x.to_pylist()], pa.string())

    return run(text)


def _structs(lists: pa.Array) -> list[list[dict] | None]:
    """``to_pylist`` of lists of structs, column by column."""
    names = [f.name for f in lists.type.value_type]
    rows = [dict(zip(names, r, strict=True)) for r in zip(*(c.to_pylist() for c in lists.values.flatten()), strict=True)]
    at, none = lists.offsets.to_pylist(), lists.is_null().to_pylist()
    return [None if gone else rows[a:b] for a, b, gone in zip(at, at[1:], none, strict=False)]


def _planned(rules: kernel.Rules) -> Column:
    """The plan of every cue; null: it stays whole."""
    kind = pa.struct(
        [
            ("score", pa.float64()), ("source", pa.string()),
            ("pieces", pa.list_(pa.struct([
                ("start_ms", pa.int64()), ("end_ms", pa.int64()), ("src_text", pa.string()), ("tgt_text", pa.string()),
                ("anchor", pa.string()), ("off_ms", pa.float64()), ("of_gap", pa.bool_()),
            ]))),
        ]
    )

    def one(start: int, end: int, src: str | None, tgt: str | None, words: list | None, cuts: list | None) -> dict | None:
        text = src or tgt or ""
        found = kernel.cut_plan(text, start, end, words, cuts, rules)
        if found is None:
            return None
        inner, score = found
        positions = [n.position for n in inner]
        upto = [0, *kernel.widths(text).cumsum().tolist()]
        shares = [upto[p] / max(upto[-1], 1) for p in positions]
        cut = lambda t: t if t is None else kernel.pieces_at(t, positions) if t == text else kernel.pieces_by_share(t, shares)
        srcs, tgts = cut(src), cut(tgt)
        ends = [*(int(n.time) for n in inner), end]
        last = kernel.Node(len(text), end, kernel.EDGE, 0.0, 0.0, False)
        pieces = [
            {
                "start_ms": a, "end_ms": max(a + 50, b), "src_text": srcs and srcs[k], "tgt_text": tgts and tgts[k],
                "anchor": kernel.SOURCES[n.source] if n.source in (kernel.WEAK, kernel.STRONG) else "", "off_ms": n.off_ms, "of_gap": n.of_gap,
            }
            for k, (a, b, n) in enumerate(zip([start, *ends], ends, [*inner, last], strict=False))
        ]
        kinds = {n.source for n in inner}
        source = "word_gap_dp" if any(n.of_gap for n in inner) else "acoustic_anchor_dp" if kinds - {kernel.TEXT} else "proportional_text_dp"
        return {"score": score, "source": source, "pieces": pieces}

    @F.arrow_udf(PLAN)
    def run(start: pa.Array, end: pa.Array, src: pa.Array, tgt: pa.Array, words: pa.Array, cuts: pa.Array) -> pa.Array:
        columns = (*(c.to_pylist() for c in (start, end, src, tgt)), _structs(words), _structs(cuts))
        return pa.array([one(*row) for row in zip(*columns, strict=True)], kind)

    long = F.col("end_ms") - F.col("start_ms") > rules.most_ms
    # Short cues do not send their texts to Python.
    send = lambda c: F.when(long, F.col(c))
    return run("start_ms", "end_ms", send("src_text"), send("tgt_text"), send("words"), send("cuts"))


def with_layout(cues: DataFrame) -> DataFrame:
    """The columns that the layout carries; missing ones get their empty values."""
    have = set(cues.columns)
    empty = {
        "words": F.lit(None).cast(WORDS), "cuts": F.lit(None).cast(CUTS), "spoken_start_ms": F.col("start_ms"), "spoken_end_ms": F.col("end_ms"),
        "continues_before": F.lit(False), "continues_after": F.lit(False), "piece": F.lit(0),
        "split_source": F.lit(None).cast("string"), "anchor": F.lit(""), "off_ms": F.lit(0.0), "score": F.lit(None).cast("double"),
    }
    return cues.select("*", *(v.alias(k) for k, v in empty.items() if k not in have))


def split_long(cues: DataFrame, rules: kernel.Rules = kernel.Rules()) -> DataFrame:
    """Cues longer than ``most_ms`` as pieces in place; others as they are.

    A piece takes the words that begin and the cuts that lie inside it, tells on
    which sides its sentence goes on (the outer sides as its cue said), what ends
    it (``anchor``, ``off_ms``), and how its cue was cut (``split_source``,
    ``score``).  ``piece`` counts the pieces of the row they come from.  Rows
    without text, or that no path of pieces fits, stay whole.
    """
    planned = with_layout(cues).withColumn("plan", _planned(rules))
    rows = planned.select("*", F.posexplode_outer("plan.pieces").alias("k", "p"))
    cut, last = F.col("p").isNotNull(), F.col("k") == F.size("plan.pieces") - 1
    start, end = F.coalesce("p.start_ms", "start_ms"), F.coalesce("p.end_ms", "end_ms")
    inside = F.filter("words", lambda w: (w["start_ms"] >= F.col("p.start_ms")) & (w["start_ms"] < F.col("p.end_ms")))
    within = F.filter("cuts", lambda c: (c["time_ms"] > F.col("p.start_ms")) & (c["time_ms"] < F.col("p.end_ms")))
    new = {
        "start_ms": start, "end_ms": end, "spoken_start_ms": F.when(cut, start).otherwise(F.col("spoken_start_ms")),
        "spoken_end_ms": F.when(cut, end).otherwise(F.col("spoken_end_ms")),
        "src_text": F.when(cut, F.col("p.src_text")).otherwise(F.col("src_text")),
        "tgt_text": F.when(cut, F.col("p.tgt_text")).otherwise(F.col("tgt_text")),
        "words": F.when(cut, inside).otherwise(F.col("words")), "cuts": F.when(cut, within).otherwise(F.col("cuts")),
        "continues_before": F.when(cut & (F.col("k") > 0), True).otherwise(F.col("continues_before")),
        "continues_after": F.when(cut & ~last, True).otherwise(F.col("continues_after")),
        "piece": F.coalesce("k", F.lit(0)), "split_source": F.coalesce("plan.source", "split_source"),
        "anchor": F.when(cut, F.col("p.anchor")).otherwise(F.col("anchor")),
        "off_ms": F.when(cut, F.col("p.off_ms")).otherwise(F.col("off_ms")), "score": F.coalesce("plan.score", "score"),
    }
    return rows.select(*(new.get(c, F.col(c)).alias(c) for c in planned.columns if c != "plan"))


def _order() -> Window:
    return Window.partitionBy("media_id").orderBy("start_ms", "end_ms", "place", "piece")


def _placed(cues: DataFrame) -> DataFrame:
    """Starts moved back to the first measured word, rows numbered in the order of time."""
    heard = F.filter("words", lambda w: w["aligned"] & (w["end_ms"] > w["start_ms"]))
    first = F.array_min(F.transform(heard, lambda w: w["start_ms"]))
    moved = cues.withColumn("start_ms", F.least("start_ms", first))
    moved = moved.withColumn("end_ms", F.greatest("start_ms", "end_ms"))
    return moved.withColumn("place", F.row_number().over(_order())).withColumn("piece", F.lit(0))


def _before_next(cues: DataFrame) -> DataFrame:
    """Ends two frames before the next start, but not before the own start."""
    nxt = F.lead("start_ms").over(_order())
    late = F.col("end_ms") + GAP_MS > nxt
    return cues.withColumn("end_ms", F.when(late, F.greatest(F.col("start_ms"), nxt - GAP_MS)).otherwise(F.col("end_ms")))


def _least_windows(cues: DataFrame) -> DataFrame:
    """Spoken windows of at least the shortest display time where the next cue leaves room, of 50 ms at any rate."""
    start, nxt = F.col("start_ms"), F.lead("start_ms").over(_order())
    limit = F.greatest(start + 50, nxt - GAP_MS)
    # ``greatest`` and ``least`` skip nulls: without a next cue the limit must be one.
    limit = F.when(nxt.isNotNull(), limit)
    end = F.least(F.greatest(F.least(F.col("end_ms"), limit), start + MIN_DISPLAY_MS), limit)
    return cues.withColumn("end_ms", F.when(end <= start, start + 50).otherwise(end))


def _lingering(cues: DataFrame) -> DataFrame:
    """Short gaps closed, longer ones shortened, at most ``LINGER_MS`` past the spoken end."""
    start, nxt = F.col("start_ms"), F.lead("start_ms").over(_order())
    end = F.greatest(start + 50, F.col("end_ms"))
    most = F.greatest(start + 50, nxt - GAP_MS)
    held = F.least(end + LINGER_MS, F.greatest(start + 50, nxt - SHORT_GAP_MS))
    want = F.when(F.greatest(F.lit(0), nxt - end) < SHORT_GAP_MS, most).otherwise(held)
    full = F.when(nxt.isNull(), end + LINGER_MS).otherwise(F.least(F.greatest(end, want), most))
    return cues.withColumn("end_ms", F.greatest(start + 50, F.least(full, F.col("spoken_end_ms") + LINGER_MS)))


def _flagged(cues: DataFrame) -> DataFrame:
    """Ends clamped to the longest display time, with shifts and violations."""
    w = _order()
    span = F.col("end_ms") - F.col("start_ms")
    out = cues.withColumn("clamped", span > MAX_DISPLAY_MS).withColumn("end_ms", F.least(F.col("end_ms"), F.col("start_ms") + MAX_DISPLAY_MS))
    near = (F.lead("start_ms").over(w) - F.col("end_ms") < GAP_MS, F.col("start_ms") - F.lag("end_ms").over(w) < GAP_MS)
    return out.withColumns(
        {
            "shift_start_ms": F.col("start_ms") - F.col("spoken_start_ms"),
            "shift_end_ms": F.col("end_ms") - F.col("spoken_end_ms"),
            "duration_violation": F.col("end_ms") - F.col("start_ms") < MIN_DISPLAY_MS,
            "gap_violation": F.coalesce(near[0], F.lit(False)) | F.coalesce(near[1], F.lit(False)),
        }
    )


def display_cues(cues: DataFrame, rules: kernel.Rules = kernel.Rules()) -> DataFrame:
    """The display cues of every medium, numbered by ``place``.

    Sorted and freed of overlaps, given their least windows, cut, polished, cut
    again, freed of overlaps again, and flagged.  Cues of equal times keep the
    order of their ids.  Empty input gives an empty frame.
    """
    rows = with_layout(cues).withColumn("place", F.col("cue_id"))
    rows = _placed(split_long(_least_windows(_before_next(_placed(rows))), rules))
    rows = _placed(split_long(_lingering(rows), rules))
    return _flagged(_before_next(rows)).drop("piece")
