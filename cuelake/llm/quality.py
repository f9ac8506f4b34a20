"""Quality classifier by importance resampling.

Two generative models over hashed unigrams and bigrams: one of target text
(labelled as good and not toxic), one of the raw corpus.  A document's score is the
log of its importance weight, the sum of log(p_target / p_raw) - neutral over its
n-grams.  ``neutral`` is a parameter: 0 gives the plain ratio of the two models;
without it, it is the ratio of a text that is as much good as bad, fitted on the
labels.  ``length`` is another: with it every text weighs as if it had so many
n-grams, its mean log ratio times ``length``.  Target text is a part of the raw
corpus, so the summed ratio of good text is close to nothing and of either sign, and
a long text's rank would follow its length; sums of hundreds also drown the noise.
The sample of size k without replacement in proportion to these weights is the
top k of score plus Gumbel noise.  The noise comes from a hash of seed and id, so
a lost task redraws the same.

The raw model counts every n-gram of every document.  The target model is fitted on
at most ``MAX_LABELS`` labelled documents.  k is a parameter, as a number or as a
share of the rows; ``good_share`` gives the share of good quality among the labels.
Without either, k is the number of documents of the whole corpus whose mean log
ratio reaches the threshold fitted on the labels.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuelake.llm import ngrams
from cuelake.llm.tables import stored

BINS = 1 << 16
MAX_LABELS = 20_000
SMOOTHING = 0.5
QUANTILE_ERROR, RANKED = 1e-3, 1 << 14


@dataclass(frozen=True)
class Model:
    """log(p_target / p_raw) by bin, and the mean ratio from which a text counts as good."""

    ratio: np.ndarray
    threshold: float
    seed: int
    neutral: float | None = None
    length: int | None = None

    def weigh(self, text: str | None) -> tuple[float, float]:
        """(score, mean log ratio) of a text; 0 when it has no n-gram."""
        total, n = 0.0, 0
        tokens = ngrams.token_hashes(text or "")
        if len(tokens):
            for part in ngrams.pieces(tokens, len(self.ratio)):
                total += float(self.ratio[part].sum())
                n += len(part)
        mean = total / max(n, 1)
        neutral = self.threshold if self.neutral is None else self.neutral
        return (mean - neutral) * (n if self.length is None else self.length * (n > 0)), mean

    def gumbel(self, key: str) -> float:
        """Standard Gumbel noise from the seed and a row's key."""
        h = hashlib.blake2b(f"{self.seed}:{key}".encode(), digest_size=8).digest()
        return -math.log(-math.log((int.from_bytes(h, "little") + 0.5) / 2.0**64))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(BINS, np.int64)
    for b in batches:
        for t in b.column(0):
            tokens = ngrams.token_hashes(t.as_py() or "")
            if len(tokens):
                for part in ngrams.pieces(tokens, BINS):
                    total += np.bincount(part, minlength=BINS)
    hit = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(hit), pa.array(total[hit])], ["bin", "n"])


def counts(texts: DataFrame) -> np.ndarray:
    """n-gram counts by bin over all rows of a one-column frame; ``BINS`` numbers reach the driver."""
    rows = texts.mapInArrow(_count, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(BINS, np.int64)
    for r in rows:
        out[r["bin"]] = r["n"]
    return out


def labelled(docs: DataFrame, labels: DataFrame, id_col: str, most: int) -> DataFrame:
    """(text, good): documents with a label, at most ``most`` labels in hash order of the id."""
    picked = (
        labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
        .select("doc_id", ((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).alias("good"), F.col("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(most)
    )
    return picked


def fit(
    docs: DataFrame, labels: DataFrame, *, seed: int = 0, id_col: str = "doc_id", text_col: str = "text",
    max_labels: int = MAX_LABELS, neutral: float | None = None, length: int | None = None,
) -> Model:
    """Both models and the threshold.

    Without usable labels the ratio is zero everywhere and every text counts as
    good.
    """
    text = F.col(f"`{text_col}`").alias("text")
    picked = F.broadcast(stored(labelled(docs, labels, id_col, max_labels), "labelled"))  # at most max_labels rows
    known = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text).join(picked, "doc_id").select("text", "good", "quality")
    known = stored(known, "known")
    raw, target = counts(docs.select(text)), counts(known.where("good").select("text"))
    if not target.sum() or not raw.sum():
        return Model(np.zeros(BINS), -1.0, seed, 0.0, length)
    p, q = target + SMOOTHING, raw + SMOOTHING
    ratio = np.log(p / p.sum()) - np.log(q / q.sum())
    model = Model(ratio, 0.0, seed)

    def means(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [model.weigh(t.as_py())[1] for t in b.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(got, pa.float64()), b.column(1)], ["mean", "quality"])

    rows = known.select("text", F.col("quality").cast("int")).mapInArrow(means, "mean double, quality int").collect()
    return Model(ratio, _threshold([(r["mean"], r["quality"] == 1) for r in rows]), seed, neutral, length)


def good_share(labels: DataFrame) -> float:
    """The share of good quality among the labels that say it; 1 without any."""
    share = labels.where(F.col("quality").isNotNull()).agg(F.avg((F.col("quality") == 1).cast("double"))).first()[0]
    return 1.0 if share is None else share


def _threshold(known: list[tuple[float, bool]]) -> float:
    """The cut with the best balanced accuracy; midway in the gap it lies in."""
    goods = sum(g for _, g in known)
    bads = len(known) - goods
    if not goods or not bads:
        return min((m for m, _ in known), default=0.0) - 1.0
    known = sorted(known)
    best, cut, good_below, bad_below = -1.0, known[0][0] - 1.0, 0, 0
    for i, (m, g) in enumerate(known):
        good_below, bad_below = good_below + g, bad_below + (not g)
        score = bad_below / bads + 1 - good_below / goods
        if score > best and (i + 1 == len(known) or known[i + 1][0] > m):
            best, cut = score, (m + known[i + 1][0]) / 2 if i + 1 < len(known) else m + 1.0
    return cut


def _weigher(model: Model):
    @F.arrow_udf("struct<score double, mean double, key double>")
    def weigh(ids: pa.Array, texts: pa.Array) -> pa.Array:
        rows = []
        for i, t in zip(ids, texts, strict=True):
            score, mean = model.weigh(t.as_py())
            rows.append((score, mean, score + model.gumbel(i.as_py() or "")))
        cols = [pa.array(c, pa.float64()) for c in (list(zip(*rows, strict=True)) or [(), (), ()])]
        return pa.StructArray.from_arrays(cols, ["score", "mean", "key"])

    return weigh


def _cut(rows: DataFrame, rank: int) -> tuple[float, object]:
    """(key, id) of the row of this rank by descending key, then id, nulls first.

    Bounds around the rank close in, without a sort of all rows, until few rows are
    left or all that are left share a key; those are counted by id.
    """
    n = rows.count()
    while n > RANKED:
        at = 1 - rank / n
        e = QUANTILE_ERROR
        lo, hi = rows.approxQuantile("key", [max(0.0, at - 2 * e), min(1.0, at + 2 * e)], e)
        rank -= rows.where(F.col("key") > hi).count()
        rows = rows.where(F.col("key").between(lo, hi))
        before, n = n, rows.count()
        if lo == hi or n == before:
            break
    counted = rows.groupBy("key", "id").agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.orderBy(F.desc("key"), F.asc("id")))
    found = counted.withColumn("upto", upto).where(F.col("upto") >= rank).orderBy("upto").first()
    return found["key"], found["id"]


def _kept(scores: DataFrame, model: Model, k: int | None, share: float | None) -> Column:
    """Whether (key, id) is among the top k."""
    n, good = scores.agg(F.count(F.lit(1)), F.count_if(F.col("mean") >= model.threshold)).first()
    k = (good if share is None else round(share * n)) if k is None else k
    if k >= n:
        return F.lit(True)
    if k <= 0:
        return F.lit(False)
    cut, last = _cut(scores.select("key", "id"), k)
    tied = F.col("id").isNull() | F.coalesce(F.col("id") <= F.lit(last), F.lit(False))
    return (F.col("key") > cut) | ((F.col("key") == cut) & tied)


def importance_sample(
    docs: DataFrame, labels: DataFrame, *, k: int | None = None, share: float | None = None, neutral: float | None = None,
    length: int | None = None, seed: int = 0, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """(id, score, mean, key, kept) for every row; k rows are kept, or ``share`` of them if k is not given.

    Rows that tie with the last one kept go by id.  Null texts count as empty: score zero.  Null ids share the noise of ''.
    Repeated rows get the same key and are kept or rejected together, so that more
    than k may stay.  Labels of
    ids that are not in ``docs`` are ignored.  Empty input gives an empty frame.
    """
    return _sampled(docs, labels, k, share, neutral, length, seed, id_col, text_col)[0]


def _sampled(
    docs: DataFrame, labels: DataFrame, k: int | None, share: float | None, neutral: float | None, length: int | None, seed: int,
    id_col: str, text_col: str,
) -> tuple[DataFrame, Column, Model]:
    model = fit(docs, labels, seed=seed, id_col=id_col, text_col=text_col, neutral=neutral, length=length)
    got = _weigher(model)(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")), F.col(f"`{text_col}`"))
    scores = stored(docs.select(F.col(f"`{id_col}`").alias("id"), got.alias("w")).select("id", "w.*"), "scores")
    kept = F.coalesce(_kept(scores, model, k, share), F.lit(False))
    return scores.withColumn("kept", kept).withColumnRenamed("id", id_col), kept, model


def keep_target_like(
    docs: DataFrame, labels: DataFrame, *, k: int | None = None, share: float | None = None, neutral: float | None = None,
    length: int | None = None, seed: int = 0, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """The rows of ``docs`` that the sample keeps, columns as they came; no text is shuffled."""
    _, kept, model = _sampled(docs, labels, k, share, neutral, length, seed, id_col, text_col)
    got = _weigher(model)(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")), F.col(f"`{text_col}`"))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("r"), F.col(f"`{id_col}`").alias("id"), got.alias("w"))
    return rows.select("r", "id", "w.key").where(kept).select("r.*")
