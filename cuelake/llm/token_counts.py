"""Token counts of whole texts, behind a table of counts that are known already.

The cache is a Parquet table (digest, n_tokens) with one folder per tokenizer
version; a version is the digest of the vocabulary file, the library's version
and the way it is called, so another file or library never meets old counts.  Rows join it
by the digest of what the tokenizer reads.  Of the digests without a count, the
row with the smallest id stands for its copies: only such rows' texts are encoded,
and their counts appended.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelake.llm.bpe import slices
from cuelake.llm.tables import column, stored, whole

SCHEMA = "digest binary, n_tokens long, version string"
ROW_BYTES, MOST_BROADCAST = 100, 64 << 20  # of a missing text's key, about; of all that is broadcast
REMEMBERED = 100_000  # digests a task keeps, so that repeated rows of one id are encoded once


class Counter:
    """Counts of texts by a vocabulary file, as its library gives them: ``.json`` or ``.model``."""

    def __init__(self, path: str) -> None:
        if path.endswith(".model"):
            import sentencepiece

            self.pieces = sentencepiece.SentencePieceProcessor(model_file=path)
            self.library = f"sentencepiece {sentencepiece.__version__}"
            return
        import tokenizers

        self.pieces = None
        self.words = tokenizers.Tokenizer.from_file(path)
        self.words.no_truncation()
        self.words.no_padding()
        self.library = f"tokenizers {tokenizers.__version__}"

    def counts(self, texts: list[str]) -> list[int]:
        if self.pieces is not None:
            return [len(x) for x in self.pieces.encode(texts, num_threads=1)]
        return [len(x) for x in self.words.encode_batch_fast(texts, add_special_tokens=False)]


_counters: dict[str, Counter] = {}


def loaded(path: str) -> Counter:
    """One counter per worker process and file."""
    if path not in _counters:
        _counters[path] = Counter(path)
    return _counters[path]


def version(path: str) -> str:
    """SHA-256 over the vocabulary file, its library's version and the options."""
    with open(path, "rb") as f:
        held = hashlib.sha256(f.read())
    held.update(f"|{loaded(path).library}|whole text, no added tokens".encode())
    return held.hexdigest()


def known_counts(spark: SparkSession, cache: str, of_version: str) -> DataFrame:
    """(digest, n_tokens) of one version; empty if nothing is stored.

    Appends of concurrent or repeated jobs may hold a digest twice: it counts once.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(cache)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], "digest binary, n_tokens long")
    rows = spark.read.schema(SCHEMA).parquet(cache).where(F.col("version") == of_version)
    return rows.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def _encoder(path: str):
    """(digest, n_tokens) of (digest, text) rows; of a digest seen shortly before nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, seen = loaded(path), set()
        for b in batches:
            digests, texts = [], []
            for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if d not in seen:
                    seen.add(d)
                    digests.append(d)
                    texts.append(t)
            for at, end in slices(texts):
                counts = counter.counts(texts[at:end])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(digests[at:end], pa.binary()), pa.array(counts, pa.int64())], ["digest", "n_tokens"]
                )
            if len(seen) > REMEMBERED:
                seen.clear()

    return run


def count_tokens(
    docs: DataFrame, path: str, cache: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every row; ``cache`` grows by the counts of new texts.

    ``path``: the vocabulary file, on every node.  ``cache``: a folder that all
    nodes see.  Null texts count as empty; special strings inside texts are what
    the library takes them for.  Repeated rows and ids stay as they are, null ids
    too.  An empty table gives an empty frame and leaves the cache alone.

    The texts of missing digests meet their keys by a broadcast while all keys
    have at most ``MOST_BROADCAST`` bytes, as with a warm cache, else by one shuffle
    on (id, digest), which deals copies of one text out by their ids.
    """
    spark, of_version = docs.sparkSession, version(path)
    text = whole(column(text_col))
    digest = F.unhex(F.sha2(text, 256)).alias("digest")
    keys = stored(docs.select(column(id_col).alias("id"), digest, F.octet_length(text).cast("long").alias("n_bytes")), "keys")
    known = known_counts(spark, cache, of_version)
    first = keys.groupBy("digest").agg(F.min("id").alias("first"))
    missing = stored(first.join(known, "digest", "left_anti"), "missing")
    small = missing.count() * ROW_BYTES <= MOST_BROADCAST
    texts = docs.select(column(id_col).alias("id"), digest, text.alias("text")).alias("t")
    wanted = missing.alias("m").hint("broadcast" if small else "shuffle_hash")
    same = (F.col("t.digest") == F.col("m.digest")) & F.col("t.id").eqNullSafe(F.col("m.first"))
    chosen = texts.join(wanted, same, "left_semi")
    fresh = chosen.select("digest", "text").mapInArrow(_encoder(path), "digest binary, n_tokens long")
    fresh = stored(fresh.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens")), "fresh")
    used = stored(known.join(first.select("digest"), "digest", "left_semi"), "used").unionByName(fresh)
    if not fresh.isEmpty():
        fresh.withColumn("version", F.lit(of_version)).write.mode("append").partitionBy("version").parquet(cache)
    return keys.join(used, "digest").select(
        F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )
