"""A corpus pipeline: quality, exact copies, near copies, mixture, tokens.

Every stage takes (spark, docs, sf_dir) and works on all that the stage before
it kept; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelake.llm import bpe, exact_dedup, mixing, quality, simhash
from cuelake.llm.queries import MIX_SEED, MIX_WEIGHTS, QUALITY_LENGTH, QUALITY_SEED, TOKENIZERS, WORD_BPE, table
from cuelake.llm.tables import stored

#: Sampling and trained ratios are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling keeps, as large a share as the labels call good; the rejected ones go."""
    labels = table(spark, sf_dir, "labels")
    share = quality.good_share(labels)
    return quality.keep_target_like(docs, labels, share=share, neutral=0.0, length=QUALITY_LENGTH, seed=QUALITY_SEED)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest id."""
    return exact_dedup.drop_exact_duplicates(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked fingerprints, the document with the smallest id.

    The stage follows the contract of ``op10_simhash``: shingles of three words, at
    most 3 of 64 bits.  That is narrower than five words at similarity 0.8: most
    copies of that kind stay.
    """
    return simhash.drop_near_duplicates(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents by the target weights of domain, language and source, once per epoch."""
    return mixing.mix(docs, MIX_WEIGHTS, seed=MIX_SEED).select("r.*")


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and the digest of the text they decode to."""
    coded = bpe.encode(docs, f"{TOKENIZERS}/{WORD_BPE}", decoded=True)
    return coded.select(
        "doc_id", F.expr("octet_length(ids) div 4").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256")
    )


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", good_documents),
    ("exact dedup", without_copies),
    ("SimHash near-dedup", without_near_copies),
    ("mixing sources to target weights", mixed),
    ("BPE encoding and decoding", encoded),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each result written before the next stage reads it."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs, f"stage{k}")
    return docs
