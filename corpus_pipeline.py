"""Documents to token ids in five stages, each written and read again.

Toxic documents go, then exact copies, near copies and documents that hold a
benchmark passage; what is left is encoded and decoded.  Every stage works on all
that the one before kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tremolo.llm import crf_toxicity, decontaminate, exact_dedup, near_dedup, piece_prefix
from tremolo.llm._common import folded, read
from tremolo.llm.queries import tokenizer
from tremolo.sources.materialize import materialize


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below one half; four fifths of the labels teach."""
    labels = read(spark, sf_dir, "labels")
    model = crf_toxicity.fit(docs, labels, ~folded(F.col("doc_id"), 5, 0))
    return crf_toxicity.clean(docs, model)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the largest id of those with equal texts."""
    return exact_dedup.survivors(docs, exact_dedup.batches(F.col("doc_id")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by shingles of five words, 0.8 or more."""
    return near_dedup.survivors(docs, size=5, percent=80)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate.clean(docs, read(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``(doc_id, ids, decoded)`` of what is left."""
    return piece_prefix.encode_texts(docs, tokenizer("piece_bpe_32k.model"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_leaks),
    ("sentencepiece", encode),
]

#: A conditional random field, registers and merges have no SQL form; the tests
#: hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the result is the last stage's table."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
