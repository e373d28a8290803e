"""Bag-of-words and TF-IDF in posting form ``(…, id, term, weight)``.

No vocabulary index is built: terms stay strings, so there is no global
numbering, no cap on the vocabulary and nothing to collect.

``keys`` are the columns that name one text: ``[id]``, or grouping columns such
as a project followed by the id; there is one row for each text.  A text's terms
are counted inside its row, by sorting them in an array, so counts and count
vectors need no exchange; the first one is where terms of different texts meet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as txt
from .skew import lookup


def frequencies(
    text: Column, ngram_range: tuple[int, int] = (1, 1)
) -> Column:
    """``ARRAY<STRUCT<term, tf>>`` of a text."""
    return txt.term_frequencies(txt.ngrams(txt.tokens(text), ngram_range))


def term_counts(
    docs: DataFrame,
    keys: list[str],
    text_col: str = "text",
    ngram_range: tuple[int, int] = (1, 1),
    outer: bool = False,
) -> DataFrame:
    """Term frequency per text: ``(*keys, term, tf)``.  With ``outer`` a text
    without terms keeps one row, whose term is NULL and whose count is 0."""
    counted = docs.select(*keys, frequencies(F.col(text_col), ngram_range).alias("_f"))
    # An inner ``inline`` would be given a filter that counts the terms once more.
    rows = counted.select(*keys, F.inline_outer("_f"))
    if not outer:
        return rows.where(F.col("term").isNotNull())
    return rows.withColumn("tf", F.coalesce("tf", F.lit(0).cast("long")))


def count_vectors(
    docs: DataFrame,
    keys: list[str],
    text_col: str = "text",
    ngram_range: tuple[int, int] = (1, 1),
) -> DataFrame:
    """One row per text, without any exchange: ``(*keys, terms, weights)``."""
    counted = docs.select(*keys, frequencies(F.col(text_col), ngram_range).alias("_f"))
    return counted.select(
        *keys, F.col("_f")["term"].alias("terms"), F.col("_f")["tf"].cast("array<double>").alias("weights")
    )


def vocabulary(postings: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Distinct terms (per group), with the number of texts that hold each."""
    return (
        postings.where(F.col("term").isNotNull())
        .groupBy(*(by or []), "term")
        .agg(F.count(F.lit(1)).alias("df"))
    )


def vocabulary_sizes(postings: DataFrame, by: list[str]) -> DataFrame:
    """Number of distinct terms per group.  The distinct step shuffles on
    (group, term), so one large group is spread like any other."""
    return postings.groupBy(*by).agg(F.count_distinct("term").alias("n_terms"))


def smoothed_idf(postings: DataFrame, n_texts: int) -> DataFrame:
    """``ln((1 + n) / (1 + df)) + 1`` per term: ``(term, df, idf)``."""
    if n_texts < 1:
        raise ValueError("cannot fit inverse document frequencies on no texts")
    return vocabulary(postings).withColumn(
        "idf", F.log((1.0 + F.lit(n_texts)) / (F.lit(1.0) + F.col("df"))) + 1.0
    )


def in_vocabulary(postings: DataFrame, vocab: DataFrame, keys: list[str]) -> DataFrame:
    """Drop the terms the fitted vocabulary does not hold."""
    return lookup(postings, vocab, "term", "df", keys).select(*postings.columns)


def weighted_terms(postings: DataFrame, idf: DataFrame, keys: list[str]) -> DataFrame:
    """``tf * idf`` before normalising: ``(*keys, term, w)``.  Terms outside the
    fitted vocabulary are dropped by the same join."""
    return lookup(postings, idf, "term", "df", keys).select(
        *keys, "term", (F.col("tf") * F.col("idf")).alias("w")
    )


def tfidf(postings: DataFrame, idf: DataFrame, keys: list[str]) -> DataFrame:
    """``tf * idf`` with unit-length rows: ``(*keys, term, w)``."""
    rows = tfidf_vectors(postings, idf, keys)
    return rows.select(*keys, F.inline(F.arrays_zip("terms", "weights")).alias("term", "w"))


def tfidf_vectors(postings: DataFrame, idf: DataFrame, keys: list[str]) -> DataFrame:
    """The same as one row per text (``terms, weights``).  Terms and squared
    length come from one aggregate, the only exchange by text."""
    weighted = weighted_terms(postings, idf, keys)
    pair = F.struct(F.col("term").alias("t"), F.col("w"))
    rows = weighted.groupBy(*keys).agg(
        F.collect_list(pair).alias("_p"),
        F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("_n"),
    )
    weights = F.transform("_p", lambda p: p["w"] / F.col("_n"))
    return rows.select(*keys, F.col("_p")["t"].alias("terms"), weights.alias("weights"))


def sparse_vectors(postings: DataFrame, keys: list[str], weight: str) -> DataFrame:
    """One row per text: ``(*keys, terms ARRAY<STRING>, weights ARRAY<DOUBLE>)``.

    A text's array is no longer than the text itself.  Rows with a NULL term
    (see ``outer``) give empty arrays: a zero vector.
    """
    pair = F.when(
        F.col("term").isNotNull(),
        F.struct(F.col("term").alias("t"), F.col(weight).cast("double").alias("w")),
    )
    return (
        postings.groupBy(*keys)
        .agg(F.collect_list(pair).alias("_p"))
        .select(
            *keys, F.col("_p")["t"].alias("terms"), F.col("_p")["w"].alias("weights")
        )
    )


