"""Tokens and word n-grams as column expressions (no shuffle, JVM only)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as a token.  ``\w`` is ASCII-only in Java, so the
# Unicode letters and numbers are spelled out.
TOKEN_PATTERN = r"[\p{L}\p{N}_]{2,}"
WORD_PATTERN = r"[\p{L}\p{N}_]+"


def tokens(text: Column) -> Column:
    """Lower-cased tokens of two or more word characters."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN_PATTERN), F.lit(0))


def ngrams_of(token_array: Column, n: int) -> Column:
    """Word n-grams of one length, joined by one space: those of one word less,
    each with the word behind it."""
    grams = token_array
    for word in range(2, n + 1):
        count = F.greatest(F.size(token_array) - F.lit(word - 1), F.lit(0))
        grams = F.zip_with(
            F.slice(grams, 1, count), F.slice(token_array, word, count),
            lambda gram, last: F.concat(gram, F.lit(" "), last),
        )
    return grams


def ngrams(token_array: Column, ngram_range: tuple[int, int] = (1, 1)) -> Column:
    low, high = ngram_range
    if low < 1 or high < low:
        raise ValueError(f"bad n-gram range {ngram_range}")

    def of(found: Column) -> Column:
        parts = [ngrams_of(found, n) for n in range(low, high + 1)]
        return parts[0] if len(parts) == 1 else F.concat(*parts)

    return token_array if (low, high) == (1, 1) else bound(token_array, of)


def fold_case(text: Column) -> Column:
    """Lower case that also merges the four letters whose case-insensitive
    match is an ASCII letter (dotted and dotless i, long s, Kelvin sign)."""
    return F.lower(F.translate(text, "İıſK", "iisk"))


def words(text: Column) -> Column:
    """All maximal runs of word characters, case-folded."""
    return F.regexp_extract_all(fold_case(text), F.lit(WORD_PATTERN), F.lit(0))


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)``, with ``value`` computed once however often it is used."""
    return F.element_at(F.transform(F.array(value), body), 1)


def term_frequencies(terms: Column) -> Column:
    """``ARRAY<STRUCT<term, tf>>`` of an array of terms, in the order of terms: the
    array is sorted and the lengths of its runs are taken.  Null counts as empty."""

    def runs(ordered: Column) -> Column:
        def begin(term: Column, i: Column) -> Column:
            return F.when((i == 0) | (term != F.get(ordered, i - 1)), i)

        def counted(starts: Column) -> Column:
            ends = F.slice(F.concat(starts, F.array(F.size(ordered))), 2, F.size(starts))
            return F.zip_with(
                starts, ends,
                lambda a, b: F.struct(F.get(ordered, a).alias("term"), (b - a).cast("long").alias("tf")),
            )

        starts = F.filter(F.transform(ordered, begin), lambda i: i.isNotNull())
        return bound(starts, counted)

    return bound(F.sort_array(F.coalesce(terms, F.array().cast("array<string>"))), runs)
