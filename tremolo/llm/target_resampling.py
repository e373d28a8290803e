"""Importance resampling of documents towards the distribution of a target.

A text's features are its runs of one to ``max_words`` consecutive words, dealt to
buckets by their CRC-32.  A bucket's gain is the logarithm of the ratio of its
smoothed shares in the target and in the documents; a document's weight is the sum
of the gains of its features.  Adding Gumbel noise, drawn from a hash of the id, to
the weights and taking the highest scores draws without replacement in proportion
to the exponentials of the weights (Xie and others, 2023).

The CRC of many short spans of one buffer is taken without a loop over bytes.  CRC-32
is linear up to a constant of the length: a byte at a given distance from the end of
its span contributes one value, whatever the other bytes are.  These contributions
come from a table of ``SPAN`` distances by 256 bytes, are combined over each span by
``bitwise_xor.reduceat``, and the constant of the span's length is added.  Longer
spans are cut from their end into blocks of ``SPAN`` bytes; a block's value is carried
over the blocks behind it by operators for 1, 2, 4, … blocks of zero bytes.
"""

from __future__ import annotations

import math
import sys
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.materialize import materialize
from . import _common
from ._common import parts

#: Distances from a span's end that the table holds, and bytes combined at once.
SPAN, CHUNK = 64, 1 << 20
#: Text bytes handled at once.
PIECE = 1 << 20

_U = np.uint32


def _single() -> np.ndarray:
    """What one byte leaves in an empty register."""
    value = np.arange(256, dtype=_U)
    for _ in range(8):
        value = np.where(value & 1, (value >> 1) ^ _U(0xEDB88320), value >> 1)
    return value


@cache
def position_table() -> np.ndarray:
    """``[distance, byte]``: what a byte followed by ``distance`` others leaves."""
    rows = [_single()]
    while len(rows) < SPAN:
        rows.append((rows[-1] >> 8) ^ rows[0][rows[-1] & 255])
    return np.stack(rows)


def _carried(tables: np.ndarray, value: np.ndarray) -> np.ndarray:
    """The register after the zero bytes that the four tables stand for."""
    out = tables[0][value & 255]
    for k in range(1, 4):
        out ^= tables[k][(value >> (8 * k)) & 255]
    return out


@cache
def carry_tables(power: int) -> np.ndarray:
    """``[byte of the register, its value]`` after ``SPAN * 2**power`` zero bytes; a
    register's bytes act like the next four bytes of the data."""
    if power == 0:
        return position_table()[SPAN - 4 :][::-1].copy()
    half = carry_tables(power - 1)
    return np.stack([_carried(half, row) for row in half])


@cache
def length_constant(length: int) -> int:
    """The CRC of as many zero bytes."""
    return zlib.crc32(bytes(length))


def _blocks(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The linear part of blocks of 1 to ``SPAN`` bytes, about ``CHUNK`` bytes at once."""
    table = position_table().ravel()
    out = np.empty(len(starts), _U)
    ends = np.cumsum(sizes)
    first = 0
    while first < len(starts):
        base = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, base + CHUNK, side="right")))
        size = sizes[first:last]
        stops = (ends[first:last] - base).astype(np.int64)
        at = np.arange(stops[-1])
        behind = np.repeat(stops - 1, size) - at
        byte = data[at + np.repeat(starts[first:last] - (stops - size), size)]
        out[first:last] = np.bitwise_xor.reduceat(table[behind * 256 + byte], stops - size)
        first = last
    return out


def span_crcs(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The CRC-32 of spans of at least one byte of ``data``, an array of bytes."""
    if len(starts) == 0:
        return np.zeros(0, _U)
    lengths, which = np.unique(sizes, return_inverse=True)
    constants = np.array([length_constant(int(n)) for n in lengths], _U)[which]
    pieces = -(-sizes // SPAN)
    if pieces.max() == 1:
        return _blocks(data, starts, sizes) ^ constants
    first = np.cumsum(pieces) - pieces
    number = np.arange(pieces.sum()) - np.repeat(first, pieces)
    behind = np.repeat(pieces - 1, pieces) - number
    stop = np.repeat(starts + sizes, pieces) - behind * SPAN
    start = np.maximum(stop - SPAN, np.repeat(starts, pieces))
    value = _blocks(data, start, stop - start)
    for power in range(int(behind.max()).bit_length()):
        moved = np.flatnonzero((behind >> power) & 1)
        value[moved] = _carried(carry_tables(power), value[moved])
    return np.bitwise_xor.reduceat(value, first) ^ constants


def _letters() -> tuple[np.ndarray, np.ndarray]:
    """Of each byte: whether it is part of a word, and its lower case.  Words are
    runs of digits, letters and whatever is not ASCII, whose bytes are all above 127."""
    lower = np.arange(256, dtype=np.uint8)
    lower[ord("A") : ord("Z") + 1] += 32
    inside = np.zeros(256, bool)
    inside[ord("0") : ord("9") + 1] = True
    inside[ord("a") : ord("z") + 1] = True
    inside[128:] = True
    return inside[lower], lower


_INSIDE, _LOWER = _letters()


def features(texts: pa.Array, buckets: int, max_words: int) -> tuple[np.ndarray, ...]:
    """``(bucket of each feature, features of each text, words of each text)``; the
    features of a text follow each other, and a null text has none."""
    texts = texts.cast(pa.large_string()).fill_null("")
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    inside = _INSIDE[data]
    begins, stops = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    stops[:-1] &= ~inside[1:]
    filled = np.flatnonzero(offsets[1:] > offsets[:-1])  # texts end words
    begins[offsets[filled]] = inside[offsets[filled]]
    stops[offsets[filled + 1] - 1] = inside[offsets[filled + 1] - 1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    words = np.diff(np.searchsorted(starts, offsets))
    sizes = ends - starts
    if len(starts) == 0:
        return np.zeros(0, np.int64), words, words
    joined, at = _LOWER[data], starts
    if max_words > 1:  # all words, with one space behind each: a run of words is one span
        at = np.cumsum(sizes + 1) - sizes - 1
        spaced = np.full(at[-1] + sizes[-1] + 1, 32, np.uint8)
        spaced[np.arange(int(sizes.sum())) + np.repeat(np.arange(len(sizes)), sizes)] = joined[inside]
        joined = spaced
    text = np.repeat(np.arange(n), words)
    found, owner = [], []
    for run in range(1, max_words + 1):
        low = np.arange(len(starts) - run + 1)
        low = low[text[low] == text[low + run - 1]]
        high = low + run - 1
        found.append(span_crcs(joined, at[low], at[high] + sizes[high] - at[low]))
        owner.append(text[low])
    bucket, owner = np.concatenate(found).astype(np.int64) % buckets, np.concatenate(owner)
    if max_words > 1:
        bucket = bucket[np.argsort(owner, kind="stable")]
    return bucket, np.bincount(owner, minlength=n), words


def bucket_counts(texts: DataFrame, buckets: int, max_words: int = 1) -> DataFrame:
    """``(bucket, n)``: how many features of all rows of ``texts(text)`` fall into each
    bucket that has any.  Each task adds up its own, so at most ``buckets`` rows of a
    task are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in parts(batches, size=PIECE):
            total += np.bincount(features(batch.column(0), buckets, max_words)[0], minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["bucket", "n"])

    found = texts.select("text").mapInArrow(run, "bucket long, n long")
    return found.groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(source: DataFrame, target: DataFrame, buckets: int) -> np.ndarray:
    """A gain for each bucket: ``floor(1000 * ln(((t+1)/(T+B)) / ((s+1)/(S+B))))``.  The
    driver gets at most ``buckets`` rows of each side."""

    def counts(side: DataFrame) -> list[int]:
        out = [0] * buckets
        for bucket, n in side.collect():
            out[bucket] = n
        return out

    s, t = counts(source), counts(target)
    in_source, in_target = float(sum(s) + buckets), float(sum(t) + buckets)
    return np.array(
        [
            math.floor(1000 * math.log((y + 1) * in_source / ((x + 1) * in_target)))
            for x, y in zip(s, t, strict=True)
        ],
        np.int64,
    )


def weigh(docs: DataFrame, gains: np.ndarray, max_words: int = 1) -> DataFrame:
    """``(doc_id, n_words, n_features, weight)`` of every row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, size=PIECE):
            bucket, sizes, words = features(batch.column(1), len(gains), max_words)
            sums = np.concatenate([[0], np.cumsum(gains[bucket])])
            ends = np.cumsum(sizes)
            columns = (words, sizes, sums[ends] - sums[ends - sizes])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(x.astype(np.int64)) for x in columns)],
                ["doc_id", "n_words", "n_features", "weight"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, n_words long, n_features long, weight long"
    )


def noise(doc_id: Column, seed: int) -> Column:
    """``floor(1000 * g)`` of Gumbel noise g from a hash of seed and id."""
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(named.cast("binary"), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + F.lit(0.5)) / F.lit(float(1 << 32))))).cast("long")


def ranked(rows: DataFrame, order: list[Column], limit: Column) -> DataFrame:
    """Add ``rank`` 1, 2, … in ``order``, null beyond ``limit``.  Rows are dealt by ranges
    and sorted there; only the number of rows of each range meets in one place."""
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    # Numbers each partition's rows in their order, above the partition's number.
    placed = materialize(placed.withColumn("__place", F.monotonically_increasing_id()), "ranges")
    piece, number = F.shiftright("__place", 33), F.col("__place").bitwiseAND((1 << 33) - 1)
    sizes = placed.groupBy(piece.alias("piece")).agg(F.count("*").alias("n")).collect()
    offsets, total = [], 0
    for at, n in sorted(map(tuple, sizes)):
        offsets.append((at, total))
        total += n
    spark = rows.sparkSession
    starts = spark.createDataFrame(offsets, "__piece long, __before long")
    rank = F.col("__before") + number + 1
    joined = placed.join(F.broadcast(starts), piece == F.col("__piece"))
    return joined.select(*rows.columns, F.when(rank <= limit, rank).alias("rank"))


def resample(
    docs: DataFrame,
    target: DataFrame,
    *,
    percent: int = 10,
    seed: int = 2024,
    buckets: int = 10_000,
    max_words: int = 1,
    least_words: int = 20,
) -> DataFrame:
    """``(doc_id, n_features, weight, score, rank)``, one row per row of
    ``docs(doc_id, text)``: of the N texts of ``least_words`` words, the
    ``floor(percent * N / 100)`` highest scores are drawn and numbered, with ties to
    the smaller id; other ranks are null.  ``target(text)`` holds the texts to resemble.

    A null text has no words, and a text without features has weight 0.  A null id
    counts as the empty text in the noise and comes last in ties.  Rows that repeat an
    id are drawn each for itself.  An empty target gives every feature the smoothed
    share of an unseen one; an empty table of documents gives an empty result.  Other
    columns are not read.  Texts are read twice; only scores are shuffled.
    """
    gains = bucket_gains(
        bucket_counts(docs, buckets, max_words), bucket_counts(target, buckets, max_words), buckets
    )
    scored = weigh(docs, gains, max_words).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    # A number of its own makes rows that repeat an id differ, so ranges can part them.
    scored = materialize(scored.withColumn("row", F.monotonically_increasing_id()), "scores")
    entitled = F.col("n_words") >= least_words
    drawn = scored.where(entitled).count() * percent // 100
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("row")]
    kept = ["doc_id", "n_features", "weight", "score"]
    chosen = ranked(scored.where(entitled).select(*kept, "row"), order, F.lit(drawn))
    others = scored.where(~entitled).select(*kept, F.lit(None).cast("long").alias("rank"))
    return chosen.select(*kept, "rank").union(others)


def drawn_texts(docs: DataFrame, resampled: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose id was drawn, with all their columns."""
    ids = resampled.where("rank IS NOT NULL").select(F.col("doc_id").alias("__drawn")).distinct()
    return docs.join(ids, docs["doc_id"].eqNullSafe(F.col("__drawn")), "left_semi")


# Workers get these functions by value, so they need no copy of the package.
for _module in (sys.modules[__name__], _common):
    cloudpickle.register_pickle_by_value(_module)
