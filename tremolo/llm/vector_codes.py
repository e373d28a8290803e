"""Product codes of vectors, learned on whole integers over Hilbert-sorted blocks.

A vector's components become integers and the vector is cut into equal parts; each
part position has a codebook of a few entries, improved by rounds of assignment and
averaging.  All sums are whole numbers, so results do not depend on the order of rows
or on how they are dealt to tasks.

Rows are read once into *segments* of at most ``SEGMENT`` rows.  For each part
position a segment holds its rows' parts sorted along a Hilbert curve and cut into flat
blocks of ``BLOCK`` points, each with the least and greatest value of every component
(its box) and the sums of its components.  A round reads the segments: distances from
an entry to a block's box bound its distances to the block's points, so an entry whose
least distance exceeds the smallest greatest distance of any entry is nearest to none
of them.  If one entry is left, the block's sums go to it and no point is looked at;
otherwise the points are compared with the short list of entries that are left, in
integers.  Segments never meet, so a round shuffles one row per component of the
codebooks and task, and the codes of a row are made where its parts are.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.materialize import materialize

#: Rows of a segment, components of a segment, and points of a block.
SEGMENT, VALUES, BLOCK = 16_384, 1 << 21, 16
#: Differences computed at once by the kernel.
CHUNK = 1 << 21
#: Components beyond this (before scaling) cannot be summed in 64 bits.
LIMIT = float(1 << 16)


# -- The curve


def hilbert_keys(points: np.ndarray) -> np.ndarray:
    """Place of each point ``(n, d)`` of whole numbers on a Hilbert curve through
    their box; beyond 60 components the first 60 decide.  (Skilling, 2004: the axes'
    bits are turned into the transposed index, whose bits are then interleaved.)"""
    points = points[:, :60]
    d = points.shape[1]
    low = points.min(axis=0)
    span = int((points - low).max())
    bits = min(60 // d, max(1, span.bit_length()))
    x = ((points - low) >> max(0, span.bit_length() - bits)).T.astype(np.uint64)
    for k in range(bits - 1, 0, -1):  # undo the turns of the cells, large ones first
        one, below = np.uint64(1 << k), np.uint64((1 << k) - 1)
        for i in range(d):
            turned = (x[i] & one) != 0
            swapped = np.where(turned, 0, (x[0] ^ x[i]) & below)
            x[0] ^= np.where(turned, below, swapped)
            x[i] ^= swapped
    for i in range(1, d):
        x[i] ^= x[i - 1]
    flips = np.zeros(len(points), np.uint64)
    for k in range(bits - 1, 0, -1):
        flips ^= np.where(x[d - 1] & np.uint64(1 << k), np.uint64((1 << k) - 1), np.uint64(0))
    x ^= flips
    keys = np.zeros(len(points), np.uint64)
    for k in range(bits - 1, -1, -1):
        for i in range(d):
            keys = (keys << np.uint64(1)) | ((x[i] >> np.uint64(k)) & np.uint64(1))
    return keys


# -- Blocks


class Blocks(NamedTuple):
    """One part position of a segment: points in curve order, the row of each, and
    box and sums of every block of ``BLOCK`` of them."""

    points: np.ndarray  # (n, d)
    order: np.ndarray  # (n,)
    low: np.ndarray  # (blocks, d)
    high: np.ndarray
    sums: np.ndarray

    def sizes(self) -> np.ndarray:
        out = np.full(len(self.low), BLOCK, np.int64)
        out[-1] = len(self.points) - BLOCK * (len(self.low) - 1)
        return out


def cut_blocks(points: np.ndarray) -> Blocks:
    """The blocks of at least one point."""
    order = np.argsort(hilbert_keys(points), kind="stable")
    points = points[order]
    at = np.arange(0, len(points), BLOCK)
    return Blocks(
        points, order, np.minimum.reduceat(points, at), np.maximum.reduceat(points, at),
        np.add.reduceat(points, at),
    )


def short_lists(blocks: Blocks, book: np.ndarray) -> np.ndarray:
    """``(blocks, entries)``: whether an entry may be nearest to a point of the block."""
    low, high = blocks.low[:, None, :], blocks.high[:, None, :]
    out = np.maximum(np.maximum(low - book, book - high), 0)
    near = (out * out).sum(axis=2)
    out = np.maximum(np.abs(book - low), np.abs(book - high))
    far = (out * out).sum(axis=2)
    return near <= far.min(axis=1)[:, None]


def assign(blocks: Blocks, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(decided, nearest, distance)``: the entry of each block that has one left, or
    -1; and for each point of the other blocks, in curve order, entry and squared
    distance (elsewhere -1 and 0).  Ties go to the entry of the lower index."""
    listed = short_lists(blocks, book)
    width = listed.sum(axis=1)
    decided = np.where(width == 1, listed.argmax(axis=1), -1)
    n, d = blocks.points.shape
    nearest, distance = np.full(n, -1, np.int64), np.zeros(n, np.int64)
    # Listed entries first, in order of index; others can only be farther.
    entries = np.argsort(~listed, axis=1, kind="stable")
    classes = np.ceil(np.log2(np.maximum(width, 1))).astype(np.int64)
    for c in np.unique(classes[width > 1]):
        mine = np.flatnonzero((classes == c) & (width > 1))
        take = min(1 << int(c), len(book))
        step = max(1, CHUNK // (BLOCK * take * d))
        for start in range(0, len(mine), step):
            part = mine[start : start + step]
            at = np.minimum(part[:, None] * BLOCK + np.arange(BLOCK), n - 1)
            chosen = entries[part, :take]
            gap = np.zeros((len(part), BLOCK, take), np.int64)
            for k in range(d):
                diff = blocks.points[at, k][:, :, None] - book[chosen, k][:, None, :]
                gap += diff * diff
            best = gap.argmin(axis=2)
            nearest[at] = np.take_along_axis(chosen, best, axis=1)
            distance[at] = np.take_along_axis(gap, best[:, :, None], axis=2)[:, :, 0]
    return decided, nearest, distance


def totals(blocks: Blocks, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(sums, counts)`` of the points that are nearest to each entry."""
    decided, nearest, _ = assign(blocks, book)
    sums, counts = np.zeros(book.shape, np.int64), np.zeros(len(book), np.int64)
    whole = decided >= 0
    np.add.at(sums, decided[whole], blocks.sums[whole])
    np.add.at(counts, decided[whole], blocks.sizes()[whole])
    looked = nearest >= 0
    looked &= ~np.repeat(whole, blocks.sizes())
    counts += np.bincount(nearest[looked], minlength=len(book))
    for k in range(book.shape[1]):  # sums of a segment stay far below 2**53
        added = np.bincount(nearest[looked], blocks.points[looked, k], minlength=len(book))
        sums[:, k] += added.astype(np.int64)
    return sums, counts


def codes(blocks: Blocks, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(entry, squared distance)`` of each row of the segment."""
    decided, nearest, distance = assign(blocks, book)
    given = np.repeat(decided, blocks.sizes())
    nearest = np.where(given >= 0, given, nearest)
    gap = blocks.points - book[nearest]
    distance = np.where(given >= 0, (gap * gap).sum(axis=1), distance)
    entry, error = np.empty_like(nearest), np.empty_like(distance)
    entry[blocks.order], error[blocks.order] = nearest, distance
    return entry, error


# -- Tables


def finite(vector: Column) -> Column:
    """Not null, and without null or non-finite components."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~bad


def _least(kept: DataFrame, n: int) -> list[list[float]]:
    """The vectors of the n smallest ids, ascending; nulls last, ties by the vector."""
    order = [F.col("vec_id").asc_nulls_last(), F.col("vector")]
    return [r.vector for r in kept.orderBy(*order).limit(n).collect()]


def _whole(vectors: np.ndarray, scale: int) -> np.ndarray:
    return np.floor(scale * vectors.astype(np.float64)).astype(np.int64)


def segments(rows: DataFrame, dim: int, parts: int, scale: int) -> DataFrame:
    """Rows ``(vec_id, label, vector)`` as segments: ids, labels, and the blocks of
    every part position."""
    size = max(1, min(SEGMENT, VALUES // dim))

    def packed(pending: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(pending).combine_chunks()
        ids, labels, vectors = (table.column(i).combine_chunks() for i in range(3))
        values = _whole(np.asarray(vectors.flatten()), scale).reshape(len(table), dim)
        small = np.min_scalar_type(-max(1, int(np.abs(values).max())) * 2)
        cut = [cut_blocks(x) for x in np.split(values, parts, axis=1)]

        def joined(name: str, kind) -> pa.Array:
            return pa.array([b"".join(getattr(b, name).astype(kind).tobytes() for b in cut)], pa.binary())

        return pa.RecordBatch.from_arrays(
            [
                pa.ListArray.from_arrays(pa.array([0, len(table)], pa.int32()), ids),
                pa.ListArray.from_arrays(pa.array([0, len(table)], pa.int32()), labels),
                pa.array([small.itemsize], pa.int32()),
                joined("points", small), joined("order", np.uint16),
                joined("low", small), joined("high", small), joined("sums", np.int64),
            ],
            ["ids", "labels", "width", "points", "order", "low", "high", "sums"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending, held = [], 0
        for batch in batches:
            while batch.num_rows:
                part = batch.slice(0, size - held)
                batch = batch.slice(part.num_rows)
                pending.append(part)
                held += part.num_rows
                if held == size:
                    yield packed(pending)
                    pending, held = [], 0
        if pending:
            yield packed(pending)

    schema = T.StructType([
        T.StructField("ids", T.ArrayType(rows.schema["vec_id"].dataType)),
        T.StructField("labels", T.ArrayType(rows.schema["label"].dataType)),
        T.StructField("width", T.IntegerType()),
        *(T.StructField(c, T.BinaryType()) for c in ("points", "order", "low", "high", "sums")),
    ])
    return rows.select("vec_id", "label", "vector").mapInArrow(run, schema)


def _unpacked(batch: pa.RecordBatch, row: int, dim: int, parts: int) -> Iterator[Blocks]:
    """The blocks of each part position of one segment."""
    d = dim // parts
    kind = np.dtype(f"i{batch.column('width')[row].as_py()}")

    def read(name: str, kind, *shape: int) -> np.ndarray:
        flat = np.frombuffer(batch.column(name)[row].as_buffer(), kind)
        return flat.reshape(parts, *shape)

    n = len(batch.column("order")[row].as_buffer()) // (2 * parts)
    stacked = (
        read("points", kind, n, d), read("order", np.uint16, n),
        read("low", kind, -1, d), read("high", kind, -1, d), read("sums", np.int64, -1, d),
    )
    for of_part in zip(*stacked, strict=True):
        points, order, *boxes = of_part
        yield Blocks(points.astype(np.int64), order, *(x.astype(np.int64) for x in boxes))


def next_books(table: DataFrame, books: np.ndarray) -> np.ndarray:
    """One round: books ``(parts, entries, d)`` with every entry that is nearest to some
    part replaced by the floor of their mean."""
    parts, n_entries, d = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros(books.shape, np.int64), np.zeros(books.shape[:2], np.int64)
        for batch in batches:
            for row in range(batch.num_rows):
                for p, blocks in enumerate(_unpacked(batch, row, parts * d, parts)):
                    added, n = totals(blocks, books[p])
                    sums[p] += added
                    counts[p] += n
        used = np.flatnonzero(np.repeat(counts.ravel(), d))
        yield pa.RecordBatch.from_arrays(
            [pa.array(used), pa.array(sums.ravel()[used]), pa.array(np.repeat(counts.ravel(), d)[used])],
            ["cell", "total", "n"],
        )

    read = table.select("width", "points", "order", "low", "high", "sums")
    found = read.mapInArrow(run, "cell long, total long, n long")
    found = found.groupBy("cell").agg(F.sum("total"), F.sum("n")).collect()
    out = books.copy().reshape(-1)
    for cell, total, n in found:
        out[cell] = total // n
    return out.reshape(books.shape)


def coded(table: DataFrame, books: np.ndarray) -> DataFrame:
    """``(vec_id, label, code, error)`` of every row of the segments."""
    parts, _, d = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                entries, error = [], 0
                for blocks, book in zip(_unpacked(batch, row, parts * d, parts), books, strict=True):
                    entry, gap = codes(blocks, book)
                    entries.append(entry.astype(np.uint8))
                    error = error + gap
                text = np.stack(entries, axis=1).tobytes().hex()
                w = 2 * parts
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("ids")[row].values, batch.column("labels")[row].values,
                        pa.array([text[i : i + w] for i in range(0, len(text), w)], pa.string()),
                        pa.array(error, pa.int64()),
                    ],
                    ["vec_id", "label", "code", "error"],
                )

    def kind(name: str) -> T.DataType:
        return table.schema[name].dataType.elementType

    schema = T.StructType([
        T.StructField("vec_id", kind("ids")), T.StructField("label", kind("labels")),
        T.StructField("code", T.StringType()), T.StructField("error", T.LongType()),
    ])
    return table.mapInArrow(run, schema)


def digest(books: np.ndarray) -> str:
    """SHA-256 of all components in decimal, by part, entry and place in the part."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def learn(rows: DataFrame, parts: int, entries: int, rounds: int, scale: int):
    """``(segments, books)`` of rows ``(vec_id, label, vector)`` of one length."""
    first = np.array(_least(rows, entries))
    books = _whole(first, scale)
    dim = books.shape[1]
    books = books.reshape(len(books), parts, dim // parts).transpose(1, 0, 2)
    table = materialize(segments(rows, dim, parts, scale), "segments")
    for _ in range(rounds):
        books = next_books(table, books)
    return table, books


def compress(
    vectors: DataFrame, *, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256
) -> DataFrame:
    """``(vec_id, label, code, error, label_error, codebooks_sha256)`` of the rows of
    ``vectors(vec_id, vector, label)`` whose vector is not null and has no null or
    non-finite component.

    A component x counts as ``floor(scale * x)``.  ``code`` has two hex digits for each
    part, ``error`` is the sum of the parts' squared distances, and ``label_error`` sums
    it over equal labels, nulls together.  Codebooks begin with the vectors of the
    ``entries`` (at most 256) smallest ids: null ids come last, and rows that repeat an id
    are taken in the order of their vectors.  Fewer vectors make smaller codebooks.

    The length of vectors is that of the smallest id whose length is a positive multiple
    of ``parts``.  Vectors of another length, or with a component of absolute value
    65,536 or more, have a null code and error and take part in nothing else.  An empty
    table gives an empty result.  Other columns are not read.
    """
    if not 1 <= entries <= 256:
        raise ValueError("entries must be from 1 to 256")
    kept = vectors.select("vec_id", "label", "vector").where(finite(F.col("vector")))
    length = F.size("vector")
    fits = kept.where((length > 0) & (length % parts == 0))
    within = ~F.exists("vector", lambda x: F.abs(x) >= LIMIT)
    shape = _least(fits.where(within), 1)
    if not shape:
        nothing = [F.lit(None).cast(t).alias(c) for c, t in _ADDED.items()]
        return kept.select("vec_id", "label", *nothing)
    usable = (length == len(shape[0])) & within
    table, books = learn(kept.where(usable), parts, entries, rounds, scale)
    found = materialize(coded(table, books), "codes")
    others = kept.where(~usable).select(
        "vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error")
    )
    # One row for a label, made by partial sums: a label of a third of all rows is one
    # row of the smaller side of the join.
    sums = found.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    return (
        found.union(others)
        .join(sums, F.col("label").eqNullSafe(F.col("of")), "left")
        .select("vec_id", "label", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
    )


_ADDED = {"code": "string", "error": "long", "label_error": "long", "codebooks_sha256": "string"}

# Workers get these functions by value, so they need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
