"""Near copies by SimHash: all pairs of fingerprints at a small distance, found at the
anchors of covering codes.

Two fingerprints that differ in at most ``t`` bits are close in one of the ranges that
the 64 bits are cut into: with ``m`` ranges and shares ``t_i`` whose ``t_i + 1`` sum to
``t + 1``, one of them has at most ``t_i`` differing bits.  The anchors of a range are
the values whose lowest ``2**r - 1`` bits are a word of the Hamming code, the other bits
being free; they cover the range with radius 1, as every value is at most one bit from
exactly one of them, its *home*.  A fingerprint is sent to every anchor at most
``1 + t_i`` bits away.  If x and y differ in at most ``t_i`` bits of the range, y is
therefore at the home of x, so comparing the fingerprints at home with all that were
sent to an anchor misses no pair.

Equal fingerprints are one row throughout.  An anchor's rows lie next to each other in a
sorted partition and are compared by exclusive or and a count of bits, many anchors at
once.  Those at home at a crowded anchor are dealt to pieces, each of which sees all rows
of the anchor.  Pairs are not written: what is found at an anchor is joined to trees,
whose edges are at most as many as the rows, and components are those of all edges.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.materialize import materialize
from . import _common
from ._common import parts as byte_parts
from ._common import words
from ._components import components

BITS = 64
#: Fingerprints at home at an anchor that one piece compares, and pairs tested at once.
HOMES, PAIRS = 4096, 1 << 22
#: Shingle hashes whose bits are counted at once.
ROWS = 1 << 14

_U = np.uint64


# -- Fingerprints


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """XXH64 (seed 42) of every run of ``size`` words, joined by one space; of a shorter
    text, of all its words; of a text without words, none."""
    found = words(text)
    if not found:
        return np.zeros(0, _U)
    joined = b" ".join(found)
    ends = np.cumsum([len(w) + 1 for w in found]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    size = min(size, len(found))
    value = xxhash.xxh64_intdigest
    spans = zip(starts[: len(found) - size + 1].tolist(), ends[size - 1 :].tolist(), strict=True)
    return np.array([value(joined[a:b], 42) for a, b in spans], _U)


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes; of none, zero."""
    counts = np.zeros(BITS, np.int64)
    for start in range(0, len(hashes), ROWS):
        bytes_ = hashes[start : start + ROWS].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(bytes_, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, size: int = 4) -> DataFrame:
    """``(doc_id, print)`` of every row; the 64 bits as a signed number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_parts(batches):
            found = [majority(shingle_hashes(t, size)) for t in batch.column(1).to_pylist()]
            prints = pa.array(np.array(found, _U).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), prints], ["doc_id", "print"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, print long")


# -- Anchors


def ranges(threshold: int, m: int) -> list[tuple[int, int, int]]:
    """``(first bit, bits, share of the threshold)`` of ``m`` ranges of the 64 bits; the
    shares plus one sum to the threshold plus one."""
    out, first = [], 0
    for i in range(m):
        bits = BITS // m + (i < BITS % m)
        out.append((first, bits, (threshold + m - i) // m - 1))
        first += bits
    return out


def _checked(bits: int) -> int:
    """Bits of a range that the Hamming code takes: the largest ``2**r - 1``."""
    return (1 << ((bits + 1).bit_length() - 1)) - 1


def syndromes(values: np.ndarray, bits: int) -> np.ndarray:
    """Zero for a word of the code, else the place, from 1, of the bit to flip."""
    out = np.zeros(len(values), np.int64)
    for i in range(_checked(bits)):
        out ^= np.where((values >> _U(i)) & _U(1), i + 1, 0)
    return out


@cache
def flips(bits: int, radius: int) -> list[np.ndarray]:
    """For each syndrome, the changes of at most ``radius`` bits that lead from a value
    with it to an anchor, smallest changes first."""
    found = [[] for _ in range(_checked(bits) + 1)]
    for weight in range(radius + 1):
        for places in combinations(range(bits), weight):
            syndrome = 0
            for i in places:
                syndrome ^= i + 1 if i < _checked(bits) else 0
            found[syndrome].append(sum(1 << i for i in places))
    return [np.array(x, _U) for x in found]


def to_anchors(prints: np.ndarray, spread: list[tuple[int, int, int]]) -> Iterator[tuple]:
    """``(number of the range, anchor, print, home)`` arrays: each print at every anchor
    it is sent to; ``home`` marks the one at most one bit away."""
    for number, (first, bits, share) in enumerate(spread):
        values = (prints >> _U(first)) & _U((1 << bits) - 1)
        syndrome = syndromes(values, bits)
        for s, changes in enumerate(flips(bits, 1 + share)):
            mine = np.flatnonzero(syndrome == s)
            anchors = (values[mine, None] ^ changes[None, :]).ravel()
            home = np.tile(np.arange(len(changes)) == 0, len(mine))
            yield number, anchors, np.repeat(prints[mine], len(changes)), home


def replicated(prints: DataFrame, threshold: int, m: int) -> DataFrame:
    """``(range, anchor, print, home)`` of a table of different prints."""
    spread = ranges(threshold, m)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1 << 13):
                part = np.asarray(batch.column(0).slice(start, 1 << 13)).view(_U)
                for number, anchors, sent, home in to_anchors(part, spread):
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(len(sent), number, np.int32)), pa.array(anchors.view(np.int64)),
                            pa.array(sent.view(np.int64)), pa.array(home),
                        ],
                        ["range", "anchor", "print", "home"],
                    )

    return prints.select("print").mapInArrow(run, "range int, anchor long, print long, home boolean")


# -- Comparison


def join_trees(tree: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the trees of ``a[i]`` and ``b[i]``; ``tree`` holds the root of each row, the
    smallest of its rows."""
    while True:
        low, high = np.minimum(tree[a], tree[b]), np.maximum(tree[a], tree[b])
        apart = low != high
        if not apart.any():
            return
        a, b = a[apart], b[apart]
        np.minimum.at(tree, high[apart], low[apart])
        while True:
            above = tree[tree]
            if (above == tree).all():
                break
            tree[:] = above


def links(group: np.ndarray, prints: np.ndarray, home: np.ndarray, threshold: int) -> np.ndarray:
    """Edges ``(n, 2)`` that join what the pairs (at home, any) of equal ``group`` join
    that differ in at most ``threshold`` bits; rows are sorted by group."""
    start = np.searchsorted(group, group[home], side="left")
    count = np.searchsorted(group, group[home], side="right") - start
    at_home = np.flatnonzero(home)
    start, at_home, count = start[count > 1], at_home[count > 1], count[count > 1]
    ends = np.cumsum(count)
    tree = np.arange(len(prints))
    first = 0
    while first < len(at_home):
        base = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, base + PAIRS, side="right")))
        n = count[first:last]
        stops = ends[first:last] - base
        a = np.repeat(at_home[first:last], n)
        b = np.arange(stops[-1]) + np.repeat(start[first:last] - (stops - n), n)
        near = np.flatnonzero(np.bitwise_count(prints[a] ^ prints[b]) <= threshold)
        join_trees(tree, a[near], b[near])
        first = last
    moved = np.flatnonzero(tree != np.arange(len(tree)))
    return np.stack([prints[moved], prints[tree[moved]]], axis=1)


def compared(sent: DataFrame, threshold: int) -> DataFrame:
    """Edges ``(a, b)`` from the rows of ``replicated``."""
    key = ["range", "anchor"]
    crowd = sent.where("home").groupBy(*key).agg(F.ceil(F.count("*") / HOMES).cast("int").alias("pieces"))
    crowd = materialize(crowd.where("pieces > 1"), "crowded")
    pieces = F.coalesce("pieces", F.lit(1))
    own = F.pmod(F.xxhash64("print"), pieces.cast("long")).cast("int")
    dealt = sent.join(crowd, key, "left").select(
        *key, "print", "home", own.alias("own"), F.explode(F.sequence(F.lit(0), pieces - 1)).alias("piece")
    )
    key.append("piece")
    dealt = dealt.select(*key, "print", (F.col("home") & (F.col("own") == F.col("piece"))).alias("home"))
    dealt = dealt.repartition(*key).sortWithinPartitions(*key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in _with_end(batches):
            table = held
            if batch is not None:
                columns = [np.asarray(batch.column(i)) for i in range(5)]
                table = columns if held is None else [np.concatenate(x) for x in zip(held, columns)]
            if table is None:
                return
            number, anchor, piece, prints, home = table
            new = (np.diff(number) != 0) | (np.diff(anchor) != 0) | (np.diff(piece) != 0)
            group = np.concatenate([[0], np.cumsum(new)])
            # The last group may go on in the next batch.
            stop = len(group) if batch is None else int(np.searchsorted(group, group[-1]))
            held = [x[stop:] for x in table]
            found = links(group[:stop], prints[:stop].view(_U), home[:stop], threshold)
            if len(found):
                both = np.unique(found, axis=0).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["a", "b"])

    return dealt.mapInArrow(run, "a long, b long")


def _with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    """The batches that have rows, in larger pieces, then None."""
    pending, n = [], 0
    for batch in batches:
        if batch.num_rows:
            pending.append(batch)
            n += batch.num_rows
        if n >= 1 << 17:
            yield pa.Table.from_batches(pending).combine_chunks().to_batches()[0]
            pending, n = [], 0
    if pending:
        yield pa.Table.from_batches(pending).combine_chunks().to_batches()[0]
    yield None


def near_prints(prints: DataFrame, threshold: int = 4, m: int = 3) -> DataFrame:
    """``(node, component)`` of the prints that differ in at most ``threshold`` bits from
    another one of ``prints(print)``, which are all different."""
    if not 2 <= m <= threshold + 1:
        raise ValueError("m must be from 2 to threshold + 1")
    edges = materialize(compared(replicated(prints, threshold, m), threshold).distinct(), "edges")
    return components(edges, "a", "b")


def hexadecimal(value: Column) -> Column:
    """16 lower-case digits of a 64-bit number."""
    return F.lower(F.lpad(F.hex(value), 16, "0"))


def near_components(docs: DataFrame, size: int = 4, threshold: int = 4, m: int = 3) -> DataFrame:
    """``(doc_id, fingerprint, component_id)``, one row per row of ``docs(doc_id, text)``:
    texts are linked if their fingerprints, over runs of ``size`` words, differ in at most
    ``threshold`` bits; a component is named by its smallest doc_id.

    Null, empty and white texts have the fingerprint zero and are linked by it like any
    other.  Rows that repeat an id are linked each by its own text.  A row with a null id
    is linked with nothing and has no component.  Other columns are not read.  An empty
    table gives an empty result.

    ``m`` changes costs only: three ranges send a print to 32 anchors, of 2**17 or more
    a range; two send it to 187, of 2**27 a range, which pays where prints are so many
    that each anchor of three ranges has thousands.
    """
    rows = materialize(fingerprints(docs, size), "prints")
    named = rows.where("doc_id IS NOT NULL")
    groups = named.groupBy("print").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
    groups = materialize(groups, "groups")
    joined = materialize(near_prints(groups.select("print"), threshold, m), "components")
    joined = groups.join(joined, F.col("print") == F.col("node"), "left").select(
        "print", "rep", "copies", F.coalesce("component", "print").alias("component")
    )
    least = joined.groupBy("component").agg(F.min("rep").alias("component_id"))
    # Only what is not its own component is joined with the rows.
    moved = materialize(
        joined.join(least, "component").where("copies > 1 OR component_id <> rep").select("print", "component_id"),
        "moved",
    )
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return rows.join(moved, "print", "left").select(
        "doc_id", hexadecimal(F.col("print")).alias("fingerprint"), component.alias("component_id")
    )


# Workers get these functions by value, so they need no copy of the package.
for _module in (sys.modules[__name__], _common):
    cloudpickle.register_pickle_by_value(_module)
