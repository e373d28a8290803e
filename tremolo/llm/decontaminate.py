"""Benchmark passages in texts, found by spaced seeds.

Words are ``\\w+`` after lower-casing.  A mask reads some positions of a window of
words and ignores the others, so a window hashes alike though ignored words were
substituted.  Window hashes of texts and benchmark items are joined, and around
every common hash the words of both are laid side by side: a passage counts if it
has ``MIN_WORDS`` words or more (all words of a shorter item) of which at least
four fifths are equal, the first and the last included.

Five masks serve the items of ``MIN_WORDS`` words or more.  An item with fewer
words counts as a whole only, so it has masks as long as itself, one for every
choice of places that may be substituted; they miss nothing.  Of the substitutions
that a longer passage may have, the five masks find 98 % at 13 to 15 words and
99.9 % or more from 16 on (all placements counted).
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.materialize import materialize
from ._common import WordHashes, mix, parts

#: Positions read (1) and ignored (0).
MASKS = ("111111", "11101101", "11011011", "11110011", "10111101")
MIN_WORDS = 13
SIMILARITY = (4, 5)
#: Words on either side of a hit that are compared; a longer overlap holds one
#: of at most twice the least length that passes.
REACH = 2 * MIN_WORDS
#: Bits of the table that screens windows before any row leaves a task; a fixed
#: size, whatever the benchmark's.
SCREEN_BITS = 24

_WORD = re.compile(r"\w+")
_WIDTH = 2 * REACH + max(map(len, MASKS))


def word_hashes(text: str | None, hashes: WordHashes) -> np.ndarray:
    found = _WORD.findall(text.lower()) if text else ()
    return np.fromiter(map(hashes.__getitem__, found), np.uint64, len(found))


@cache
def masks(words: int) -> tuple[str, ...]:
    """The masks of an item of so many words.  A short one with ``s`` places to
    substitute deals its inner places to ``s + 2`` blocks, and every choice of
    ``s`` blocks is ignored by a mask: any ``s`` places lie in some choice."""
    if words >= MIN_WORDS:
        return MASKS
    up, down = SIMILARITY
    spare = words - -(-words * up // down)
    return tuple(
        "".join("0" if 0 < k < words - 1 and k % (spare + 2) in ignored else "1" for k in range(words))
        for ignored in combinations(range(spare + 2), spare)
    )


def seeds(h: np.ndarray, used: Iterable[str] = MASKS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each mask, the hash at every place where its window fits."""
    for mask in used:
        places = len(h) - len(mask) + 1
        if places <= 0:
            continue
        value = np.full(places, len(mask) << 32 | int(mask, 2), np.uint64)
        for k, read in enumerate(mask):
            if read == "1":
                value = (value ^ h[k : k + places]) * np.uint64(0x9E3779B97F4A7C15)
                value ^= value >> np.uint64(29)
        yield mix(value), np.arange(places)


def around(h: np.ndarray, at: int) -> bytes:
    """32 bits of each word from ``REACH`` before to behind a place; 0 outside."""
    low, high = at - REACH, at - REACH + _WIDTH
    cut = (h[max(low, 0) : high] >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    out = np.zeros(_WIDTH, np.uint32)
    out[max(-low, 0) : max(-low, 0) + len(cut)] = cut
    return out.tobytes()


def overlaps(left: list[bytes], right: list[bytes], needed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Length and equal words of the longest passage of each aligned pair; 0, 0
    if none passes."""
    a = np.frombuffer(b"".join(left), np.uint32).reshape(-1, _WIDTH)
    b = np.frombuffer(b"".join(right), np.uint32).reshape(-1, _WIDTH)
    same = (a == b) & (a != 0)
    both = (a != 0) & (b != 0)
    sums = np.pad(np.cumsum(same, axis=1, dtype=np.int16), ((0, 0), (1, 0)))
    inside = np.pad(np.cumsum(both, axis=1, dtype=np.int16), ((0, 0), (1, 0)))
    length = np.zeros(len(a), np.int64)
    equal = np.zeros(len(a), np.int64)
    up, down = SIMILARITY
    for size in range(int(needed.min()) if len(needed) else 1, _WIDTH + 1):
        hits = sums[:, size:] - sums[:, :-size]
        good = (hits * down >= up * size) & (inside[:, size:] - inside[:, :-size] == size)
        good &= same[:, : _WIDTH - size + 1] & same[:, size - 1 :]
        found = good.any(axis=1) & (size >= needed)
        length[found] = size
        equal[found] = np.where(good, hits, 0).max(axis=1)[found]
    return length, equal


def item_seeds(items: DataFrame) -> DataFrame:
    """``(key, item_id, needed, item_around)`` of every window of every item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in parts(batches):
            keys, ids, need, near = [], [], [], []
            for item, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                h = word_hashes(text, hashes)
                for values, places in seeds(h, masks(len(h)) if len(h) else ()):
                    keys.append(values.view(np.int64))
                    ids += [item] * len(places)
                    need += [min(MIN_WORDS, len(h))] * len(places)
                    near += [around(h, p) for p in places]
            key = np.concatenate(keys) if keys else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(key), pa.array(ids, batch.schema.field(0).type), pa.array(need, pa.int32()), pa.array(near, pa.binary())],
                ["key", "item_id", "needed", "item_around"],
            )

    kind = items.schema["item_id"].dataType.simpleString()
    return items.select("item_id", "text").mapInArrow(
        run, f"key long, item_id {kind}, needed int, item_around binary"
    )


def screen_table(keys: DataFrame) -> np.ndarray:
    """A table of ``2**SCREEN_BITS`` bits with those of all keys set.  It is put
    together by groups; what comes to the driver has a fixed size."""
    places = keys.select(F.expr(f"shiftrightunsigned(key, {64 - SCREEN_BITS})").alias("b"))
    rows = places.select(
        F.expr("shiftright(b, 5)").alias("word"),
        F.expr("shiftleft(1L, cast(b & 31 AS INT))").alias("bit"),
    )
    table = np.zeros(1 << (SCREEN_BITS - 5), np.uint32)
    for row in rows.groupBy("word").agg(F.bit_or("bit").alias("bits")).collect():
        table[row.word] = row.bits
    return table


def text_hits(docs: DataFrame, table: np.ndarray, used: Iterable[str] = MASKS) -> DataFrame:
    """``(doc_id, key, around)`` of the windows that pass the screen."""
    used = tuple(used)
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, bits = WordHashes(), shared.value
        for batch in parts(batches):
            # All texts of a slice at once; windows over the end of a text go.
            own = [word_hashes(text, hashes) for text in batch.column(1).to_pylist()]
            sizes = np.array([len(h) for h in own], np.int64)
            ends = np.cumsum(sizes)
            every = np.concatenate(own) if own else np.zeros(0, np.uint64)
            keys, rows, near = [], [], []
            for mask in used:
                for values, places in seeds(every, (mask,)):
                    b = values >> np.uint64(64 - SCREEN_BITS)
                    hit = np.flatnonzero((bits[b >> np.uint64(5)] >> (b & np.uint64(31)).astype(np.uint32)) & 1)
                    at = places[hit]
                    row = np.searchsorted(ends, at, side="right")
                    inside = at + len(mask) <= ends[row]
                    found, row, at = values[hit[inside]], row[inside], at[inside]
                    if "0" not in mask and len(mask) < min(map(len, MASKS)):  # equal as a whole: once a text
                        _, first = np.unique(np.stack([row.astype(np.uint64), found]), axis=1, return_index=True)
                        found, row, at = found[first], row[first], at[first]
                    if len(found):
                        keys.append(found.view(np.int64))
                        rows += row.tolist()
                        near += [around(own[r], p) for r, p in zip(row, at - ends[row] + sizes[row], strict=True)]
            if keys:
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(rows)), pa.array(np.concatenate(keys)), pa.array(near, pa.binary())],
                    ["doc_id", "key", "around"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, key long, around binary")


def find(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``(doc_id, item_id, overlap_words, equal_words)``: for every text and every
    benchmark item that share a passage, the longest one compared.

    ``docs(doc_id, text)``, ``items(item_id, text)``; null and empty texts share
    nothing; rows that repeat an id are judged together under it; null ids are
    kept as such; other columns are not read.  Items without words share nothing;
    one of a few words is in every text that holds them, so items that are no
    evidence must be taken out before.  Texts are read with the masks of the item
    lengths there are.  Only windows that pass the screen are shuffled; a window that
    very many texts hold meets one row for each item that has it, in a plain join
    that adaptive execution splits.
    """
    keys = materialize(item_seeds(items), "seeds")
    lengths = [row.needed for row in keys.select("needed").distinct().collect()]  # MIN_WORDS at most
    used = dict.fromkeys(mask for n in sorted(lengths) for mask in masks(n))
    hits = text_hits(docs, screen_table(keys.select("key")), used)
    matched = hits.join(keys, "key")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4_096):
                part = batch.slice(at, 4_096)
                doc, item, needed, left, right = part.columns
                length, equal = overlaps(left.to_pylist(), right.to_pylist(), np.asarray(needed))
                keep = pa.array(np.flatnonzero(length))
                yield pa.RecordBatch.from_arrays(
                    [doc.take(keep), item.take(keep), pa.array(length).take(keep), pa.array(equal).take(keep)],
                    ["doc_id", "item_id", "overlap_words", "equal_words"],
                )

    kinds = [matched.schema[c].dataType.simpleString() for c in ("doc_id", "item_id")]
    checked = matched.select("doc_id", "item_id", "needed", "around", "item_around").mapInArrow(
        verify, f"doc_id {kinds[0]}, item_id {kinds[1]}, overlap_words long, equal_words long"
    )
    longest = F.max(F.struct("overlap_words", "equal_words")).alias("longest")
    return checked.groupBy("doc_id", "item_id").agg(longest).select("doc_id", "item_id", "longest.*")


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all their columns, that share no passage."""
    bad = materialize(find(docs, items).select("doc_id").distinct(), "contaminated")
    bad = bad.withColumnRenamed("doc_id", "__bad")
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["__bad"]), "left_anti")
