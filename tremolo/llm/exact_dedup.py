"""Exact de-duplication of a new batch against immutable snapshots.

A snapshot never changes, so the digests of each of its buckets are packed once
into a static three-way binary fuse filter (Graf and Lemire, 2022) of about nine
bits a digest here doubled to 16-bit fingerprints.  Digests of a new batch are
grouped among themselves first, then screened by the filters of their bucket;
only positives are joined with the exact digests, and bytes are compared last.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.materialize import materialize
from ._common import mix

#: Digests that one filter should hold; the number of buckets follows.
KEYS_PER_FILTER = 50_000


class FuseFilter:
    """A static set of 64-bit keys; no false negatives, one false positive in
    65,536.  ``build`` peels whole generations of keys at a time."""

    def __init__(self, seed: int, segment: int, count: int, cells: np.ndarray):
        self.seed, self.segment, self.count, self.cells = seed, segment, count, cells

    @staticmethod
    def _slots(keys: np.ndarray, seed: int, segment: int, count: int):
        h = mix(keys ^ np.uint64(seed * 0x9E3779B97F4A7C15 & (2**64 - 1)))
        first = ((h >> np.uint64(32)) * np.uint64(count * segment)) >> np.uint64(32)
        mask = np.uint64(segment - 1)
        second = (first + np.uint64(segment)) ^ ((h >> np.uint64(18)) & mask)
        third = (first + np.uint64(2 * segment)) ^ (h & mask)
        print_ = (mix(h) & np.uint64(0xFFFF)).astype(np.uint16)
        return np.stack([first, second, third]).astype(np.int64), print_

    @classmethod
    def build(cls, keys: np.ndarray) -> FuseFilter:
        keys = np.unique(keys.astype(np.uint64))
        n = max(len(keys), 2)
        segment = 1 << max(2, min(18, int(math.log(n) / math.log(3.33) + 2.25)))
        factor = max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(n))
        count = max(1, -(-int(n * factor) // segment) - 2)
        for seed in range(1, 1000):
            if seed % 10 == 0:  # very small sets: a little more room
                count += 1
            slots, prints = cls._slots(keys, seed, segment, count)
            order = cls._peel(slots, (count + 2) * segment)
            if order is None:
                continue
            cells = np.zeros((count + 2) * segment, np.uint16)
            for rows, own in reversed(order):
                # Nothing else of this generation touches its own slots.
                cells[own] = 0
                value = prints[rows].copy()
                for k in range(3):
                    value ^= cells[slots[k, rows]]
                cells[own] = value
            return cls(seed, segment, count, cells)
        raise RuntimeError("no seed peels this set")

    @staticmethod
    def _peel(slots: np.ndarray, size: int):
        n, order = slots.shape[1], []
        alive = np.arange(n)
        degree = np.bincount(slots.ravel(), minlength=size)
        while len(alive):
            single = degree[slots[:, alive]] == 1
            some = single.any(axis=0)
            if not some.any():
                return None
            rows, which = alive[some], single[:, some].argmax(axis=0)
            order.append((rows, slots[which, rows]))
            degree -= np.bincount(slots[:, rows].ravel(), minlength=size)
            alive = alive[~some]
        return order

    def contains(self, keys: np.ndarray) -> np.ndarray:
        slots, prints = self._slots(keys.astype(np.uint64), self.seed, self.segment, self.count)
        c = self.cells
        return (c[slots[0]] ^ c[slots[1]] ^ c[slots[2]]) == prints

    def to_bytes(self) -> bytes:
        head = np.array([self.seed, self.segment, self.count], "<u8").tobytes()
        return head + self.cells.astype("<u2").tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> FuseFilter:
        seed, segment, count = (int(x) for x in np.frombuffer(data[:24], "<u8"))
        return cls(seed, segment, count, np.frombuffer(data, "<u2", offset=24))


def _keys(digests: pd.Series) -> np.ndarray:
    return np.array([int(d[:16], 16) for d in digests], dtype=np.uint64)


def _bucket(digest: Column, buckets: int) -> Column:
    # Later hex digits than those that make up the filter's key.
    return (F.conv(F.substring(digest, 17, 8), 16, 10).cast("long") % buckets).cast("int")


def build_filters(digests: DataFrame, buckets: int) -> DataFrame:
    """``(snapshot, bucket, filter)`` from distinct ``(snapshot, digest)``."""

    def pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        made = FuseFilter.build(_keys(rows["digest"])).to_bytes()
        return pd.DataFrame({"snapshot": [key[0]], "bucket": [key[1]], "filter": [made]})

    return (
        digests.select("snapshot", "digest", _bucket(F.col("digest"), buckets).alias("bucket"))
        .groupBy("snapshot", "bucket")
        .applyInPandas(pack, "snapshot int, bucket int, filter binary")
    )


def screen(digests: DataFrame, filters: DataFrame, buckets: int) -> DataFrame:
    """The distinct incoming ``digest`` values that some snapshot may hold."""

    def test(incoming: pd.DataFrame, packed: pd.DataFrame) -> pd.DataFrame:
        hit = np.zeros(len(incoming), bool)
        if len(incoming) and len(packed):
            keys = _keys(incoming["digest"])
            for data in packed["filter"]:
                hit |= FuseFilter.from_bytes(data).contains(keys)
        return incoming.loc[hit, ["digest"]]

    keyed = digests.select("digest", _bucket(F.col("digest"), buckets).alias("bucket"))
    return keyed.groupBy("bucket").cogroup(filters.groupBy("bucket")).applyInPandas(
        test, "digest string"
    )


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def group_copies(docs: DataFrame, snapshot: Column, digest=sha256) -> DataFrame:
    """Groups of equal texts over snapshots and a new batch.

    ``docs(doc_id, text)``; ``snapshot`` gives the number of the immutable
    snapshot that a row is part of, and null for rows of the new batch.  Returns
    ``(doc_id, keep_id, group_size, kept, digest)``, one row per row: the
    largest doc_id of equal texts stays.  A null text counts as empty; a row that
    is repeated with its doc_id counts as often as it occurs and shares its
    decision; null ids are smaller than all others, so a row with a null id stays
    only if no equal text has an id.

    Hot groups: copies are pre-aggregated on the map side wherever a digest is a
    key, and the last join is a plain left join, which adaptive execution splits.
    """
    rows = docs.select(
        "doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"), snapshot.alias("snapshot")
    )
    rows = rows.withColumn("digest", digest(F.col("text")))
    ids = materialize(rows.select("doc_id", "digest", F.col("snapshot").cast("int")), "digests")

    # New-batch duplicates are grouped on their own; so are those of snapshots.
    per = materialize(
        ids.groupBy("digest", "snapshot").agg(F.count("*").alias("n"), F.max("doc_id").alias("top")),
        "groups",
    )
    stored, incoming = per.where("snapshot IS NOT NULL"), per.where("snapshot IS NULL")
    buckets = max(1, math.ceil(stored.count() / KEYS_PER_FILTER))
    filters = build_filters(stored, buckets)
    positive = screen(incoming, filters, buckets)

    # Positives meet the exact digests; what repeats anywhere goes on to bytes.
    # Snapshots are screened against each other the same way at their creation,
    # here by their digests.
    seen = stored.groupBy("digest").agg(
        F.sum("n").alias("n"), F.max("top").alias("top"), F.count("*").alias("snapshots")
    )
    fresh = incoming.select("digest", F.col("n").alias("new_n"), F.col("top").alias("new_top"))
    crossed = fresh.join(positive, "digest").join(seen, "digest")
    within_new = fresh.join(crossed.select("digest"), "digest", "left_anti").where("new_n > 1")
    within_old = seen.join(crossed.select("digest"), "digest", "left_anti").where("n > 1")
    suspects = materialize(
        crossed.select("digest", (F.col("n") + F.col("new_n")).alias("n"), F.greatest("top", "new_top").alias("top"))
        .union(within_new.select("digest", "new_n", "new_top"))
        .union(within_old.select("digest", "n", "top")),
        "suspects",
    )

    # Byte check: a digest must have one text only.  Texts are keys, so partial
    # aggregation sends each once from a task, and digests alone go on.
    texts = rows.groupBy("digest", "text").agg(F.count("*").alias("copies"))
    different = texts.groupBy("digest").agg(F.count("*").alias("texts"))
    checked = materialize(
        suspects.join(different, "digest").select("digest", "n", "top", (F.col("texts") == 1).alias("same")),
        "checked",
    )
    same = checked.where("same").select("digest", "n", "top")
    result = ids.join(same, "digest", "left")
    if checked.where("NOT same").limit(1).count():  # equal digests of unequal texts
        clash = checked.where("NOT same").select("digest")
        apart = rows.join(clash, "digest", "left_semi")
        split = apart.groupBy("digest", "text").agg(F.count("*").alias("n"), F.max("doc_id").alias("top"))
        exact = apart.join(split, ["digest", "text"]).select("digest", "doc_id", "snapshot", "n", "top")
        rest = result.join(clash, "digest", "left_anti")
        result = rest.select("digest", "doc_id", "snapshot", "n", "top").union(exact)
    keep = F.coalesce("top", "doc_id")
    return result.select(
        "doc_id", keep.alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"), "digest",
    )


def survivors(docs: DataFrame, snapshot: Column) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; rows that repeat
    both the doc_id and the text of a row that stays, stay with it."""
    kept = group_copies(docs, snapshot).where("kept").select("doc_id", "digest").distinct()
    digest = sha256(F.coalesce(docs["text"], F.lit("")))
    same = docs["doc_id"].eqNullSafe(kept["doc_id"]) & (digest == kept["digest"])
    return docs.join(kept, same, "left_semi")


def batches(doc_id: Column, snapshots: int = 2) -> Column:
    """A stand-in for arrival: ids hashed to ``snapshots`` stored snapshots and
    one new batch (null)."""
    at = F.pmod(F.xxhash64(doc_id), F.lit(snapshots + 1)).cast("int")
    return F.when(at < snapshots, at)


__all__ = ["FuseFilter", "batches", "build_filters", "group_copies", "screen", "sha256", "survivors"]

