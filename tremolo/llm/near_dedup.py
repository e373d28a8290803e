"""Near copies by HyperMinHash registers, banding, estimation and verification.

A text is the set of its distinct word shingles.  Shingle hashes are dealt to
``REGISTERS`` buckets; a register holds, of the least hash of its bucket, the
number of leading zeros and the ten bits after the first one (Yu and Weber,
2017).  Registers of empty buckets are borrowed from others in an order that is
the same for all texts, so each register still agrees with probability J.  Bands
of ``ROWS`` registers make the candidates; a pair with Jaccard similarity 0.8
agrees in none of the 51 bands with probability 2e-9.

Texts with equal sets are one class, and only classes are compared.  Links are
confirmed on the full sets, in two rounds, none of which writes all pairs of a
group:

1. every class with the smallest class of its bucket;
2. classes that buckets tie together, directly or through others, but round 1
   did not connect: they meet in blocks, where pairs of different components are
   tested, highest estimates first, unless their components are connected by
   then or the estimate rules a link out.  Only links are written.

After that no candidate pair of different components is untested, so components
are those of all candidate links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.materialize import materialize
from ._common import WordHashes, mix, parts, words
from ._components import components

REGISTERS, ROWS = 256, 5
BANDS = REGISTERS // ROWS
MANTISSA = 10
#: Members compared at once with one hub, and members of one block of a cluster.
PIECE, BLOCK = 256, 256

_U = np.uint64
_ORDER = np.argsort(
    mix(np.arange(REGISTERS * REGISTERS, dtype=_U) + _U(77)).reshape(REGISTERS, REGISTERS), axis=1
).astype(np.int16)


def shingles(text: str | None, size: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the shingles of ``size`` words; of a shorter
    text, one of all its words; of a text without words, none."""
    found = words(text)
    if not found:
        return np.zeros(0, _U)
    h = np.array([hashes[w] for w in found], _U)
    k = min(size, len(h))
    value = np.full(len(h) - k + 1, k, _U)
    for i in range(k):
        value = (value ^ h[i : i + len(value)]) * _U(0x9E3779B97F4A7C15)
        value ^= value >> _U(32)
    return np.unique(mix(value))


def registers(hashes: np.ndarray) -> np.ndarray:
    """The ``REGISTERS`` registers of a set that is not empty."""
    x = np.sort(mix(hashes ^ _U(0x5851F42D4C957F2D)))  # the bucket is in the top bits
    bucket = (x >> _U(56)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    m, e = np.frexp((x[first] & _U((1 << 56) - 1)).astype(float) + 0.5)
    value = ((56 - e) << MANTISSA) | ((m - 0.5) * (2 << MANTISSA)).astype(np.int64)
    out = np.zeros(REGISTERS, np.uint16)
    full = np.zeros(REGISTERS, bool)
    out[bucket[first]] = value
    full[bucket[first]] = True
    if len(first) < REGISTERS:
        empty = np.flatnonzero(~full)
        lender = _ORDER[empty, full[_ORDER[empty]].argmax(axis=1)]
        out[empty] = out[lender]
    return out


def band_keys(regs: np.ndarray) -> np.ndarray:
    """``(n, BANDS)`` keys from ``(n, REGISTERS)``."""
    r = regs[:, : BANDS * ROWS].reshape(len(regs), BANDS, ROWS).astype(_U)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=_U), r.shape[:2]).copy()
    for k in range(ROWS):
        key = (key ^ r[:, :, k]) * _U(0x9E3779B97F4A7C15)
        key ^= key >> _U(32)
    return mix(key).view(np.int64)


#: Probability that registers of disjoint sets agree.  The mantissa is even over
#: its values, and two leading-zero counts agree with probability 1/3 as they are
#: all but geometric at any set size; a constant therefore stands for the sizes.
COLLISION = 1 / 3 / (1 << MANTISSA)


def estimate(equal: np.ndarray) -> np.ndarray:
    """Jaccard similarity from the number of equal registers, corrected for
    registers that agree by chance."""
    return (equal / REGISTERS - COLLISION) / (1 - COLLISION)


def least_estimate(percent: int) -> float:
    """Five standard deviations of the estimate below the threshold."""
    j = percent / 100
    return j - 5 * (j * (1 - j) / REGISTERS) ** 0.5


def signatures(docs: DataFrame, size: int) -> DataFrame:
    """``(doc_id, n, set_a, set_b, regs)``; two sums of hashes name the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in parts(batches):
            n, a, b, regs = [], [], [], []
            for text in batch.column(1).to_pylist():
                s = shingles(text, size, hashes)
                n.append(len(s))
                a.append(s.sum(dtype=_U))
                b.append(mix(s + _U(1)).sum(dtype=_U))
                regs.append(registers(s).tobytes() if len(s) else None)
            sums = [pa.array(np.array(x, _U).view(np.int64)) for x in (a, b)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), *sums, pa.array(regs, pa.binary())],
                ["doc_id", "n", "set_a", "set_b", "regs"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id long, n long, set_a long, set_b long, regs binary"
    )


def bands(classes: DataFrame) -> DataFrame:
    """``(key, rep)``: the band keys of ``classes(rep, regs)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            regs = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16)
            keys = band_keys(regs.reshape(-1, REGISTERS))
            reps = np.repeat(np.asarray(batch.column(0)), BANDS)
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(reps)], ["key", "rep"])

    return classes.select("rep", "regs").mapInArrow(run, "key long, rep long")


def likely(pairs: DataFrame, classes: DataFrame, least: float) -> DataFrame:
    """The pairs ``(a, b)`` whose estimate does not rule a link out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = (
                np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(-1, REGISTERS)
                for i in (2, 3)
            )
            equal = (left == right).sum(axis=1)
            keep = pa.array(np.flatnonzero(estimate(equal) >= least))
            yield pa.RecordBatch.from_arrays([batch.column(i).take(keep) for i in (0, 1)], ["a", "b"])

    regs = classes.select("rep", "regs")
    both = pairs.join(regs.toDF("a", "regs_a"), "a").join(regs.toDF("b", "regs_b"), "b")
    return both.select("a", "b", "regs_a", "regs_b").mapInArrow(run, "a long, b long")


def verified(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` whose full sets are similar enough.

    Pairs are gathered by ``b``, their hub, in pieces of about ``PIECE`` members;
    a hub's text goes to each of its pieces, so a hub of very many members is
    dealt to as many tasks.
    """

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        hashes = WordHashes()
        is_hub = rows["doc"] == key[0]
        hubs = [shingles(t, size, hashes) for t in rows.loc[is_hub, "text"]]
        found = []
        for member, text in rows.loc[~is_hub, ["doc", "text"]].itertuples(index=False):
            own = shingles(text, size, hashes)
            if any(_similar(own, hub, percent) for hub in hubs):
                found.append(member)
        return pd.DataFrame({"a": np.array(found, np.int64), "b": np.full(len(found), key[0], np.int64)})

    pairs = materialize(pairs, "pairs")
    pieces = pairs.groupBy("b").agg(F.ceil(F.count("*") / PIECE).cast("int").alias("pieces"))
    pieces = materialize(pieces, "pieces")
    members = pairs.join(pieces, "b").select(
        F.col("a").alias("doc"), F.col("b").alias("hub"),
        F.pmod(F.xxhash64("a"), F.col("pieces").cast("long")).cast("int").alias("piece"),
    )
    hubs = pieces.select(
        F.col("b").alias("doc"), F.col("b").alias("hub"),
        F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"),
    )
    rows = members.union(hubs).join(texts, "doc").select("hub", "piece", "doc", "text")
    return rows.groupBy("hub", "piece").applyInPandas(run, "a long, b long")


def _similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """``100 * intersection >= percent * union`` of two sorted sets."""
    low, high = sorted((len(a), len(b)))
    if low == 0 or 100 * low < percent * high:
        return False
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    common = int((b[at] == a).sum())
    return 100 * common >= percent * (len(a) + len(b) - common)


def _across(open_: DataFrame, size: int, percent: int) -> DataFrame:
    """Links between components of one cluster; ``open_(cluster, rep, comp, regs,
    members, text)``.  A cluster of many members is cut into blocks, and every
    pair of blocks is one unit, so that none grows with the cluster."""
    least = least_estimate(percent)

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["rep", "text"], ignore_index=True)
        regs = np.frombuffer(b"".join(rows["regs"]), np.uint16).reshape(-1, REGISTERS)
        comp, rep, block = (rows[c].to_numpy() for c in ("comp", "rep", "block"))
        hashes, sets = WordHashes(), {}

        def of(i: int) -> np.ndarray:
            if i not in sets:
                sets[i] = shingles(rows["text"][i], size, hashes)
            return sets[i]

        found, comp = [], comp.copy()
        for i in range(len(rows) - 1):
            rest = np.flatnonzero(comp[i + 1 :] != comp[i]) + i + 1
            if key[1] != key[2]:  # pairs inside a block are its own unit's
                rest = rest[block[rest] != block[i]]
            equal = (regs[rest] == regs[i]).sum(axis=1)
            good = estimate(equal) >= least
            for j in rest[good][np.argsort(-equal[good], kind="stable")]:
                if comp[i] != comp[j] and _similar(of(i), of(j), percent):
                    found.append((rep[j], rep[i]))
                    comp[comp == comp[j]] = comp[i]
        pairs = np.array(found, np.int64).reshape(-1, 2)
        return pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})

    blocks = F.ceil(F.col("members") / BLOCK).cast("int")
    block = F.pmod(F.xxhash64("rep"), blocks.cast("long")).cast("int")
    other = F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other")
    kept = ["cluster", "rep", "comp", "regs", "text", "block"]
    dealt = open_.withColumn("block", block).select(*kept, other).select(
        *kept, F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high")
    )
    return dealt.groupBy("cluster", "low", "high").applyInPandas(run, "a long, b long")


def near_components(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)``, one row per row of
    ``docs(doc_id, text)``: texts whose shingle sets satisfy
    ``100 * intersection >= percent * union`` are linked; a component is named by
    its smallest doc_id, and that document is kept.

    Null, empty and white texts have no shingles and are linked with nothing.
    Rows that repeat a doc_id are one document with the links of all its rows.  A
    row with a null id is kept, alone and without component.  Other columns are not
    read.  An empty table gives an empty result.
    """
    least = least_estimate(percent)
    sets = materialize(signatures(docs, size), "sets")
    named = ["n", "set_a", "set_b"]
    filled = sets.where("n > 0 AND doc_id IS NOT NULL")
    groups = filled.groupBy(*named).agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
    groups = materialize(groups, "classes")
    classes = materialize(
        filled.withColumnRenamed("doc_id", "rep")
        .join(groups.select("rep", *named), ["rep", *named], "left_semi")
        .select("rep", "regs"),
        "registers",
    )
    keyed = bands(classes)
    buckets = materialize(
        keyed.groupBy("key").agg(F.count("*").alias("members"), F.min("rep").alias("hub")).where("members > 1"),
        "buckets",
    )
    stars = keyed.join(buckets, "key").where("rep <> hub")
    stars = materialize(stars.select(F.col("rep").alias("a"), F.col("hub").alias("b")).distinct(), "stars")
    involved = stars.select(F.explode(F.array("a", "b")).alias("doc")).distinct()
    # One plan at every size: the merge join ships each text once.
    named_texts = docs.select(F.col("doc_id").cast("long").alias("doc"), "text")
    texts = materialize(named_texts.join(involved.hint("merge"), "doc"), "texts")
    links = materialize(verified(likely(stars, classes, least), texts, size, percent), "links")

    clusters = components(stars, "a", "b").withColumnRenamed("component", "cluster")
    connected = components(links, "a", "b").withColumnRenamed("component", "comp")
    labelled = materialize(
        clusters.join(connected, "node", "left").select(
            "cluster", F.col("node").alias("rep"), F.coalesce("comp", "node").alias("comp")
        ),
        "labelled",
    )
    # A cluster of two was tested in the first round.
    open_ = labelled.groupBy("cluster").agg(
        F.count("*").alias("members"), F.min("comp").alias("x"), F.max("comp").alias("y")
    ).where("members > 2 AND x < y")
    open_ = labelled.join(materialize(open_.select("cluster", "members"), "open"), "cluster")
    open_ = open_.join(classes, "rep").join(texts.withColumnRenamed("doc", "rep"), "rep")
    more = materialize(_across(open_, size, percent), "links")
    links = links.union(more)
    # Two classes with one representative are two rows of one document.
    comp = materialize(components(links, "a", "b"), "components")
    resolved = groups.join(comp, F.col("rep") == F.col("node"), "left").select(
        *named, "rep", "copies", F.coalesce("component", "rep").alias("component_id")
    )
    resolved = materialize(
        resolved.where("copies > 1 OR component_id <> rep").select(*named, "component_id"), "resolved"
    )
    joined = sets.select("doc_id", *named).join(resolved, named, "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return joined.select(
        "doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"),
        F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"),
    )


def survivors(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` of which one document of each group stays, with all
    their columns."""
    gone = near_components(docs, size, percent).where("NOT kept").select(
        F.col("doc_id").alias("__gone")
    )
    gone = materialize(gone.distinct(), "gone")
    return docs.join(gone, docs["doc_id"] == gone["__gone"], "left_anti")
