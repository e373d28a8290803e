"""Language sets of texts by a mixture of n-gram models.

Every language has a distribution over hashed byte trigrams (ASCII letters
lower-cased, other ASCII characters as one separator).  The n-grams of a text
are taken as drawn from a mixture of languages, whose proportions are found by
expectation-maximisation.  Languages are then kept in the order of their shares
as long as the log-likelihood rises by more than a penalty for each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import parts

BITS = 16
MAX_LANGUAGES = 1_000
#: Weight of the penalty; a text's n-grams overlap, so that each language must
#: pay for more than half a logarithm of their number.
PENALTY = 4.0
_SMOOTHING = 0.5
_ROUNDS, _REFITS = 12, 6
_ENTRIES = 400_000

_CLASS = np.arange(256, dtype=np.uint32)
_CLASS[:128] = [c | 32 if chr(c).isalpha() else 32 for c in range(128)]


def grams(text: str) -> np.ndarray:
    """Hashes of the byte trigrams, the text being set between separators."""
    raw = _CLASS[np.frombuffer(b" " + text.encode("utf-8", "replace") + b" ", np.uint8)]
    raw = raw[np.concatenate([[True], (raw[1:] != 32) | (raw[:-1] != 32)])]
    code = raw[:-2] << 16 | raw[1:-1] << 8 | raw[2:]
    return (code * np.uint32(2654435761)) >> np.uint32(32 - BITS)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def count_grams(docs: DataFrame) -> DataFrame:
    """``(lang, gram, n)`` over all rows of ``docs(text, lang)`` with a language
    and a letter.  Each task sends its own sums, at most one row per language and
    hash value, however many texts it has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in parts(batches):
            for text, lang in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if has_letter(text):
                    own = sums.setdefault(lang, np.zeros(1 << BITS, np.int64))
                    own += np.bincount(grams(text), minlength=1 << BITS)
        for lang, own in sums.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(own[at])],
                ["lang", "gram", "n"],
            )

    known = docs.where("lang IS NOT NULL").select("text", F.col("lang").cast("string"))
    counted = known.mapInArrow(run, "lang string, gram int, n long")
    return counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages in order, and their distributions ``(2**BITS, languages)``."""
    rows = count_grams(docs).groupBy("lang").agg(F.collect_list(F.struct("gram", "n")).alias("grams"))
    found = rows.limit(MAX_LANGUAGES + 1).collect()
    if len(found) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    found.sort(key=lambda r: r.lang)
    table = np.full((1 << BITS, len(found)), _SMOOTHING)
    for k, row in enumerate(found):
        pairs = np.array(row.grams, np.int64).reshape(-1, 2)
        table[pairs[:, 0], k] += pairs[:, 1]
    return [r.lang for r in found], (table / table.sum(axis=0)).astype(np.float32)


def _em(p: np.ndarray, weight: np.ndarray, begin: np.ndarray, doc: np.ndarray, share: np.ndarray, rounds: int):
    """Proportions after some rounds of EM, for all texts at once.  ``p`` has a
    row for each (text, n-gram); texts lie one after the other."""
    total = np.add.reduceat(weight, begin)
    for _ in range(rounds):
        joint = p * share[doc]
        joint *= (weight / np.maximum(joint.sum(axis=1), 1e-30))[:, None]
        share = np.add.reduceat(joint, begin, axis=0) / total[:, None]
    mixed = np.log(np.maximum((p * share[doc]).sum(axis=1), 1e-30))
    return share, np.add.reduceat(weight * mixed, begin)


def mixtures(texts: list[str], table: np.ndarray) -> np.ndarray:
    """Shares ``(texts, languages)`` of the chosen languages; others are 0."""
    counted = [np.unique(grams(t), return_counts=True) for t in texts]
    sizes = np.array([len(g) for g, _ in counted])
    begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    weight = np.concatenate([n for _, n in counted]).astype(np.float32)
    p = table[np.concatenate([g for g, _ in counted])]
    doc = np.repeat(np.arange(len(texts)), sizes)
    n, k = len(texts), table.shape[1]
    every, _ = _em(p, weight, begin, doc, np.full((n, k), 1 / k, np.float32), _ROUNDS)
    order = np.argsort(-every, axis=1, kind="stable")
    fee = PENALTY * np.log(np.add.reduceat(weight, begin) + 1)
    best = np.full(n, -np.inf)
    chosen = np.zeros((n, k), np.float32)
    open_ = np.ones(n, bool)
    for size in range(1, k + 1):
        keep = np.zeros((n, k), np.float32)
        np.put_along_axis(keep, order[:, :size], 1, axis=1)
        share = (every + 1e-6) * keep
        share, fit_ = _em(p, weight, begin, doc, share / share.sum(axis=1, keepdims=True), _REFITS if size > 1 else 0)
        better = open_ & (fit_ - fee * size > best)
        best[better] = (fit_ - fee * size)[better]
        chosen[better] = share[better]
        open_ = better  # a set that does not pay ends a text's search
        if not open_.any():
            break
    return chosen


def identify(docs: DataFrame, languages: list[str], table: np.ndarray) -> DataFrame:
    """``(doc_id, languages, lang_pred, score)`` of every row of
    ``docs(doc_id, text)``: the chosen languages with their shares, largest first,
    and the first of them with its share.

    A null text or one without any letter, or a model without languages, gives
    ``und``, no languages and score 0.  Ties go to the language first in the
    alphabet.  Rows are judged one by one; repeated and null ids are kept, and no
    other column is read.  Narrow; the model has one fixed-size table a language.
    """
    shared = docs.sparkSession.sparkContext.broadcast((languages, table))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, p = shared.value
        kind = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))
        for batch in parts(batches):
            texts = batch.column(1).to_pylist()
            found: list[list[dict]] = [[] for _ in texts]
            able = [i for i, t in enumerate(texts) if names and has_letter(t)]
            at = 0
            while at < len(able):
                some, size = [], 0
                while at < len(able) and (not some or size + len(texts[able[at]]) <= _ENTRIES):
                    size += len(texts[able[at]])
                    some.append(able[at])
                    at += 1
                for i, share in zip(some, mixtures([texts[i] for i in some], p), strict=True):
                    ranked = sorted(np.flatnonzero(share > 0), key=lambda k: (-share[k], k))
                    found[i] = [{"lang": names[k], "share": float(min(share[k], 1.0))} for k in ranked]
            first = [f[0]["lang"] if f else "und" for f in found]
            score = [f[0]["share"] if f else 0.0 for f in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(found, kind), pa.array(first), pa.array(score, pa.float64())],
                ["doc_id", "languages", "lang_pred", "score"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        run,
        f"doc_id {kind}, languages array<struct<lang:string,share:double>>, lang_pred string, score double",
    )
