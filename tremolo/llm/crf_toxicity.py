"""Toxic spans with a linear-chain conditional random field.

Tokens have two states.  A token's log-odds are the sum of weights of the
features of itself and its neighbours; four transition weights tie neighbours.
Only whole documents are labelled, so token labels are derived first: a word of
a toxic text is labelled toxic if it or its stem occurs in a far larger share of toxic than
of clean texts.  Those shares are counted over all labelled texts (``marking_terms``);
only the field's weights are fitted on a bounded sample.  Forward and backward messages of a batch of texts are computed at
once (``Chain``); the marginals give spans, and a small logistic model over
their sum, maximum and density gives the document's score.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.materialize import materialize
from ._common import parts, words

#: The field's weights come from at most so many labelled texts of each class, the
#: first by hash of their id, whatever their length.
MAX_TEXTS_PER_CLASS = 1_500
#: Tokens whose messages are computed at once while weights are fitted.
_FIT_TOKENS = 200_000
#: Different terms held by a task before it sends their counts on.
_TERMS_HELD = 200_000
_LIFT, _RATIO = 8.0, 40.0
_FEATURES = 11
_WORDS_KEPT = 250_000
#: Bytes of text whose messages are computed at once, about sixty times as many
#: bytes of memory.
_BATCH = 1 << 20
_WORD = re.compile(r"[^ \t-\r]+")
_EDGE = b".,;:!?\"'()[]{}<>*_-"


_LOOKALIKES = bytes.maketrans(b"0134578@$!", b"oieastbasi")


def stems(core: bytes) -> list[bytes]:
    """Beginnings of a word of three to eight letters, the word itself if it is
    shorter than eight; a letter of more bytes is never cut."""
    if core.isascii():
        return [core[:k] for k in range(3, min(len(core), 8) + 1)]
    text = core.decode("utf-8", "ignore")
    return [text[:k].encode() for k in range(3, min(len(text), 8) + 1)]


def _terms(word: bytes) -> list[bytes]:
    core = word.strip(_EDGE)
    return [core, *stems(core)]


def features(word: bytes, marking: frozenset[bytes] | set[bytes] = frozenset()) -> list[bytes]:
    """Names of a token's features: the word, its core without punctuation, the
    core with look-alike digits and signs read as letters, the stems, the core's
    last three bytes, and one that all marking words share."""
    core = word.strip(_EDGE)
    beginnings = stems(core)
    named = [b"w" + word, b"c" + core, b"l" + core.translate(_LOOKALIKES), b"e" + core[-3:]]
    named += [b"s" + stem for stem in beginnings]
    if core in marking or not marking.isdisjoint(beginnings):
        named.append(b"m")
    return named + [b""] * (_FEATURES - len(named))


class Chain:
    """Messages of many chains laid end to end.

    The tokens are written into a table of ``COLUMNS`` columns, row after row.
    A step is a two-by-two matrix; the matrix of a chain's first token forgets
    what came before.  All rows are multiplied out column by column at once, the
    products are passed from row to row, and then all rows are filled at once.
    """

    COLUMNS = 128

    def __init__(self, log_odds: np.ndarray, starts: np.ndarray, transition: np.ndarray):
        n = self.n = len(log_odds)
        rows = self.rows = max(1, -(-n // self.COLUMNS))
        size = rows * self.COLUMNS
        weight = np.ones(size)
        weight[:n] = np.exp(np.clip(log_odds, -30, 30))
        first = np.ones(size, bool)
        first[:n] = starts
        t = np.exp(transition)
        table = lambda x: np.ascontiguousarray(x.reshape(rows, self.COLUMNS).T)
        w = table(weight)
        first = table(first)
        self.a00 = np.where(first, 1.0, t[0, 0])
        self.a10 = np.where(first, 1.0, t[1, 0])
        self.a01 = np.where(first, 1.0, t[0, 1]) * w
        self.a11 = np.where(first, 1.0, t[1, 1]) * w
        self.first = first
        self._messages()

    def _messages(self) -> None:
        rows, columns = self.rows, self.COLUMNS
        p00, p11 = np.ones(rows), np.ones(rows)
        p01, p10 = np.zeros(rows), np.zeros(rows)
        for c in range(columns):
            a00, a01, a10, a11 = self.a00[c], self.a01[c], self.a10[c], self.a11[c]
            p00, p01 = p00 * a00 + p01 * a10, p00 * a01 + p01 * a11
            p10, p11 = p10 * a00 + p11 * a10, p10 * a01 + p11 * a11
            scale = 1.0 / (p00 + p01 + p10 + p11)
            p00, p01, p10, p11 = p00 * scale, p01 * scale, p10 * scale, p11 * scale
        f = np.empty((columns, rows, 2))
        b = np.empty((columns, rows, 2))
        head, tail = np.empty((rows, 2)), np.empty((rows, 2))
        products = np.stack([p00, p01, p10, p11], axis=1).tolist()
        x, y = 0.5, 0.5
        for r in range(rows):
            head[r] = x, y
            q = products[r]
            x, y = x * q[0] + y * q[2], x * q[1] + y * q[3]
            s = x + y
            x, y = x / s, y / s
        x, y = 0.5, 0.5
        for r in range(rows - 1, -1, -1):
            tail[r] = x, y
            q = products[r]
            x, y = q[0] * x + q[1] * y, q[2] * x + q[3] * y
            s = x + y
            x, y = x / s, y / s
        x, y = head[:, 0], head[:, 1]
        for c in range(columns):
            x, y = x * self.a00[c] + y * self.a10[c], x * self.a01[c] + y * self.a11[c]
            s = 1.0 / (x + y)
            x, y = x * s, y * s
            f[c, :, 0], f[c, :, 1] = x, y
        x, y = tail[:, 0], tail[:, 1]
        for c in range(columns - 1, -1, -1):
            b[c, :, 0], b[c, :, 1] = x, y
            x, y = self.a00[c] * x + self.a01[c] * y, self.a10[c] * x + self.a11[c] * y
            s = 1.0 / (x + y)
            x, y = x * s, y * s
        flat = lambda z: z.transpose(1, 0, 2).reshape(-1, 2)[: self.n]
        self.forward, self.backward = flat(f), flat(b)

    def marginals(self) -> np.ndarray:
        joint = self.forward * self.backward
        return joint[:, 1] / joint.sum(axis=1)

    def expected_transitions(self) -> np.ndarray:
        """Expected counts of the four transitions inside chains."""
        flat = lambda z: z.T.reshape(-1)[: self.n]
        inside = ~flat(self.first)
        inside[0] = False
        at = np.flatnonzero(inside)
        before, after = self.forward[at - 1], self.backward[at]
        step = np.stack([flat(z)[at] for z in (self.a00, self.a01, self.a10, self.a11)], axis=1)
        joint = step * before[:, [0, 0, 1, 1]] * after[:, [0, 1, 0, 1]]
        joint /= joint.sum(axis=1, keepdims=True)
        return joint.sum(axis=0).reshape(2, 2)


@dataclass
class Model:
    """Weights ``(features + 1, 3)`` for the token itself, the one before and the
    one after, the last row being zero for unknown features; transitions; and the
    document model (bias and three weights)."""

    names: dict[bytes, int]
    weights: np.ndarray
    transition: np.ndarray
    document: np.ndarray
    marking: frozenset[bytes] = frozenset()

    def odds(self, some: list[bytes]) -> np.ndarray:
        none, get, marking = len(self.names), self.names.get, self.marking
        found = [[get(f, none) for f in features(w, marking)] for w in some]
        return self.weights[np.array(found)].sum(axis=1)


def _shifted(odds: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Log-odds of tokens from ``(3, n)``: own part, what the token before says
    about its successor, and what the token after says about its predecessor."""
    total = odds[0].copy()
    inner = ~starts[1:]
    total[1:][inner] += odds[1][:-1][inner]
    total[:-1][inner] += odds[2][1:][inner]
    return total


def _starts(sizes: np.ndarray) -> np.ndarray:
    starts = np.zeros(int(sizes.sum()), bool)
    begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    starts[begin[sizes > 0]] = True
    return starts


def summaries(marginals: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Per text: log of one plus the expected toxic tokens, the largest
    marginal, and the root of the density; zeros for a text without tokens."""
    ends = np.cumsum(sizes)
    total = np.concatenate([[0.0], np.cumsum(marginals)])
    sums = total[ends] - total[ends - sizes]
    largest = np.zeros(len(sizes))
    some = sizes > 0
    if some.any():
        largest[some] = np.maximum.reduceat(marginals, (ends - sizes)[some])
    density = np.sqrt(np.maximum(sums, 0) / np.maximum(sizes, 1))
    return np.stack([np.log1p(np.maximum(sums, 0)), largest, density], axis=1)


def token_labels(texts: list[list[bytes]], toxic: np.ndarray) -> set[bytes]:
    """Cores and stems that mark a token of a toxic text as toxic: ``_LIFT`` times as
    frequent in toxic as in clean texts, with a log-likelihood ratio that chance
    and groups of near copies do not reach among very many words."""
    seen = {True: Counter(), False: Counter()}
    for text, label in zip(texts, toxic, strict=True):
        cores = {w.strip(_EDGE) for w in text}
        seen[bool(label)].update(cores | {stem for core in cores for stem in stems(core)})
    n_toxic = int(toxic.sum())
    n_clean = len(toxic) - n_toxic
    return {w for w, a in seen[True].items() if w and _marks(a, seen[False][w], n_toxic, n_clean)}


class _WordTerms(dict):
    """word → its terms, each once, kept up to a bound; a pure function of the word."""

    LIMIT = 50_000

    def __missing__(self, word: bytes) -> tuple[bytes, ...]:
        if len(self) >= self.LIMIT:
            self.clear()
        value = self[word] = tuple(set(_terms(word)))
        return value


def _marks(a: int, b: int, n_toxic: int, n_clean: int) -> bool:
    """Whether a term of ``a`` toxic and ``b`` clean texts marks."""
    share = (a + b) / (n_toxic + n_clean)
    ratio = 2 * (a * np.log(a / (n_toxic * share)) + (b * np.log(b / (n_clean * share)) if b else 0))
    lift = (a + 0.5) / (n_toxic + 1) / ((b + 0.5) / (n_clean + 1))
    return bool(ratio >= _RATIO and lift >= _LIFT)


class _Adam:
    def __init__(self, rate: float):
        self.rate, self.t, self.m, self.v = rate, 0, 0.0, 0.0

    def step(self, gradient: np.ndarray) -> np.ndarray:
        self.t += 1
        self.m = 0.9 * self.m + 0.1 * gradient
        self.v = 0.99 * self.v + 0.01 * gradient**2
        return self.rate * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.99**self.t)) + 1e-9)


def learn(texts: list[str], toxic: list[int], epochs: int = 40, marking: set[bytes] | None = None) -> Model:
    """Fit field and document model; ``marking`` are the terms that mark, by default
    those of ``texts``.  Copies of a text count once; without both classes, there are
    no weights and the score is the share of toxic texts.  Messages are computed for
    ``_FIT_TOKENS`` at once, so memory holds a few bytes a token."""
    once = {}
    for text, label in zip(texts, toxic, strict=True):
        once.setdefault(text, label)
    label = np.array(list(once.values()), float)
    if marking is None:
        marking = token_labels([words(t) for t in once], label)
    types: dict[bytes, int] = {}
    coded = [np.array([types.setdefault(w, len(types)) for w in words(t)], np.int32) for t in once]
    transition = np.zeros((2, 2))
    rate = (label.sum() + 0.5) / (len(label) + 1)
    document = np.array([np.log(rate / (1 - rate)), 0, 0, 0])
    sizes = np.array([len(t) for t in coded], dtype=np.int64)
    if label.min(initial=1) == label.max(initial=0) or len(label) < 2 or not sizes.sum():
        return Model({}, np.zeros((1, 3), np.float32), transition, document)
    marked = np.array([not marking.isdisjoint(_terms(w)) for w in types])
    names: dict[bytes, int] = {}
    numbers = (names.setdefault(f, len(names)) for w in types for f in features(w, marking))
    of_type = np.fromiter(numbers, np.int32, len(types) * _FEATURES).reshape(-1, _FEATURES)
    kinds, n = len(types), int(sizes.sum())
    del types
    groups = []  # texts in order, about ``_FIT_TOKENS`` a group
    number = (np.cumsum(sizes) - sizes) // _FIT_TOKENS
    for k in np.unique(number):
        at = np.flatnonzero(number == k)
        if sizes[at].sum():
            ids, starts = np.concatenate([coded[i] for i in at]), _starts(sizes[at])
            groups.append((at, ids, starts, marked[ids] & np.repeat(label[at] > 0, sizes[at])))
    del coded
    seen = np.zeros((2, 2))
    for _, _, starts, truth in groups:
        inside = np.flatnonzero(~starts)
        seen += np.bincount(truth[inside - 1] * 2 + truth[inside], minlength=4).reshape(2, 2)
    weights = np.zeros((3, len(names)))

    def type_odds() -> np.ndarray:
        odds = np.zeros((3, kinds))
        for j in range(of_type.shape[1]):
            odds += weights[:, of_type[:, j]]
        return odds

    # Each of the three rows of weights has steps of its own, so that those of one are
    # made and dropped before the next: the names are the greatest table here.
    by_weight, by_transition = [_Adam(0.3) for _ in weights], _Adam(0.1)
    for _ in range(epochs):
        odds, per_type, expected = type_odds(), np.zeros((3, kinds)), np.zeros((2, 2))
        for _, ids, starts, truth in groups:
            chain = Chain(_shifted(odds[:, ids], starts), starts, transition)
            rest = truth - chain.marginals()
            after, before = np.zeros(len(ids)), np.zeros(len(ids))
            after[:-1] = np.where(starts[1:], 0, rest[1:])
            before[1:] = np.where(starts[1:], 0, rest[:-1])
            for k, part in enumerate((rest, after, before)):
                per_type[k] += np.bincount(ids, part, minlength=kinds)
            if not starts.all():
                expected += chain.expected_transitions()
        for k, adam in enumerate(by_weight):
            gradient = np.zeros(len(names))
            for j in range(of_type.shape[1]):
                gradient += np.bincount(of_type[:, j], per_type[k], minlength=len(names))
            weights[k] += adam.step((gradient - 0.5 * weights[k]) / n)
        transition += by_transition.step((seen - expected - 0.5 * transition) / n)
    odds, x = type_odds(), np.zeros((len(sizes), 3))
    for at, ids, starts, _ in groups:
        x[at] = summaries(Chain(_shifted(odds[:, ids], starts), starts, transition).marginals(), sizes[at])
    table = np.concatenate([weights.T, np.zeros((1, 3))]).astype(np.float32)
    return Model(names, table, transition, _logistic(x, label), frozenset(marking))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Newton steps for a ridge-penalised logistic model with a bias, both classes
    weighted by their share in the sample."""
    x = np.concatenate([np.ones((len(x), 1)), x], axis=1)
    beta = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(beta))
        beta += np.linalg.solve(hessian, x.T @ (y - p) - ridge * beta)
    return beta


def _known(labels: DataFrame, allowed) -> DataFrame:
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & allowed)
    return known.select("doc_id", F.col("toxic").cast("int").alias("toxic")).distinct()


def labelled_texts(docs: DataFrame, labels: DataFrame, allowed) -> DataFrame:
    """The different texts with an allowed label, ``(doc_id, digest, toxic, text)``, written
    once.  Equal texts are one row, of the smallest id and clean if they have both labels.

    Which rows these are is settled on ids and digests, so texts are shuffled only for
    the one join that selects them.
    """
    texts = docs.select("doc_id", "text").where(F.col("text").isNotNull())
    digest = F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest")
    known = texts.select("doc_id", digest).join(_known(labels, allowed), "doc_id")
    chosen = known.groupBy("digest").agg(F.min("toxic").alias("toxic"), F.min("doc_id").alias("doc_id"))
    chosen = materialize(chosen, "labelled-ids")
    named = texts.select("doc_id", digest, "text").join(chosen, ["doc_id", "digest"])
    # An id may be repeated with the same text; the join has brought such rows together.
    named = named.dropDuplicates(["doc_id", "digest"])
    return materialize(named.select("doc_id", "digest", "toxic", "text"), "labelled")


def training_texts(texts: DataFrame) -> DataFrame:
    """The bounded training sample ``(doc_id, text, toxic)``: of the labelled texts of each
    class the first ``MAX_TEXTS_PER_CLASS`` by hash of the id.  The rows are chosen
    without their texts, which they meet in a broadcast join of so many rows at most."""
    order = [F.xxhash64("doc_id"), "doc_id", "digest"]
    rows = texts.select("doc_id", "digest", "toxic")
    chosen = [rows.where(F.col("toxic") == c).orderBy(*order).limit(MAX_TEXTS_PER_CLASS) for c in (0, 1)]
    sample = F.broadcast(chosen[0].union(chosen[1]).select("doc_id", "digest"))
    return texts.join(sample, ["doc_id", "digest"]).select("doc_id", "text", "toxic")


def marking_terms(texts: DataFrame) -> set[bytes]:
    """Terms that mark (``token_labels``) by their shares in all labelled texts.  Counts
    are added up in tasks first; only terms that mark come to the driver."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, terms = (Counter(), Counter()), _WordTerms()

        def out() -> pa.RecordBatch:
            named = list(seen[0] | seen[1])
            a, b = (pa.array([seen[k][t] for t in named], pa.int64()) for k in (1, 0))
            return pa.RecordBatch.from_arrays([pa.array(named, pa.binary()), a, b], ["term", "a", "b"])

        for batch in parts(batches):
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen[toxic].update({t for w in set(words(text)) for t in terms[w]})
                if len(seen[0]) + len(seen[1]) >= _TERMS_HELD:
                    yield out()
                    seen[0].clear(), seen[1].clear()
        if seen[0] or seen[1]:
            yield out()

    total = texts.select("text", "toxic").mapInArrow(count, "term binary, a long, b long").groupBy("term").agg(
        F.sum("a").alias("a"), F.sum("b").alias("b")
    )
    n = texts.agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.count(F.lit(1))).first()
    n_toxic, n_clean = n[0], n[1] - n[0]
    if not n_toxic or not n_clean:
        return set()
    lift = (F.col("a") + 0.5) / (n_toxic + 1) / ((F.col("b") + 0.5) / (n_clean + 1))
    likely = total.where((F.col("a") > 0) & (F.length("term") > 0) & (lift >= _LIFT * 0.999))
    share = (F.col("a") + F.col("b")) / float(n[1])
    ratio = 2 * (
        F.col("a") * F.log(F.col("a") / (n_toxic * share))
        + F.when(F.col("b") > 0, F.col("b") * F.log(F.col("b") / (n_clean * share))).otherwise(0.0)
    )
    rows = likely.where(ratio >= _RATIO * 0.999).collect()
    return {bytes(r.term) for r in rows if _marks(r.a, r.b, n_toxic, n_clean)}


def fit(docs: DataFrame, labels: DataFrame, allowed) -> Model:
    """Marking terms from all allowed labelled texts, weights on the driver from the
    bounded sample; rows are put in id order first, so that the model does not
    depend on how they arrive."""
    texts = labelled_texts(docs, labels, allowed)
    marking = marking_terms(texts)
    rows = training_texts(texts).collect()
    rows.sort(key=lambda r: (r.doc_id, r.toxic, r.text))
    texts, toxic = [r.text for r in rows], [r.toxic for r in rows]
    del rows
    return learn(texts, toxic, marking=marking)


class Scorer:
    """Applies a model inside a worker; keeps the log-odds of known words."""

    def __init__(self, model: Model):
        self.model = model
        self.known: dict[bytes, int] = {}
        self.odds = np.zeros((1 << 12, 3), np.float32)
        self.met = np.zeros(1 << 12, np.int32)  # batches that held the word

    def _forget(self) -> None:
        """Words of one batch alone go first, then those of few; half is kept at most."""
        n = len(self.known)
        least = max(2, int(np.partition(self.met[:n], n // 2)[n // 2]) + 1)
        kept = self.met[:n] >= least
        self.known = {w: k for k, w in enumerate(compress(self.known, kept))}
        end = len(self.known)
        self.odds[:end], self.met[:end] = self.odds[:n][kept], 1

    def _ids(self, tokens: list[list[bytes]]) -> np.ndarray:
        if len(self.known) > _WORDS_KEPT:
            self._forget()
        known = self.known
        new = list({w for t in tokens for w in t if w not in known})
        if new:
            end = len(known) + len(new)
            if end > len(self.odds):
                self.odds = np.concatenate([self.odds, np.zeros((end, 3), np.float32)])
                self.met = np.concatenate([self.met, np.zeros(end, np.int32)])
            self.met[len(known) : end] = 0
            self.odds[len(known) : end] = self.model.odds(new)
            known.update(zip(new, range(len(known), end), strict=True))
        ids = np.fromiter((known[w] for t in tokens for w in t), np.int64)
        self.met[ids] += 1  # once for a word, however often it occurs
        return ids

    def __call__(self, texts: list[str | None]):
        """Scores, and for each text its marginals."""
        tokens = [words(t) for t in texts]
        sizes = np.array([len(t) for t in tokens], dtype=np.int64)
        marginals = np.zeros(0)
        if sizes.sum():
            starts = _starts(sizes)
            odds = np.ascontiguousarray(self.odds_of(tokens).T)
            marginals = Chain(_shifted(odds, starts), starts, self.model.transition).marginals()
        x = summaries(marginals, sizes)
        beta = self.model.document
        scores = 1 / (1 + np.exp(-np.clip(beta[0] + x @ beta[1:], -30, 30)))
        return scores, np.split(marginals, np.cumsum(sizes)[:-1])

    def odds_of(self, tokens: list[list[bytes]]) -> np.ndarray:
        ids = self._ids(tokens)  # may replace the table
        return self.odds[ids].astype(float)


def spans(text: str, marginals: np.ndarray, least: float = 0.5) -> list[dict]:
    """Runs of tokens with a marginal of ``least`` or more, as character offsets."""
    found: list[dict] = []
    if not len(marginals) or marginals.max() < least:
        return found
    last = -2
    for k, match in enumerate(_WORD.finditer(text)):
        if marginals[k] >= least:
            if last == k - 1:
                found[-1]["end"] = match.end()
                found[-1]["probability"] = max(found[-1]["probability"], float(marginals[k]))
            else:
                found.append({"start": match.start(), "end": match.end(), "probability": float(marginals[k])})
            last = k
    return found


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, score, spans)`` of every row of ``docs(doc_id, text)``.

    Null, empty and white texts have no tokens: the score is that of a text
    without toxic tokens, and there are no spans.  Rows are scored one by one, so
    repeated and null ids are kept; no other column is read.  Narrow; the
    model's size is bounded by the training sample.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        kind = pa.list_(
            pa.struct([("start", pa.int32()), ("end", pa.int32()), ("probability", pa.float64())])
        )
        for batch in parts(batches, size=_BATCH):
            texts = batch.column(1).to_pylist()
            scores, marginals = scorer(texts)
            found = [spans(t, m) if t else [] for t, m in zip(texts, marginals, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(scores, pa.float64()), pa.array(found, kind)],
                ["doc_id", "score", "spans"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, score double, spans array<struct<start:int,end:int,probability:double>>"
    )


def clean(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` with a score below ``threshold``, with all their
    columns.  Narrow: each row is judged where it is."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in parts(batches, size=_BATCH):
            scores, _ = scorer(batch.column(at).to_pylist())
            yield batch.filter(pa.array(scores < threshold))

    return docs.mapInArrow(run, docs.schema)
