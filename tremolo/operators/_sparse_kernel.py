"""Tiles of sparse rows for the neighbour join: which pairs of two tiles may be near.

Rows of a block that use the same terms lie in the same tiles.  The greatest weight of
each term in a training tile bounds what a query can share with any row of it, so queries
that have nothing near there are left out.  The products of the others are made in single
precision: frequent terms by a matrix product, rarer ones posting by posting.  Pairs that
may be within a query's bound, whatever the rounding, are computed once more in double
precision by the caller."""

from __future__ import annotations

import sys

import numpy as np
from pyspark import cloudpickle

HEADS = 256  # terms by which rows are compared when they are put in order
MOST_CENTRES = 16
SAMPLE_ROWS = 4096
ROUNDS = 6
# A term goes through the matrix product when its pairs would fill more than
# this share of the two tiles; rarer terms are added pair by pair.
DENSE_SHARE = 0.001
COLUMN_CHUNK = 2048
RARE_CHUNK = 1 << 17  # pairs of rare terms added at a time, which fit a cache
SINGLE_ERROR = 6e-8  # of one rounding in single precision
EXACT_CHUNK = 2_000_000  # entries of pairs computed at a time
COMPACTED = 0.75  # share of a tile's queries from which all of them are multiplied
GREATEST = 1e15  # lengths whose products are safe in single precision


def ranges(starts, counts) -> np.ndarray:
    """The numbers of all ranges, one after the other."""
    ends = np.cumsum(counts)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - counts), counts)


def squares(starts, weights) -> np.ndarray:
    """The squared length of every row of flat lists."""
    rows = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    weights = weights.astype(np.float64)
    return np.bincount(rows, weights * weights, minlength=len(starts) - 1)


def _inverse(squared) -> np.ndarray:
    lengths = np.sqrt(squared)
    return np.divide(1.0, lengths, out=np.zeros_like(lengths), where=lengths > 0)


def alike(starts, at, weights, tile_rows: int) -> list[np.ndarray]:
    """The row numbers of tiles, each in ascending order: rows are dealt to the nearest
    of a few centres by the terms that weigh most."""
    n = len(starts) - 1
    n_centres = min(MOST_CENTRES, n // tile_rows)
    if n_centres < 2 or not len(at):
        return [np.arange(lo, min(lo + tile_rows, n)) for lo in range(0, n, tile_rows)]
    lengths = np.diff(starts)
    rows = np.repeat(np.arange(n), lengths)
    unit = weights * _inverse(squares(starts, weights))[rows]
    energy = np.bincount(at, unit * unit)
    heads = np.argsort(-energy, kind="stable")[:HEADS]
    column = np.full(len(energy), -1, dtype=np.int64)
    column[heads] = np.arange(len(heads))
    place = column[at]
    used = place >= 0
    matrix = np.zeros((n, len(heads)), dtype=np.float32)
    matrix[rows[used], place[used]] = unit[used]
    filled = np.flatnonzero(matrix.any(axis=1))
    if len(filled) < n_centres:
        return [np.arange(lo, min(lo + tile_rows, n)) for lo in range(0, n, tile_rows)]

    def spread(count: int) -> np.ndarray:
        return matrix[filled[np.unique(np.linspace(0, len(filled) - 1, count).astype(np.int64))]]

    sample, centres = spread(SAMPLE_ROWS), spread(n_centres)
    for _ in range(ROUNDS):
        mine = np.argmax(sample @ centres.T, axis=1)
        sums = np.array([sample[mine == c].sum(axis=0) for c in range(n_centres)])
        size = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        centres = np.where(size > 0, sums / np.maximum(size, 1e-30), centres)
    mine = np.argmax(matrix @ centres.T, axis=1)
    # Centres of few rows share tiles with others.
    small = np.bincount(mine, minlength=n_centres) < tile_rows // 4
    mine = np.where(small[mine], n_centres, mine)
    tiles = []
    for c in range(n_centres + 1):
        own = np.flatnonzero(mine == c)
        if len(own):
            tiles += np.array_split(own, -(-len(own) // tile_rows))
    return tiles


class Postings:
    """The rows of a tile as postings: their entries in the order of terms, each term of
    a row once, in single precision.  Rows are scaled to unit length with ``unit``."""

    def __init__(self, rows, at, weights, squared, unit: bool):
        # Sorted by term; rows come in order, and stay so.
        order = np.sort((at.astype(np.int64) << 32) | np.arange(len(at))) & 0xFFFFFFFF
        rows, at, weights = rows[order].astype(np.int32), at[order], weights[order]
        first = np.ones(len(at), dtype=bool)
        first[1:] = (at[1:] != at[:-1]) | (rows[1:] != rows[:-1])
        if not first.all():
            weights = np.add.reduceat(weights, np.flatnonzero(first))
            rows, at = rows[first], at[first]
        self.n_rows, self.squared = len(squared), squared
        self.lengths = np.sqrt(squared)
        self.rows = rows
        self.single = (weights * _inverse(squared)[rows] if unit else weights).astype(np.float32)
        self.begins = np.flatnonzero(np.append(len(at) > 0, at[1:] != at[:-1]))
        self.terms = at[self.begins]
        self.counts = np.diff(np.append(self.begins, len(at)))
        # Rounded up, as it bounds what is not rounded.
        most = np.maximum.reduceat(np.abs(self.single), self.begins) if len(at) else self.single
        self.most = most * np.float32(1 + 4 * SINGLE_ERROR)
        sums = np.add.reduceat(self.single, self.begins) if len(at) else self.single
        #: The direction of the tile's middle, which says only where to look first.
        self.middle = sums / np.float32(max(np.sqrt(np.sum(sums.astype(np.float64) ** 2)), 1e-30))
        self.counted = np.bincount(rows, minlength=self.n_rows)
        self.plain = bool((self.single >= 0).all())

    def only(self, kept) -> "Postings":
        """The postings of the rows ``kept`` alone, which are numbered anew."""
        out = object.__new__(Postings)
        used = kept[self.rows]
        sums = np.append(0, np.cumsum(used))
        counts = sums[self.begins + self.counts] - sums[self.begins]
        some = counts > 0
        out.n_rows = int(kept.sum())
        out.rows = (np.cumsum(kept) - 1).astype(np.int32)[self.rows[used]]
        out.single = self.single[used]
        out.terms, out.counts = self.terms[some], counts[some]
        out.begins = np.cumsum(out.counts) - out.counts
        return out


def _dense(side: Postings, which, n_columns: int) -> np.ndarray:
    out = np.zeros((side.n_rows, n_columns), dtype=np.float32)
    counts = side.counts[which]
    at = ranges(side.begins[which], counts)
    out[side.rows[at], np.repeat(np.arange(len(which)), counts)] = side.single[at]
    return out


def _products(left: Postings, right: Postings, place) -> np.ndarray:
    """The products of all pairs in single precision; ``place`` has the position of each
    term in ``left``, or -1."""
    m, n = left.n_rows, right.n_rows
    found = place[right.terms]
    theirs = np.flatnonzero(found >= 0)
    mine = found[theirs]
    pairs = left.counts[mine] * right.counts[theirs]
    heavy = pairs > DENSE_SHARE * m * n
    dots = None
    lt, rt = mine[heavy], theirs[heavy]
    for lo in range(0, len(lt), COLUMN_CHUNK):
        a, b = (x[lo : lo + COLUMN_CHUNK] for x in (lt, rt))
        made = _dense(left, a, len(a)) @ _dense(right, b, len(b)).T
        dots = made if dots is None else np.add(dots, made, out=dots)
    if dots is None:
        dots = np.zeros((m, n), dtype=np.float32)
    lt, rt = mine[~heavy], theirs[~heavy]
    if not len(lt):
        return dots
    # Rare terms: for each training posting, the query postings of its term.
    times = right.counts[rt]
    posting = ranges(right.begins[rt], times)
    column, weight = right.rows[posting], right.single[posting]
    fan, first = np.repeat(left.counts[lt], times), np.repeat(left.begins[lt], times)
    base, own = left.rows.astype(np.int64) * n, left.single
    reach = np.cumsum(fan)
    target = dots.reshape(-1)
    start = 0
    while start < len(fan):
        done = reach[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(reach, done + RARE_CHUNK, "right")))
        f = fan[start:stop]
        at = np.arange(int(reach[stop - 1] - done))
        at += np.repeat(first[start:stop] - (reach[start:stop] - done - f), f)
        to = base[at]
        to += np.repeat(column[start:stop], f)
        made = own[at]
        made *= np.repeat(weight[start:stop], f)
        np.add.at(target, to, made)
        start = stop
    return dots


class Pairs:
    """One tile of queries, to be met by tiles of training rows.  With ``whole`` all
    weights are integers, whose products single precision holds; else, for the cosine,
    postings are those of rows of unit length."""

    def __init__(self, left: Postings, metric: str, n_terms: int, whole: bool):
        self.left, self.metric, self.whole, self.plain = left, metric, whole, left.plain
        self.n_terms = n_terms
        self.place = self._places(left)

    def _places(self, left: Postings) -> np.ndarray:
        place = np.full(self.n_terms, -1, dtype=np.int32)
        place[left.terms] = np.arange(len(left.terms))
        return place

    def _shared(self, weights, right: Postings, values) -> np.ndarray:
        """Sums of the queries' ``weights`` by ``values`` of the terms of ``right``."""
        left = self.left
        found = self.place[right.terms]
        known = found >= 0
        of_term = np.zeros(len(left.terms), dtype=np.float32)
        of_term[found[known]] = values[known]
        return np.bincount(left.rows, weights * np.repeat(of_term, left.counts), minlength=left.n_rows)

    def most(self, right: Postings) -> np.ndarray:
        """The most that each query can have in common with a row of ``right``."""
        return self._shared(np.abs(self.left.single), right, right.most) * (1 + 1e-6)

    def likeness(self, right: Postings) -> np.ndarray:
        return self._shared(self.left.single, right, right.middle)

    def _floors(self, right: Postings, bound, slack: float):
        """What a product has to reach; the scale and offset of training rows that it is
        given before."""
        left = self.left
        error = SINGLE_ERROR * (np.minimum(left.counted, right.counted.max(initial=0)) + 16)
        if self.metric == "cosine":
            floor = np.where(np.isinf(bound), -np.inf, 1.0 - bound - slack - error)
            if self.whole:
                # A vector of no length is at the distance 1 of all.
                return floor * np.maximum(left.lengths, 1e-30), _inverse(right.squared), None
            return floor, None, None
        a, b = left.lengths, right.lengths.max(initial=0.0)
        offset = -0.5 * right.squared
        # Products are off by up to error * a * b, their sums with offsets by some more.
        rounding = error * a * b + 4 * SINGLE_ERROR * (a * b + b * b) + 1e-11 * (left.squared + b * b)
        floor = np.where(np.isinf(bound), -np.inf, 0.5 * (left.squared - (bound + slack) ** 2) - rounding)
        return floor, None, offset

    def near(self, right: Postings, bound, slack: float, wanted=True):
        """Index arrays of the pairs, of the ``wanted`` queries, that may be nearer than
        ``bound``, and their products, exact if these are ``whole``."""
        floor, scale, offset = self._floors(right, bound, slack)
        best = self.most(right)
        if scale is not None:
            best = best * scale.max(initial=0.0)
        if offset is not None:
            best = best + offset.max(initial=-np.inf)
        kept = (best >= floor) & wanted
        none = np.zeros(0, dtype=np.int64)
        if not kept.any() or not right.n_rows:
            return none, none, none.astype(np.float32)
        left, place, rows = self.left, self.place, None
        floor = np.where(kept, floor, np.inf)
        if kept.sum() < COMPACTED * len(kept):
            left, rows = left.only(kept), np.flatnonzero(kept)
            place = self._places(left)
            floor = floor[kept]
        made = rate = _products(left, right, place)
        if scale is not None:
            rate = made * scale.astype(np.float32)
        if offset is not None:
            rate = made + offset.astype(np.float32)
        # Rounded down, so that a comparison in single precision drops nothing.
        low = np.nextafter(floor.astype(np.float32), np.float32(-np.inf))
        hits = np.flatnonzero(rate >= low[:, None])
        q, t = np.divmod(hits, right.n_rows)
        return (q if rows is None else rows[q]), t, made.reshape(-1)[hits]


def exact(left, right, q, t, size: int) -> np.ndarray:
    """The products of pairs of rows of two blocks in double precision, the pairs in the
    order of queries; ``size`` exceeds all numbers of terms of ``left``, whose rows hold
    no term twice."""
    out = np.zeros(len(q))
    if not len(q):
        return out
    stored = right.order[t]
    counts = right.starts[stored + 1] - right.starts[stored]
    ends = np.cumsum(counts)
    weight_of = np.zeros(size + 1)  # the last for terms that no query has
    lo = 0
    while lo < len(q):
        done = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, done + EXACT_CHUNK, "right")))
        flat = ranges(right.starts[stored[lo:hi]], counts[lo:hi])
        at, product = np.minimum(right.at[flat], size), right.weights[flat].astype(np.float64)
        stops = np.append(np.flatnonzero(q[lo + 1 : hi] != q[lo : hi - 1]) + 1, hi - lo)
        begin = first = 0
        for stop in stops:
            at_row = left.order[q[lo + first]]
            own = slice(left.starts[at_row], left.starts[at_row + 1])
            terms = left.at[own]
            weight_of[terms] = left.weights[own]
            end = int(ends[lo + stop - 1] - done)
            product[begin:end] *= weight_of[at[begin:end]]
            weight_of[terms] = 0.0
            begin, first = end, stop
        out[lo:hi] = np.bincount(np.repeat(np.arange(hi - lo), counts[lo:hi]), product, minlength=hi - lo)
        lo = hi
    return out


# Workers get these functions by value, so they need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
