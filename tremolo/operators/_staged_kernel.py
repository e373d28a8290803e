"""Tiles of projected counts for the neighbour join, multiplied slot by slot.

Projected counts are integers, so their products in single precision are exact.  The slots
that weigh most come first.  After some of them, what the others can add is bounded by the
lengths of what is left, share by share; queries that no row of the tile can be near to
any more are left out of the next stage."""

from __future__ import annotations

import sys

import numpy as np
from pyspark import cloudpickle

STAGES = (256, 640)  # slots after which pairs are looked at
SHARES = 32  # parts of the slots that are left, each bounded by its own length
WORTH = 0.75  # share of the queries left from which all slots are multiplied at once
FEW = 0.005  # share of a query's pairs that are worth computing one by one
PAIR_CHUNK = 4_000_000
SINGLE_EXACT = 1 << 24  # integers up to this are exact in single precision
SINGLE_ERROR = 6e-8  # of one rounding in single precision


def heaviest_first(drawn, squares, dim: int) -> np.ndarray:
    """The new place of each slot: those whose terms have the greatest sums of ``squares``
    come first."""
    energy = np.zeros(dim)
    for slots in drawn[0]:
        energy += np.bincount(slots, squares, minlength=dim)
    place = np.empty(dim, dtype=drawn[0].dtype)
    place[np.argsort(-energy, kind="stable")] = np.arange(dim)
    return place


class Counts:
    """Rows of integers; each is to be divided by the root of ``n_draws``."""

    def __init__(self, values: np.ndarray, n_draws: int):
        squares = np.einsum("ij,ij->i", values, values).astype(np.float64)
        if values.dtype == np.float32 and squares.max(initial=0.0) >= SINGLE_EXACT:
            wide = values.astype(np.float64)
            squares = np.einsum("ij,ij->i", wide, wide)
        self.n_draws, self.squared = n_draws, squares / n_draws
        #: Lengths of the integers, whose products must be exact.
        self.lengths = np.sqrt(squares)
        self.double = None
        if self.lengths.max(initial=0.0) >= SINGLE_EXACT:
            self.double = values
        self.values = values.astype(np.float32, copy=False)
        self._left = {}

    def left(self, stop: int) -> np.ndarray:
        """Lengths of the slots from ``stop`` on, in shares."""
        if stop not in self._left:
            rest = self.values[:, stop:]
            width = rest.shape[1] // SHARES * SHARES
            parts = np.einsum("isj,isj->ij", *2 * (rest[:, :width].reshape(len(rest), -1, SHARES),))
            tail = rest[:, width:]
            parts[:, : tail.shape[1]] += tail * tail
            # Rounded up, as they bound what is not rounded.
            self._left[stop] = np.sqrt(parts) * np.float32(1 + 1e-5)
        return self._left[stop]


def _exact(a: Counts, b: Counts) -> bool:
    return a.lengths.max(initial=0.0) * b.lengths.max(initial=0.0) < SINGLE_EXACT


def _wide(side: Counts) -> np.ndarray:
    return side.values.astype(np.float64) if side.double is None else side.double


def products(a: Counts, b: Counts):
    """Dot products and squared lengths."""
    if _exact(a, b):
        dots = (a.values @ b.values.T).astype(np.float64)
    else:
        dots = _wide(a) @ _wide(b).T
    return dots / a.n_draws, a.squared, b.squared


def _floors(a: Counts, b: Counts, metric: str, bound, slack: float):
    """What a product of integers has to reach, as a number for each query by which the
    ``scale`` of a row is multiplied and the ``offset`` of a row that is added to it; how far
    sums of the two may be off."""
    length, longest = a.lengths, b.lengths.max(initial=0.0)
    if metric == "cosine":
        floor = np.where(np.isinf(bound), -4.0, 1.0 - bound - slack) * length
        # Lengths other than 0 are 1 at least, and a row of no length has products of 0.
        return floor, np.maximum(b.lengths, 1.0), np.zeros(len(b.lengths)), 100 * SINGLE_ERROR * length * longest
    floor = 0.5 * a.n_draws * (a.squared - (np.minimum(bound, 1e15) + slack) ** 2)
    off = 100 * SINGLE_ERROR * (length * longest + longest * longest + np.abs(floor))
    off += 1e-11 * (length * length + longest * longest)
    return floor, np.ones(len(b.lengths)), -0.5 * b.lengths * b.lengths, off


def near(a: Counts, b: Counts, metrics, bounds, slack: float):
    """For each metric the index arrays of the pairs that may be nearer than the query's
    bound, and their exact products."""
    asked = [_floors(a, b, m, bound, slack) for m, bound in zip(metrics, bounds)]
    dim = a.values.shape[1]
    rows = np.arange(len(a.lengths))
    dots, done, singles = None, 0, []
    if not _exact(a, b):
        dots, done = _wide(a) @ _wide(b).T, dim
    for stop in [s for s in STAGES if s < dim - SHARES] + [dim]:
        if done == dim or not len(rows):
            break
        every = len(rows) == len(a.lengths)
        some = a.values[:, done:stop] if every else a.values[rows, done:stop]
        made = some @ b.values[:, done:stop].T
        dots = made if dots is None else np.add(dots, made, out=dots)
        done = stop
        if stop == dim:
            break
        mine = a.left(stop)[rows]
        open_ = np.zeros(dots.shape, dtype=bool)
        for floor, scale, offset, off in asked:
            left = np.column_stack([mine, -floor[rows], np.ones(len(rows))]).astype(np.float32)
            right = np.column_stack([b.left(stop), scale, offset]).astype(np.float32)
            top = left @ right.T
            top += dots
            open_ |= top >= -off[rows].astype(np.float32)[:, None]
        counts = np.count_nonzero(open_, axis=1)
        few = (counts > 0) & (counts <= FEW * dots.shape[1])
        if few.any():
            some = np.flatnonzero(few)
            q, t = np.nonzero(open_[some])
            q = some[q]
            singles.append((rows[q], t, dots[q, t] + _rest(a, b, rows[q], t, stop)))
        kept = counts > FEW * dots.shape[1]
        if kept.sum() < WORTH * len(rows) or few.any():
            rows, dots = rows[kept], dots[kept]
    if not len(rows):
        dots = np.zeros((0, len(b.lengths)), dtype=np.float32)
    out = []
    for floor, scale, offset, off in asked:
        scale, offset = ((1.0 / scale).astype(dots.dtype), offset.astype(dots.dtype))
        if offset.any():
            low = (floor - off).astype(dots.dtype)

            def rate(made, t):
                return made + offset[t]
        else:  # floors of a scale become floors of the rate
            low = (floor - 100 * SINGLE_ERROR * a.lengths).astype(dots.dtype)

            def rate(made, t):
                return made * scale[t]

        hits = np.flatnonzero(rate(dots, slice(None)) >= low[rows][:, None])
        q, t = np.divmod(hits, len(b.lengths))
        found = [(rows[q], t, dots.reshape(-1)[hits])]
        for q, t, made in singles:
            near_enough = rate(made, t) >= low[q]
            found.append((q[near_enough], t[near_enough], made[near_enough]))
        q, t, made = (np.concatenate(x) for x in zip(*found))
        out.append((q, t, made.astype(np.float64) / a.n_draws))
    return out


def _rest(a: Counts, b: Counts, q, t, start: int) -> np.ndarray:
    """The products of pairs over the slots from ``start`` on."""
    out = np.empty(len(q), dtype=np.float32)
    step = max(1, PAIR_CHUNK // a.values.shape[1])
    for lo in range(0, len(q), step):
        some = slice(lo, lo + step)
        out[some] = np.einsum("ij,ij->i", a.values[q[some], start:], b.values[t[some], start:])
    return out


# Workers get these functions by value, so they need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
