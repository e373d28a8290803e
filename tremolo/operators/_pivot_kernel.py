"""The in-task part of the pivot index: rows against the pivots of their group, and
queries against their home block.  Only arithmetic on the rows Spark hands over."""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle

from . import _block_kernel
from ._block_kernel import _column, best_per_row, distances, products

#: Share of the lengths involved by which a computed distance may be off.
MARGIN = 1e-6
ROUTED_ROWS = 512  # queries that meet all rings of a group at a time
SUB_BITS = 40  # of a block's code; the rest numbers pivot and ring


def gaps(dots, l_sq, r_sq, metric: str) -> np.ndarray:
    """Distances that satisfy the triangle inequality: Euclidean ones, or chords
    between unit vectors.  A zero vector counts as a direction of its own, which is
    never farther from anything than its cosine distance says."""
    if metric == "euclidean":
        return np.sqrt(np.maximum(l_sq[:, None] + r_sq[None, :] - 2.0 * dots, 0.0))
    scale = np.sqrt(np.outer(l_sq, r_sq))
    cosine = np.zeros_like(dots)
    np.divide(dots, scale, out=cosine, where=scale > 0)
    cosine[np.outer(l_sq == 0, r_sq == 0)] = 1.0
    return np.sqrt(np.maximum(2.0 - 2.0 * cosine, 0.0))


def gap_of(distance: np.ndarray, metric: str) -> np.ndarray:
    return distance if metric == "euclidean" else np.sqrt(2.0 * distance)


def locate(rows, pivots, *, metric, schema):
    """The rows with their nearest pivot (of equals the first), the gap to it, and
    their length (1 for cosine)."""
    if rows.num_rows == 0 or pivots.num_rows == 0:
        return pa.Table.from_pylist([], schema=schema)
    pivots = pivots.sort_by("pivot")
    dots, l_sq, r_sq = products(rows, pivots)
    gap = gaps(dots, l_sq, r_sq, metric)
    first = gap.argmin(axis=1)
    length = np.sqrt(l_sq) if metric == "euclidean" else np.ones(rows.num_rows)
    added = {
        "pivot": _column(pivots, "pivot").take(pa.array(first)),
        "gap": pa.array(gap[np.arange(rows.num_rows), first]),
        "length": pa.array(length),
    }
    columns = [added[f.name] if f.name in added else _column(rows, f.name) for f in schema]
    return pa.table(columns, schema=schema)


def _rings(pivots) -> dict[str, np.ndarray]:
    """All rings of the pivots as flat arrays; ``at`` is the row of the pivot."""
    rings = _column(pivots, "rings")
    flat = rings.flatten()
    out = {name: np.asarray(flat.field(name)) for name in ("ring", "subs", "low", "high", "short", "long")}
    out["at"] = np.repeat(np.arange(len(rings)), np.asarray(pc.list_value_length(rings)))
    out["pivot"] = np.asarray(_column(pivots, "pivot"))[out["at"]]
    return out


def targets(gap, length, reach, rings, home, ring_count, metric):
    """For each query the blocks, but its home, that may hold a row within ``reach``:
    ``(offsets, codes)``.  A ring is out of reach if the query's gap to the pivot, or
    its own length, differs too much from what the ring's rows have."""
    g = gap[:, rings["at"]]
    apart = np.maximum(g - rings["high"], rings["low"] - g)
    margin = MARGIN * (1.0 + rings["high"])[None, :]
    if metric == "euclidean":
        apart = np.maximum(apart, length[:, None] - rings["long"])
        apart = np.maximum(apart, rings["short"] - length[:, None])
        margin = MARGIN * (1.0 + length[:, None] + rings["long"])
    q, r = np.nonzero(apart <= reach[:, None] + margin)
    first = (rings["pivot"].astype(np.int64) * ring_count + rings["ring"]) << SUB_BITS
    subs = rings["subs"][r].astype(np.int64)
    ends = np.cumsum(subs)
    total = int(ends[-1]) if len(ends) else 0
    number = np.arange(total) - np.repeat(ends - subs, subs)
    codes, owner = np.repeat(first[r], subs) + number, np.repeat(q, subs)
    other = codes != home[owner]
    counts = np.bincount(owner[other], minlength=len(gap))
    return np.concatenate([[0], np.cumsum(counts)]), codes[other]


def search_home(left, rows, *, k, metric, exclude_self, schema):
    """Every query of a home block with its k nearest rows there."""
    if left.num_rows == 0:
        return pa.Table.from_pylist([], schema=schema)
    rows = rows.sort_by("id")
    n = left.num_rows
    dist = np.zeros((n, 0))
    if rows.num_rows:
        dist = distances(*products(left, rows), metric)
        if exclude_self:
            _block_kernel.hide_self(dist, left, rows)
    q_idx, t_idx = best_per_row(dist, k)
    finite = np.isfinite(dist[q_idx, t_idx])
    q_idx, t_idx = q_idx[finite], t_idx[finite]
    ends = np.cumsum(np.bincount(q_idx, minlength=n))
    starts = pa.array(np.concatenate([[0], ends]), pa.int32())
    pick = pa.array(t_idx)
    added = {
        "near_id": pa.ListArray.from_arrays(starts, _column(rows, "id").take(pick)),
        "near_distance": pa.ListArray.from_arrays(starts, pa.array(dist[q_idx, t_idx])),
    }
    if "near_label" in schema.names:
        added["near_label"] = pa.ListArray.from_arrays(starts, _column(rows, "label").take(pick))
    columns = [(added[f.name] if f.name in added else _column(left, f.name)).cast(f.type) for f in schema]
    return pa.table(columns, schema=schema)


def route(left, pivots, *, k, metric, ring_count, most, schema):
    """Queries that searched their homes with the blocks that may hold nearer rows (null:
    more than ``most``).  ``pivots`` are all of the group."""
    if left.num_rows == 0 or pivots.num_rows == 0:
        return pa.Table.from_pylist([], schema=schema)
    n = left.num_rows
    near = _column(left, "near_distance")
    found, counts = np.asarray(near.flatten()), np.asarray(pc.list_value_length(near))
    reach = np.full(n, np.inf)
    full = counts == k
    reach[full] = gap_of(found[np.cumsum(counts)[full] - 1], metric)
    dots, l_sq, r_sq = products(left, pivots)
    gap, length, rings = gaps(dots, l_sq, r_sq, metric), np.sqrt(l_sq), _rings(pivots)
    home = np.asarray(_column(left, "block"))
    lengths, codes = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    for lo in range(0, n, ROUTED_ROWS):
        some = slice(lo, lo + ROUTED_ROWS)
        ends_, named = targets(gap[some], length[some], reach[some], rings, home[some], ring_count, metric)
        lengths.append(np.diff(ends_))
        codes.append(named[np.repeat(lengths[-1] <= most, lengths[-1])])
    lengths, codes = np.concatenate(lengths), np.concatenate(codes)
    wide = lengths > most
    offsets = pa.array(np.concatenate([[0], np.cumsum(np.where(wide, 0, lengths))]), pa.int32())
    listed = pa.ListArray.from_arrays(offsets, pa.array(codes), mask=pa.array(wide))
    columns = [(listed if f.name == "targets" else _column(left, f.name)).cast(f.type) for f in schema]
    return pa.table(columns, schema=schema)


# Workers get these functions by value, so they need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
