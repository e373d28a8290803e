"""The in-task part of the neighbour join: one block of queries against one
block of training rows.  Spark decides the blocks, moves them and merges the
results; this is only the arithmetic on the two blocks it is handed."""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import cloudpickle

from . import _staged_kernel as staged
from ._sparse_kernel import GREATEST, Pairs, Postings, alike, exact, squares

TILE_ROWS = 2048  # rows of a side whose distances are held at a time
TILE_VALUES = 8_000_000  # projected values of a side held at a time
# A term goes through the matrix product when its pairs would fill more than
# this share of the block pair; rarer terms are added pair by pair.
DENSE_SHARE = 0.001
COLUMN_CHUNK = 2048
PAIR_CHUNK = 4_000_000
RARE_CHUNK = 1 << 18  # pairs of rare terms added at a time, which fit a cache
SNAP = 1e-12
PACK_ROWS = 32768  # rows packed together, with the next
PACK_BYTES = 64_000_000
KEPT_VALUES = 16_000_000  # projected values of a side kept for all tiles of the other
SINGLE_EXACT = 1 << 24  # integers up to this are exact in single precision
SINGLE_ERROR = 6e-8  # of one rounding in single precision
RECHECKED = 0.02  # share of a tile's pairs that are worth computing one by one
SCREENED_ROWS = 256  # of either side, from which pairs of sparse rows are screened
MOST_SLOTS = 4096  # slots of rows that are held as dense rows
MOST_TERMS = 50_000_000  # numbers of terms that fit tables of them


def _column(table: pa.Table, name: str):
    col = table.column(name).combine_chunks()
    return col.chunk(0) if isinstance(col, pa.ChunkedArray) else col


def _offsets(list_array) -> np.ndarray:
    return np.asarray(pc.list_value_length(list_array).fill_null(0)).astype(np.int64)


def _row_numbers(list_array) -> np.ndarray:
    lengths = _offsets(list_array)
    return np.repeat(np.arange(len(lengths)), lengths)


def _first_chunk(column):
    column = column.combine_chunks()
    return column.chunk(0) if isinstance(column, pa.ChunkedArray) else column


def _lists(lengths, values) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum(lengths)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)


def _to_bytes(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    options = pa.ipc.IpcWriteOptions(compression="zstd")
    with pa.ipc.new_stream(sink, table.schema, options=options) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def _from_bytes(data) -> pa.Table:
    return pa.ipc.open_stream(data.as_buffer()).read_all()


def _gathered(batches):
    """Batches as tables of up to ``PACK_ROWS`` rows or ``PACK_BYTES``, about."""
    held, rows, size = [], 0, 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            rows, size = rows + batch.num_rows, size + batch.nbytes
        if rows >= PACK_ROWS or size >= PACK_BYTES:
            yield pa.Table.from_batches(held)
            held, rows, size = [], 0, 0
    if held:
        yield pa.Table.from_batches(held)


def pack_rows(batches, *, keys, named, schema):
    """Rows of equal ``keys`` that lie together as one row: ``(*keys, rows BINARY, names
    BINARY)``.  The lists of the column ``named`` (None: no such column) hold numbers
    of ``names`` there, which has each name once."""
    for table in _gathered(batches):
        if named:
            lists = _column(table, named)
            coded = lists.flatten().dictionary_encode()
            numbers = _lists(_offsets(lists), coded.indices)
            table = table.set_column(table.column_names.index(named), named, numbers)
        numbered = table.select(keys).append_column("_at", pa.array(np.arange(table.num_rows)))
        groups = numbered.group_by(keys).aggregate([("_at", "list")])
        body = table.drop_columns(keys)
        out = {"rows": [], "names": []}
        for at in _column(groups, "_at_list"):
            part = body.take(at.values)
            names = None
            if named:
                lists = _column(part, named)
                used, inverse = np.unique(np.asarray(lists.flatten()), return_inverse=True)
                numbers = _lists(_offsets(lists), pa.array(inverse.reshape(-1), pa.int32()))
                part = part.set_column(part.column_names.index(named), named, numbers)
                names = _to_bytes(pa.table({"name": coded.dictionary.take(pa.array(used))}))
            out["rows"].append(_to_bytes(part))
            out["names"].append(names)
        columns = [_column(groups, f.name) if f.name in keys else pa.array(out[f.name], f.type) for f in schema]
        yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema)], schema=schema)


VECTORS = ("terms", "codes", "slots", "vec")


def _compact(weights) -> np.ndarray:
    """Numbers in single precision, if that loses nothing."""
    weights = np.asarray(weights, dtype=np.float64)
    single = weights.astype(np.float32)
    return single if (single == weights).all() else weights


class Block:
    """The rows of one side of a block pair: ``heads`` has the columns that are no
    vectors, and the vectors lie in flat arrays.  With ``ordered`` the rows are in the
    order of their ids, so that of equal distances the first is the one to take."""

    def __init__(self, tables, numbers=None, ordered=False):
        heads, lengths, at, weights, dense = [], [], [], [], []
        for number, table in enumerate(tables):
            self.form = next(c for c in VECTORS if c in table.column_names)
            lists = _column(table, self.form)
            if self.form == "vec":
                flat = np.asarray(lists.flatten())
                dense.append(flat.reshape(len(lists), -1) if len(lists) else flat.reshape(0, 0))
            else:
                flat = np.asarray(lists.flatten())
                lengths.append(_offsets(lists))
                at.append(flat if numbers is None else numbers[number][flat])
                weights.append(_compact(_flat(table, "weights")))
            heads.append(table.drop_columns([c for c in (self.form, "weights") if c in table.column_names]))
        self.heads = pa.concat_tables(heads).combine_chunks()
        if self.form == "vec":
            self.dense = np.concatenate(dense)
        else:
            self.starts = np.concatenate([[0], np.cumsum(np.concatenate(lengths))])
            self.at, self.weights = np.concatenate(at), np.concatenate(weights)
        self._squares = self._whole = self._term_squares = None
        self.tiles = {}  # what was made of rows to meet several blocks
        self.order = np.arange(self.heads.num_rows)
        if ordered:
            self.order = np.asarray(pc.sort_indices(self.heads.select(["id"]), sort_keys=[("id", "ascending")])).astype(np.int64)
            self.heads = self.heads.take(pa.array(self.order))

    @property
    def num_rows(self) -> int:
        return self.heads.num_rows

    def put(self, order: np.ndarray) -> None:
        """Puts the rows in this order."""
        self.order, self.heads = self.order[order], self.heads.take(pa.array(order))

    @property
    def whole(self) -> bool:
        """Whether all weights are integers."""
        if self._whole is None:
            self._whole = bool((np.rint(self.weights) == self.weights).all())
        return self._whole

    @property
    def squares(self) -> np.ndarray:
        """The squared lengths of the rows as they are stored (not in ``order``)."""
        if self._squares is None:
            self._squares = squares(self.starts, self.weights)
        return self._squares

    def term_squares(self, n_terms: int) -> np.ndarray:
        """The sum of squared weights of each of the ``n_terms`` numbers."""
        if self._term_squares is None:
            self._term_squares = np.bincount(self.at, self.weights.astype(np.float64) ** 2, minlength=n_terms)
        return self._term_squares

    def entries(self, here: np.ndarray):
        """Row, number and weight of the entries of the rows ``here``, and their count."""
        at = self.order[here]
        lengths = self.starts[at + 1] - self.starts[at]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        flat = np.arange(total) + np.repeat(self.starts[at] - (ends - lengths), lengths)
        weights = self.weights[flat].astype(np.float64)
        return np.repeat(np.arange(len(here)), lengths), self.at[flat], weights, len(here)

    def vectors(self, here: np.ndarray):
        """What the products of the rows ``here`` are made of."""
        if self.form == "vec":
            return self.dense[self.order[here]].astype(np.float64)
        return self.entries(here)

    def projected(self, here: np.ndarray, dim: int, drawn) -> np.ndarray:
        """The rows ``here`` under one random projection, as a dense matrix."""
        slots, signs = drawn
        rows, at, weights, _ = self.entries(here)
        weights = weights / np.sqrt(len(slots))
        out = np.zeros((len(here), dim))
        base = rows * dim
        step = max(1, PAIR_CHUNK // max(1, len(at)))
        for i in range(0, len(slots), step):
            slot, sign = slots[i : i + step], signs[i : i + step]
            out += np.bincount(
                (base + slot[:, at]).ravel(), (sign[:, at] * weights).ravel(), minlength=out.size
            ).reshape(out.shape)
        return out


    def whole_projected(self, here: np.ndarray, dim: int, drawn) -> staged.Counts:
        """The same of integers, not divided by the root of the number of draws."""
        slots, signs = drawn
        rows, at, weights, _ = self.entries(here)
        base = rows * dim
        # Sums of integers that single precision holds.
        small = np.bincount(rows, np.abs(weights)).max(initial=0.0) * len(slots) < SINGLE_EXACT
        out = np.zeros(len(here) * dim, dtype=np.float32 if small else np.float64)
        weights = weights.astype(out.dtype)
        for slot, sign in zip(slots, signs):
            np.add.at(out, base + slot[at], sign[at] * weights)
        return staged.Counts(out.reshape(len(here), dim), len(slots))


def blocks_of(left, right) -> tuple[Block, Block]:
    """Two sides as blocks, if they are tables; the right one in the order of ids."""
    if isinstance(left, Block):
        return left, right
    left, right = numbered_terms(left, right)
    return Block([left]), Block([right], ordered=True)


def unpack_side(side: pa.Table, keys, named, known=None, ordered=False):
    """One side as a block of the rows that :func:`pack_rows` was given (with ``keys`` of
    their own), and the names that the numbers in the column ``named`` stand for.  These
    begin with the names ``known`` already, so that numbers given before stay right."""
    names, numbers = None, None
    if named:
        parts = [_from_bytes(x).column("name") for x in side.column("names")]
        sizes = [0 if known is None else len(known), *map(len, parts)]
        chunks = [] if known is None else [known]
        chunks += [c for x in parts for c in x.chunks]
        coded = _first_chunk(pa.chunked_array(chunks, parts[0].type)).dictionary_encode()
        names = coded.dictionary
        numbers = np.split(np.asarray(coded.indices), np.cumsum(sizes)[:-1])[1:]
        del parts, coded
    block = Block((_from_bytes(x) for x in side.column("rows")), numbers, ordered)
    for key in keys:
        block.heads = block.heads.append_column(key, pa.repeat(side.column(key)[0], block.num_rows))
    return block, names


def unpack_sides(left: pa.Table, right: pa.Table, keys, named):
    """Both sides as blocks, and the names of either."""
    left, names = unpack_side(left, keys, named)
    right, names = unpack_side(right, keys, named, names, ordered=True)
    return left, right, names


def read_packed(folder: str) -> pa.Table:
    """The packed rows of one block in the shared folder."""
    system, root = fs.FileSystem.from_uri(folder if ":" in folder.split("/")[0] else "file://" + folder)
    found = system.get_file_info(fs.FileSelector(root, allow_not_found=True))
    files = sorted(f.path for f in found if f.path.endswith(".parquet"))
    read = [pq.ParquetFile(system.open_input_file(f)).read(["rows", "names"]) for f in files]
    return pa.concat_tables(read) if read else None


def read_blocks(folders, named, names):
    """The blocks of training rows in ``folders`` one after the other, each with the
    names of its numbers, which begin with ``names``."""
    for folder in folders:
        packed = read_packed(folder)
        if packed is not None:
            yield unpack_side(packed, [], named, names, ordered=True)


def numbered_terms(left: pa.Table, right: pa.Table):
    """Both sides with numbers in the place of their terms, if they have any as text."""
    if "terms" not in left.column_names or not pa.types.is_string(left.schema.field("terms").type.value_type):
        return left, right
    lists = [_column(side, "terms") for side in (left, right)]
    values = [x.flatten() for x in lists]
    numbers = pa.concat_arrays(values).dictionary_encode().indices
    out, start = [], 0
    for side, listed, flat in zip((left, right), lists, values):
        mine = _lists(_offsets(listed), numbers.slice(start, len(flat)))
        out.append(side.set_column(side.column_names.index("terms"), "terms", mine))
        start += len(flat)
    return tuple(out)


def _dense_matrix(table: pa.Table) -> np.ndarray:
    col = _column(table, "vec")
    flat = np.asarray(col.flatten(), dtype=np.float64)
    return flat.reshape(len(col), -1) if len(col) else flat.reshape(0, 0)


def _scatter(rows, codes, weights, n_rows, n_cols) -> np.ndarray:
    flat = np.bincount(rows * n_cols + codes, weights, minlength=n_rows * n_cols)
    return flat.reshape(n_rows, n_cols)


def _table_entries(table: pa.Table, name: str):
    lists = _column(table, name)
    weights = np.asarray(_flat(table, "weights"), dtype=np.float64)
    return _row_numbers(lists), np.asarray(lists.flatten()), weights, len(lists)


def _sparse_products(left, right):
    """Dot products and squared norms of two blocks of sparse rows, given as row,
    number and weight of their entries."""
    l_row, l_at, l_val, n_left = left
    r_row, r_at, r_val, n_right = right
    l_sq = np.bincount(l_row, l_val * l_val, minlength=n_left)
    r_sq = np.bincount(r_row, r_val * r_val, minlength=n_right)

    coded = pa.array(l_at).dictionary_encode()
    l_code = np.asarray(coded.indices).astype(np.int64)
    found = pc.index_in(pa.array(r_at), value_set=coded.dictionary)
    known = np.asarray(found.is_valid())
    r_code = np.asarray(found.fill_null(0)).astype(np.int64)[known]
    r_row, r_val = r_row[known], r_val[known]

    n_codes = len(coded.dictionary)
    dots = np.zeros((n_left, n_right))
    if n_codes == 0 or len(r_code) == 0:
        return dots, l_sq, r_sq
    # Sums of products of counts are integers, and none exceeds the lengths' product.
    counts = (np.rint(l_val) == l_val).all() and (np.rint(r_val) == r_val).all()
    if counts and np.sqrt(l_sq.max()) * np.sqrt(r_sq.max()) < SINGLE_EXACT:
        dots = dots.astype(np.float32)
    l_df = np.bincount(l_code, minlength=n_codes)
    r_df = np.bincount(r_code, minlength=n_codes)
    heavy = l_df * r_df > DENSE_SHARE * n_left * n_right

    # Frequent terms: matrix products over chunks of columns.
    column = np.full(n_codes, -1, dtype=np.int64)
    heavy_codes = np.flatnonzero(heavy)
    column[heavy_codes] = np.arange(len(heavy_codes))
    l_col, r_col = column[l_code], column[r_code]
    for lo in range(0, len(heavy_codes), COLUMN_CHUNK):
        hi = min(lo + COLUMN_CHUNK, len(heavy_codes))
        a, b = (l_col >= lo) & (l_col < hi), (r_col >= lo) & (r_col < hi)
        dots += (
            _scatter(l_row[a], l_col[a] - lo, l_val[a], n_left, hi - lo).astype(dots.dtype, copy=False)
            @ _scatter(r_row[b], r_col[b] - lo, r_val[b], n_right, hi - lo).T.astype(dots.dtype, copy=False)
        )

    # Rare terms: for each training posting, the query postings of its term.
    rare = np.flatnonzero(l_col < 0)
    rare = rare[np.argsort(l_code[rare], kind="stable")]
    first = np.searchsorted(l_code[rare], np.arange(n_codes))
    mine = np.flatnonzero((r_col < 0) & (l_df[r_code] > 0))
    fan = l_df[r_code[mine]]
    reach = np.cumsum(fan)
    target = dots.reshape(-1)
    start = 0
    while start < len(mine):
        base = reach[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(reach, base + RARE_CHUNK, "right")))
        part, f = mine[start:stop], fan[start:stop]
        ends = np.cumsum(f)
        step = np.arange(ends[-1]) - np.repeat(ends - f, f)
        lpos = rare[np.repeat(first[r_code[part]], f) + step]
        rpos = np.repeat(part, f)
        np.add.at(
            target, l_row[lpos] * n_right + r_row[rpos], (l_val[lpos] * r_val[rpos]).astype(dots.dtype, copy=False)
        )
        start = stop
    return dots.astype(np.float64, copy=False), l_sq, r_sq


def _flat(table: pa.Table, name: str) -> np.ndarray:
    return np.asarray(_column(table, name).flatten())


def _slot_products(*sides):
    """The same for rows of numbered slots, where repeated slots add up."""
    width = 1 + max((int(s[1].max()) for s in sides if len(s[1])), default=0)
    dots, l_sq, r_sq = 0.0, 0.0, 0.0
    for lo in range(0, width, COLUMN_CHUNK):
        hi = min(lo + COLUMN_CHUNK, width)
        parts = []
        for rows, slots, weights, n in sides:
            here = (slots >= lo) & (slots < hi)
            parts.append(
                _scatter(rows[here], slots[here].astype(np.int64) - lo, weights[here], n, hi - lo)
            )
        a, b = parts
        dots = dots + a @ b.T
        l_sq, r_sq = l_sq + (a * a).sum(axis=1), r_sq + (b * b).sum(axis=1)
    return dots, l_sq, r_sq


def drawn_slots(names, dim: int, draws, prime: int):
    """Slot and sign of every code of ``names`` in every draw."""
    names = np.asarray(names)
    high, low = names >> 30, names & ((1 << 30) - 1)
    slots = np.empty((len(draws), len(names)), dtype=np.int32)
    signs = np.empty(slots.shape, dtype=np.int8)
    for i, (a, b, c, d, e, f) in enumerate(draws):
        slots[i] = (a * high + e * low + b) % prime % dim
        signs[i] = 1 - 2 * (((c * low + f * high + d) % prime) & 1)
    return slots, signs


def products(left: pa.Table, right: pa.Table):
    """Dot products and squared norms of the rows of two tables."""
    if "vec" in left.column_names:
        return _matrix_products(_dense_matrix(left), _dense_matrix(right))
    left, right = numbered_terms(left, right)
    form = next(c for c in VECTORS if c in left.column_names)
    return _multiply(form)(_table_entries(left, form), _table_entries(right, form))


def _multiply(form: str):
    return {"vec": _matrix_products, "slots": _slot_products}.get(form, _sparse_products)


def _matrix_products(a: np.ndarray, b: np.ndarray):
    return a @ b.T, (a * a).sum(axis=1), (b * b).sum(axis=1)


def distances(dots, l_sq, r_sq, metric: str) -> np.ndarray:
    """Distances to 12 places, so that rows equal but for the order of additions tie;
    a vector with a component that is not finite is an error."""
    _check_finite(l_sq, r_sq)
    return _measured(dots, l_sq[:, None], r_sq[None, :], metric)


def _check_finite(l_sq, r_sq) -> None:
    if not (np.isfinite(l_sq).all() and np.isfinite(r_sq).all()):
        raise ValueError("vectors must have finite components")


def _measured(dots, l_sq, r_sq, metric: str) -> np.ndarray:
    if metric == "cosine":
        scale = np.sqrt(l_sq * r_sq)
        out = np.ones_like(dots)
        np.divide(dots, scale, out=out, where=scale > 0)
        np.subtract(1.0, out, out=out)
        out[scale == 0] = 1.0
        out[out < SNAP] = 0.0
    else:
        total = l_sq + r_sq
        out = total - 2.0 * dots
        out[out < 0.1 * SNAP * total] = 0.0
        np.sqrt(out, out=out)
    return np.round(out, 12)


def _nearer(dots, l_sq, r_sq, metric: str, bound):
    """Index arrays of the pairs nearer than their query's ``bound``, and their
    distances.  Only pairs that pass a looser test on the products are measured."""
    _check_finite(l_sq, r_sq)
    if metric == "cosine":
        rate = dots * _inverse(r_sq)
        floor = np.where(np.isinf(bound), -np.inf, 1.0 - bound - 10 * SNAP) * np.maximum(np.sqrt(l_sq), 1e-300)
    else:
        rate = dots - 0.5 * r_sq
        slack = 4 * SNAP * (l_sq + r_sq.max(initial=0.0))
        floor = 0.5 * (l_sq - (bound + 10 * SNAP) ** 2) - slack
    rows, columns = np.nonzero(rate >= floor[:, None])
    dist = _measured(dots[rows, columns], l_sq[rows], r_sq[columns], metric)
    kept = dist < bound[rows]
    return rows[kept], columns[kept], dist[kept]


def _inverse(squares) -> np.ndarray:
    """1 / length, and 0 of a zero vector."""
    lengths = np.sqrt(squares)
    return np.divide(1.0, lengths, out=np.zeros_like(lengths), where=lengths > 0)


class _Matrix:
    """Projected rows, with their directions in single precision."""

    def __init__(self, values: np.ndarray):
        self.values = values
        self.squares = (values * values).sum(axis=1)
        self._single = None

    @property
    def single(self) -> np.ndarray:
        if self._single is None:
            self._single = (self.values * _inverse(self.squares)[:, None]).astype(np.float32)
        return self._single


def _nearer_directions(a: _Matrix, b: _Matrix, bound):
    """:func:`_nearer` for the cosine of projected rows.  Products in single precision
    name the pairs that may be near enough, whatever their rounding; these are measured
    in double precision, or all are if they are many (None)."""
    _check_finite(a.squares, b.squares)
    margin = SINGLE_ERROR * (a.values.shape[1] + 8)
    floor = np.where(np.isinf(bound), -np.inf, 1.0 - bound - 10 * SNAP - margin)
    rate = a.single @ b.single.T
    # Rounded down, so that a comparison in single precision drops nothing.
    rows, columns = np.nonzero(rate >= np.nextafter(floor.astype(np.float32), np.float32(-np.inf))[:, None])
    if len(rows) > RECHECKED * rate.size:
        return None
    dots = np.empty(len(rows))
    step = max(1, PAIR_CHUNK // a.values.shape[1])
    for lo in range(0, len(rows), step):
        some = slice(lo, lo + step)
        dots[some] = np.einsum("ij,ij->i", a.values[rows[some]], b.values[columns[some]])
    dist = _measured(dots, a.squares[rows], b.squares[columns], "cosine")
    kept = dist < bound[rows]
    return rows[kept], columns[kept], dist[kept]


def _membership(table: pa.Table, listed: np.ndarray) -> np.ndarray:
    """Which rows (columns) belong to which of the sorted splits (rows)."""
    rows = _row_numbers(_column(table, "splits"))
    flat = _flat(table, "splits")
    place = np.minimum(np.searchsorted(listed, flat), len(listed) - 1)
    known = listed[place] == flat
    out = np.zeros((len(listed), table.num_rows), dtype=bool)
    out[place[known], rows[known]] = True
    return out


def hide_self(dist, left, right) -> None:
    """No row is its own neighbour."""
    same = pc.index_in(_column(left, "id"), value_set=_column(right, "id"))
    hit = np.asarray(same.is_valid())
    dist[hit, np.asarray(same.fill_null(0))[hit]] = np.inf


def best_per_row(dist, k):
    """Index arrays (row, column) of the k least values of every row, in order; of
    equal values the first columns."""
    n, width = dist.shape
    k = min(k, width)
    if k == 0:
        none = np.zeros(0, dtype=np.int64)
        return none, none
    if 4 * k >= width:
        order = np.argsort(dist, axis=1, kind="stable")[:, :k]
        return np.repeat(np.arange(n), k), order.reshape(-1)
    last = np.partition(dist, k - 1, axis=1)[:, k - 1]
    rows, columns = np.nonzero(dist <= last[:, None])  # k of each, or more with ties
    order = np.lexsort((columns, dist[rows, columns], rows))
    rows, columns = rows[order], columns[order]
    place = np.arange(len(rows)) - np.searchsorted(rows, rows)
    return rows[place < k], columns[place < k]


def _best_per_split(dist, test_in, train_in, k):
    """Index arrays (split code, query, training row) of the k best rows of
    every query in every split that tests it."""
    found = []
    for code, (tested, trained) in enumerate(zip(test_in, train_in)):
        queries, rows = np.flatnonzero(tested), np.flatnonzero(trained)
        if len(queries) and len(rows):
            q, t = best_per_row(dist[np.ix_(queries, rows)], k)
            found.append((np.full(len(q), code), queries[q], rows[t]))
    if not found:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none
    return tuple(np.concatenate(x) for x in zip(*found))


def _rows(left, right, schema, by, q_idx, t_idx, dist, numbers):
    """The chosen pairs as an Arrow table."""
    finite = np.isfinite(dist)
    q_pick, t_pick = pa.array(q_idx[finite]), pa.array(t_idx[finite])
    columns = {c: _column(left, c).take(q_pick) for c in by}
    columns |= {name: pa.array(v[finite]) for name, v in numbers.items()}
    columns["query_id"] = _column(left, "id").take(q_pick)
    columns["train_id"] = _column(right, "id").take(t_pick)
    if "query_label" in schema.names:
        columns["query_label"] = _column(left, "label").take(q_pick)
    if "label" in schema.names:
        columns["label"] = _column(right, "label").take(t_pick)
    columns["distance"] = pa.array(dist[finite])
    return pa.table([columns[f.name].cast(f.type) for f in schema], schema=schema)


def _tiles(n: int, rows: int):
    return [(lo, min(lo + rows, n)) for lo in range(0, n, rows)]


def _first_k(found, k, named=None):
    """Of the tiles' finds (index arrays of split, query and training row, and the
    distances) the k first of every split and query; ``named`` are other numbers to give
    back for the rows."""
    if len(found) == 1 and named is None:
        return found[0]
    split, query, row, dist = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((row, dist, query, split))
    row = row if named is None else named
    split, query, row, dist = split[order], query[order], row[order], dist[order]
    first = np.ones(len(split), dtype=bool)
    first[1:] = (split[1:] != split[:-1]) | (query[1:] != query[:-1])
    starts = np.flatnonzero(first)
    place = np.arange(len(split)) - np.repeat(starts, np.diff(np.append(starts, len(split))))
    kept = place < k
    return split[kept], query[kept], row[kept], dist[kept]


class _Found:
    """The k nearest rows met so far of every query (and split) of a tile.  Of equal
    distances the first row of a block is taken; ``before`` has what earlier blocks gave."""

    def __init__(self, k: int, n_queries: int, test_in, train_in=None):
        self.k, self.test_in, self.train_in = k, test_in, train_in
        n_splits = 1 if test_in is None else len(test_in)
        self.bounds = np.full((n_splits, n_queries), np.inf)
        self.last = np.full((n_splits, n_queries), -1)  # the row of the block that set a bound
        self.best = self.before = None

    def enter(self, train_in) -> None:
        """Turns to a block.  Its rows may come before those of other blocks, so they
        are of use at an equal distance too."""
        self.train_in = train_in
        if self.before is not None:
            none = np.zeros(0, dtype=np.int64)
            self.best = none, none, none, np.zeros(0)
            self.bounds = np.nextafter(self.bounds, np.inf)
        self.last[:] = -1

    def leave(self, heads: pa.Table) -> None:
        """Keeps, of what this block and those before gave, the k first by distance and id."""
        if self.best is None:
            return
        split, query, row, dist = self.best
        rows = heads.select([c for c in ("id", "label") if c in heads.column_names]).take(pa.array(row))
        if self.before is not None:
            split, query, dist = (np.concatenate(x) for x in zip(self.before[:3], (split, query, dist)))
            rows = pa.concat_tables([self.before[3], rows]).combine_chunks()
        place = np.asarray(pc.rank(_column(rows, "id"), tiebreaker="dense"))
        split, query, at, dist = _first_k([(split, query, place, dist)], self.k, np.arange(len(dist)))
        self.before = split, query, dist, rows.take(pa.array(at))
        self._bound(split, query, np.full(len(dist), -1), dist)

    @property
    def loosest(self) -> np.ndarray:
        """Per query, the greatest distance that may still be of use in a split."""
        if self.test_in is None:
            return self.bounds[0]
        return np.where(self.test_in, self.bounds, -1.0).max(axis=0)

    def of_use(self, q, t, nearest: float) -> np.ndarray:
        """Which pairs, all at ``nearest`` at least, may be of use."""
        bound = self.loosest[q]
        return (bound > nearest) | ((bound == nearest) & (t < self.last.max(axis=0)[q]))

    def start(self, tiles) -> None:
        """Takes the distances to first tiles: the queries, the rows of the block, and the
        distances of all pairs, each query in one tile."""
        out = []
        for queries, rows, dist in tiles:
            if self.test_in is None:
                q, t = best_per_row(dist, self.k)
                s = np.zeros(len(q), dtype=np.int64)
            else:
                s, q, t = _best_per_split(dist, self.test_in[:, queries], self.train_in[:, rows], self.k)
            out.append((s, queries[q], rows[t], dist[q, t]))
        self._merge(out)

    def add(self, q, t, dist) -> None:
        """Takes pairs of a query and a row, each once."""
        if self.test_in is None:
            near = self._near(0, q, t, dist)
            self._merge([self.best, (np.zeros(near.sum(), dtype=np.int64), q[near], t[near], dist[near])])
            return
        found = [self.best]
        for s in range(len(self.bounds)):
            near = np.flatnonzero(self.test_in[s, q] & self.train_in[s, t] & self._near(s, q, t, dist))
            found.append((np.full(len(near), s), q[near], t[near], dist[near]))
        self._merge(found)

    def _near(self, s: int, q, t, dist) -> np.ndarray:
        bound = self.bounds[s, q]
        return (dist < bound) | ((dist == bound) & (t < self.last[s, q]))

    def _merge(self, found) -> None:
        split, query, row, dist = self.best = _first_k(found, self.k)
        self._bound(split, query, row, dist)

    def _bound(self, split, query, row, dist) -> None:
        if len(split):
            ends = np.append(np.flatnonzero((split[1:] != split[:-1]) | (query[1:] != query[:-1])), len(split) - 1)
            full = ends[np.diff(np.append(-1, ends)) == self.k]
            self.bounds[split[full], query[full]] = dist[full]
            self.last[split[full], query[full]] = row[full]


def _same(left: pa.Table, right: pa.Table) -> np.ndarray:
    """For each row the row of the other side that has its id, or -1."""
    return np.asarray(pc.index_in(_column(left, "id"), value_set=_column(right, "id")).fill_null(-1))


def _search(left: Block, right: Block, tiles, metric, exclude_self) -> None:
    """Adds what the rows of ``right`` are to the queries of ``tiles``: the first and last
    row of ``left``, and what was found."""
    if left.form in ("terms", "codes") and _screened(left, right):
        _search_sparse(left, right, tiles, metric, exclude_self)
        return
    if left.form == "slots" and len(left.at) and len(right.at):
        width = 1 + int(max(left.at.max(), right.at.max()))
        if width <= MOST_SLOTS and min(left.at.min(), right.at.min()) >= 0:
            _search_slots(left, right, width, tiles, metric, exclude_self)
            return
    multiply = _multiply(left.form)
    for q_lo, q_hi, found in tiles:
        some, heads = left.vectors(np.arange(q_lo, q_hi)), left.heads.slice(q_lo, q_hi - q_lo)
        for t_lo, t_hi in _tiles(right.num_rows, TILE_ROWS):
            others = right.heads.slice(t_lo, t_hi - t_lo)
            made = multiply(some, right.vectors(np.arange(t_lo, t_hi)))
            if found.best is None:
                dist = distances(*made, metric)
                if exclude_self:
                    hide_self(dist, heads, others)
                found.start([(np.arange(q_hi - q_lo), np.arange(t_lo, t_hi), dist)])
                continue
            q, t, dist = _nearer(*made, metric, found.loosest)
            if exclude_self:
                other = _same(heads, others)[q] != t
                q, t, dist = q[other], t[other], dist[other]
            found.add(q, t + t_lo, dist)


def _screened(left: Block, right: Block) -> bool:
    """Whether there are rows enough, and no lengths that single precision cannot hold."""
    if min(left.num_rows, right.num_rows) < SCREENED_ROWS or not len(left.at) or not len(right.at):
        return False
    for side in (left, right):
        _check_finite(side.squares, side.squares)
    extremes = max(left.squares.max(), right.squares.max()) < GREATEST
    return bool(extremes and left.at.max() < MOST_TERMS and left.at.min() >= 0 and right.at.min() >= 0)


def _alike(block: Block, rows: int) -> list[np.ndarray]:
    """Tiles of rows of a block that use the same terms, each in the block's order."""
    place = np.empty(len(block.order), dtype=np.int64)
    place[block.order] = np.arange(len(block.order))
    return [np.sort(place[stored]) for stored in alike(block.starts, block.at, block.weights, rows)]


def _arrange(block: Block):
    """Puts rows that use the same terms beside each other and gives the edges of tiles;
    None if that cannot be done or is not worth it."""
    if block.form not in ("terms", "codes", "slots") or block.num_rows <= TILE_ROWS or not len(block.at):
        return None
    if block.at.min() < 0 or block.at.max() >= MOST_TERMS:
        return None
    tiles = _alike(block, TILE_ROWS)
    block.put(np.concatenate(tiles))
    return np.cumsum([0, *map(len, tiles)])


def _search_sparse(left: Block, right: Block, tiles, metric, exclude_self) -> None:
    """:func:`_search` for sparse rows; see :mod:`._sparse_kernel`."""
    whole = left.whole and right.whole and np.sqrt(left.squares.max() * right.squares.max()) < SINGLE_EXACT
    unit = metric == "cosine" and not whole
    size = int(left.at.max()) + 1
    used = np.zeros(size + 1, dtype=bool)
    used[left.at] = True

    def postings(side: Block, rows) -> Postings:
        numbers, at, weights, _ = side.entries(rows)
        if side is right:
            known = used[np.minimum(at, size)]
            numbers, at, weights = numbers[known], at[known], weights[known]
        return Postings(numbers, at, weights, side.squares[side.order[rows]], unit)

    others = [(rows, postings(right, rows)) for rows in _alike(right, TILE_ROWS)]
    for q_lo, q_hi, found in tiles:
        if (q_lo, unit) not in left.tiles:
            left.tiles[q_lo, unit] = postings(left, np.arange(q_lo, q_hi))
        pairs = Pairs(left.tiles[q_lo, unit], metric, size, whole)
        heads = left.heads.slice(q_lo, q_hi - q_lo)
        own = _same(heads, right.heads) if exclude_self else None
        home = None

        def measured(rows, some):
            return _sparse_products(left.entries(q_lo + some), right.entries(rows))

        if found.best is None:
            # Every query first meets the tile that is most like it.
            home = np.argmax([pairs.likeness(other) for _, other in others], axis=0)
            begun = []
            for at in np.unique(home):
                rows, some = others[at][0], np.flatnonzero(home == at)
                dist = distances(*measured(rows, some), metric)
                if exclude_self:
                    hide_self(dist, heads.take(pa.array(some)), right.heads.take(pa.array(rows)))
                begun.append((some, rows, dist))
            found.start(begun)
        for at, (rows, other) in enumerate(others):
            wanted = True if home is None else home != at
            bound = np.nextafter(found.loosest, np.inf)  # rows of a tile may come before others
            q, t, dots = pairs.near(other, bound, 10 * SNAP, wanted)
            most = RECHECKED * len(bound) * len(rows)
            if len(q) > most and metric == "cosine" and pairs.plain and other.plain:
                # Many pairs that share nothing lie at the distance 1: products of
                # weights of one sign do not cancel.
                kept = (dots > 0) | found.of_use(q, rows[t], 1.0)
                q, t, dots = q[kept], t[kept], dots[kept]
            if whole or len(q) <= most:
                kept = found.of_use(q, rows[t], 0.0)
                q, t, dots = q[kept], t[kept], dots[kept].astype(np.float64)
                if not whole:
                    dots = exact(left, right, q + q_lo, rows[t], size)
                dist = _measured(dots, pairs.left.squared[q], other.squared[t], metric)
            else:
                some = np.unique(q)
                q, t, dist = _nearer(*measured(rows, some), metric, bound[some])
                q = some[q]
            if exclude_self:
                another = own[q] != rows[t]
                q, t, dist = q[another], t[another], dist[another]
            found.add(q, rows[t], dist)


def _search_slots(left: Block, right: Block, width: int, tiles, metric, exclude_self) -> None:
    """:func:`_search` for rows of numbered slots, as dense rows; integers in stages, see
    :mod:`._staged_kernel`."""
    whole = left.whole and right.whole
    place = np.arange(width)
    if whole:
        place = staged.heaviest_first((place[None, :], None), right.term_squares(width), width)

    def tile(side: Block, some):
        rows, at, weights, _ = side.entries(some)
        values = _scatter(rows, place[at], weights, len(some), width)
        return staged.Counts(values, 1) if whole else _Matrix(values)

    kept = left.num_rows * width <= KEPT_VALUES
    made = [tile(left, np.arange(lo, hi)) for lo, hi, _ in tiles] if kept else None
    order = np.arange(right.num_rows)
    if min(left.num_rows, right.num_rows) > TILE_ROWS:  # few queries do not earn it back
        order = np.concatenate(_alike(right, TILE_ROWS))
    for part in _parts(order, TILE_ROWS, any(found.best is None for _, _, found in tiles)):
        others = tile(right, part)
        for number, (q_lo, q_hi, found) in enumerate(tiles):
            some, heads = made[number] if kept else tile(left, np.arange(q_lo, q_hi)), left.heads.slice(q_lo, q_hi - q_lo)

            def products():
                if whole:
                    return staged.products(some, others)
                return some.values @ others.values.T, some.squares, others.squares

            if found.best is None:
                dist = distances(*products(), metric)
                if exclude_self:
                    hide_self(dist, heads, right.heads.take(pa.array(part)))
                found.start([(np.arange(q_hi - q_lo), part, dist)])
                continue
            bound = np.nextafter(found.loosest, np.inf)  # of rows in any order
            if whole:
                ((q, t, dots),) = staged.near(some, others, [metric], [bound], 10 * SNAP)
                dist = _measured(dots, some.squared[q], others.squared[t], metric)
            else:
                near = _nearer_directions(some, others, bound) if metric == "cosine" else None
                q, t, dist = _nearer(*products(), metric, bound) if near is None else near
            if exclude_self:
                another = _same(heads, right.heads)[q] != part[t]
                q, t, dist = q[another], t[another], dist[another]
            found.add(q, part[t], dist)


def _parts(rows, size: int, first: bool):
    """Rows that are alike, cut into tiles, each in ascending order.  With ``first``, rows of
    every kind come first, so that every query has a bound."""
    parts = []
    if first and len(rows) > 2 * size:
        step = len(rows) // size
        parts.append(rows[::step][:size])
        rows = rows[~np.isin(rows, parts[0])]
    if len(rows):
        parts += np.array_split(rows, -(-len(rows) // size))
    return [np.sort(part) for part in parts]


def _query_tiles(n: int, k: int, test_in, rows: int, edges=None):
    return [
        (lo, hi, _Found(k, hi - lo, None if test_in is None else test_in[:, lo:hi]))
        for lo, hi in (_tiles(n, rows) if edges is None else zip(edges[:-1], edges[1:]))
    ]


def _nearest(left, right, k, metric, exclude_self, test_in=None, train_in=None):
    """Index arrays (split, query, training row) and distances of the k nearest rows of
    every query (and split), tile by tile."""
    left, right = blocks_of(left, right)
    tiles = _query_tiles(left.num_rows, k, test_in, TILE_ROWS)
    none = np.zeros(0, dtype=np.int64)
    out = [(none, none, none, np.zeros(0))]
    for _, _, found in tiles:
        found.enter(train_in)
    _search(left, right, tiles, metric, exclude_self)
    for lo, _, found in tiles:
        s, q, t, dist = found.best
        out.append((s, q + lo, t, dist))
    return tuple(np.concatenate(x) for x in zip(*out))


def _kept(tiles):
    """What the tiles hold after the last block: split, query, distance, and the heads of
    the training rows; None if there was nothing to find."""
    found = [(f.before[0], f.before[1] + lo, *f.before[2:]) for lo, _, f in tiles if f.before is not None]
    if not found:
        return None
    return *(np.concatenate([x[i] for x in found]) for i in range(3)), pa.concat_tables([x[3] for x in found])


def nearest_in_block(left, right, *, k, metric, by, with_splits, exclude_self, schema):
    """The k nearest rows of this training block for every row of this query
    block (once per split both belong to), as an Arrow table."""
    if left.num_rows == 0 or right.num_rows == 0:
        return pa.Table.from_pylist([], schema=schema)
    left, right = blocks_of(left, right)
    return nearest_in_blocks(
        left, [(right, None)], k=k, metric=metric, by=by, with_splits=with_splits,
        exclude_self=exclude_self, schema=schema,
    )


def nearest_in_blocks(left: Block, blocks, *, k, metric, by, with_splits, exclude_self, schema):
    """The same over several training blocks, held one at a time."""
    test_in, edges = None, _arrange(left)
    if with_splits:
        listed = np.unique(_flat(left.heads, "splits"))
        test_in = _membership(left.heads, listed)
    tiles = _query_tiles(left.num_rows, k, test_in, TILE_ROWS, edges)
    for right, _ in blocks:
        train_in = _membership(right.heads, listed) if with_splits else None
        for _, _, found in tiles:
            found.enter(train_in)
        _search(left, right, tiles, metric, exclude_self)
        for _, _, found in tiles:
            found.leave(right.heads)
    found = _kept(tiles)
    if found is None:
        return pa.Table.from_pylist([], schema=schema)
    s_idx, q_idx, dist, rows = found
    numbers = {"split": listed[s_idx]} if with_splits else {}
    return _rows(left.heads, rows, schema, by, q_idx, np.arange(len(dist)), dist, numbers)


def nearest_under_projections(left, right, names, *, schema, **settled):
    """As above for coded rows under several random projections.

    Row columns ``dims`` and ``n_draws`` give sizes of projections in this group.
    A setting ``(place, key, first, count)`` takes the size at ``place`` (-1: raw
    counts) and the draws of ``key``, and serves the splits ``first`` and on, ``count``
    of them (0: all).  Of several parts, this one does every ``_parts``-th setting.
    Every metric comes from the same products.
    """
    if left.num_rows == 0 or right.num_rows == 0:
        return pa.Table.from_pylist([], schema=schema)
    return nearest_of_blocks_under_projections(left, [(right, names)], schema=schema, **settled)


def nearest_of_blocks_under_projections(
    left: Block, blocks, *, k, metrics, by, settings, parts, draws, prime, schema
):
    """The same over several training blocks, held one at a time."""
    dims, counts = _column(left.heads, "dims")[0].as_py(), _column(left.heads, "n_draws")[0].as_py()
    _arrange(left)
    listed = np.unique(_flat(left.heads, "splits"))
    in_test = _membership(left.heads, listed)
    part, step = 0, 1
    if parts > 1:
        part, step = (_column(left.heads, c)[0].as_py() for c in ("_part", "_parts"))
    tasks = []
    for i in range(part, len(settings), step):
        place, key, first, count = settings[i]
        mine = (listed >= first) & (listed < first + count) if count else np.ones(len(listed), bool)
        tested = np.flatnonzero(in_test[mine].any(axis=0))
        if len(tested):
            # If one split is left, all of these rows belong to it.
            test_in = in_test[mine][:, tested] if mine.sum() > 1 else None
            rows = TILE_ROWS if place < 0 else max(1, min(TILE_ROWS, TILE_VALUES // dims[place]))
            tiles = [_query_tiles(len(tested), k, test_in, rows) for _ in metrics]
            tasks.append((i, mine, tested, rows, tiles))
    for right, names in blocks:
        in_train = _membership(right.heads, listed)
        whole = len(left.at) and len(right.at) and left.whole and right.whole
        alike_first = np.arange(right.num_rows)
        if whole and right.num_rows > TILE_ROWS and right.at.max() < MOST_TERMS:
            alike_first = np.concatenate(_alike(right, TILE_ROWS))
        for i, mine, tested, rows, tiles in tasks:
            trained = in_train[mine].any(axis=0)
            if not trained.any():
                continue
            place, key, _, _ = settings[i]
            train_in = in_train[mine] if mine.sum() > 1 else None
            for each in tiles:
                for _, _, found in each:
                    found.enter(train_in)
            if place >= 0 and whole:
                drawn = drawn_slots(names, dims[place], draws[key][: counts[place]], prime)
                _meet_counts(left, right, tested, alike_first[trained[alike_first]], rows, dims[place], drawn, tiles, metrics)
            else:
                trained = np.flatnonzero(trained)
                drawn = None
                if place >= 0:
                    drawn = drawn_slots(names, dims[place], draws[key][: counts[place]], prime)
                _meet_tiles(left, right, tested, trained, rows, dims[place], drawn, tiles, metrics)
            for each in tiles:
                for _, _, found in each:
                    found.leave(right.heads)
    out = []
    for i, mine, tested, _, tiles in tasks:
        for m, each in enumerate(tiles):
            found = _kept(each)
            if found is None:
                continue
            s_idx, q_idx, dist, rows = found
            numbers = {
                "metric": np.full(len(s_idx), m, dtype=np.int64),
                "setting": np.full(len(s_idx), i, dtype=np.int64),
                "split": listed[mine][s_idx],
            }
            out.append(_rows(left.heads, rows, schema, by, tested[q_idx], np.arange(len(dist)), dist, numbers))
    return pa.concat_tables(out) if out else pa.Table.from_pylist([], schema=schema)


def _meet_tiles(left: Block, right: Block, tested, trained, rows: int, dim: int, drawn, tiles, metrics) -> None:
    """Adds the pairs of the rows ``tested`` and ``trained`` to ``tiles`` (of every metric)."""

    def tile(side, some):
        return side.entries(some) if drawn is None else _Matrix(side.projected(some, dim, drawn))

    kept = drawn is not None and len(tested) * dim <= KEPT_VALUES
    made = [tile(left, tested[lo:hi]) for lo, hi, _ in tiles[0]] if kept else None
    for t_lo, t_hi in _tiles(len(trained), rows):
        others = tile(right, trained[t_lo:t_hi])
        for number, (q_lo, q_hi, _) in enumerate(tiles[0]):
            some = made[number] if kept else tile(left, tested[q_lo:q_hi])
            _meet(some, others, trained[t_lo:t_hi], [each[number][2] for each in tiles], metrics)


def _meet_counts(left: Block, right: Block, tested, trained, rows: int, dim: int, drawn, tiles, metrics) -> None:
    """The same for integers under a projection, in stages; see :mod:`._staged_kernel`.
    Rows that are alike lie together in ``trained``."""
    order = staged.heaviest_first(drawn, right.term_squares(drawn[0].shape[1]), dim)
    drawn = order[drawn[0]], drawn[1]
    kept = len(tested) * dim <= KEPT_VALUES
    made = [left.whole_projected(tested[lo:hi], dim, drawn) for lo, hi, _ in tiles[0]] if kept else None
    for part in _parts(trained, rows, any(found.best is None for _, _, found in tiles[0])):
        others = right.whole_projected(part, dim, drawn)
        for number, (q_lo, q_hi, _) in enumerate(tiles[0]):
            some = made[number] if kept else left.whole_projected(tested[q_lo:q_hi], dim, drawn)
            found = [each[number][2] for each in tiles]
            if found[0].best is None:
                made_now = staged.products(some, others)
                for mine, metric in zip(found, metrics):
                    mine.start([(np.arange(q_hi - q_lo), part, distances(*made_now, metric))])
                continue
            bounds = [np.nextafter(mine.loosest, np.inf) for mine in found]  # of rows in any order
            for mine, metric, near in zip(found, metrics, staged.near(some, others, metrics, bounds, 10 * SNAP)):
                q, t, dots = near
                kept_pairs = mine.of_use(q, part[t], 0.0)
                q, t, dots = q[kept_pairs], t[kept_pairs], dots[kept_pairs]
                dist = _measured(dots, some.squared[q], others.squared[t], metric)
                mine.add(q, part[t], dist)


def _meet(some, others, rows, found, metrics) -> None:
    """Adds the pairs of two tiles, the second of these ``rows``, to what was ``found`` by
    each metric."""
    projected = isinstance(some, _Matrix)
    if projected and metrics == ["cosine"] and found[0].best is not None:
        near = _nearer_directions(some, others, found[0].loosest)
        if near is not None:
            found[0].add(near[0], rows[near[1]], near[2])
            return
    if projected:
        made = some.values @ others.values.T, some.squares, others.squares
    else:
        made = _sparse_products(some, others)
    for mine, metric in zip(found, metrics):
        if mine.best is None:
            dist = distances(*made, metric)
            mine.start([(np.arange(len(dist)), rows, dist)])
        else:
            q, t, dist = _nearer(*made, metric, mine.loosest)
            mine.add(q, rows[t], dist)


# Workers get these functions by value, so they need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
