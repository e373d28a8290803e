"""Exact k-nearest-neighbour join.

A vector table has the columns ``id`` and one of ``terms ARRAY<STRING>, weights
ARRAY<DOUBLE>`` (sparse), ``slots ARRAY<INT>, weights`` (projected) or ``vec
ARRAY<…>`` (dense), plus any grouping columns.  Neighbours are searched inside a
group only.

How it is distributed
---------------------
Each side of each group is cut into blocks of bounded size by a hash of the id,
so a group with a third of all rows becomes many blocks, like any other group.
Every (query block, training block) pair is one cogrouped task unit that keeps
only its k best rows per query; a window merges these short lists.  Row pairs
are never emitted and no side has to fit into one executor.

A group of more than ``MOST_COPIES`` blocks on a side would be copied so often that
the copies grow with the square of its rows.  Its training blocks are written to the
shared folder once instead; a query block reads them there one after the other and
keeps its k best rows throughout, so what is moved and written follows the rows: each
row of either side moves once, however many tasks there are.

Where a group has many blocks, pairs of blocks are pruned first
(:mod:`.pivot_index`): blocks are cut by nearness, and a query meets only blocks
that may hold one of its k nearest rows.  For texts an inverted index of the
blocks (:mod:`.term_index`) gives tighter bounds.

Cross-validation is answered by *one* pass: a row carries the list of splits in
which it is a query (or a training row), the distances of a block pair are
computed once, and the k best are then picked per split.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..sources.materialize import materialize, release
from ._block_kernel import (
    nearest_in_block,
    nearest_in_blocks,
    nearest_of_blocks_under_projections,
    nearest_under_projections,
    pack_rows,
    read_blocks,
    unpack_side,
    unpack_sides,
)
from .pivot_index import PivotIndex
from .projection import PRIME, draw_functions
from .term_index import TermIndex

METRICS = ("cosine", "euclidean")
INDEXES = ("blocks", "pivots", "terms")
MAX_BLOCK_ROWS = 65536  # with the next, bounds the vectors one task holds
MAX_BLOCK_VALUES = 8_000_000
MIN_BLOCK_ROWS = 128  # smaller blocks only add overhead
# Work units wanted even for small groups.  A block is copied once for each block of
# the other side, so blocks are as large as they may be.  Training blocks of a few
# tiles come first, up to their number below, and query blocks make up the rest.
UNITS = 24
TRAIN_SPREAD = 10
SPREAD_ROWS = 4096
# Parts that many settings of a sweep are dealt to, if blocks do not give the units;
# each projects a row once for each of its settings, where more blocks would repeat that.
SETTING_PARTS = 12
# Blocks of a side that bounds on rows and values may ask for while blocks are copied.
MOST_COPIES = 1
# Partitions for each unit that reads blocks, so that few units meet in one; more of
# them, most of which are empty, while they are few in all.
PARTITIONS_A_UNIT = 3
FEW_PARTITIONS = 1000
MOST_A_UNIT = 32

# Training rows of a group from which blocks are pruned; with fewer there are so
# few blocks that building the index costs more than it saves.
PRUNE_FROM = 16384


def _partitions(units: int) -> int:
    return max(PARTITIONS_A_UNIT * units, min(MOST_A_UNIT * units, FEW_PARTITIONS))


def _pieces(n: Column, size: int) -> Column:
    return F.ceil(n / F.lit(float(size)))


def block_count(n_rows: Column, n_values: Column, spread: Column) -> Column:
    """Blocks for one side of a group: enough to keep an average block within
    the row and value bounds, and up to ``spread`` while they stay worth a
    task."""
    return F.greatest(
        _pieces(n_rows, MAX_BLOCK_ROWS),
        _pieces(n_values, MAX_BLOCK_VALUES),
        F.least(spread, _pieces(n_rows, MIN_BLOCK_ROWS)),
        F.lit(1),
    ).cast("int")


def _validated(k: int, metric: str) -> None:
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}, not {metric!r}")
    if k < 1:
        raise ValueError("k must be positive")


def knn_join(
    queries: DataFrame,
    train: DataFrame,
    k: int,
    *,
    metric: str = "cosine",
    by: list[str] | None = None,
    with_splits: bool = False,
    exclude_self: bool = False,
    index: str | None = None,
    block_rows: int | None = None,
) -> DataFrame:
    """``(*by, [split,] query_id, [query_label,] train_id, [label,] distance,
    rank)``.

    The labels are carried over from the side that has them.  With
    ``with_splits`` both sides hold ``splits ARRAY<INT>``: the splits in which
    the row is a query, respectively a training row.  Fewer than k training
    rows give fewer neighbours.  Order and ties are ``(distance, train_id)``.

    ``index`` is "blocks" (none), "pivots" or "terms" (cosine of sparse rows
    without negative weights), the last two with about ``block_rows`` rows in a
    block.  By default pivots are used where a group has ``PRUNE_FROM`` training
    rows, and nothing with splits.  All ways are exact.

    Each input is scanned twice (sizes, then rows): hand in materialized
    tables rather than long plans.
    """
    _validated(k, metric)
    if index not in (None, *INDEXES):
        raise ValueError(f"index must be one of {INDEXES}, not {index!r}")
    by = list(by or [])
    vector = vector_columns(queries)
    extra = ["splits"] if with_splits else []
    q_label = ["label"] if "label" in queries.columns else []
    t_label = ["label"] if "label" in train.columns else []
    if index is None:
        # Distances of texts to a pivot are too alike to prune anything.
        dense = vector == ["vec"] and not with_splits
        pivots = dense and _largest_group(train, by) >= PRUNE_FROM
        index = "pivots" if pivots else "blocks"
    if index != "blocks":
        if with_splits or (index == "terms" and (metric != "cosine" or vector[0] != "terms")):
            raise ValueError(f"index {index!r} does not serve this join")
        sides = (queries, q_label), (train, t_label)
        return _indexed(*sides, k, metric, by, vector, exclude_self, index, block_rows)
    split = ["split"] if with_splits else []
    found = _plain(
        (queries, q_label), (train, t_label), k, metric, by, [*vector, *extra], exclude_self, split
    )
    return top_k(found, k, [*by, *split])


def _plain(left, right, k, metric, by, carried, exclude_self, split) -> DataFrame:
    """Candidates of every block pair."""
    (queries, q_label), (train, t_label) = left, right
    schema = _result_schema(queries, train, by, split)
    settled = dict(
        k=k,
        metric=metric,
        by=by,
        with_splits=bool(split),
        exclude_self=exclude_self,
        schema=to_arrow_schema(schema),
    )
    kernels = partial(nearest_in_block, **settled), partial(nearest_in_blocks, **settled)
    return _met(queries, train, by, F.size(carried[0]), carried, q_label, t_label, 1, kernels, schema)


def _met(queries, train, by, size, carried, q_label, t_label, parts, kernels, schema) -> DataFrame:
    """Candidates of all groups: the blocks of small ones are copied, those of large
    ones are read where they lie."""
    sizes = _sizes(queries, train, by, size)
    if not by:
        large = sizes.select(_is_large().alias("_large")).first()
        kinds = {large["_large"]} if large else {False}
        sides = {kind: (queries, train, sizes) for kind in kinds}
    else:
        sizes = materialize(sizes.withColumn("_large", _is_large()), "sizes")
        kinds = {r["_large"] for r in sizes.select("_large").distinct().collect()} or {False}
        sides = {}
        for kind in kinds:
            mine = sizes.where("_large" if kind else "NOT _large").drop("_large")
            own = (x.join(mine.select(*by), by, "left_semi") if len(kinds) > 1 else x for x in (queries, train))
            sides[kind] = (*own, mine)
    out = []
    for kind, (q, t, mine) in sides.items():
        way = _Streamed if kind else _Pairs
        out.append(way(q, t, by, size, carried, q_label, t_label, parts, mine).run(kernels[kind], schema))
    return out[0] if len(out) == 1 else out[0].union(out[1])


def _sizes(queries, train, by, size) -> DataFrame:
    """``(*by, _q, _t)``: rows and values of both sides of each group."""
    # One row per group (one in all without groups).
    counts = [F.count(F.lit(1)).alias("_n"), F.sum(size).alias("_v")]
    q_sizes, t_sizes = (
        side.groupBy(*by).agg(*counts).select(*by, F.struct("_n", "_v").alias(name))
        for side, name in ((queries, "_q"), (train, "_t"))
    )
    return q_sizes.join(t_sizes, by) if by else q_sizes.crossJoin(t_sizes)


def _is_large() -> Column:
    def bounded(side: str) -> Column:
        return block_count(F.col(f"{side}._n"), F.col(f"{side}._v"), F.lit(1))

    return F.greatest(bounded("_q"), bounded("_t")) > MOST_COPIES


def _largest_group(train: DataFrame, by: list[str]) -> int:
    counts = train.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.max("n")).first()[0] or 0


def _indexed(left, right, k, metric, by, vector, exclude_self, index, block_rows) -> DataFrame:
    keys = by or ["_all"]

    def side(table: DataFrame, label: list[str]) -> DataFrame:
        table = table if by else table.withColumn("_all", F.lit(0))
        return table.select(*keys, "id", *label, *vector)

    queries, train = side(*left), side(*right)
    if index == "terms":
        built = TermIndex(train, keys, block_rows)
    else:
        built = PivotIndex(train, vector, metric, keys, block_rows)
    schema = _result_schema(queries, train, keys, [])

    def plain(wide: DataFrame) -> DataFrame:
        found = _plain((wide, left[1]), (train, right[1]), k, metric, keys, vector, exclude_self, [])
        return found.select(*schema.names)

    found = top_k(built.search(queries, k, schema, exclude_self, plain), k, keys)
    return found if by else found.drop("_all")


def projected_knn_join(
    rows: DataFrame,
    k: int,
    *,
    settings: list[tuple[int, tuple[int, int], int, int]],
    max_draws: list[int],
    metrics: list[str],
    by: list[str] | None = None,
) -> DataFrame:
    """Neighbours over splits under several random projections and metrics, in one
    pass: ``(*by, metric, setting, split, query_id, query_label, train_id, label,
    distance, rank)``; ``metric`` and ``setting`` are positions in their lists.

    ``rows`` is ``(*by, id, label, codes, weights, dims, n_draws, test_in,
    train_in)``: coded sparse vectors, the sizes of projections, and the splits that
    test or train on the row.  A setting ``(place, (seed, key), first, count)`` uses
    the size at ``place`` of ``dims`` (-1: no projection) and the draws of ``key``,
    for ``count`` splits from ``first`` on (0: all).  ``max_draws`` holds the most
    draws of each place.

    Only these rows move, to at most ``SETTING_PARTS`` parts of the settings; they
    are projected where their blocks meet, so hundreds of projections cost no more
    shuffling than one.
    """
    for metric in metrics:
        _validated(k, metric)
    by = list(by or [])

    def side(column: str) -> DataFrame:
        return rows.withColumn("splits", F.col(column)).where(F.size("splits") > 0)

    parts = min(SETTING_PARTS, len(settings))
    queries, train = side("test_in"), side("train_in")
    carried = ["codes", "weights", "dims", "n_draws", "splits"]
    size = F.size("codes")
    schema = _result_schema(queries, train, by, ["metric", "setting", "split"])
    needed = {}
    for place, key, _, _ in settings:
        if place >= 0:
            needed[key] = max(needed.get(key, 0), max_draws[place])
    settled = dict(
        k=k,
        metrics=metrics,
        by=by,
        settings=settings,
        parts=parts,
        draws={key: draw_functions(*key, count) for key, count in needed.items()},
        prime=PRIME,
        schema=to_arrow_schema(schema),
    )
    kernels = (
        partial(nearest_under_projections, **settled),
        partial(nearest_of_blocks_under_projections, **settled | {"parts": 1}),
    )
    found = _met(queries, train, by, size, carried, ["label"], ["label"], parts, kernels, schema)
    return top_k(found, k, [*by, "metric", "setting", "split"])


def vector_columns(table: DataFrame) -> list[str]:
    """The vector columns of a table, whichever form they have."""
    for form in (["vec"], ["terms", "weights"], ["slots", "weights"]):
        if set(form) <= set(table.columns):
            return form
    raise ValueError(f"no vector columns among {table.columns}")


def _result_schema(queries, train, by: list[str], numbers: list[str]) -> T.StructType:
    fields = [(c, queries.schema[c].dataType) for c in by]
    fields += [(c, T.IntegerType()) for c in numbers]
    fields.append(("query_id", queries.schema["id"].dataType))
    if "label" in queries.columns:
        fields.append(("query_label", queries.schema["label"].dataType))
    fields.append(("train_id", train.schema["id"].dataType))
    if "label" in train.columns:
        fields.append(("label", train.schema["label"].dataType))
    fields.append(("distance", T.DoubleType()))
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


def _packed(rows: DataFrame, keys: list[str], named: str | None) -> DataFrame:
    """Rows of a block that lie together as one compressed row, so that a copy for
    each partner block takes a fraction of the space."""
    binary = [T.StructField(n, T.BinaryType()) for n in ("rows", "names")]
    schema = T.StructType([*(rows.schema[c] for c in keys), *binary])
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in schema])
    pack = partial(pack_rows, keys=keys, named=named, schema=to_arrow_schema(schema))

    def run(batches):
        return pack(batches)

    return rows.mapInArrow(run, schema)


def _named(carried: list[str]) -> str | None:
    return next((c for c in ("terms", "codes") if c in carried), None)


def _salt(n: str) -> Column:
    return F.pmod(F.xxhash64("id"), F.col(n)).cast("int")


def _each(n: str) -> Column:
    return F.explode(F.sequence(F.lit(0), F.col(n) - 1))


class _Pairs:
    """Both sides cut into blocks and brought together block by block."""

    def __init__(self, queries, train, by, size, carried, q_label, t_label, parts=1, sizes=None):
        sizes = _sizes(queries, train, by, size) if sizes is None else sizes
        spread = F.least(F.lit(TRAIN_SPREAD), _pieces(F.col("_t._n"), SPREAD_ROWS))
        spread = spread if parts == 1 else F.lit(1)
        blocks = sizes.withColumn("_nt", block_count(F.col("_t._n"), F.col("_t._v"), spread))
        missing = F.ceil(F.lit(UNITS) / F.col("_nt")) if parts == 1 else F.lit(1)
        blocks = blocks.withColumn("_nq", block_count(F.col("_q._n"), F.col("_q._v"), missing))
        # Parts of the work give the units that blocks do not give then.
        units = F.ceil(F.lit(UNITS) / (F.col("_nq") * F.col("_nt")))
        blocks = blocks.withColumn("_parts", F.least(units, F.lit(parts)).cast("int"))
        own = ["_nq", "_nt", "_parts"]
        if by:
            # Written out so that its true size decides whether the joins broadcast it.
            blocks = materialize(blocks.select(*by, *own), "blocks")
            queries, train = queries.join(blocks, by), train.join(blocks, by)
        else:
            both = {c: F.lit(n) for c, n in blocks.select(*own).first().asDict().items()}
            queries, train = queries.withColumns(both), train.withColumns(both)

        self.by = by
        self.named = _named(carried)
        self.key = [*by, "_qb", "_tb"]
        if parts > 1:
            self.key += ["_part", "_parts"]

        def cut(side: DataFrame, own: str, other: str, n_own: str, n_other: str, columns: list[str]):
            keys = [*by, own, n_other, "_parts"]
            packed = _packed(side.withColumn(own, _salt(n_own)).select(*keys, "id", *columns), keys, self.named)
            packed = packed.withColumn(other, _each(n_other))
            if parts > 1:
                packed = packed.withColumn("_part", _each("_parts"))
            return packed.select(*self.key, "rows", "names")

        self.q = cut(queries, "_qb", "_tb", "_nq", "_nt", [*q_label, *carried])
        t = cut(train, "_tb", "_qb", "_nt", "_nq", [*t_label, *carried])
        # New column identities: both sides often come from one table.
        self.t = t.select(*[F.col(c).alias(c) for c in t.columns])

    def run(self, kernel, schema: T.StructType) -> DataFrame:
        keys, named = self.key, self.named
        names_too = "codes" == named
        empty = to_arrow_schema(schema)

        def run(left, right):
            if left.num_rows == 0 or right.num_rows == 0:
                return empty.empty_table()
            left, right, names = unpack_sides(left, right, keys, named)
            return kernel(left, right, names) if names_too else kernel(left, right)

        q, t = self.q.groupBy(*self.key), self.t.groupBy(*self.key)
        return q.cogroup(t).applyInArrow(run, schema)


class _Streamed:
    """Query blocks that read the training blocks of their group, which are written once.
    Units are query blocks and nothing else, so a query row moves once."""

    def __init__(self, queries, train, by, size, carried, q_label, t_label, parts, sizes):
        blocks = sizes.select(
            *by, block_count(F.col("_q._n"), F.col("_q._v"), F.lit(UNITS)).alias("_nq"),
            block_count(F.col("_t._n"), F.col("_t._v"), F.lit(1)).alias("_nt"),
        )
        # A number of the group, which names its folder.
        blocks = materialize(blocks.withColumn("_group", F.monotonically_increasing_id()), "blocks")
        units = blocks.agg(F.sum("_nq")).first()[0]
        self.named, self.by = _named(carried), by
        own = ["_nq", "_group", "_nt"]
        if by:
            queries, train = queries.join(blocks.select(*by, *own), by), train.join(blocks.select(*by, *own), by)
        else:
            all_ = {c: F.lit(n) for c, n in blocks.select(*own).first().asDict().items()}
            queries, train = queries.withColumns(all_), train.withColumns(all_)
        keys = ["_group", "_tb"]
        rows = train.withColumn("_tb", _salt("_nt")).select(*keys, "id", *t_label, *carried)
        rows = _packed(rows, keys, self.named).repartition(*keys)
        self.t = materialize(rows, "train", by=keys)
        release(self.t.sparkSession)

        self.key = [*by, "_qb", "_group", "_nt"]
        rows = queries.withColumn("_qb", _salt("_nq")).select(*self.key, "id", *q_label, *carried)
        rows = _packed(rows, self.key, self.named)
        self.q = rows.repartition(_partitions(units), *self.key)

    def run(self, kernel, schema: T.StructType) -> DataFrame:
        keys, named, folder = self.by, self.named, self.t.scratch_path

        def run(left):
            group, blocks = (left.column(c)[0].as_py() for c in ("_group", "_nt"))
            block, names = unpack_side(left, keys, named)
            mine = (f"{folder}/_group={group}/_tb={b}" for b in range(blocks))
            return kernel(block, read_blocks(mine, named, names))

        return self.q.groupBy(*self.key).applyInArrow(run, schema)


def top_k(candidates: DataFrame, k: int, by: list[str]) -> DataFrame:
    """Merge per-block lists: the k first by (distance, train_id) per query."""
    order = Window.partitionBy(*by, "query_id").orderBy("distance", "train_id")
    return candidates.withColumn("rank", F.row_number().over(order)).where(
        F.col("rank") <= k
    )


def require_k(train: DataFrame, k: int) -> None:
    """The base algorithm's check: asking for more neighbours than there are
    training rows is an error there (elsewhere k is clamped)."""
    if train.select(F.lit(1)).limit(k).count() < k:
        raise ValueError(f"k = {k} exceeds the number of training rows")


def predict_nearest(neighbours: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Baseline classifier: the label of the single nearest row."""
    return neighbours.where(F.col("rank") == 1).select(
        *(by or []), "query_id", F.col("label").cast("int").alias("prediction")
    )
