"""Exact nearest neighbours without meeting all blocks: a pivot index.

Some training rows of a group, drawn by a hash of the id, are its *pivots*.  Every
training row belongs to its nearest pivot, and the rows of a pivot are cut into *rings*
by their distance to it, and rings into blocks of bounded size.  A ring keeps the least
and greatest distance to the pivot and the least and greatest length of its rows.

A query first searches one block, its home: a ring of its nearest pivot.  The k-th
distance found there bounds the k-th distance of the answer, and by the triangle
inequality a ring can only matter if the query's distance to its pivot (or the query's
length) lies within that bound of the ring's range.  The query is then sent to the blocks
of these rings alone; training rows are never copied, except to part the queries of a
block that too many of them ask for.  On rows without any clusters every ring matters, and
each query meets every block, as in the plain block join.

Cosine distances go through the chord between unit vectors, ``sqrt(2 * distance)``, which
satisfies the triangle inequality.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..sources.materialize import materialize
from ._block_kernel import nearest_in_block
from ._pivot_kernel import SUB_BITS, locate, route, search_home

MAX_PIVOTS = 256  # of one group: bounds the work per row and the rows sent to each block
RINGS = 16  # of one pivot, at most
BLOCK_ROWS = 2048  # of one block, about
BLOCK_VALUES = 4_000_000
QUERY_ROWS = 4096  # queries one block answers in one task
# Blocks a query is copied to at most; one that would need more meets all rows in the
# plain join, whose copies do not depend on what can be pruned.
MOST_TARGETS = 32


def _pieces(n: Column, size: int) -> Column:
    return F.ceil(n / F.lit(float(size))).cast("int")


def _bounded(vector: list[str], rows: int) -> Column:
    """In how many pieces to cut what is aggregated, by rows and by values."""
    values = _pieces(F.sum(F.size(vector[0])), BLOCK_VALUES)
    return F.greatest(_pieces(F.count(F.lit(1)), rows), values, F.lit(1))


def _units(left: DataFrame, right: DataFrame, key: list[str], kernel, schema: T.StructType):
    def run(a, b):
        return kernel(a, b)

    # New column identities: both sides often come from one table.
    right = right.select(*[F.col(c).alias(c) for c in right.columns])
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(run, schema)


def _part(id_: str, pieces: str) -> Column:
    return F.pmod(F.xxhash64(F.lit("part"), F.col(id_)), F.col(pieces).cast("long")).cast("int")


def _numbers(pieces: str) -> Column:
    return F.explode(F.sequence(F.lit(0), F.col(pieces) - 1))


def _with(schema: T.StructType, **kinds: T.DataType) -> T.StructType:
    return T.StructType([*schema.fields, *(T.StructField(n, t) for n, t in kinds.items())])


class PivotIndex:
    """The index of a training table ``(*by, id, [label,] vector)``; ``rows`` are its
    blocks and ``pivots`` the pivots with their rings."""

    def __init__(
        self, train: DataFrame, vector: list[str], metric: str, by: list[str], block_rows: int | None = None
    ):
        self.vector, self.metric, self.by = vector, metric, by
        self.block_rows = block_rows or BLOCK_ROWS
        sizes = train.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
        sizes = materialize(sizes.withColumn("_pivots", F.least(_pieces(F.col("_n"), self.block_rows), F.lit(MAX_PIVOTS))), "sizes")
        first = Window.partitionBy(*by).orderBy(F.xxhash64(F.lit("pivot"), "id"), "id")
        drawn = train.select(*by, *vector, F.row_number().over(first).alias("_rn")).where(
            F.col("_rn") <= MAX_PIVOTS
        )
        pivots = materialize(
            drawn.join(sizes, by).where(F.col("_rn") <= F.col("_pivots"))
            .select(*by, (F.col("_rn") - 1).alias("pivot"), *vector),
            "pivots",
        )
        located = materialize(self._located(train, pivots), "located")
        rows, rings = self._cut(located)
        listed = rings.groupBy(*by, "pivot").agg(
            F.sort_array(F.collect_list(F.struct("ring", "subs", "n", "low", "high", "short", "long"))).alias("rings")
        )
        #: One row per pivot that has rows: at most MAX_PIVOTS of a group.
        self.pivots = materialize(pivots.join(listed, [*by, "pivot"]), "pivots")
        self.rows = materialize(rows, "blocks")

    def _located(self, rows: DataFrame, pivots: DataFrame) -> DataFrame:
        """Rows with ``pivot, gap, length``."""
        schema = _with(rows.schema, pivot=T.IntegerType(), gap=T.DoubleType(), length=T.DoubleType())
        return self._beside(rows, pivots, partial(locate, metric=self.metric, schema=to_arrow_schema(schema)), schema)

    def _beside(self, rows: DataFrame, pivots: DataFrame, kernel, schema: T.StructType) -> DataFrame:
        """Each part of a group meets the pivots of the group, which are copied once for
        ``QUERY_ROWS`` rows."""
        n = _bounded(self.vector, QUERY_ROWS).alias("_parts")
        parts = materialize(rows.groupBy(*self.by).agg(n), "parts")
        left = rows.join(parts, self.by).withColumn("_part", _part("id", "_parts")).drop("_parts")
        right = pivots.join(parts, self.by).select(*pivots.columns, _numbers("_parts").alias("_part"))
        return _units(left, right, [*self.by, "_part"], kernel, schema)

    def _cut(self, located: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The rows with their block, and the rings.  Ring borders are approximate
        quantiles; rings that are larger, as of many equal rows, have more blocks."""
        cell = [*self.by, "pivot"]
        shares = F.array(*[F.lit(i / RINGS) for i in range(1, RINGS)])
        borders = located.groupBy(*cell).agg(
            F.percentile_approx("gap", shares, F.lit(1000)).alias("_borders"),
            F.least(_pieces(F.count(F.lit(1)), self.block_rows), F.lit(RINGS)).alias("_rings"),
        )
        below = F.size(F.filter("_borders", lambda b: b < F.col("gap")))
        ring = F.floor(below * F.col("_rings") / RINGS).cast("int")
        ringed = located.join(materialize(borders, "borders"), cell).withColumn("ring", ring).drop("_borders", "_rings")
        rings = materialize(
            ringed.groupBy(*cell, "ring").agg(
                _bounded(self.vector, self.block_rows).alias("subs"),
                F.count(F.lit(1)).alias("n"),
                F.min("gap").alias("low"), F.max("gap").alias("high"),
                F.min("length").alias("short"), F.max("length").alias("long"),
            ),
            "rings",
        )
        parted = ringed.join(rings.select(*cell, "ring", "subs"), [*cell, "ring"])
        block = _code("pivot", "ring", _part("id", "subs"))
        kept = [c for c in located.columns if c not in ("pivot", "gap", "length")]
        return parted.select(*kept, block.alias("block")), rings

    def _homes(self, queries: DataFrame, k: int) -> DataFrame:
        """Queries with the code of their home block: of the rings of the nearest pivot
        that have k rows in a block, the one whose range is nearest to the query."""
        located = self._located(queries, self.pivots.drop("rings"))
        joined = located.join(self.pivots.select(*self.by, "pivot", "rings"), [*self.by, "pivot"])

        def rated(ring: Column) -> Column:
            miss = F.greatest(ring["low"] - F.col("gap"), F.col("gap") - ring["high"], F.lit(0.0))
            few = ring["n"] < 2 * k * ring["subs"]
            return F.struct(few.alias("few"), miss.alias("miss"), ring["ring"].alias("ring"), ring["subs"].alias("subs"))

        chosen = joined.withColumn("_home", F.array_min(F.transform("rings", rated)))
        chosen = chosen.withColumns({"ring": F.col("_home.ring"), "subs": F.col("_home.subs")})
        block = _code("pivot", "ring", _part("id", "subs"))
        return chosen.select(*queries.columns, block.alias("block"))

    def _met(self, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Queries with a block each, and that block's rows, both with the number of the
        part of a block that many queries ask for."""
        key = [*self.by, "block"]
        asked = materialize(queries.groupBy(*key).agg(_bounded(self.vector, QUERY_ROWS).alias("_parts")), "asked")
        left = queries.join(asked, key).withColumn("_part", _part("id", "_parts")).drop("_parts")
        right = self.rows.join(asked, key).withColumn("_part", _numbers("_parts")).drop("_parts")
        return left, right

    def routed(self, queries: DataFrame, k: int, exclude_self: bool = False) -> DataFrame:
        """Queries with ``near_id, [near_label,] near_distance`` of the k nearest rows of
        their home, and ``targets``: the other blocks that may hold nearer ones (NULL if
        these are more than ``MOST_TARGETS``)."""
        left, right = self._met(materialize(self._homes(queries, k), "homes"))
        label = {"near_label": T.ArrayType(self.rows.schema["label"].dataType)} if "label" in self.rows.columns else {}
        near = dict(near_id=T.ArrayType(self.rows.schema["id"].dataType), **label, near_distance=T.ArrayType(T.DoubleType()))
        schema = _with(queries.schema, block=T.LongType(), **near)
        kernel = partial(
            search_home, k=k, metric=self.metric, exclude_self=exclude_self, schema=to_arrow_schema(schema)
        )
        searched = materialize(_units(left, right, [*self.by, "block", "_part"], kernel, schema), "searched")
        schema = _with(queries.schema, targets=T.ArrayType(T.LongType()), **near)
        kernel = partial(
            route, k=k, metric=self.metric, ring_count=RINGS, most=MOST_TARGETS, schema=to_arrow_schema(schema)
        )
        return materialize(self._beside(searched, self.pivots, kernel, schema), "routed")

    def search(self, queries: DataFrame, k: int, schema: T.StructType, exclude_self: bool, plain) -> DataFrame:
        """Candidates ``(*by, query_id, [query_label,] train_id, [label,] distance)``,
        which hold the k nearest rows of every query.  ``plain`` finds those of queries
        for which too few blocks can be left out."""
        every = self.routed(queries, k, exclude_self)
        wide, routed = every.where("targets IS NULL"), every.where("targets IS NOT NULL")
        q_label = ["label"] if "label" in queries.columns else []
        t_label = ["label"] if "label" in self.rows.columns else []
        near = F.inline(F.arrays_zip("near_id", *(f"near_{c}" for c in t_label), "near_distance"))
        names = ["query_id", *(["query_label"] if q_label else []), "train_id", *t_label, "distance"]
        home = routed.select(*self.by, "id", *q_label, near).toDF(*self.by, *names)
        sent = routed.select(*queries.columns, F.explode("targets").alias("block"))
        kernel = partial(
            nearest_in_block, k=k, metric=self.metric, by=self.by, with_splits=False,
            exclude_self=exclude_self, schema=to_arrow_schema(schema),
        )
        left, right = self._met(sent)
        away = _units(left, right, [*self.by, "block", "_part"], kernel, schema)
        found = home.select(*schema.names).union(away)
        return found.union(plain(wide.select(*queries.columns))) if wide.limit(1).count() else found


def _code(pivot: str, ring: str, sub: Column) -> Column:
    first = F.col(pivot).cast("long") * RINGS + F.col(ring)
    return F.shiftleft(first, SUB_BITS) + sub
