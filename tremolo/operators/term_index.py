"""Exact cosine neighbours of sparse texts through an inverted index of blocks.

The training rows lie in the blocks of a pivot index.  The inverted index says, for each
term, in which blocks it occurs and the greatest weight (of rows of unit length) it has
there.  A query's similarity to any row of a block is then at most the sum, over the
terms they share, of the query's weight times the block's greatest weight.

1. A query first searches the block with the greatest bound by its rarest terms.  The
   k-th similarity found there is a threshold.
2. Its terms are put in order, those of most blocks first.  As long as their greatest
   possible contributions (the query's weight times the term's greatest weight anywhere)
   sum to less than the threshold they can be left out: a row that shares no other term
   cannot reach it.  The others are looked up in the index.
3. Blocks whose bound reaches the threshold are searched; no others can hold a nearer row.

A query whose terms name too many blocks meets all rows in the plain join instead, so
the copies and looked-up entries of a query are bounded.

Rows that share no term with a query have the distance 1.  If fewer than k rows share a
term with it, the answer is filled with rows of the smallest ids, as all of these tie.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..sources.materialize import materialize
from ._block_kernel import nearest_in_block
from .pivot_index import MOST_TARGETS, PivotIndex, _units

PROBES = 8  # rarest terms of a query that choose its first block
MOST_PROBED = 64  # blocks of a term that helps to choose it
MOST_ENTRIES = 512  # of the index, looked up for a query
#: Similarities are compared with this tolerance, which exceeds their rounding.
SLACK = 1e-9


def _unit_terms(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``(*keys, term, w)`` of rows scaled to unit length; zero weights are left out and
    negative ones are an error, as they void the bounds."""
    norm = F.sqrt(F.aggregate("weights", F.lit(0.0), lambda s, w: s + w * w))
    pairs = F.arrays_zip(F.col("terms").alias("term"), F.col("weights").alias("w"))
    # Two steps, as what is beside an explode is computed for each of its rows.
    flat = rows.select(*keys, norm.alias("_norm"), pairs.alias("_pairs")).select(
        *keys, "_norm", F.explode("_pairs").alias("_p")
    )
    weight = F.when(F.col("_p.w") >= 0, F.col("_p.w")).otherwise(
        F.raise_error(F.lit("the term index needs weights that are not negative"))
    )
    named = flat.select(*keys, F.col("_p.term").alias("term"), weight.alias("_w"), "_norm")
    return named.where("_w <> 0").select(*keys, "term", (F.col("_w") / F.col("_norm")).alias("w"))


class TermIndex(PivotIndex):
    """The index of a training table ``(*by, id, [label,] terms, weights)`` for the cosine
    distance; a row holds no term twice."""

    def __init__(self, train: DataFrame, by: list[str], block_rows: int | None = None):
        super().__init__(train, ["terms", "weights"], "cosine", by, block_rows)
        heads = _unit_terms(self.rows, [*by, "block"]).groupBy(*by, "term", "block").agg(F.max("w").alias("most"))
        entry = F.collect_list(F.struct("block", "most")).alias("blocks")
        #: One row per term: its blocks, and its greatest weight anywhere.
        self.terms = materialize(
            heads.groupBy(*by, "term").agg(entry, F.max("most").alias("top"), F.count(F.lit(1)).alias("n_blocks")),
            "terms",
        )

    def _nearest(self, sent: DataFrame, k: int, exclude_self: bool, schema: T.StructType) -> DataFrame:
        """The k best rows of the block that each row of ``sent`` names."""
        kernel = partial(
            nearest_in_block, k=k, metric="cosine", by=self.by, with_splits=False,
            exclude_self=exclude_self, schema=to_arrow_schema(schema),
        )
        left, right = self._met(sent)
        return _units(left, right, [*self.by, "block", "_part"], kernel, schema)

    def asked(self, queries: DataFrame) -> DataFrame:
        """``(*by, id, term, w, top, n_blocks, place)``: the queries' terms that the index
        has, the rarest first."""
        known = _unit_terms(queries, [*self.by, "id"]).join(self.terms.drop("blocks"), [*self.by, "term"])
        rare = Window.partitionBy(*self.by, "id").orderBy("n_blocks", "term")
        return materialize(known.withColumn("place", F.row_number().over(rare)), "asked")

    def _bounds(self, asked: DataFrame) -> DataFrame:
        """``(*by, id, block, bound)`` over the terms of ``asked``."""
        found = asked.join(self.terms.select(*self.by, "term", "blocks"), [*self.by, "term"])
        each = found.select(*self.by, "id", "w", F.inline("blocks"))
        return each.groupBy(*self.by, "id", "block").agg(F.sum(F.col("w") * F.col("most")).alias("bound"))

    def homes(self, asked: DataFrame) -> DataFrame:
        """``(*by, id, block)``: the block of the greatest bound by the rarest terms;
        none for a query whose terms are all common."""
        best = F.max(F.struct("bound", (-F.col("block")).alias("first")))
        rare = (F.col("place") <= PROBES) & (F.col("n_blocks") <= MOST_PROBED)
        chosen = self._bounds(asked.where(rare)).groupBy(*self.by, "id").agg(best.alias("_b"))
        return chosen.select(*self.by, "id", (-F.col("_b.first")).alias("block"))

    def rated(self, asked: DataFrame, floors: DataFrame) -> DataFrame:
        """``asked`` with the query's ``floor``, and the most that the term and all more
        common ones may add to a similarity (``left_out``)."""
        common = Window.partitionBy(*self.by, "id").orderBy(F.col("place").desc())
        summed = F.sum(F.col("w") * F.col("top")).over(common.rowsBetween(Window.unboundedPreceding, 0))
        floor = F.coalesce("floor", F.lit(0.0)) - SLACK
        rated = asked.join(floors, [*self.by, "id"], "left").withColumn("floor", floor).withColumn("left_out", summed)
        return materialize(rated, "rated")

    def targets(self, asked: DataFrame, homes: DataFrame, floors: DataFrame) -> DataFrame:
        """``(*by, id, block)``: the blocks, but its home, that may hold a row whose
        similarity reaches the query's ``floor``."""
        return self._targets(self.rated(asked, floors), homes)

    def _targets(self, rated: DataFrame, homes: DataFrame) -> DataFrame:
        # What the terms that are left out may add to any bound.
        rest = rated.where(F.col("left_out") < F.col("floor")).groupBy(*self.by, "id").agg(F.max("left_out").alias("rest"))
        bounds = self._bounds(rated.where(F.col("left_out") >= F.col("floor")))
        known = rated.groupBy(*self.by, "id").agg(F.max("floor").alias("floor"))
        full = bounds.join(known.join(rest, [*self.by, "id"], "left"), [*self.by, "id"])
        kept = full.where(F.col("bound") + F.coalesce("rest", F.lit(0.0)) >= F.col("floor"))
        return kept.select(*self.by, "id", "block").join(homes, [*self.by, "id", "block"], "left_anti")

    def _split(self, rated: DataFrame, homes: DataFrame) -> tuple[DataFrame, DataFrame]:
        """``(*by, id, block)`` as above, and the ``(*by, id)`` of the queries that have
        too many entries or blocks for that.  An index of few blocks serves all."""
        keys = [*self.by, "id"]
        entries = F.sum(F.when(F.col("left_out") >= F.col("floor"), F.col("n_blocks")))
        blocks = self.rows.groupBy(*self.by).agg(F.count_distinct("block").alias("blocks"))
        counted = rated.groupBy(*keys).agg(entries.alias("n")).join(materialize(blocks, "block-counts"), self.by)
        over = (F.col("n") > MOST_ENTRIES) & (F.col("blocks") > MOST_TARGETS)
        many = materialize(counted.where(over).select(*keys), "many")
        found = materialize(self._targets(rated.join(many, keys, "left_anti"), homes), "targets")
        asked = found.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > MOST_TARGETS).select(*keys)
        wide = materialize(many.union(asked), "wide")
        return found.join(wide, keys, "left_anti"), wide

    def search(self, queries: DataFrame, k: int, schema: T.StructType, exclude_self: bool, plain) -> DataFrame:
        """Candidates that hold the k nearest rows of every query, each once."""
        keys = [*self.by, "id"]
        asked = self.asked(queries)
        homes = materialize(self.homes(asked), "homes")
        first = materialize(self._nearest(queries.join(homes, keys), k, exclude_self, schema), "first")
        # The k-th similarity of the home, where it has k rows.
        lists = first.groupBy(*self.by, F.col("query_id").alias("id")).agg(
            F.count(F.lit(1)).alias("n"), (1.0 - F.max("distance")).alias("floor")
        )
        floors = materialize(lists.where(F.col("n") == k).select(*keys, "floor"), "floors")
        targets, wide = self._split(self.rated(asked, floors), homes)
        found = first.union(self._nearest(queries.join(targets, keys), k, exclude_self, schema))
        if wide.limit(1).count():
            found = found.union(plain(queries.join(wide, keys, "left_semi")))
        found = found.union(self._padding(queries, floors, k, exclude_self, schema))
        names = [c for c in schema.names if c != "distance"]
        return found.groupBy(*names).agg(F.min("distance").alias("distance")).select(*schema.names)

    def _padding(
        self, queries: DataFrame, floors: DataFrame, k: int, exclude_self: bool, schema: T.StructType
    ) -> DataFrame:
        """The rows of the smallest ids at distance 1, for queries whose home did not have k
        rows that share a term.  A row that does share one is also found at less."""
        t_label = ["label"] if "label" in self.rows.columns else []
        q_label = ["label"] if "label" in queries.columns else []
        row = F.struct(F.col("id").alias("train_id"), *t_label)
        order = Window.partitionBy(*self.by).orderBy("id")
        first = self.rows.withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") <= k + 1)
        least = first.groupBy(*self.by).agg(F.collect_list(row).alias("_rows"))  # k + 1 rows of a group
        short = queries.join(floors.where(F.col("floor") > SLACK), [*self.by, "id"], "left_anti")
        filled = short.join(materialize(least, "least"), self.by).select(
            *self.by, F.col("id").alias("query_id"), *(F.col(c).alias("query_label") for c in q_label), F.inline("_rows")
        )
        if exclude_self:
            filled = filled.where(F.col("query_id") != F.col("train_id"))
        return filled.withColumn("distance", F.lit(1.0)).select(*schema.names)
