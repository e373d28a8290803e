"""Connected components with DataFrame joins (large star, small star)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.materialize import materialize


def _mark(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(
        F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))
    ).first()
    return int(row[0]), int(row[1] or 0)


def _step(pairs: DataFrame, minima: DataFrame) -> DataFrame:
    """Point every ``hi`` at the minimum known for its ``at``."""
    return (
        pairs.join(minima, "at")
        .where(F.col("hi") > F.col("least"))
        .select("hi", F.col("least").alias("lo"))
        .distinct()
    )


def components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """``(node, component)`` of every node of an undirected edge list; the
    component is its smallest node.  Null ends and self loops are ignored and
    nodes without edges are not returned.

    Each round replaces edges by stars around smaller nodes, so the number of
    rounds is logarithmic and the number of edges never grows.  A node with very
    many edges is only ever the key of a partial aggregate or one side of a
    shuffle join with one row on the other side, which adaptive execution splits.
    Minima are written first: that join then has two plain exchanges.
    """
    edges = materialize(
        edges.where(F.col(left) != F.col(right))
        .select(F.greatest(left, right).alias("hi"), F.least(left, right).alias("lo"))
        .distinct(),
        "edges",
    )
    before, now = None, _mark(edges)
    while now[0] and now != before:
        both = edges.select("hi", "lo").union(edges.select(F.col("lo"), F.col("hi")))
        minima = materialize(
            both.groupBy(F.col("hi").alias("at")).agg(F.min("lo").alias("near"))
            .select("at", F.least("at", "near").alias("least")),
            "minima",
        )
        # Large star: the larger neighbours of a node point at its minimum.
        large = materialize(_step(edges.select("hi", F.col("lo").alias("at")), minima), "large")
        minima = materialize(
            large.groupBy(F.col("hi").alias("at")).agg(F.min("lo").alias("least")), "minima"
        )
        # Small star: a node and its smaller neighbours point at the smallest.
        pairs = large.select(F.col("lo").alias("hi"), F.col("hi").alias("at")).union(
            large.select("hi", F.col("hi").alias("at"))
        )
        edges = materialize(_step(pairs, minima), "small")
        before, now = now, _mark(edges)
    stars = edges.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
    return stars.union(edges.select(F.col("lo"), F.col("lo")).distinct())
