"""The pruned neighbour join: exact, and each query meets few blocks of clustered rows."""

from __future__ import annotations

import numpy as np
import pytest

from tests.test_neighbors import brute, collected, frame, matrix, same
from tremolo.operators import _block_kernel, neighbors, pivot_index


@pytest.fixture
def small_index(monkeypatch):
    monkeypatch.setattr(pivot_index, "BLOCK_ROWS", 5)
    monkeypatch.setattr(pivot_index, "QUERY_ROWS", 6)
    monkeypatch.setattr(pivot_index, "MAX_PIVOTS", 4)


def clustered(n_clusters, size, width, seed, spread=0.05):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 10, (n_clusters, width))
    return np.concatenate([c + rng.normal(0, spread, (size, width)) for c in centres])


@pytest.mark.parametrize("form", ["terms", "slots", "vec"])
@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
def test_equals_brute_force(spark, small_index, form, metric):
    m = matrix(60, 20, 1, sparse=0.3)
    m[7] = 0  # two zero vectors, and copies of many rows
    m[40:50] = m[11]
    df = frame(spark, m, form)
    near = neighbors.knn_join(df.where("id < 20"), df.where("id >= 2"), 5, metric=metric, index="pivots")
    same(collected(near), sorted(brute(m, range(20), range(2, 60), 5, metric)))


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
def test_clusters_equal_brute_force(spark, small_index, metric):
    m = clustered(6, 12, 4, 3)
    df = frame(spark, m, "vec")
    near = neighbors.knn_join(df, df, 4, metric=metric, exclude_self=True, index="pivots")
    want = []
    for q in range(len(m)):
        want += brute(m, [q], [t for t in range(len(m)) if t != q], 4, metric)
    same(collected(near), sorted(want))


def test_groups_a_hot_one_and_few_rows(spark, small_index):
    m = matrix(70, 12, 5)

    def group(i):
        return "hot" if i % 6 else f"g{i % 4}"

    df = frame(spark, m, "terms", g=group)
    near = neighbors.knn_join(df.where("id % 5 = 0"), df.where("id % 5 <> 0"), 9, by=["g"], index="pivots")
    want = []
    for name in {group(i) for i in range(70)}:
        ids = [i for i in range(70) if group(i) == name]
        queries, train = [i for i in ids if i % 5 == 0], [i for i in ids if i % 5]
        want += [(name, *row) for row in brute(m, queries, train, 9, "cosine")]
    same(collected(near, "g"), sorted(want))


def test_the_index_is_used_for_large_groups(spark, small_index, monkeypatch):
    m = matrix(30, 10, 6)
    df = frame(spark, m, "vec")
    built = []
    whole = neighbors._indexed

    def noted(*args):
        built.append(args)
        return whole(*args)

    monkeypatch.setattr(neighbors, "_indexed", noted)
    neighbors.knn_join(df, df, 3)
    assert not built
    monkeypatch.setattr(neighbors, "PRUNE_FROM", 20)
    near = neighbors.knn_join(df, df, 3)
    assert built
    same(collected(near), sorted(brute(m, range(30), range(30), 3, "cosine")))


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
def test_copies_per_query_do_not_grow_with_clustered_rows(spark, monkeypatch, metric):
    """Four times the rows in four times the clusters: four times the blocks, but a
    query is still sent to about as many."""
    monkeypatch.setattr(pivot_index, "BLOCK_ROWS", 10)
    copies, blocks = [], []
    for n_clusters in (10, 40):
        m = clustered(n_clusters, 20, 16, 2, spread=0.01)
        df = frame(spark, m, "vec").drop("label").selectExpr("0 AS g", "id", "vec")
        index = pivot_index.PivotIndex(df, ["vec"], metric, ["g"])
        sent = index.routed(df, 3).selectExpr("avg(size(targets))").first()[0]
        copies.append(sent)
        blocks.append(index.rows.select("block").distinct().count())
    assert blocks[1] > 3 * blocks[0]
    assert copies[1] < 0.2 * blocks[1] and copies[1] < 2.5 * max(copies[0], 1)


def test_rows_not_pivots_are_cut_once(spark, small_index):
    """Training rows lie in one block each, which is of bounded size."""
    m = np.concatenate([matrix(40, 6, 8), np.ones((40, 6))])
    df = frame(spark, m, "vec").drop("label").selectExpr("0 AS g", "id", "vec")
    rows = pivot_index.PivotIndex(df, ["vec"], "euclidean", ["g"]).rows
    sizes = [r["count"] for r in rows.groupBy("block").count().collect()]
    assert sum(sizes) == 80 and max(sizes) <= 4 * pivot_index.BLOCK_ROWS


@pytest.mark.parametrize("index", ["blocks", "pivots"])
def test_components_that_are_not_finite_are_an_error(spark, small_index, index):
    m = matrix(30, 5, 9)
    m[4, 2] = np.nan
    df = frame(spark, m, "vec")
    for metric in neighbors.METRICS:
        with pytest.raises(Exception, match="finite"):
            neighbors.knn_join(df, df, 2, metric=metric, index=index).collect()


def test_best_per_row_orders_ties_by_column():
    rng = np.random.default_rng(0)
    for n, width, k in ((5, 3, 7), (30, 100, 7), (4, 28, 7), (3, 0, 2), (6, 50, 1)):
        dist = rng.integers(0, 5, (n, width)).astype(float)
        dist[rng.random((n, width)) < 0.1] = np.inf
        rows, columns = _block_kernel.best_per_row(dist, k)
        want = np.argsort(dist, axis=1, kind="stable")[:, :k]
        assert rows.tolist() == np.repeat(np.arange(n), min(k, width)).tolist()
        assert columns.tolist() == want.reshape(-1).tolist()


def test_tiny_distances_are_not_zero(spark):
    """Cosine distances between 1e-12 and 5e-11 stay apart from copies."""
    m = np.array([[1.0, 0.0], [1.0, 6e-6], [1.0, 0.0]])
    df = frame(spark, m, "vec")
    near = neighbors.knn_join(df.where("id = 0"), df.where("id > 0"), 2)
    got = collected(near)
    assert [(r[1], r[2]) for r in sorted(got, key=lambda r: r[2])] == [(2, 1), (1, 2)]
    assert 1e-11 < max(r[-1] for r in got) < 5e-11


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
def test_rows_without_clusters_are_not_copied_to_every_block(spark, small_index, monkeypatch, metric):
    """A query that too few blocks can be left out for meets all rows in the plain join."""
    monkeypatch.setattr(pivot_index, "MOST_TARGETS", 2)
    m = matrix(80, 12, 10)
    df = frame(spark, m, "vec")
    index = pivot_index.PivotIndex(df.selectExpr("0 AS g", "id", "vec"), ["vec"], metric, ["g"])
    routed = index.routed(df.selectExpr("0 AS g", "id", "vec"), 3)
    assert routed.where("targets IS NULL").count() > 0
    assert routed.where("size(targets) > 2").count() == 0
    near = neighbors.knn_join(df, df, 3, metric=metric, index="pivots", exclude_self=True)
    want = []
    for q in range(80):
        want += brute(m, [q], [t for t in range(80) if t != q], 3, metric)
    same(collected(near), sorted(want))


def test_pivots_do_not_go_to_every_block(spark, small_index, monkeypatch):
    """They go to parts of the queries: with small blocks, a copy for each block would be
    more than the rows themselves."""
    monkeypatch.setattr(pivot_index, "MAX_PIVOTS", 40)
    monkeypatch.setattr(pivot_index, "QUERY_ROWS", 100)
    met, whole = [], pivot_index._units
    monkeypatch.setattr(pivot_index, "_units", lambda left, right, *args: met.append(right) or whole(left, right, *args))
    rng = np.random.default_rng(31)
    rows = [(0, i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(200, 3)))]
    df = spark.createDataFrame(rows, "g INT, id BIGINT, vec ARRAY<DOUBLE>")
    index = pivot_index.PivotIndex(df, ["vec"], "euclidean", ["g"])
    pivots = index.pivots.count()
    met.clear()
    assert index.routed(df, 3).count() == 200
    beside = [right.count() for right in met if "pivot" in right.columns]
    assert pivots > 5 and sum(beside) <= 2 * pivots * -(-200 // pivot_index.QUERY_ROWS)
