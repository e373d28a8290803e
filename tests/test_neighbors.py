"""The neighbour join against brute force, in every vector form."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tremolo.operators import _block_kernel, _sparse_kernel, _staged_kernel, neighbors, projection


@pytest.fixture
def small_blocks(monkeypatch):
    """Many blocks even for few rows."""
    monkeypatch.setattr(neighbors, "MAX_BLOCK_ROWS", 7)
    monkeypatch.setattr(neighbors, "MIN_BLOCK_ROWS", 3)


def matrix(n, width, seed, sparse=0.5):
    rng = np.random.default_rng(seed)
    m = rng.integers(0, 4, size=(n, width)) * (rng.random((n, width)) < sparse)
    m[0] = 0  # a zero vector
    m[3] = m[2]  # an exact copy
    return m.astype(float)


def frame(spark, m, form, **extra):
    rows = []
    for i, v in enumerate(m):
        nz = np.flatnonzero(v)
        row = {"id": i, "label": int(i % 3 == 0)}
        if form == "vec":
            row["vec"] = [float(x) for x in v]
        elif form == "terms":
            row["terms"] = [f"t{j}" for j in nz]
            row["weights"] = [float(v[j]) for j in nz]
        else:  # every slot in two halves
            row["slots"] = [int(j) for j in nz] * 2
            row["weights"] = [float(v[j]) / 2 for j in nz] * 2
        row |= {k: f(i) for k, f in extra.items()}
        rows.append(row)
    kinds = {
        "id": "BIGINT", "label": "INT", "vec": "ARRAY<DOUBLE>", "terms": "ARRAY<STRING>",
        "weights": "ARRAY<DOUBLE>", "slots": "ARRAY<INT>", "g": "STRING",
        "splits": "ARRAY<INT>",
    }
    names = list(rows[0])
    schema = ", ".join(f"{n} {kinds[n]}" for n in names)
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], schema)


def brute_distance(a, b, metric):
    if metric == "euclidean":
        return round(float(np.linalg.norm(a - b)), 12)
    na, nb = float(a @ a), float(b @ b)
    if na * nb == 0:
        return 1.0
    d = 1 - float(a @ b) / math.sqrt(na * nb)
    return round(0.0 if d < 1e-12 else d, 12)


def brute(m, queries, train, k, metric):
    out = []
    for q in queries:
        ranked = sorted((brute_distance(m[q], m[t], metric), t) for t in train)
        out += [(q, t, r + 1, d) for r, (d, t) in enumerate(ranked[:k])]
    return out


def collected(near, *extra):
    return sorted(
        (*[r[c] for c in extra], r.query_id, r.train_id, r["rank"], r.distance)
        for r in near.collect()
    )


def same(got, want):
    assert [g[:-1] for g in got] == [w[:-1] for w in want]
    assert [g[-1] for g in got] == pytest.approx([w[-1] for w in want], abs=1e-9)


@pytest.mark.parametrize("form", ["terms", "slots", "vec"])
@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
def test_equals_brute_force(spark, small_blocks, form, metric):
    m = matrix(40, 30, 1)
    df = frame(spark, m, form)
    near = neighbors.knn_join(df.where("id < 12"), df.where("id >= 2"), 5, metric=metric)
    want = brute(m, range(12), range(2, 40), 5, metric)
    same(collected(near), sorted(want))
    copy = near.where("query_id = 3 AND train_id = 2").first()
    assert copy.distance == 0.0


def test_one_block_and_many_blocks_agree(spark, monkeypatch):
    m = matrix(50, 200, 2, sparse=0.1)
    df = frame(spark, m, "terms")
    one = collected(neighbors.knn_join(df, df, 4))
    monkeypatch.setattr(neighbors, "MAX_BLOCK_ROWS", 6)
    same(collected(neighbors.knn_join(df, df, 4)), one)


def test_no_shared_terms_is_distance_one(spark):
    df = frame(spark, np.eye(6), "terms")
    near = neighbors.knn_join(df.where("id = 5"), df.where("id < 5"), 3)
    assert collected(near) == [(5, t, t + 1, 1.0) for t in range(3)]


def test_k_is_clamped_and_base_mode_checks_it(spark):
    df = frame(spark, matrix(6, 5, 3), "vec")
    near = neighbors.knn_join(df.where("id = 5"), df.where("id < 4"), 9)
    assert near.count() == 4
    with pytest.raises(ValueError):
        neighbors.require_k(df, 7)
    neighbors.require_k(df, 6)
    for bad in (dict(k=0), dict(k=1, metric="manhattan")):
        with pytest.raises(ValueError):
            neighbors.knn_join(df, df, **bad)


def test_exclude_self(spark, small_blocks):
    m = matrix(20, 8, 4)
    df = frame(spark, m, "vec")
    near = neighbors.knn_join(df, df, 3, metric="euclidean", exclude_self=True)
    want = []
    for q in range(20):
        want += brute(m, [q], [t for t in range(20) if t != q], 3, "euclidean")
    same(collected(near), sorted(want))


def test_groups_stay_apart_and_a_hot_group_is_cut(spark, small_blocks):
    """One group holds most rows; every group gets its own exact answer."""
    m = matrix(60, 12, 5)

    def group(i):
        return "hot" if i % 6 else f"g{i % 4}"

    df = frame(spark, m, "terms", g=group)
    near = neighbors.knn_join(df.where("id % 5 = 0"), df.where("id % 5 <> 0"), 4, by=["g"])
    want = []
    for name in {group(i) for i in range(60)}:
        ids = [i for i in range(60) if group(i) == name]
        queries = [i for i in ids if i % 5 == 0]
        train = [i for i in ids if i % 5]
        want += [(name, *row) for row in brute(m, queries, train, 4, "cosine")]
    same(collected(near, "g"), sorted(want))


def test_splits_from_one_pass(spark, small_blocks):
    m = matrix(36, 10, 6)

    def tests(i):
        return [s for s in range(4) if (i + s) % 3 == 0]

    def trains(i):
        return [s for s in range(4) if (i + s) % 3 != 0]

    near = neighbors.knn_join(
        frame(spark, m, "terms", splits=tests), frame(spark, m, "terms", splits=trains),
        3, with_splits=True,
    )
    want = []
    for s in range(4):
        queries = [i for i in range(36) if s in tests(i)]
        train = [i for i in range(36) if s in trains(i)]
        want += [(s, *row) for row in brute(m, queries, train, 3, "cosine")]
    same(collected(near, "split"), sorted(want))


def projected_by_hand(vectors, dim, n_features, seed, key):
    rows = projection.project_vectors(vectors, dim, n_features, seed, key)
    out = {}
    for r in projection.slot_values(rows, ["id"]).collect():
        out.setdefault(r.id, np.zeros(dim))[r.slot] = r.value
    return out


def test_projection_inside_blocks_equals_projected_rows(spark, small_blocks):
    """Two projections of one table, the second used by splits 2 and 3."""
    m = matrix(30, 40, 7)
    dim, features, seed = 16, 40, 5
    vectors = frame(spark, m, "terms")
    coded = projection.with_codes(vectors).withColumns(
        {
            "dims": F.array(F.lit(dim), F.lit(dim)),
            "n_draws": F.array(*[F.lit(projection.n_draws(dim, features))] * 2),
            "test_in": F.expr("filter(sequence(0, 3), s -> (id + s) % 3 = 0)"),
            "train_in": F.expr("filter(sequence(0, 3), s -> (id + s) % 3 <> 0)"),
        }
    )
    near = neighbors.projected_knn_join(
        coded, 3, settings=[(0, (seed, 0), 0, 2), (1, (seed, 1), 2, 2)],
        max_draws=[projection.n_draws(dim, features)] * 2, metrics=["cosine"],
    )
    want = []
    for s in range(4):
        hand = projected_by_hand(vectors, dim, features, seed, s // 2)
        full = [hand.get(i, np.zeros(dim)) for i in range(30)]
        queries = [i for i in range(30) if (i + s) % 3 == 0]
        train = [i for i in range(30) if (i + s) % 3]
        want += [(s, *row) for row in brute(full, queries, train, 3, "cosine")]
    same(collected(near, "split"), sorted(want))


def test_projection_keeps_distances(spark):
    """Squared distances stay within the error for nearly all pairs."""
    m = matrix(40, 600, 8, sparse=0.2)
    eps = 0.3
    dim = projection.jl_dim(40, eps)
    hand = projected_by_hand(frame(spark, m, "terms"), dim, 600, 1, 0)
    ratios = []
    for i in range(1, 40):
        for j in range(i + 1, 40):
            true = ((m[i] - m[j]) ** 2).sum()
            if true:
                ratios.append(((hand[i] - hand[j]) ** 2).sum() / true)
    inside = np.mean([1 - eps <= r <= 1 + eps for r in ratios])
    assert inside > 0.97 and abs(np.mean(ratios) - 1) < 0.1


def test_dimensions():
    assert projection.jl_dim(75, 0.3) == 479
    assert projection.target_dim(75, 0.0) is None
    assert projection.target_dim(75, 0.3, dim=10) == 10
    assert projection.target_dim(75, 0.3, n_features=418) == 418
    assert projection.target_dim(75, 0.3) == 479
    for n, eps in ((0, 0.3), (10, 1.0), (10, -0.1)):
        with pytest.raises(ValueError):
            projection.jl_dim(n, eps)


def test_plan_broadcasts_no_vectors_and_caps_before_the_merge(spark):
    df = frame(spark, matrix(20, 8, 9), "terms")
    near = neighbors.knn_join(df, df, 3)
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert "WindowGroupLimit" in plan


def test_copies_of_a_block_are_few_compressed_rows(spark):
    """Rows that lie together move as one row, in less space than their vectors."""
    m = matrix(400, 60, 10)
    df = frame(spark, m, "terms").coalesce(1)
    pairs = neighbors._Pairs(df, df, [], F.size("terms"), ["terms", "weights"], ["label"], ["label"])
    sizes = pairs.t.where("_qb = 0").selectExpr("octet_length(rows) + octet_length(names) AS n").collect()
    plain = sum(int((v != 0).sum()) for v in m) * 16
    assert len(sizes) <= neighbors.TRAIN_SPREAD and sum(r.n for r in sizes) < plain / 2


@pytest.mark.parametrize("form", ["terms", "slots", "vec"])
@pytest.mark.parametrize("exclude_self", [False, True])
def test_tiles_agree_with_one_matrix(spark, monkeypatch, form, exclude_self):
    """The distances of a block pair are held a tile at a time."""
    table = frame(spark, matrix(40, 12, 11), form).toArrow()
    held = []
    whole = _block_kernel.distances
    monkeypatch.setattr(_block_kernel, "distances", lambda d, *a: held.append(d.shape) or whole(d, *a))
    one = _block_kernel._nearest(table, table, 3, "euclidean", exclude_self)
    monkeypatch.setattr(_block_kernel, "TILE_ROWS", 7)
    held.clear()
    tiled = _block_kernel._nearest(table, table, 3, "euclidean", exclude_self)
    assert max(max(shape) for shape in held) <= 7
    for a, b in zip(one, tiled):
        assert np.allclose(a, b)


def test_texts_are_not_indexed_by_pivots(spark, monkeypatch):
    """Their distances to a pivot are alike, so every block would be met."""
    monkeypatch.setattr(neighbors, "PRUNE_FROM", 10)
    monkeypatch.setattr(neighbors, "_indexed", lambda *args: pytest.fail("indexed"))
    m = matrix(30, 12, 12)
    near = neighbors.knn_join(frame(spark, m, "terms"), frame(spark, m, "terms"), 2)
    same(collected(near), sorted(brute(m, range(30), range(30), 2, "cosine")))


def test_blocks_are_as_large_as_memory_allows(spark):
    """Rows are copied once per block of the other side (and part of the settings), so
    units that parallelism does not ask for only add to the shuffle."""
    df = spark.range(40000).selectExpr("id", "array('a') AS terms", "array(1D) AS weights", "0 AS label")
    pairs = neighbors._Pairs(df, df, [], F.size("terms"), ["terms", "weights"], ["label"], ["label"], 8)
    assert pairs.t.select(*pairs.key).distinct().count() <= neighbors.UNITS


@pytest.mark.parametrize("form", ["terms", "slots", "vec"])
@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
def test_later_tiles_are_measured_within_the_bound_only(spark, monkeypatch, form, metric):
    """What a first tile found leaves few pairs to measure; ties and splits stay right."""
    m = np.repeat(matrix(30, 12, 13), 3, axis=0)  # many ties
    table = frame(spark, m, form).toArrow()
    test_in = np.array([[i % 2 == s for i in range(90)] for s in (0, 1)])
    whole = _block_kernel._nearest(table, table, 4, metric, False, test_in, ~test_in)
    measured = []
    every = _block_kernel._measured
    monkeypatch.setattr(_block_kernel, "_measured", lambda d, *a: measured.append(d.size) or every(d, *a))
    monkeypatch.setattr(_block_kernel, "TILE_ROWS", 10)
    tiled = _block_kernel._nearest(table, table, 4, metric, False, test_in, ~test_in)
    assert sum(measured) < 0.6 * 90 * 90
    by_place = [np.lexsort((x[2], x[3], x[1], x[0])) for x in (whole, tiled)]
    for a, b in zip(whole, tiled):
        assert np.allclose(a[by_place[0]], b[by_place[1]])


def test_single_precision_names_every_near_pair():
    rng = np.random.default_rng(14)
    near = rng.normal(size=(1, 50)) + 1e-5 * rng.normal(size=(60, 50))  # closer than its rounding
    far = rng.normal(size=(400, 50))
    a, b = _block_kernel._Matrix(near[:20]), _block_kernel._Matrix(np.vstack([near[20:], far])[:410])
    exact = _block_kernel.distances(a.values @ b.values.T, a.squares, b.squares, "cosine")
    for rank in (0, 3):
        bound = np.sort(exact, axis=1)[:, rank] + 1e-12
        monkey = _block_kernel._nearer_directions(a, b, bound)
        if monkey is None:  # too many to check one by one
            continue
        want = {(q, t) for q, t in zip(*np.nonzero(exact < bound[:, None]))}
        assert set(zip(monkey[0].tolist(), monkey[1].tolist())) == want
    shown = _block_kernel._nearer_directions(a, _block_kernel._Matrix(np.vstack([near[20:22], far])), np.full(20, 0.5))
    assert set(shown[1].tolist()) >= {0, 1} and len(shown[0]) < 20 * 402 * _block_kernel.RECHECKED


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
def test_large_groups_give_each_query_one_list(spark, small_blocks, monkeypatch, metric):
    """Training blocks are read one after the other, so neither rows nor lists of k are
    made once per pair of blocks; rows of equal distance in many blocks stay in order."""
    m = np.repeat(matrix(45, 12, 15), 4, axis=0)
    df = frame(spark, m, "terms", g=lambda i: "large" if i < 170 else "small")
    found, whole = [], neighbors.top_k
    monkeypatch.setattr(neighbors, "top_k", lambda c, *args: found.append(c) or whole(c, *args))
    near = neighbors.knn_join(df, df, 3, metric=metric, by=["g"])
    want = [("large", *r) for r in brute(m, range(170), range(170), 3, metric)]
    want += [("small", *r) for r in brute(m, range(170, 180), range(170, 180), 3, metric)]
    same(collected(near, "g"), sorted(want))
    assert found[0].where("g = 'large'").count() == 170 * 3


def test_large_groups_are_written_once(spark, small_blocks, monkeypatch):
    df = frame(spark, matrix(150, 12, 16), "terms")
    packed, whole = [], neighbors._packed
    monkeypatch.setattr(neighbors, "_packed", lambda *args: packed.append(whole(*args)) or packed[-1])
    written, keep = [], neighbors.materialize
    monkeypatch.setattr(neighbors, "materialize", lambda t, *a, **kw: written.append(keep(t, *a, **kw)) or written[-1])
    assert neighbors.knn_join(df, df, 2).count() == 300
    blocks = [t for t in written if "rows" in t.columns]
    assert len(blocks) == 1 and blocks[0].count() == packed[0].count()


def test_rows_of_two_blocks_move_once(spark, small_blocks, monkeypatch):
    """No row is copied for the tasks that read it once a side has two blocks."""
    made = []
    whole = neighbors._Streamed.run
    monkeypatch.setattr(neighbors._Streamed, "run", lambda self, *args: made.append(self) or whole(self, *args))
    rows = frame(spark, matrix(20, 8, 7), "terms").coalesce(1)
    queries = rows.where("id < 12")
    found = neighbors.knn_join(queries, rows, 3)
    got = sorted((r.query_id, r.rank, r.train_id, r.distance) for r in found.collect())
    blocks = made[0].q
    assert blocks.count() == blocks.select("_qb").distinct().count() > 1
    monkeypatch.setattr(neighbors, "MOST_COPIES", 1 << 30)
    copied = neighbors.knn_join(queries, rows, 3)
    assert got == sorted((r.query_id, r.rank, r.train_id, r.distance) for r in copied.collect())
    assert len(made) == 1
    monkeypatch.undo()
    assert neighbors.MOST_COPIES == 1


def kinds(n, seed, scale):
    """Rows of two kinds that share one term only, among them empty and equal ones."""
    rng = np.random.default_rng(seed)
    m = rng.integers(0, 4, size=(n, 24)) * (rng.random((n, 24)) < 0.6) * scale
    m[: n // 2, 12:] = 0
    m[n // 2 :, 1:12] = 0
    m[::17] = 0
    m[5::11] = m[5]
    return m


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
@pytest.mark.parametrize("scale", [1.0, 0.37, -0.37])
@pytest.mark.parametrize("splits", [False, True])
def test_queries_are_not_multiplied_with_tiles_that_are_unlike(spark, monkeypatch, metric, scale, splits):
    """F7 to F12, F14 and those on the same join: all pairs were multiplied.  Results are the
    same, whatever the weights and over several blocks, and far fewer pairs are multiplied."""
    m = kinds(240, 21, scale)
    if scale < 0:
        m[:, 3] *= -1
    table = frame(spark, m, "terms").toArrow()
    if splits:
        listed = [[s for s in (0, 1, 2) if i % 3 == s] for i in range(240)]
        table = table.append_column("splits", pa.array(listed, pa.list_(pa.int32())))
    schema = pa.schema([("split", pa.int32())] * splits + [("query_id", pa.int64()), ("train_id", pa.int64()), ("distance", pa.float64())])

    def found():
        left, names = _block_kernel.numbered_terms(table, table)
        blocks = [left, names.slice(0, 130), names.slice(130)]
        left, *rest = (_block_kernel.Block([b], ordered=i > 0) for i, b in enumerate(blocks))
        out = _block_kernel.nearest_in_blocks(
            left, [(b, None) for b in rest], k=4, metric=metric, by=[], with_splits=splits, exclude_self=True, schema=schema
        )
        order = [(c, "ascending") for c in schema.names if c != "train_id"] + [("train_id", "ascending")]
        return out.sort_by(order).to_pandas()

    monkeypatch.setattr(_block_kernel, "TILE_ROWS", 30)
    monkeypatch.setattr(_block_kernel, "SCREENED_ROWS", 1 << 30)
    plain = found()
    monkeypatch.setattr(_block_kernel, "SCREENED_ROWS", 1)
    pairs, every = [], _sparse_kernel._products
    monkeypatch.setattr(_sparse_kernel, "_products", lambda a, b, p: pairs.append(a.n_rows * b.n_rows) or every(a, b, p))
    screened = found()
    assert len(plain) == len(screened) > 0
    for column in schema.names:
        assert np.allclose(plain[column], screened[column], atol=1e-12), column
    if scale > 0 and metric == "cosine":
        assert 0 < sum(pairs) < 0.8 * 240 * 240


@pytest.mark.parametrize("metrics", [["cosine"], ["euclidean"], ["euclidean", "cosine"]])
def test_projected_pairs_are_multiplied_in_stages(monkeypatch, metrics):
    """All slots of all pairs were multiplied.  No pair within a bound is
    lost, products are exact, and queries without near rows leave early."""
    rng = np.random.default_rng(22)
    heavy = rng.integers(-9, 10, size=(90, 8)) * (np.arange(90)[:, None] % 3 > 0)
    values = np.hstack([heavy, rng.integers(-1, 2, size=(90, 40))]).astype(float)
    values[7] = 0
    a, b = (_staged_kernel.Counts(v, 2) for v in (values[:40], values[40:]))
    monkeypatch.setattr(_staged_kernel, "STAGES", (8, 16))
    monkeypatch.setattr(_staged_kernel, "SHARES", 4)
    exact = values[:40] @ values[40:].T / 2
    squares = (values * values).sum(axis=1) / 2
    singles, every = [], _staged_kernel._rest
    monkeypatch.setattr(_staged_kernel, "_rest", lambda a, b, q, *r: singles.append(len(q)) or every(a, b, q, *r))
    monkeypatch.setattr(_staged_kernel, "FEW", 0.1)
    for rank in (0, 2, 60):
        dist = [_block_kernel.distances(exact, squares[:40], squares[40:], m) for m in metrics]
        bounds = [np.sort(d, axis=1)[:, rank] + 1e-9 if rank < 50 else np.full(40, np.inf) for d in dist]
        found = _staged_kernel.near(a, b, metrics, bounds, 1e-11)
        for d, bound, (q, t, dots) in zip(dist, bounds, found):
            assert np.array_equal(dots, exact[q, t])
            got = set(zip(q.tolist(), t.tolist()))
            assert len(got) == len(q) and got >= set(zip(*(x.tolist() for x in np.nonzero(d < bound[:, None]))))
            assert rank > 50 or len(q) < 0.2 * d.size
    assert sum(singles) > 0


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
@pytest.mark.parametrize("scale", [2.0, 0.37])
def test_slots_are_met_as_dense_rows_in_stages(spark, monkeypatch, metric, scale):
    """Slots were scattered anew for every two tiles, in double precision."""
    m = kinds(200, 23, scale)
    table = frame(spark, m, "slots").toArrow()
    stages, every = [], _staged_kernel.near
    monkeypatch.setattr(_staged_kernel, "near", lambda *a: stages.append(1) or every(*a))
    monkeypatch.setattr(_staged_kernel, "STAGES", (6,))
    monkeypatch.setattr(_staged_kernel, "SHARES", 3)
    monkeypatch.setattr(_block_kernel, "TILE_ROWS", 30)
    halves = _block_kernel.blocks_of(table, table)[0]
    assert halves.form == "slots"
    new = _block_kernel._nearest(table, table, 4, metric, True)
    monkeypatch.setattr(_block_kernel, "MOST_SLOTS", 0)
    old = _block_kernel._nearest(table, table, 4, metric, True)
    by_place = [np.lexsort((x[2], x[3], x[1])) for x in (new, old)]
    for a, b in zip(new, old):
        assert np.allclose(a[by_place[0]], b[by_place[1]], atol=1e-12)
    assert bool(stages) == (scale == 2.0)


def test_units_that_read_blocks_seldom_meet_in_one_task(spark, small_blocks, monkeypatch):
    """Units that met in one task were done one after the other."""
    made, whole = [], neighbors._Streamed.run
    monkeypatch.setattr(neighbors._Streamed, "run", lambda self, *args: made.append(self) or whole(self, *args))
    rows = frame(spark, matrix(150, 8, 7), "terms")
    neighbors.knn_join(rows, rows, 3)
    placed = made[0].q.select("_qb", F.spark_partition_id().alias("p")).distinct()
    units, tasks = placed.select("_qb").distinct().count(), placed.select("p").distinct().count()
    assert units == neighbors.UNITS and tasks >= units - 1
    assert neighbors._partitions(1000) == 3000
