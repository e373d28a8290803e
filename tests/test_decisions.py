"""Votes, decisions, weights, metrics: every branch by hand."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tremolo.functions import decisions as d
from tremolo.operators import evaluation, imbalance, splits, voting

INF = float("inf")


def one(spark, phi, psi, sigma, column):
    df = spark.createDataFrame([(phi, psi, sigma)], "phi DOUBLE, psi DOUBLE, sigma DOUBLE")
    return df.select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "phi, psi, sigma, want",
    [
        (INF, INF, 0.0, 0), (1.0, INF, 0.0, 0), (INF, 1.0, 1.0, 1), (0.0, 0.0, 0.0, 0),
        (0.5, 0.5, 0.5, 1), (0.4, 0.6, 0.5, 0), (3.0, 1.0, 0.75, 1), (0.0, 2.0, 0.0, 1),
    ],
)
def test_base_decision(spark, phi, psi, sigma, want):
    got = one(spark, phi, psi, sigma, d.decide(F.col("phi"), F.col("psi"), F.col("sigma")))
    assert got == want


@pytest.mark.parametrize(
    "phi, psi, sigma, prior, use, want",
    [
        (INF, INF, 0.5, 0.3, True, (0, 0.3)), (INF, INF, 0.5, 0.7, True, (1, 0.7)),
        (INF, INF, 0.5, 0.7, False, (0, 0.5)), (INF, 1.0, 0.5, 0.1, True, (1, 1.0)),
        (1.0, INF, 0.5, 0.9, True, (0, 1.0)), (0.0, 0.0, 0.5, 0.8, True, (1, 0.8)),
        (0.0, 0.0, 0.5, 0.8, False, (0, 0.5)), (0.0, 0.0, 0.5, 0.1, True, (0, 0.1)),
        (3.0, 1.0, 0.5, 0.1, True, (1, 0.75)), (1.0, 3.0, 0.5, 0.1, True, (0, 0.75)),
        (3.0, 1.0, 0.9, 0.1, True, (0, 0.75)),
    ],
)
def test_prior_decision(spark, phi, psi, sigma, prior, use, want):
    cols = F.col("phi"), F.col("psi")
    label = d.decide_with_prior(*cols, F.col("sigma"), F.lit(prior), F.lit(use))
    sure = d.confidence(*cols, F.lit(prior), F.lit(use))
    got = one(spark, phi, psi, sigma, label), one(spark, phi, psi, sigma, sure)
    assert got == want


NEAR = [(1, 1, 0.5, 1), (1, 0, 0.25, 2), (1, 1, 1.0, 3), (2, 1, 0.0, 1), (2, 0, 0.0, 2)]


@pytest.fixture(scope="module")
def near(spark):
    return spark.createDataFrame(NEAR, "query_id INT, label INT, distance DOUBLE, rank INT")


def votes(df):
    return {r.query_id: (r.phi, r.psi) for r in df.collect()}


def test_tallies(near):
    assert votes(voting.tally(near, ["query_id"], "uniform")) == {1: (2.0, 1.0), 2: (1.0, 1.0)}
    assert votes(voting.tally(near, ["query_id"], "distance")) == {1: (3.0, 4.0), 2: (INF, INF)}
    weighted = voting.tally(near, ["query_id"], "distance", {0: 0.5, 1: 2.0})
    assert votes(weighted) == {1: (6.0, 2.0), 2: (INF, INF)}
    with pytest.raises(ValueError):
        voting.tally(near, ["query_id"], "other")


def test_many_k_and_sigma_from_one_table(near):
    rows = voting.tally_for_each_k(near, ["query_id"], [1, 2, 3], "uniform")
    got = {(r.query_id, r.k): (r.phi, r.psi) for r in rows.collect()}
    assert got[(1, 1)] == (1.0, 0.0) and got[(1, 2)] == (1.0, 1.0) and got[(1, 3)] == (2.0, 1.0)
    predicted = voting.predictions_for_each_sigma(rows, [0.5, 0.6, 0.7]).collect()
    third = {r.sigma: r.prediction for r in predicted if r.query_id == 1 and r.k == 3}
    assert third == {0.5: 1, 0.6: 1, 0.7: 0}


def labels(spark, values):
    return spark.createDataFrame(list(enumerate(values)), "id BIGINT, label INT")


@pytest.mark.parametrize(
    "values, ratio, want",
    [
        ([1] * 2 + [0] * 8, 0.0, {0: 10 / 16, 1: 10 / 4}), ([1] * 5 + [0] * 5, 0.0, {0: 1.0, 1: 1.0}),
        ([0] * 4, 0.0, {0: 1.0, 1: 1.0}), ([1, 0, 0, 0, 0], 5.0, {0: 1.0, 1: 5.0}),
    ],
)
def test_class_weights(spark, values, ratio, want):
    rows = imbalance.class_weights(labels(spark, values), ratio).collect()
    assert {r.label: r.weight for r in rows} == want
    n_pos = sum(values)
    pair = imbalance.weights_of_counts(len(values) - n_pos, n_pos, ratio)
    assert pair == (want[0], want[1])


def test_prior(spark):
    assert imbalance.class_prior(labels(spark, [1, 0, 0, 0])).first().prior == 0.25
    assert imbalance.class_prior(labels(spark, [1]).where("id > 5")).first().prior == 0.5


def vectors(spark, n_pos, n_neg, form="vec"):
    rows = []
    for i in range(n_pos + n_neg):
        v = [float((i * j) % 7 + j) for j in range(1, 4)]
        rows.append((i, int(i < n_pos), v))
    df = spark.createDataFrame(rows, "id BIGINT, label INT, vec ARRAY<DOUBLE>")
    if form == "vec":
        return df
    weights = F.col("vec").alias("weights")
    if form == "slots":
        return df.select("id", "label", F.expr("array(0, 1, 2)").alias("slots"), weights)
    return df.select("id", "label", F.expr("array('a', 'b', 'c')").alias("terms"), weights)


def dense(row, form):
    if form == "vec":
        return list(row.vec)
    out = [0.0, 0.0, 0.0]
    names = row.slots if form == "slots" else ["abc".index(t) for t in row.terms]
    for j, w in zip(names, row.weights):
        out[j] += w
    return out


@pytest.mark.parametrize("form", ["vec", "slots", "terms"])
def test_smote_balances_with_points_between_minority_rows(spark, form):
    train = vectors(spark, 4, 15, form)
    rows = imbalance.smote(train, k=2).collect()
    new = [r for r in rows if r.synthetic]
    assert len(new) == 11 and all(r.label == 1 and r.id < 0 for r in new)
    minority = [dense(r, form) for r in rows if r.label == 1 and not r.synthetic]

    def between(p, a, b):
        spans = [(y - x, z - x) for x, y, z in zip(a, b, p)]
        alphas = [z / s for s, z in spans if abs(s) > 1e-12]
        flat = all(abs(z) < 1e-9 for s, z in spans if abs(s) <= 1e-12)
        return flat and bool(alphas) and max(alphas) - min(alphas) < 1e-6 and -1e-9 <= alphas[0] < 1

    for r in new:
        p = dense(r, form)
        assert any(between(p, a, b) for a in minority for b in minority if a != b)
    again = imbalance.smote(train, k=2).where("synthetic").collect()
    assert {r.id: dense(r, form) for r in new} == {r.id: dense(r, form) for r in again}


@pytest.mark.parametrize("n_pos, n_neg, added", [(0, 5, 0), (5, 5, 0), (6, 2, 0), (1, 5, 0), (2, 5, 3)])
def test_smote_no_ops(spark, n_pos, n_neg, added):
    out = imbalance.smote(vectors(spark, n_pos, n_neg))
    assert out.where("synthetic").count() == added


@pytest.mark.parametrize(
    "y, p, want",
    [
        ([1, 1, 1, 0, 0], [1, 0, 0, 0, 0], (1.0, 1 / 3, 0.5, 3, 2, 1)),
        ([0, 0, 0], [1, 1, 1], (0.0, None, 0.0, 0, 3, 3)),
        ([1, 1, 1, 0, 0], [1, 0, 0, 0, 1], (0.5, 1 / 3, 0.4, 3, 2, 2)),
        ([0, 0], [0, 0], (None, None, None, 0, 2, 0)),
    ],
)
def test_metrics(spark, y, p, want):
    df = spark.createDataFrame(list(zip(y, p)), "label INT, prediction INT")
    r = evaluation.evaluate(df).first()
    got = r.precision, r.recall, r.f1, r.n_flaky, r.n_non_flaky, r.n_predicted_flaky
    assert got == pytest.approx(want)


def test_averages_skip_undefined_precision(spark):
    df = spark.createDataFrame([(None, 0.0), (0.5, 1.0)], "precision DOUBLE, recall DOUBLE")
    r = evaluation.average_over_splits(df).first()
    assert (r.n_splits, r.precision, r.recall) == (2, 0.5, 0.5)


@pytest.mark.parametrize(
    "n_pos, n_neg, train, test",
    [(4, 8, (3, 6), (1, 2)), (305, 2984, (244, 2387), (61, 597)), (67, 8, (54, 6), (13, 2))],
)
def test_stratified_quotas(spark, n_pos, n_neg, train, test):
    drawn = splits.stratified_splits(labels(spark, [1] * n_pos + [0] * n_neg), 3, 0.2, seed=1)
    rows = splits.usable_splits(drawn, ["split"]).collect()
    assert len(rows) == 3
    for r in rows:
        assert (r.train_pos, r.train_neg) == train and (r.test_pos, r.test_neg) == test


def test_splits_differ_and_cover_every_row_once(spark):
    rows = labels(spark, [1, 0, 0] * 20)
    drawn = splits.shuffle_splits(rows, 4, 0.25, seed=2).collect()
    assert len(drawn) == 240
    tests = [frozenset(r.id for r in drawn if r.split == s and not r.is_train) for s in range(4)]
    assert len(set(tests)) == 4 and all(len(t) == 15 for t in tests)


def test_unusable_splits_are_dropped(spark):
    drawn = splits.stratified_splits(labels(spark, [1] + [0] * 9), 5, 0.2)
    assert splits.usable_splits(drawn, ["split"]).count() == 0
