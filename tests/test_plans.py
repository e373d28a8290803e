"""Sources, sinks, estimator and experiments."""

from __future__ import annotations

import os
import random

import pytest
from pyspark.sql import functions as F

import tremolo
from tremolo.plans import experiments
from tremolo.sources import results, text_folders


@pytest.fixture
def folder(tmp_path):
    for name, texts in (
        ("flakyMethods", ["thread sleep", "wait é"]),
        ("nonFlakyMethods", ["assert a\nb", "list", "map"]),
    ):
        path = tmp_path / "my project" / name
        path.mkdir(parents=True)
        for i, text in enumerate(texts):
            (path / f"test_{i}.txt").write_text(text, encoding="utf-8")
        (path / ".hidden").write_text("no")
        (path / "deeper").mkdir()
        (path / "deeper" / "x.txt").write_text("no")
    return tmp_path


def test_read_projects(spark, folder):
    rows = tremolo.read_projects(spark, str(folder)).collect()
    got = sorted((r.project, r.label, r.file, r.text) for r in rows)
    assert got == [
        ("my project", 0, "test_0.txt", "assert a\nb"),
        ("my project", 0, "test_1.txt", "list"),
        ("my project", 0, "test_2.txt", "map"),
        ("my project", 1, "test_0.txt", "thread sleep"),
        ("my project", 1, "test_1.txt", "wait é"),
    ]


def test_packed_projects_equal_the_folders(spark, folder, tmp_path):
    plain = tremolo.read_projects(spark, str(folder))
    packed = str(tmp_path / "packed")
    text_folders.pack(text_folders.read_texts(spark, f"{folder}/*/*/*"), packed)
    assert len([f for f in os.listdir(packed) if f.endswith(".parquet")]) < 5  # not one a text
    again = tremolo.read_projects(spark, packed, packed=True)
    assert sorted(again.collect()) == sorted(plain.collect())
    assert tremolo.read_projects(spark, packed, "other", packed=True).count() == 0


@pytest.mark.parametrize("n", [0, 1, 3_000])
def test_listing_order(spark, n):
    """Positions over many ranges are those of a plain sort; upper case first."""
    names = [f"{'Ab'[i % 2]}/{i * 7919 % 1_000_003}" for i in range(n)]
    texts = spark.createDataFrame([(p, "x") for p in names], "path string, text string")
    got = text_folders.in_listing_order(texts.repartition(7)).collect()
    assert [r.path for r in sorted(got, key=lambda r: r.position)] == sorted(names)
    assert sorted(r.position for r in got) == list(range(1, n + 1))


def test_samples(spark, tmp_path):
    for case, name in (
        ("case1", "f.org.A.testX"), ("case1", "nf.org.B.testY"), ("case2", "nf.org.C.testZ"),
    ):
        path = tmp_path / "proj" / case
        path.mkdir(parents=True, exist_ok=True)
        (path / name).write_text(name)
    (tmp_path / "README.md").write_text("no")
    samples = tremolo.read_samples(spark, str(tmp_path))
    got = sorted((r.project, r.case_id, r.label, r.class_name, r.method) for r in samples.collect())
    assert got == [
        ("proj", "case1", 0, "org.B", "testY"), ("proj", "case1", 1, "org.A", "testX"),
        ("proj", "case2", 0, "org.C", "testZ"),
    ]
    pair = text_folders.paired_samples(samples).collect()
    assert [(p.case_id, p.flaky_method, p.stable_method) for p in pair] == [("case1", "testX", "testY")]


def test_results_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", None), ("b", 0.5)], "name STRING, precision DOUBLE")
    path = str(tmp_path / "out")
    results.write_results(df, path)
    results.write_results(df.where("name = 'b'"), path, append=True)
    raw = {(r.name, r.precision) for r in spark.read.csv(path, header=True).collect()}
    assert raw == {("a", "-"), ("b", "0.5")}
    back = results.read_results(spark, path, "name STRING, precision DOUBLE")
    assert back.where("precision IS NULL").count() == 1 and back.count() == 3


def test_fitted_modes(spark, texts):
    """Each mode changes what it should and nothing else."""
    some = texts.where("label = 0 OR id % 3 = 0")
    n_pos, n = some.where("label = 1").count(), some.count()
    models = {
        mode: tremolo.NeighborVoteClassifier(handleImbalance=mode, classWeightRatio=0.0).fit(some)
        for mode in ("smote", "weights", "none")
    }
    sizes = {m: model.vectors.groupBy("label").count().collect() for m, model in models.items()}
    got = {m: {r.label: r["count"] for r in rows} for m, rows in sizes.items()}
    assert got["weights"] == got["none"] == {0: n - n_pos, 1: n_pos}
    assert set(got["smote"].values()) == {max(n_pos, n - n_pos)}
    assert {round(m.fitted.prior, 9) for m in models.values()} == {round(n_pos / n, 9)}
    weights = {m: (x.fitted.weight_0, x.fitted.weight_1) for m, x in models.items()}
    assert weights["smote"] == weights["none"] == (None, None)
    assert weights["weights"] == pytest.approx((n / (2 * (n - n_pos)), n / (2 * n_pos)))


def test_base_algorithm(spark, texts):
    whole = tremolo.vectorize(texts.select("id", "text"), eps=0.3, seed=3)
    assert whole.dim and whole.n_rows == 60
    rows = whole.table.join(texts.select("id", "label"), "id")
    out = tremolo.classify(rows.where("id >= 10"), rows.where("id < 10"), 0.5, 3)
    assert out.where("label <> prediction").count() == 0
    with pytest.raises(ValueError):
        tremolo.classify(rows.where("id >= 58"), rows.where("id < 10"), 0.5, 3)


def test_vocabulary_scope_and_empty_vocabulary(spark, texts):
    train, test = tremolo.vectorize_split(
        texts.where("id >= 10").select("id", "text"), texts.where("id < 10").select("id", "text"), eps=0
    )
    seen = {t for r in train.table.collect() for t in r.terms}
    assert {t for r in test.table.collect() for t in r.terms} <= seen
    assert test.table.count() == 10
    with pytest.raises(ValueError, match="vocabulary"):
        tremolo.vectorize(spark.createDataFrame([(1, "a ! b")], "id BIGINT, text STRING"))


SETTINGS = [
    dict(),
    dict(eps=0.0, useTfidf=False, ngramRange=[1, 1], usePatternFeatures=False, useStructuralFeatures=False),
    dict(handleImbalance="smote", metric="euclidean"),
    dict(handleImbalance="smote", eps=0.0, dim=0, weights="uniform"),
    dict(handleImbalance="weights", classWeightRatio=0.0, dim=20),
]


@pytest.mark.parametrize("settings", SETTINGS, ids=range(len(SETTINGS)))
def test_estimator(texts, settings):
    model = tremolo.NeighborVoteClassifier(k=3, **settings).fit(texts.where("id >= 10"))
    out = model.transform(texts.where("id < 10"))
    assert out.count() == 10
    assert out.where("label <> prediction").count() == 0
    assert out.where("confidence < 0 OR confidence > 1").count() == 0


def test_estimator_with_metadata_save_and_load(spark, texts, tmp_path):
    data = texts.withColumns(
        {
            "test_age_days": F.col("id") * 1.0,
            "file_change_count": F.when(F.col("id") % 2 == 0, 1.0),  # has gaps
        }
    )
    columns = ["test_age_days", "file_change_count"]
    train, test = data.where("id >= 10"), data.where("id < 10")
    model = tremolo.NeighborVoteClassifier(metadataCols=columns, k=3).fit(train)
    assert model.fitted.metadata == ["test_age_days"]
    assert model.fitted.prior == 0.4
    path = str(tmp_path / "model")
    model.save(path)
    again = tremolo.NeighborVoteModel.load(spark, path)
    assert again.get("k") == 3 and again.fitted == model.fitted

    def shown(m, df):
        return sorted((r.id, r.prediction, round(r.confidence, 9)) for r in m.predict(df).collect())

    assert shown(model, test) == shown(again, test)
    # Metadata missing at prediction counts as the training mean.
    assert model.predict(texts.where("id < 10")).count() == 10
    row = model.evaluate(test).first()
    assert row.precision == 1.0 and row.n_flaky == 4


def test_unknown_text_meets_the_prior(spark, texts):
    plain = dict(usePatternFeatures=False, useStructuralFeatures=False, eps=0.0, k=60)
    model = tremolo.NeighborVoteClassifier(**plain).fit(texts)
    new = spark.createDataFrame([(1, "zzz qqq")], "id BIGINT, text STRING")
    row = model.predict(new).first()
    assert (row.phi, row.psi) == (24.0, 36.0) and row.prediction == 0


def test_bad_imbalance_mode(texts):
    with pytest.raises(ValueError):
        tremolo.NeighborVoteClassifier(handleImbalance="other").fit(texts)


@pytest.fixture(scope="module")
def projects(texts):
    project = F.when(F.col("id") % 3 == 0, "small").otherwise("large")
    return texts.withColumn("project", project)


def test_effectiveness(projects):
    rows = experiments.effectiveness(projects, [1, 3], [0.5], n_splits=4).collect()
    assert {(r.dataset, r.k) for r in rows} == {(p, k) for p in ("small", "large") for k in (1, 3)}
    for r in rows:
        assert r.flakyTrain + r.flakyTest == (8 if r.dataset == "small" else 16)
        assert r.precision == 1.0 and r.recall == 1.0


def test_comparison_and_sweeps(projects):
    pooled = projects.withColumn("project", F.lit("all"))
    rows = experiments.comparison(pooled, [3], [0.5, 0.95], n_splits=3).collect()
    assert {r.approach for r in rows} == {
        "nearest-baseline", "projected-k3-sigma0.5", "projected-k3-sigma0.95",
    }
    curve = experiments.learning_curve(pooled, [0.8, 0.2], k=3, n_splits=3).collect()
    assert {(r.trainingSetSize, r.sigma) for r in curve} == {
        (t, s) for t in (0.2, 0.8) for s in (0.5, 0.95)
    }
    eps = experiments.sweep_eps(pooled, [0.0, 0.5], k=3, n_splits=3).collect()
    assert {r.eps for r in eps} == {0.0, 0.5}
    metric = experiments.sweep_metric(pooled, n_splits=3).collect()
    assert {(r.distance, r.k) for r in metric} == {
        (m, k) for m in ("cosine", "euclidean") for k in (3, 7)
    }


def test_fit_counts_nan_as_missing_and_needs_terms(spark, texts):
    """One NaN in a metadata column drops it, as a gap does; at prediction NaN is the
    training mean."""
    nan = float("nan")
    data = texts.withColumns(
        {
            "test_age_days": F.col("id") * 1.0,
            "file_change_count": F.when(F.col("id") == 20, F.lit(nan)).otherwise(F.col("id") * 2.0),
        }
    )
    columns = ["test_age_days", "file_change_count"]
    train = data.where("id >= 10")
    model = tremolo.NeighborVoteClassifier(metadataCols=columns, k=3).fit(train)
    assert model.fitted.metadata == ["test_age_days"]
    new = data.where("id < 10")
    absent = model.transform(new.withColumn("test_age_days", F.lit(nan)))
    mean = model.transform(new.withColumn("test_age_days", F.lit(34.5)))
    got, want = ({r.id: (r.score, r.confidence) for r in x.collect()} for x in (absent, mean))
    assert got == want
    with pytest.raises(ValueError, match="vocabulary"):
        tremolo.NeighborVoteClassifier().fit(texts.withColumn("text", F.lit("a ! b")))
    with pytest.raises(ValueError, match="no rows"):
        tremolo.NeighborVoteClassifier().fit(texts.where("id < 0"))


def shown(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_features_need_no_exchange_and_vectors_one_by_id(texts, monkeypatch):
    from tremolo.plans import estimator

    model = tremolo.NeighborVoteClassifier(k=3, eps=0.0)
    docs = estimator._selected(model, texts, with_label=True)
    assert "Exchange" not in shown(estimator._features(model, model.rules, docs))
    fitted = model.fit(texts)
    by_id = shown(fitted.vectors_of(texts)).count("Exchange hashpartitioning(id#")
    assert by_id == 1
    # The input is read once: every other step reads the written features.
    read = []
    whole = estimator._features
    monkeypatch.setattr(estimator, "_features", lambda *args: read.append(1) or whole(*args))
    model.fit(texts)
    assert len(read) == 1


def test_sweeps_are_one_join(texts, monkeypatch):
    from tremolo.operators import neighbors

    met = []
    whole = neighbors._Pairs.run
    monkeypatch.setattr(neighbors._Pairs, "run", lambda *args: met.append(1) or whole(*args))
    docs = texts.withColumn("project", F.lit("all"))
    sweeps = (
        (experiments.sweep_eps, dict(eps=[0.0, 0.3, 0.6]), 3),
        (experiments.sweep_metric, {}, 4),
        (experiments.learning_curve, dict(test_sizes=[0.5, 0.2]), 4),
    )
    for sweep, settings, n_rows in sweeps:
        met.clear()
        assert sweep(docs, n_splits=2, **settings).count() == n_rows
        assert len(met) == 1


def test_all_bits_of_a_code_choose_slots():
    """Codes that share their high (or their low) half fall into different slots."""
    from tremolo.operators.projection import PRIME, draw_functions

    draws = draw_functions(3, 0, 40)
    rng = random.Random(1)
    halves = rng.sample(range(1 << 30), 400)
    for codes in ([(77 << 30) | i for i in halves], [(i << 30) | 77 for i in halves]):
        for a, b, c, d, e, f in draws:
            slots = {(a * (x >> 30) + e * (x & (2**30 - 1)) + b) % PRIME % 1000 for x in codes}
            signs = [(c * (x & (2**30 - 1)) + f * (x >> 30) + d) % PRIME & 1 for x in codes]
            assert len(slots) > 290 and 140 < sum(signs) < 260


def test_cells_are_tested_once_for_each_term(spark):
    """Not once for each posting; values as by hand."""
    import hashlib
    import math

    from tremolo.operators import projection

    rows = [(i, f"t{j}", (i + j) % 3 + 1) for i in range(30) for j in range(i % 4, 12)]
    counts = spark.createDataFrame(rows, "id BIGINT, term STRING, tf BIGINT")
    found = projection.cell_tests(counts, ["id"], "tf", 8, 12, 5)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "md5" not in plan  # done when the terms' cells were written
    want = {}
    for i, term, tf in rows:
        for slot in range(8):
            h = hashlib.md5(f"5|{term}|{slot}".encode()).hexdigest()
            if int(h[:8], 16) < 2**32 / math.sqrt(12):
                sign = 1 if h[8] < "8" else -1
                want[i, slot] = want.get((i, slot), 0.0) + sign * tf * math.sqrt(math.sqrt(12) / 8)
    got = {(r.id, r.slot): r.value for r in found.collect()}
    assert got.keys() == want.keys()
    assert all(abs(got[c] - want[c]) < 1e-9 for c in want)


def test_many_small_files_are_listed_by_folder_and_read_by_few_tasks(spark, tmp_path, monkeypatch):
    from tremolo.plans import queries
    from tremolo.sources import text_folders

    rows = [(f"p{i % 3}", f"text {i}") for i in range(700)]
    texts = spark.createDataFrame(rows, "project STRING, text STRING").coalesce(1)
    monkeypatch.setattr(queries, "whole", lambda *args: texts)
    globs = []
    read = text_folders.read_texts
    monkeypatch.setattr(text_folders, "READ_TASKS", 1)
    monkeypatch.setattr(text_folders, "read_texts", lambda s, path: globs.append(path) or read(s, path))
    row = queries.s1_read_all_texts(spark, "").first()
    assert tuple(row) == (700, sum(len(t) + 1 for _, t in rows))
    assert globs[0].endswith("/project=*")
    assert read(spark, globs[0]).rdd.getNumPartitions() <= 4


def test_tallies_of_sweeps_need_no_exchange(texts, monkeypatch):
    """The neighbour lists are not shuffled again to be counted."""
    plans = []
    whole = experiments.averaged
    monkeypatch.setattr(experiments, "averaged", lambda found, *args: plans.append(shown(found)) or whole(found, *args))
    docs = texts.withColumn("project", F.lit("all"))
    experiments.sweep_metric(docs, n_splits=2)
    experiments.sweep_eps(docs, eps=[0.0, 0.3], n_splits=2)
    experiments.learning_curve(docs, test_sizes=[0.5], n_splits=2)
    assert len(plans) == 3
    for plan in plans:
        above, window, _ = plan.partition("Window")
        assert window and "Aggregate" in above and "Exchange" not in above


def test_texts_of_a_corpus_are_counted_where_they_lie(spark, monkeypatch):
    """No exchange of texts or vectors; repeated and null ids as in a join
    of texts with labels."""
    plans = {}
    whole = experiments.materialize
    monkeypatch.setattr(
        experiments, "materialize", lambda df, kind="table", *args: plans.update({kind: shown(df)}) or whole(df, kind, *args)
    )
    rows = [("a", 1, "red cat", 0), ("a", 2, "old dog", 1), ("a", 2, "new dog", None), ("a", None, "fox", 1), (None, 3, "ox", 0)]
    docs = spark.createDataFrame(rows, "project string, id long, text string, label int")
    corpus = experiments.load_corpus(docs)
    assert "Exchange hashpartitioning" not in plans["vectors"]
    got = sorted(((r.id, r.terms, r.label) for r in corpus.rows.collect()), key=str)
    pairs = [(2, [first, "dog"] if first < "dog" else ["dog", first], label) for first in ("old", "new") for label in (1, None)]
    assert got == sorted([(1, ["cat", "red"], 0), *pairs], key=str)
    assert [(r.n_rows, r.n_terms) for r in corpus.sizes.collect()] == [(5, 5)]


def test_a_fit_writes_no_second_term_table_and_drops_its_features(texts, monkeypatch):
    """the table of terms is not written again for its lookup."""
    from tremolo.operators import skew
    from tremolo.plans import estimator

    kinds, dropped = [], []
    whole, drop = skew.materialize, estimator.discard
    monkeypatch.setattr(skew, "materialize", lambda df, kind, *args: kinds.append(kind) or whole(df, kind, *args))
    monkeypatch.setattr(estimator, "discard", lambda table: dropped.append(table.columns) or drop(table))
    model = tremolo.NeighborVoteClassifier(k=3, eps=0.0).fit(texts)
    assert model.transform(texts).count() == texts.count()
    assert kinds and "lookup" not in kinds
    assert len(dropped) == 1 and "counts" in dropped[0]
