"""Tokens, weights, rules and structure against plain Python."""

from __future__ import annotations

import math
import os
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tremolo.functions import text
from tremolo.functions.structural import STRUCTURAL_FEATURES, with_structural_features
from tremolo.operators import patterns, postings, scaling, storage
from tremolo.operators.skew import lookup
from tremolo.sources import text_folders

TEXTS = [
    "The quick brown fox, the LAZY dog a b _x 12",
    "",
    "Étude déjà vu: l'été\nnaïve été",
    "one",
    "x = foo.bar(1); { { } } } {\t} end;\n\n",
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "id BIGINT, text STRING")


def tokens(text):
    return re.findall(r"\w\w+", text.lower())


def grams(text, low, high):
    toks = tokens(text)
    return [
        " ".join(toks[i : i + n])
        for n in range(low, high + 1)
        for i in range(len(toks) - n + 1)
    ]


@pytest.mark.parametrize("bounds", [(1, 1), (1, 2), (2, 3)])
def test_term_counts(docs, bounds):
    got = {(r.id, r.term): r.tf for r in postings.term_counts(docs, ["id"], ngram_range=bounds).collect()}
    want = {
        (i, t): n for i, text in enumerate(TEXTS) for t, n in Counter(grams(text, *bounds)).items()
    }
    assert got == want


def test_bad_ngram_range(docs):
    with pytest.raises(ValueError):
        postings.term_counts(docs, ["id"], ngram_range=(2, 1))


def test_empty_text_keeps_a_zero_vector(docs):
    counts = postings.term_counts(docs, ["id"], outer=True)
    rows = {r.id: r for r in postings.sparse_vectors(counts, ["id"], "tf").collect()}
    assert len(rows) == len(TEXTS)
    assert rows[1].terms == [] and rows[1].weights == []
    assert dict(zip(rows[2].terms, rows[2].weights))["été"] == 2.0


def python_tfidf(train, text):
    n = len(train)
    df = Counter(t for doc in train for t in set(grams(doc, 1, 1)))
    w = {
        t: c * (math.log((1 + n) / (1 + df[t])) + 1)
        for t, c in Counter(grams(text, 1, 1)).items()
        if t in df
    }
    norm = math.sqrt(sum(v * v for v in w.values()))
    return {t: v / norm for t, v in w.items()}


def test_tfidf_long_and_vector_forms_agree_with_the_formula(docs):
    counts = postings.term_counts(docs, ["id"])
    idf = postings.smoothed_idf(counts, len(TEXTS))
    long = {}
    for r in postings.tfidf(counts, idf, ["id"]).collect():
        long.setdefault(r.id, {})[r.term] = r.w
    rows = postings.tfidf_vectors(counts, idf, ["id"]).collect()
    vectors = {r.id: dict(zip(r.terms, r.weights)) for r in rows}
    for i, text in enumerate(TEXTS):
        want = python_tfidf(TEXTS, text)
        if want:
            assert long[i] == pytest.approx(want) and vectors[i] == pytest.approx(want)
        else:
            assert i not in long and i not in vectors


def test_unknown_terms_are_dropped(spark, docs):
    vocab = postings.vocabulary(postings.term_counts(docs, ["id"]))
    new = spark.createDataFrame([(9, "the fox unseen words")], "id BIGINT, text STRING")
    known = postings.in_vocabulary(postings.term_counts(new, ["id"]), vocab, ["id"])
    assert {r.term for r in known.collect()} == {"the", "fox"}


@pytest.mark.parametrize("salt_rows", [1, 7, 1000])
def test_lookup_with_hot_keys(spark, salt_rows):
    """One key holds most rows; the result is the plain join for any bound."""
    rows = spark.range(1000).select(
        "id", F.when(F.col("id") % 3 == 0, F.col("id").cast("string")).otherwise("hot").alias("k")
    )
    rows = rows.union(spark.createDataFrame([(-1, None), (-2, "3"), (-3, "3")], "id BIGINT, k STRING"))
    table = rows.groupBy("k").agg(F.count("*").alias("n")).where("k <> '3'")
    got = lookup(rows, table, "k", "n", ["id"], salt_rows=salt_rows)
    want = rows.join(table, "k")
    assert sorted((r.id, r.k, r.n) for r in got.collect()) == sorted(
        (r.id, r.k, r.n) for r in want.collect()
    )


def test_lookup_leaves_partitions_even(spark):
    """A key with half of all rows is spread over all partitions."""
    rows = spark.range(20_000).select("id", F.when(F.col("id") % 2 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"))
    table = rows.groupBy("k").agg(F.count("*").alias("n"))
    keep = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1k")
    try:
        found = lookup(rows, table, "k", "n", ["id"], salt_rows=250)
        sizes = found.groupBy(F.spark_partition_id()).count().toPandas()["count"]
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)
    assert sizes.sum() == 20_000 and sizes.max() < 1.5 * sizes.mean()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("bounds", [(1, 1), (1, 2)])
def test_terms_are_counted_inside_the_row(docs, bounds):
    """No exchange until a term is the key, and the text is tokenised once."""
    for counted in (
        postings.term_counts(docs, ["id"], ngram_range=bounds),
        postings.term_counts(docs, ["id"], ngram_range=bounds, outer=True),
        postings.count_vectors(docs, ["id"], ngram_range=bounds),
    ):
        shown = plan(counted)
        assert "Exchange" not in shown and "Python" not in shown
        assert shown.count("regexp_extract_all(") == 1


def test_run_lengths(spark):
    rows = [([],), (None,), (["b"],), (["b", "a", "b", "é", "a", "b"],), (["x"] * 1000,)]
    df = spark.createDataFrame(rows, "t ARRAY<STRING>")
    got = [[tuple(x) for x in r[0]] for r in df.select(text.term_frequencies(F.col("t"))).collect()]
    assert got == [[], [], [("b", 1)], [("a", 2), ("b", 3), ("é", 1)], [("x", 1000)]]


def test_footprint(docs):
    counts = postings.term_counts(docs, ["id"], outer=True)
    row = storage.footprint(counts, ["id"], 10).first()
    assert row.n_rows == 5 and row.dense_bytes == 5 * (10 * 8 + 8)
    assert row.n_postings == sum(len(set(tokens(t))) for t in TEXTS)


def rule_lines():
    fill = [
        (r"\b", " "), (r"\s*", "  "), (r"\s+", " "), (r"\(", "("), (r"\.", "."),
        (r"\w+", "Xyz"), (r"\w*", ""),
    ]
    out = []
    for _, pattern in patterns.DEFAULT_RULES:
        line = pattern
        for old, new in fill:
            line = line.replace(old, new)
        out.append(f"{line}; {line.upper()} pre{line}post")
    out.append("ſLEEP ( tımer TİMER asſertTrue AsSertTrue Thread.sleep(1) verify(x)")
    return out


def test_rule_counts_equal_the_regular_expressions(spark):
    lines = rule_lines()
    docs = spark.createDataFrame(list(enumerate(lines)), "id BIGINT, text STRING")
    names = patterns.categories()
    got = {r.id: r for r in patterns.with_pattern_counts(docs).collect()}
    total = 0
    for i, line in enumerate(lines):
        for c in names:
            want = sum(
                len(re.findall(p, line, re.IGNORECASE))
                for category, p in patterns.DEFAULT_RULES
                if category == c
            )
            total += want
            assert got[i][c] == want, (line, c)
    assert total > 400


def test_rules_overlap_and_repeat(spark):
    docs = spark.createDataFrame([(0, "Thread.sleep(5); Timeout; verify(a)")], "id INT, text STRING")
    row = patterns.with_pattern_counts(docs).first()
    assert (row.concurrency, row.timing) == (1.0, 4.0)
    assert (row.external_deps, row.assertions) == (1.0, 1.0)


def test_custom_rules_and_long_form(spark):
    rules = [("a", r"\bfoo\b"), ("b", r"x|yy"), ("a", r"o{2}")]
    docs = spark.createDataFrame([(0, "foo FOO xyy"), (1, "none")], "id INT, text STRING")
    got = {(r.id, r.category): r.n for r in patterns.pattern_counts_long(docs, ["id"], rules=rules).collect()}
    assert got == {(0, "a"): 4, (0, "b"): 2, (1, "a"): 0, (1, "b"): 0}
    kinds = [r.kind for r in patterns.rule_table(spark, rules).orderBy("rule_id").collect()]
    assert kinds == ["word", "regex", "regex"]


def test_pattern_counts_need_no_shuffle(docs):
    plan = patterns.with_pattern_counts(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def python_structure(text):
    depth = deepest = 0
    for ch in text:
        depth = depth + 1 if ch == "{" else max(0, depth - 1) if ch == "}" else depth
        deepest = max(deepest, depth)
    lines = len(text.split("\n"))
    return [
        len(text), lines, len(text.split()), len(text) / lines, deepest,
        text.count("("), text.count(";"), text.count("."),
    ]


def test_structure(docs):
    for r in with_structural_features(docs).collect():
        assert [r[c] for c in STRUCTURAL_FEATURES] == python_structure(TEXTS[r.id])


def test_scaler_uses_population_deviation_and_keeps_constants(spark):
    train = spark.createDataFrame([(1.0, 5.0, 0.1), (3.0, 5.0, 0.1)], "a DOUBLE, b DOUBLE, c DOUBLE")
    scaler = scaling.fit_scaler(train, ["a", "b", "c"])
    new = spark.createDataFrame([(4.0, 7.0, 0.1)], "a DOUBLE, b DOUBLE, c DOUBLE")
    row = scaling.apply_scaler(new, scaler).first()
    assert (row.a, row.b) == (2.0, 2.0) and row.c == pytest.approx(0.0)


def test_missing_metadata(spark):
    train = spark.createDataFrame([(0, 1.0), (1, 3.0)], "id INT, test_age_days DOUBLE")
    docs = spark.createDataFrame([(0,), (1,), (2,)], "id INT")
    assert scaling.complete_columns(docs, train, "id") == []
    assert scaling.complete_columns(docs.where("id < 2"), train, "id") == ["test_age_days"]
    scaler = scaling.fit_scaler(train, ["test_age_days"])
    with pytest.raises(ValueError):
        scaling.apply_scaler(docs, scaler)
    joined = scaling.with_metadata(docs, train, "id", ["test_age_days"])
    got = {r.id: r.test_age_days for r in scaling.apply_scaler(joined, scaler, True).collect()}
    assert got == {0: -1.0, 1: 1.0, 2: 0.0}


def test_texts_are_written_as_spark_names_them_and_by_the_tasks_alone(spark, tmp_path):
    """each file had a checksum file, was moved and was committed."""
    rows = [("a/b", "x"), ("a/b", "x"), ("a=%#", ""), (None, "y\nz"), ("", None), ("é ü", "two")]
    texts = spark.createDataFrame(rows, "project STRING, text STRING").withColumn("class", F.lit(1))
    mine, theirs = str(tmp_path / "mine"), str(tmp_path / "theirs")
    text_folders.write_texts(texts, mine, ["project", "class"])
    texts.write.partitionBy("project", "class").option("maxRecordsPerFile", 1).text(theirs)

    def files(folder):
        found = text_folders.read_texts(spark, f"{folder}/project=*/class=*").collect()
        return sorted((r.path.split("/")[-3:-1], r.text) for r in found)

    assert files(mine) == files(theirs) and len(files(mine)) == len(rows)
    assert sum(len(names) for _, _, names in os.walk(mine)) == len(rows)
