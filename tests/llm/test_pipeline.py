"""The pipeline against brute force, stage by stage, and the registration."""

from __future__ import annotations

import re

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from tests.llm.test_near_dedup import brute
from tremolo.llm import crf_toxicity
from tremolo.llm._common import folded

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = [docs.cache()]
    for _, stage in corpus_pipeline.STAGES:
        found.append(stage(spark, found[-1], SF).cache())
    return found


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_columns(stages):
    assert all(set(s.columns) == set(stages[0].columns) for s in stages[:-1])


def test_toxic(spark, stages):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = crf_toxicity.fit(stages[0], labels, ~folded(F.col("doc_id"), 5, 0))
    good = crf_toxicity.score(stages[0], model).where("score < 0.5")
    assert {r.doc_id for r in good.collect()} == set(texts(stages[1]))


def test_copies(stages):
    before, after = texts(stages[1]), texts(stages[2])
    largest = {t: i for i, t in sorted(before.items())}
    assert set(after) == set(largest.values())


def test_near_copies(stages):
    rows = sorted(texts(stages[2]).items())
    assert set(texts(stages[3])) == {r[0] for r in brute(rows, 5) if r[3]}


def test_leaks(spark, stages):
    items = [re.findall(r"\w+", r.text.lower()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    before, after = texts(stages[3]), texts(stages[4])
    wholly = {
        i for i, t in before.items()
        if any(" ".join(item) in " ".join(re.findall(r"\w+", (t or "").lower())) for item in items)
    }
    assert wholly.isdisjoint(after)
    assert len(before) - len(after) <= len(wholly) + 2


def test_encoding(stages):
    import sentencepiece

    from tremolo.llm.queries import tokenizer

    library = sentencepiece.SentencePieceProcessor(model_file=tokenizer("piece_bpe_32k.model"))
    kept = texts(stages[4])
    got = stages[5].collect()
    assert {r.doc_id for r in got} == set(kept)
    for r in got:
        assert r.ids == library.encode(kept[r.doc_id] or "", add_eos=True)


def test_run_and_registration(spark, stages):
    rows = corpus_pipeline.run(spark, SF)
    assert {r.doc_id for r in rows.collect()} == {r.doc_id for r in stages[-1].collect()}
    found = __spark_entry__.queries()
    assert "pipeline" in found
    assert all(any(k.startswith(f"op{n}_") for k in found) for n in range(1, 11))


def test_empty_input(spark, stages):
    docs = stages[0].limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0
