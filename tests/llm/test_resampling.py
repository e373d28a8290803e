"""CRC of spans, gains, scores and ranks against plain Python: op13."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.check_oracles import connect, differences
from tremolo.llm import target_resampling
from tremolo.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, rank string, row int"


def features(text, buckets, max_words):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
    runs = [words[i : i + k] for k in range(1, max_words + 1) for i in range(len(words) - k + 1)]
    return [zlib.crc32(" ".join(r).encode()) % buckets for r in runs], len(words)


def brute(docs, target, percent=10, seed=2024, buckets=10_000, max_words=1, least_words=20):
    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(features(text, buckets, max_words)[0])
    for text in target:
        t.update(features(text, buckets, max_words)[0])
    big_s, big_t = sum(s.values()), sum(t.values())
    out = []
    for i, text in docs:
        found, n = features(text, buckets, max_words)
        gains = [math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets)))) for b in found]
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = sum(gains) + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([n, i, len(found), sum(gains), score, None])
    eligible = sorted((r for r in out if r[0] >= least_words), key=lambda r: (-r[4], r[1] is None, r[1] or 0))
    for place, r in enumerate(eligible[: len(eligible) * percent // 100], 1):
        r[5] = place
    return sorted((tuple(r[1:]) for r in out), key=str)


def found(spark, docs, target, **settings):
    table = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], DOCS)
    items = spark.createDataFrame([(t, 1) for t in target], "text string, doc_id int")
    return sorted((tuple(r) for r in target_resampling.resample(table, items, **settings).collect()), key=str)


ODD = [
    None, "", " -", "a", "Ab_c9 ż漢字-x", "\x00q\x7fr", "é" * 40 + " b", "w" * 1000 + " " + "v" * 64 + " " + "u" * 65,
    "0" * 100_001, " lead", "trail ", "A", "😀 ok",
]


def corpus(seed, n=150):
    rng = random.Random(seed)
    words = ["alpha", "Beta", "gamma", "DELTA", "x1", "naïve", "ключ", "zeta"]
    texts = [" ".join(rng.choice(words[: rng.randint(1, 8)]) for _ in range(rng.randint(1, 60))) for _ in range(n)]
    return list(enumerate(ODD + texts)), [" ".join(rng.choice(words[4:]) for _ in range(30)) for _ in range(5)]


def test_span_crcs_equal_the_library():
    rng = np.random.default_rng(0)
    data = rng.integers(0, 256, 400_000).astype(np.uint8)
    sizes = np.concatenate([rng.integers(1, 70, 500), rng.integers(1, 100_000, 40), [1, 64, 65, 128, 129]])
    starts = rng.integers(0, 300_000, len(sizes))
    got = target_resampling.span_crcs(data, starts, sizes)
    assert got.tolist() == [zlib.crc32(data[a : a + n].tobytes()) for a, n in zip(starts, sizes)]
    assert len(target_resampling.span_crcs(data, starts[:0], sizes[:0])) == 0


@pytest.mark.parametrize("chunk", [1 << 20, 100])
@pytest.mark.parametrize("max_words", [1, 2, 4])
def test_features_equal_a_loop(monkeypatch, max_words, chunk):
    monkeypatch.setattr(target_resampling, "CHUNK", chunk)
    texts = [t for _, t in corpus(1, 40)[0]]
    for array in (pa.array(texts), pa.array(["cut", *texts, "cut"]).slice(1, len(texts)), pa.array(texts, pa.large_string())):
        bucket, sizes, words = target_resampling.features(array, 997, max_words)
        at = 0
        for text, size, n in zip(texts, sizes, words, strict=True):
            want, n_words = features(text, 997, max_words)
            assert sorted(bucket[at : at + size]) == sorted(want) and n == n_words
            at += size
        assert at == len(bucket)


@pytest.mark.parametrize("settings", [{}, {"percent": 40, "max_words": 3, "buckets": 50, "least_words": 3}, {"percent": 100, "least_words": 0}])
def test_ranks_equal_a_plain_version(spark, settings):
    docs, target = corpus(2)
    assert found(spark, docs, target, **settings) == brute(docs, target, **settings)


def test_repeated_and_null_ids(spark):
    text = " ".join(f"t{k}" for k in range(25))
    docs = [(5, text)] * 12 + [(None, text)] * 3 + [(1, text), (2, "short"), (None, None)]
    assert found(spark, docs, [text, None], percent=50) == brute(docs, [text, None], percent=50)


def test_empty_tables(spark):
    assert found(spark, [], ["a b"]) == []
    docs, _ = corpus(3, 30)
    assert found(spark, docs, []) == brute(docs, [])


def test_drawn_texts_keep_all_columns(spark):
    docs, target = corpus(4)
    table = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], DOCS)
    result = target_resampling.resample(table, spark.createDataFrame([(t,) for t in target], "text string"), percent=30)
    got = target_resampling.drawn_texts(table, result)
    assert got.columns == table.columns
    assert {r.doc_id for r in got.collect()} == {r.doc_id for r in result.where("rank IS NOT NULL").collect()}


def test_drawing_moves_towards_the_target(spark):
    """The drawn texts hold more of the words of the target than all texts do."""
    rng = random.Random(6)

    def text(share):
        return " ".join(rng.choice(["zeta", "ключ"] if rng.random() < share else ["alpha", "gamma"]) for _ in range(30))

    table = spark.createDataFrame([(i, text(i % 10 / 10), "x", 1) for i in range(400)], DOCS)
    items = spark.createDataFrame([(text(0.9),) for _ in range(20)], "text string")
    result = target_resampling.resample(table, items)
    share = F.avg(F.regexp_count("text", F.lit("zeta|ключ")) / 30)
    (drawn,), (all_,) = target_resampling.drawn_texts(table, result).agg(share).first(), table.agg(share).first()
    assert drawn > 1.5 * all_


def test_query_equals_sql(spark):
    if not Path(SF).exists():
        pytest.skip("no test data here")
    got = QUERIES["op13_target_resampling"](spark, SF).toPandas()
    assert differences(got, connect(SF).execute(ORACLES["op13_target_resampling"]).df()) is None
