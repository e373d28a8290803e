"""Ranks in hash order: groups of very different sizes."""

from __future__ import annotations

import hashlib
import math

import pytest
from pyspark.sql import functions as F

from tremolo.operators import ranking

SIZES = {"a": 1, "b": 3, "c": 700, "d": 40}


@pytest.mark.parametrize("bucket_rows", [4, 4096])
def test_ranks_equal_a_sort(spark, monkeypatch, bucket_rows):
    monkeypatch.setattr(ranking, "BUCKET_ROWS", bucket_rows)
    rows = [
        (g, part, i, hashlib.md5(f"{g}{part}{i % (n - n // 3)}".encode()).hexdigest())  # some digests are equal
        for g, n in SIZES.items() for part in (0, 1) for i in range(n)
    ]
    table = spark.createDataFrame(rows, "g string, part int, id int, o string")
    sizes = spark.createDataFrame(list(SIZES.items()), "g string, _rows long")
    got = ranking.hash_rank(table, ["g", "part"], "o", "id", sizes)
    assert set(got.columns) == {*table.columns, "rank"}
    found = {(r.g, r.part, r.id): r["rank"] for r in got.collect()}
    want = {}
    for g in SIZES:
        for part in (0, 1):
            own = sorted((o, i) for h, p, i, o in rows if (h, p) == (g, part))
            want |= {(g, part, i): k + 1 for k, (_, i) in enumerate(own)}
    assert found == want


def test_buckets_of_a_large_group_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(ranking, "BUCKET_ROWS", 64)
    n = 20_000
    rows = spark.range(n).select(F.lit(0).alias("g"), "id", F.md5(F.col("id").cast("string")).alias("o"))
    sizes = spark.createDataFrame([(0, n)], "g int, _rows long")
    plan = ranking.hash_rank(rows, ["g"], "o", "id", sizes)
    assert [r["rank"] for r in plan.orderBy("rank").select("rank").collect()] == list(range(1, n + 1))
    digits = math.ceil(math.log(n / 64, 16))
    largest = rows.groupBy(F.substring("o", 1, digits)).count().agg(F.max("count")).first()[0]
    assert largest <= 64
