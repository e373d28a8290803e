"""The inverted index of blocks against the block join and brute force."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_neighbors import brute, collected, frame, matrix, same
from tremolo.operators import neighbors, pivot_index, term_index


@pytest.fixture
def small_index(monkeypatch):
    monkeypatch.setattr(pivot_index, "BLOCK_ROWS", 6)
    monkeypatch.setattr(pivot_index, "QUERY_ROWS", 7)
    monkeypatch.setattr(term_index, "PROBES", 2)


def topics(n_topics, size, seed):
    """Texts of topics: words of their own, and some that all texts share."""
    rng = np.random.default_rng(seed)
    width = 8 * n_topics + 4
    m = np.zeros((n_topics * size, width))
    for i in range(len(m)):
        own = 8 * (i // size)
        m[i, own : own + 8] = rng.integers(0, 5, 8)
        m[i, -4:] = rng.integers(0, 2, 4)
    return m


def test_few_shared_terms_copies_and_zero_vectors(spark, small_index):
    m = matrix(60, 25, 1, sparse=0.12)
    m[7] = 0
    m[30] = 0
    m[40:48] = m[11]
    df = frame(spark, m, "terms")
    near = neighbors.knn_join(df.where("id < 20"), df.where("id >= 2"), 6, index="terms")
    same(collected(near), sorted(brute(m, range(20), range(2, 60), 6, "cosine")))


def test_topics_in_groups_with_more_neighbours_than_rows(spark, small_index):
    m = topics(8, 9, 2)

    def group(i):
        return "hot" if i % 6 else f"g{i % 5}"

    df = frame(spark, m, "terms", g=group)
    near = neighbors.knn_join(df.where("id % 4 = 0"), df.where("id % 4 <> 0"), 7, by=["g"], index="terms")
    want = []
    for name in {group(i) for i in range(72)}:
        ids = [i for i in range(72) if group(i) == name]
        queries, train = [i for i in ids if i % 4 == 0], [i for i in ids if i % 4]
        want += [(name, *row) for row in brute(m, queries, train, 7, "cosine")]
    same(collected(near, "g"), sorted(want))


def test_without_itself_and_equal_to_the_block_join(spark, small_index):
    m = topics(6, 10, 3)
    df = frame(spark, m, "terms").drop("label")
    found = [
        collected(neighbors.knn_join(df, df, 4, exclude_self=True, index=index)) for index in ("terms", "blocks")
    ]
    same(*found)


def test_no_shared_term_at_all(spark):
    df = frame(spark, np.eye(6), "terms")
    near = neighbors.knn_join(df.where("id = 5"), df.where("id < 5"), 3, index="terms")
    assert collected(near) == [(5, t, t + 1, 1.0) for t in range(3)]


def test_blocks_searched_do_not_grow_with_topics(spark, small_index):
    sent, blocks = [], []
    for n_topics in (6, 24):
        df = frame(spark, topics(n_topics, 12, 4), "terms").drop("label").withColumn("g", F.lit(0))
        index = term_index.TermIndex(df, ["g"])
        asked = index.asked(df)
        homes = index.homes(asked)
        floors = df.select("g", "id", F.lit(0.6).alias("floor"))
        sent.append(index.targets(asked, homes, floors).count() / df.count())
        blocks.append(index.rows.select("block").distinct().count())
    assert blocks[1] > 3 * blocks[0]
    assert sent[1] < 0.15 * blocks[1] and sent[1] < 2 * max(sent[0], 1)


def test_wrong_uses_are_errors(spark):
    m = matrix(20, 6, 5)
    df = frame(spark, m, "terms")
    for bad in (dict(index="terms", metric="euclidean"), dict(index="trees")):
        with pytest.raises(ValueError):
            neighbors.knn_join(df, df, 2, **bad)
    with pytest.raises(ValueError):
        neighbors.knn_join(frame(spark, m, "vec"), frame(spark, m, "vec"), 2, index="terms")
    with pytest.raises(Exception, match="not negative"):
        neighbors.knn_join(df, frame(spark, -m, "terms"), 2, index="terms").collect()


def test_queries_of_many_blocks_meet_all_rows_once(spark, small_index, monkeypatch):
    monkeypatch.setattr(term_index, "MOST_TARGETS", 1)
    monkeypatch.setattr(term_index, "MOST_ENTRIES", 12)
    m = topics(6, 12, 6)
    df = frame(spark, m, "terms")
    flat = df.selectExpr("0 AS g", "id", "terms", "weights")
    index = term_index.TermIndex(flat, ["g"])
    asked = index.asked(flat)
    homes = index.homes(asked)
    floors = flat.selectExpr("g", "id", "0.2D AS floor")
    targets, wide = index._split(index.rated(asked, floors), homes)
    assert wide.count() > 0
    assert targets.groupBy("id").count().where("count > 1").count() == 0
    near = neighbors.knn_join(df.where("id < 30"), df.where("id >= 20"), 4, index="terms")
    same(collected(near), sorted(brute(m, range(30), range(20, 72), 4, "cosine")))
