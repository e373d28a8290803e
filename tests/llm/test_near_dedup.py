"""Near copies against brute force."""

from __future__ import annotations

import random

import numpy as np
import pytest

from tremolo.llm import near_dedup
from tremolo.llm._common import WordHashes

SF = "/root/testdata/sf0.001"


def brute(rows, size, percent=80):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        own = {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()
        sets[i] = own
    up = {i: i for i, _ in rows}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(i for i in sets if sets[i])
    for at, a in enumerate(ids):
        for b in ids[at + 1 :]:
            low, high = sorted((len(sets[a]), len(sets[b])))
            if 100 * low >= percent * high:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (low + high - both):
                    x, y = sorted((root(a), root(b)))
                    up[y] = x
    return sorted((i, len(sets[i]), root(i), root(i) == i) for i in up)


def run(spark, rows, size):
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, regs string, n long")
    got = near_dedup.near_components(docs, size)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    return sorted((tuple(r) for r in got.collect()), key=lambda r: (r[0] is None, r))


def edited(rng, words, share):
    return [f"new{rng.randrange(10**6)}" if rng.random() < share else w for w in words]


@pytest.mark.parametrize("size", [4, 5])
def test_components_equal_brute_force(spark, size):
    rng = random.Random(size)
    rows = []
    for _ in range(12):
        base = [f"w{rng.randrange(3_000)}" for _ in range(rng.choice([3, 8, 20, 60, 200, 600]))]
        chain = base
        for k in range(rng.randrange(1, 12)):  # stars and chains of copies
            source = base if k % 2 else chain
            chain = edited(rng, source, rng.choice([0, 0.005, 0.02, 0.04, 0.06]))
            rows.append(" ".join(chain).upper() if k % 3 == 0 else "\n ".join(chain))
    rows += ["", None, "  \t", "one", "ONE", "one two three", "one two three", "a b c d e f"]
    rng.shuffle(rows)
    rows = list(enumerate(rows))
    assert run(spark, rows, size) == brute(rows, size)


def test_many_copies_of_one_text(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "PIECE", 16)
    monkeypatch.setattr(near_dedup, "BLOCK", 32)
    rng = random.Random(9)
    base = [f"w{k}" for k in range(300)]
    # Most copies are linked with the original only, which has the largest id.
    rows = [(i, " ".join(edited(rng, base, 0.025))) for i in range(150)] + [(150, " ".join(base))]
    assert run(spark, rows, 4) == brute(rows, 4)


def test_given_texts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = sorted(tuple(r) for r in near_dedup.near_components(docs, 4).collect())
    assert got == brute(rows, 4)
    assert len({r[2] for r in got}) < len(got)


def test_nothing_and_odd_ids(spark):
    assert run(spark, [], 5) == []
    text = " ".join(f"w{k}" for k in range(50))
    rows = [(None, text), (None, ""), (4, text), (4, text), (7, text + " end")]
    got = sorted(run(spark, rows, 5), key=str)
    assert [r[2:] for r in got if r[0] is not None] == [(4, True), (4, True), (4, False)]
    assert [r[2:] for r in got if r[0] is None] == [(None, True)] * 2
    left = near_dedup.survivors(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, rep int"))
    assert left.columns == ["doc_id", "text", "rep"] and left.count() == 4


def test_registers_estimate():
    rng = np.random.default_rng(5)
    hashes = WordHashes()
    for n in (1, 5, 50, 500, 5_000):
        errors = []
        for _ in range(60):
            x = rng.integers(0, 2**63, 2 * n).astype(np.uint64)
            a, b = np.unique(x[: n + n // 3]), np.unique(x[n // 3 : n + n // 2])
            true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
            equal = (near_dedup.registers(a) == near_dedup.registers(b)).sum()
            errors.append(near_dedup.estimate(equal) - true)
        assert abs(np.mean(errors)) < 0.05
    assert len(near_dedup.shingles("a b c", 4, hashes)) == 1
