"""Product codes against a plain version in Python integers: op11."""

from __future__ import annotations

import hashlib
import math
import random
from pathlib import Path

import numpy as np
import pytest

from tests.check_oracles import connect, differences
from tremolo.llm import vector_codes
from tremolo.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, vector array<float>, label int, code string, ids int"


def brute(rows, parts, entries, rounds, scale=256):
    kept = [(i, v, label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    dim = next((len(v) for _, v, _ in kept if v and len(v) % parts == 0), None)
    fits = [r for r in kept if len(r[1]) == dim and all(abs(x) < 65536 for x in r[1])]
    other = [r for r in kept if r not in fits]
    d = dim // parts
    cut = [
        [tuple(math.floor(scale * x) for x in np.float32(v[p * d : (p + 1) * d]).tolist()) for p in range(parts)]
        for _, v, _ in fits
    ]
    books = [[row[p] for row in cut[:entries]] for p in range(parts)]

    def nearest(point, book):
        return min((sum((a - b) ** 2 for a, b in zip(point, e)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for row in cut:
                groups.setdefault(nearest(row[p], books[p])[1], []).append(row[p])
            for k, members in groups.items():
                books[p][k] = tuple(sum(c) // len(members) for c in zip(*members))
    out = []
    for (i, _, label), row in zip(fits, cut):
        found = [nearest(row[p], books[p]) for p in range(parts)]
        out.append([i, label, "".join(f"{k:02x}" for _, k in found), sum(g for g, _ in found)])
    flat = ",".join(str(c) for b in books for e in b for c in e)
    sums = {}
    for _, label, _, error in out:
        sums[label] = sums.get(label, 0) + error
    out += [[i, label, None, None] for i, _, label in other]
    sha = hashlib.sha256(flat.encode()).hexdigest()
    return sorted(((i, code, error, sums.get(label), sha) for i, label, code, error in out), key=str)


def found(spark, rows, **settings):
    table = spark.createDataFrame([(*r, "x", 7) for r in rows], SCHEMA)
    got = vector_codes.compress(table, **settings)
    columns = ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    return sorted((tuple(r) for r in got.select(*columns).collect()), key=str)


@pytest.mark.parametrize(("parts", "dim", "entries", "n"), [(4, 8, 5, 90), (2, 2, 3, 40), (16, 64, 64, 200), (1, 70, 8, 50)])
def test_codes_equal_plain_integers(spark, monkeypatch, parts, dim, entries, n):
    monkeypatch.setattr(vector_codes, "SEGMENT", 37)
    rng = random.Random(dim)
    spread = (0.01, 0.2, 3.0)
    rows = [(i, [float(np.float32(rng.gauss(0, spread[i % 3]))) for _ in range(dim)], rng.choice([0, 1, None])) for i in range(n)]
    rng.shuffle(rows)
    assert found(spark, rows, parts=parts, entries=entries) == brute(rows, parts, entries, 2)


def test_odd_rows(spark):
    rows = [
        (5, [0.5, -0.25, 1.0, 0.0], 1), (5, [0.5, -0.25, 1.0, 0.0], 1), (5, [0.25, -0.25, 1.0, 0.0], None),
        (1, None, 1), (2, [], 1), (3, [1.0, None, 0.0, 0.0], 2), (4, [math.nan, 1.0, 0.0, 0.0], 2),
        (6, [math.inf, 1.0, 0.0, 0.0], 2), (7, [1.0, 2.0], 2), (8, [1e30, 0.0, 0.0, 0.0], 3),
        (None, [0.125, 0.0, -7.0, 2.0], 3), (9, [0.0, 0.0, 0.0, 0.0], None), (10, [1.0, 2.0, 3.0], 1),
    ]
    rows[8] = (70, [1.0, 2.0], 2)  # another length than the smallest id's
    got = found(spark, rows, parts=2, entries=3)
    assert got == brute(rows, 2, 3, 2)
    assert len(got) == 9 and sum(r[1] is None for r in got) == 4


def test_nothing_to_code(spark):
    assert found(spark, []) == []
    assert found(spark, [(1, None, 1), (2, [1.0, None], 1)]) == []
    assert found(spark, [(1, [1.0] * 5, 1)]) == [(1, None, None, None, None)]
    with pytest.raises(ValueError):
        found(spark, [], entries=257)


def test_neighbours_on_the_curve_are_neighbours():
    for d, side in ((2, 16), (3, 8), (5, 4)):
        cells = np.stack(np.meshgrid(*[np.arange(side)] * d, indexing="ij"), -1).reshape(-1, d)
        keys = vector_codes.hilbert_keys(cells)
        assert len(np.unique(keys)) == len(cells)
        steps = np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(axis=1)
        assert (steps == 1).all()


def test_short_lists_keep_the_nearest_and_ties():
    rng = np.random.default_rng(3)
    shorter = 0
    for n, k, wide in ((1, 1, 3), (700, 40, 9), (900, 64, 400), (33, 7, 2)):
        points, book = rng.integers(-wide, wide, (n, 3)), rng.integers(-wide, wide, (k, 3))
        book[k // 2] = book[0]
        blocks = vector_codes.cut_blocks(points)
        gap = ((points[:, None] - book[None]) ** 2).sum(axis=2)
        entry, error = vector_codes.codes(blocks, book)
        assert (entry == gap.argmin(axis=1)).all() and (error == gap.min(axis=1)).all()
        sums, counts = vector_codes.totals(blocks, book)
        assert (counts == np.bincount(entry, minlength=k)).all()
        assert all((sums[e] == points[entry == e].sum(axis=0)).all() for e in range(k))
        shorter += (vector_codes.short_lists(blocks, book).mean() < 0.8) * n
    assert shorter >= 900


def test_query_equals_sql(spark):
    if not Path(SF).exists():
        pytest.skip("no test data here")
    got = QUERIES["op11_vector_codes"](spark, SF).toPandas()
    assert differences(got, connect(SF).execute(ORACLES["op11_vector_codes"]).df()) is None
