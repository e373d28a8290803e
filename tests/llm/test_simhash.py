"""Fingerprints and links against all pairs: op12."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tremolo.llm import simhash_anchors
from tremolo.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def fingerprint(text, size):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    found = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    n = len(found)
    runs = [found[i : i + size] for i in range(max(1, n - size + 1))] if found else []
    hashes = [xxhash.xxh64_intdigest(" ".join(r).encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints, threshold=4):
    """Component of each (id, print), by all pairs."""
    least = {p: min(i for i, q in prints if q == p) for _, p in prints}
    groups = {p: p for p in least}

    def root(p):
        while groups[p] != p:
            p = groups[p]
        return p

    nodes = sorted(least)
    for k, p in enumerate(nodes):
        for q in nodes[:k]:
            if (p ^ q).bit_count() <= threshold:
                groups[root(p)] = root(q)
    best = {}
    for p in nodes:
        best[root(p)] = min(best.get(root(p), least[p]), least[p])
    return {p: best[root(p)] for p in nodes}


def brute(rows, size=4, threshold=4):
    prints = [(i, fingerprint(t, size)) for i, t in rows]
    comp = components([x for x in prints if x[0] is not None], threshold)
    return sorted(((i, f"{p:016x}", None if i is None else comp[p]) for i, p in prints), key=str)


def found(spark, rows, **settings):
    docs = spark.createDataFrame([(i, t, 1, "y") for i, t in rows], "doc_id long, text string, print int, rep string")
    return sorted((tuple(r) for r in simhash_anchors.near_components(docs, **settings).collect()), key=str)


def edited(rng, words, share):
    return [rng.choice(["x", "y", "zz"]) if rng.random() < share else w for w in words]


def corpus(seed):
    rng = random.Random(seed)
    rows = []
    for k in range(12):
        base = [rng.choice("abcdefghijklm") + str(rng.randint(0, 300)) for _ in range(rng.choice([5, 60, 400]))]
        for _ in range(9):
            rows.append(" ".join(edited(rng, base, rng.choice([0, 0.002, 0.01, 0.03]))))
        base = base[:-1]
        rows.append("\n".join(base).upper())
    rows += ["", None, " \t\x0b", "one", "ONE", "one two three", "a b c d", "é è ŻÓŁĆ z", "w" * 5000]
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize(("m", "size", "threshold"), [(3, 4, 4), (2, 4, 4), (5, 2, 4), (3, 4, 7), (2, 4, 1)])
def test_components_equal_all_pairs(spark, m, size, threshold):
    rows = corpus(m)
    want = brute(rows, size, threshold)
    assert found(spark, rows, size=size, threshold=threshold, m=m) == want
    assert 3 < len({r[2] for r in want}) < len(want)


def test_crowded_anchors_and_chains(spark, monkeypatch):
    """Many prints at one anchor in pieces, few pairs at once, and chains of links."""
    monkeypatch.setattr(simhash_anchors, "HOMES", 8)
    monkeypatch.setattr(simhash_anchors, "PAIRS", 64)
    rng = random.Random(4)
    prints = {0, (1 << 64) - 1}
    for _ in range(3):
        p = rng.getrandbits(64)
        for _ in range(120):
            p ^= sum(1 << b for b in rng.sample(range(22, 64), rng.choice([1, 4, 5])))
            prints.add(p)
    prints = list(prints)
    table = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "print long")
    got = {r.node % (1 << 64): r.component % (1 << 64) for r in simhash_anchors.near_prints(table).collect()}
    want = components([(p, p) for p in prints])
    groups = {}
    for p in prints:
        groups.setdefault(want[p], set()).add(p)
    for members in groups.values():
        if len(members) == 1:
            assert not members & set(got)
        else:
            assert len({got[p] for p in members}) == 1 and got[min(members)] in members
    assert len({got[p] for p in got}) == sum(len(g) > 1 for g in groups.values())


def test_every_close_pair_meets_at_a_home():
    rng = np.random.default_rng(1)
    for threshold, m in ((4, 2), (4, 3), (4, 5), (3, 2), (6, 3)):
        spread = simhash_anchors.ranges(threshold, m)
        assert sum(share + 1 for *_, share in spread) == threshold + 1
        assert sum(bits for _, bits, _ in spread) == 64
        x = rng.integers(0, 2**63, 60).astype(np.uint64)
        y = np.array([p ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, threshold, replace=False))) for p in x])

        def places(prints, spread=spread):
            sent, home = {}, {}
            for number, anchors, of, at_home in simhash_anchors.to_anchors(prints, spread):
                for a, p, h in zip(anchors.tolist(), of.tolist(), at_home.tolist()):
                    sent.setdefault(p, set()).add((number, a))
                    if h:
                        home.setdefault(p, []).append((number, a))
            return sent, home

        (_, homes), (sent, _) = places(x), places(y)
        assert all(len(h) == m for h in homes.values())  # one home in each range
        assert all(set(homes[int(p)]) & sent[int(q)] for p, q in zip(x, y))


def test_shingle_hash_is_that_of_the_engine(spark):
    text = "b c d e"
    (value,) = spark.range(1).select(F.xxhash64(F.lit(text))).first()
    assert simhash_anchors.shingle_hashes("B  c\nd e", 4).view(np.int64).tolist() == [value]


def test_null_ids_repeated_rows_and_nothing(spark):
    assert found(spark, []) == []
    text = " ".join(f"w{k}" for k in range(50))
    rows = [(None, text), (None, None), (4, text), (4, text), (9, ""), (7, None), (4, "")]
    assert found(spark, rows) == brute(rows)
    with pytest.raises(ValueError):
        found(spark, rows, m=1)


def test_given_texts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = sorted((tuple(r) for r in QUERIES["op12_simhash_anchors"](spark, SF).collect()), key=str)
    assert got == brute(rows)
    assert len({r[2] for r in got}) < len(got)
