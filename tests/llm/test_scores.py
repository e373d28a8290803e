"""Toxicity, languages, benchmark passages, licences: brute force and accuracy."""

from __future__ import annotations

import itertools
import random
import re
import textwrap

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tremolo.llm import crf_toxicity, decontaminate, language_mix, licenses, queries
from tremolo.llm._common import WordHashes

SF = "/root/testdata/sf0.01"
EXTRA = "doc_id long, text string, score string, lang string, license string"


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "x", "en", "y") for i, t in enumerate(texts)], EXTRA)


# -- Toxicity


def test_chain_against_all_paths():
    rng = np.random.default_rng(1)
    odds, transition = rng.normal(size=9), rng.normal(size=(2, 2))
    starts = np.zeros(9, bool)
    starts[[0, 4]] = True
    chain = crf_toxicity.Chain(odds, starts, transition)
    marginal, pairs = np.zeros(9), np.zeros((2, 2))
    for low, high in ((0, 4), (4, 9)):
        total, m, e = 0.0, np.zeros(high - low), np.zeros((2, 2))
        for path in itertools.product((0, 1), repeat=high - low):
            w = sum(odds[low + i] for i, y in enumerate(path) if y)
            w = np.exp(w + sum(transition[a, b] for a, b in itertools.pairwise(path)))
            total += w
            m += w * np.array(path)
            for a, b in itertools.pairwise(path):
                e[a, b] += w
        marginal[low:high] = m / total
        pairs += e / total
    assert np.allclose(chain.marginals(), marginal)
    assert np.allclose(chain.expected_transitions(), pairs)


def test_chain_does_not_depend_on_its_rows(monkeypatch):
    rng = np.random.default_rng(2)
    odds, starts = rng.normal(size=1_000), rng.random(1_000) < 0.02
    starts[0] = True
    t = rng.normal(size=(2, 2))
    whole = crf_toxicity.Chain(odds, starts, t).marginals()
    monkeypatch.setattr(crf_toxicity.Chain, "COLUMNS", 1_000)
    assert np.allclose(whole, crf_toxicity.Chain(odds, starts, t).marginals())


def test_toxicity_held_out(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = crf_toxicity.fit(docs, labels, F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    scored = crf_toxicity.score(docs, model).join(labels, "doc_id")
    scored = scored.where(F.crc32(F.col("doc_id").cast("string")) % 5 == 0).toPandas()
    assert ((scored.score >= 0.5) == (scored.toxic == 1)).mean() > 0.93
    toxic, clean = (scored[scored.toxic == k].score.mean() for k in (1, 0))
    assert toxic > clean + 0.4


def test_labelled_texts_are_one_row_each(spark):
    rows = [(1, "a b"), (1, "a b"), (1, "c"), (2, "a b"), (3, "c"), (4, None), (None, "d"), (5, "e"), (6, "f")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, digest string")
    known = [(1, 1), (2, 1), (3, 0), (4, 1), (5, 0), (5, 0), (6, None), (None, 1)]
    labels = spark.createDataFrame(known, "doc_id long, toxic int")
    texts = crf_toxicity.labelled_texts(docs, labels, F.lit(True))
    assert sorted((r.doc_id, r.text, r.toxic) for r in texts.collect()) == [(1, "a b", 1), (1, "c", 0), (5, "e", 0)]


def test_toxic_spans_and_edges(spark):
    rng = random.Random(0)
    plain = lambda: [f"word{rng.randrange(40)}" for _ in range(8)]
    texts = [" ".join([*plain(), "stupid", *plain()]) for _ in range(60)] + [" ".join(plain()) for _ in range(60)]
    model = crf_toxicity.learn(texts, [1] * 60 + [0] * 60)
    odd = [None, "", "  \n", "Stupid, really", "fine " * 30_000 + "stupid", "fine day", "é stupid é"]
    got = {r.doc_id: r for r in crf_toxicity.score(frame(spark, odd), model).collect()}
    assert [len(got[i].spans) for i in (0, 1, 2, 5)] == [0, 0, 0, 0]
    assert got[0].score == got[1].score == got[2].score < 0.5
    assert any(odd[6][s.start : s.end] == "stupid" for s in got[6].spans)
    assert any(s.end == len(odd[4]) for s in got[4].spans)
    assert crf_toxicity.score(frame(spark, []), model).count() == 0
    for labels in ([], [0, 0], [1, 1]):
        flat = crf_toxicity.learn(["a b", "c d"][: len(labels)], labels)
        assert 0 < crf_toxicity.score(frame(spark, ["a", None]), flat).first().score < 1


def test_rare_toxic_words_are_learned_from_all_texts(spark, monkeypatch):
    """A word of 40 toxic texts among 1,200 is rare in the sample, and not rare in all
    labelled texts; long texts teach too, and repeated ids give one row."""
    rng = random.Random(3)
    plain = lambda: [f"word{rng.randrange(60)}" for _ in range(10)]
    rows = []
    for i in range(1_200):
        bad = "zyxwv" if i % 30 == 0 else "stupid"
        rows.append((i, " ".join([*plain(), *([bad] if i % 2 == 0 else []), *plain()]), i % 2 == 0))
    rows += [(5_000 + 2 * i, " ".join(["plain"] * 5_000 + [f"w{i}", "qqqqq"]), True) for i in range(40)]
    docs = spark.createDataFrame([r[:2] for r in rows] + [rows[0][:2]] * 50, "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], int(r[2])) for r in rows], "doc_id long, toxic int")
    monkeypatch.setattr(crf_toxicity, "MAX_TEXTS_PER_CLASS", 100)
    texts = crf_toxicity.labelled_texts(docs, labels, F.lit(True))
    assert crf_toxicity.training_texts(texts).count() == 200
    assert {b"zyxwv", b"qqqqq", b"stupid"} <= crf_toxicity.marking_terms(texts)
    model = crf_toxicity.fit(docs, labels, F.lit(True))
    got = crf_toxicity.score(frame(spark, ["word1 word2 zyxwv word3", "word1 word2 word3"]), model).collect()
    assert sorted(len(r.spans) for r in got) == [0, 1]


# -- Languages


def test_languages_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    found = language_mix.identify(docs, *language_mix.fit(docs.where(~held)))
    both = found.join(docs.where(held).select("doc_id", "lang"), "doc_id").toPandas()
    assert (both.lang_pred == both.lang).mean() > 0.98


def test_two_languages_in_one_text(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("n_chars > 1500")
    languages, table = language_mix.fit(docs)
    one = {lang: docs.where(F.col("lang") == lang).first().text[:1500] for lang in ("en", "de", "fr")}
    texts = [one["en"] + " " + one["de"], one["fr"], None, "", "12 34", "漢字", one["en"] * 60]
    got = {r.doc_id: r for r in language_mix.identify(frame(spark, texts), languages, table).collect()}
    assert {x.lang for x in got[0].languages} == {"en", "de"}
    assert [x.lang for x in got[1].languages] == ["fr"]
    assert [(got[i].lang_pred, got[i].score) for i in (2, 3, 4)] == [("und", 0.0)] * 3
    assert got[5].lang_pred in languages and got[6].lang_pred == "en"
    nothing = language_mix.fit(docs.limit(0))
    assert {r.lang_pred for r in language_mix.identify(frame(spark, ["a"]), *nothing).collect()} == {"und"}


def test_em_climbs():
    rng = np.random.default_rng(0)
    p = rng.dirichlet(np.ones(50), 3).T.astype(np.float32)
    weight, begin, doc = np.ones(50, np.float32), np.array([0]), np.zeros(50, int)
    fits = [language_mix._em(p, weight, begin, doc, np.full((1, 3), 1 / 3, np.float32), n)[1][0] for n in range(8)]
    assert all(b >= a - 1e-4 for a, b in itertools.pairwise(fits))


# -- Benchmark passages


def longest(a, b):
    """By hand: all aligned stretches."""
    best = 0
    for shift in range(-len(b) + 1, len(a)):
        low, high = max(0, shift), min(len(a), shift + len(b))
        same = [a[i] == b[i - shift] for i in range(low, high)]
        for i in range(len(same)):
            for j in range(i, len(same)):
                n = j - i + 1
                if n > best and same[i] and same[j] and sum(same[i : j + 1]) * 5 >= 4 * n and n >= min(13, len(b)):
                    best = n
    return best


def test_passages(spark):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(2_000)] + ["the", "of", "to", "a"] * 20
    words_ = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [words_(n) for n in (3, 5, 6, 7, 10, 12, 20, 30, 40, 50)]
    texts, want = [], set()
    for n in range(120):
        own = words_(60)
        item = rng.randrange(len(items))
        piece = list(items[item])
        if n % 3:
            if n % 3 == 2:  # at most one word in ten is another one
                for k in rng.sample(range(len(piece)), len(piece) // 10):
                    piece[k] = "other"
            own[30:30] = piece
        texts.append(", ".join(own).replace("w1", "W1") if n % 2 else " ".join(own))
    for i, text in enumerate(texts):
        for k, item in enumerate(items):
            if longest([w.strip(",") for w in text.lower().split()], item):
                want.add((i, k))
    assert len(want) > 50
    bench = spark.createDataFrame([(k, " ".join(i), "z") for k, i in enumerate(items)], "item_id long, text string, doc_id string")
    got = decontaminate.find(frame(spark, [*texts, None, ""]), bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want
    left = decontaminate.clean(frame(spark, [*texts, None, ""]), bench)
    assert left.columns == ["doc_id", "text", "score", "lang", "license"]
    assert {r.doc_id for r in left.collect()} == set(range(122)) - {i for i, _ in want}


@pytest.mark.parametrize("n", range(1, 18))
def test_recall_of_substitutions(n):
    """All placements of the most words that may be substituted in n words."""
    hashes = WordHashes()
    words_ = [f"w{k}" for k in range(n)]
    whole = decontaminate.word_hashes(" ".join(words_), hashes)
    used = decontaminate.masks(n)
    seeds = [set(v.tolist()) for v, _ in decontaminate.seeds(whole, used)]
    found = total = 0
    for places in itertools.combinations(range(1, n - 1), n // 5):
        text = " ".join("other" if k in places else w for k, w in enumerate(words_))
        other = decontaminate.seeds(decontaminate.word_hashes(f"x {text} y", hashes), used)
        found += any(s & set(v.tolist()) for s, (v, _) in zip(seeds, other, strict=True))
        total += 1
    assert total and (found == total if n < decontaminate.MIN_WORDS else found >= 0.97 * total)


def test_short_items(spark):
    bench = spark.createDataFrame([(1, "Yes."), (2, "one two"), (3, "a b c d e"), (4, ""), (5, "a b X d e f")], "item_id long, text string")
    texts = ["yes, yes yes", "one  TWO", "two one", "z a b q d e f", "a q c d e", "q b c d e", "no"]
    got = {(r.doc_id, r.item_id, r.overlap_words, r.equal_words) for r in decontaminate.find(frame(spark, texts), bench).collect()}
    assert got == {(0, 1, 1, 1), (1, 2, 2, 2), (3, 3, 5, 4), (3, 5, 6, 5), (4, 3, 5, 4)}


def test_passages_of_nothing(spark):
    bench = spark.createDataFrame([(0, None), (1, "")], "item_id long, text string")
    assert decontaminate.find(frame(spark, ["a b c d e f g h"]), bench).count() == 0
    assert decontaminate.find(frame(spark, []), bench.limit(0)).count() == 0


def test_ignored_words_do_not_change_a_seed():
    hashes = WordHashes()
    a, b = (decontaminate.word_hashes(t, hashes) for t in ("a b c d e f g h", "a b c X e f Y h"))
    same = [(x == y).any() for (x, _), (y, _) in zip(decontaminate.seeds(a), decontaminate.seeds(b), strict=True)]
    assert same == [m in ("11101101",) for m in decontaminate.MASKS]


def test_forgotten_words_do_not_change_a_score(monkeypatch):
    rng = random.Random(3)
    common = [f"w{i}" for i in range(30)]
    texts = [
        " ".join(rng.choice(common) if rng.random() < 0.5 else f"x{rng.random()}" for _ in range(40))
        for _ in range(200)
    ]
    texts += ["", None, " ".join(f"y{i}" for i in range(500))]
    model = crf_toxicity.learn(texts[:100], [i % 2 for i in range(100)])
    whole, _ = crf_toxicity.Scorer(model)(texts)
    monkeypatch.setattr(crf_toxicity, "_WORDS_KEPT", 60)
    scorer = crf_toxicity.Scorer(model)
    parts = [scorer(texts[i : i + 5])[0] for i in range(0, len(texts), 5)]
    np.testing.assert_allclose(np.concatenate(parts), whole, rtol=1e-9)


# -- Licences


def test_licenses(spark):
    known = licenses.KNOWN
    mit = next(t for n, t in known if n == "MIT" and len(t) > 100)
    texts = [
        mit, "MIT licence text\n", "Copyright (c) 2020 A. Person\n\n" + mit.upper().replace(",", " ,\n"),
        "some text\nReleased under the MIT licence\nmore\nLICENSED UNDER CC BY-NC 4.0", None, "", "© 2020 me",
    ]
    got = {r.doc_id: r for r in licenses.scan(frame(spark, texts)).collect()}
    assert [got[i].license for i in range(7)] == ["MIT", None, "MIT", None, None, None, None]
    assert got[3].line_licenses == ["CC-BY-NC-4.0", "MIT"]
    assert got[4].digest == got[5].digest == got[6].digest
    with pytest.raises(ValueError):
        licenses.known_digests(spark, [("a", "b")] * 6_000)


def _wrapped(text, width):
    """All paragraphs at one width; at width 0 the whole text is one line."""
    paragraphs = [" ".join(p.split()) for p in re.split(r"\n\s*\n", text.strip())]
    return "\n\n".join(textwrap.fill(p, width, break_long_words=False) for p in paragraphs) if width else " ".join(paragraphs)


@pytest.mark.parametrize("width", [0, 40, 50, 72, 79, 100, 10**6])
def test_whole_license_texts(spark, width):
    """Whole texts of every licence at every width, in capitals, with another owner."""
    known = [*licenses.whole_texts(), *((n, t) for n, t in licenses.KNOWN if len(t) > 300)]
    texts = ["Copyright (c) 2021 A. Person\nand others\n\n" + _wrapped(t, width) for _, t in known]
    texts += [_wrapped(t, width).upper() + "\r\n" for _, t in known]
    got = {r.doc_id: r.license for r in licenses.scan(frame(spark, texts)).collect()}
    names = [n for n, _ in known]
    assert [got[i] for i in range(len(texts))] == names + names


def test_license_titles_and_statements(spark):
    mit = next(t for n, t in licenses.KNOWN if n == "MIT" and len(t) > 100)
    isc = next(t for n, t in licenses.KNOWN if n == "ISC" and len(t) > 100)
    whole = dict(licenses.whole_texts())
    bsd = whole["BSD-2-Clause"].split("\n", 1)[1]
    wanted = {
        f"MIT License\n\nCopyright (c) 2020 A. Person\n\n{_wrapped(mit, 50)}": "MIT",
        f"The MIT License (MIT)\n\nCopyright © A. Person <a@b.c>\n\n{mit}": "MIT",
        f"MIT Licence Copyright 2020-2024, A. Person and others. All rights reserved. {mit}": "MIT",
        f"ISC License\n\nCopyright (c) 2004-2010 by A. Person\n\n{_wrapped(isc, 60)}": "ISC",
        f"BSD 2-Clause License\n\n(c) 2020, A. Person\nAll rights reserved.\n{_wrapped(bsd, 72)}": "BSD-2-Clause",
        f"The Unlicense\n\n{whole['Unlicense']}": "Unlicense",
        f"{mit}\n\nNo use on Sundays.": None,
        mit.replace("without restriction", "with restriction"): None,
        "MIT License": None,
        "Copyright notices are kept. Licensed under CC BY-NC 4.0.": None,
        "Copyright 2020 A. Person. Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0",
    }
    got = {r.doc_id: r.license for r in licenses.scan(frame(spark, list(wanted))).collect()}
    assert [got[i] for i in range(len(wanted))] == list(wanted.values())


def test_license_twin(spark):
    """The twin finds whole texts too, at other widths than those of the files."""
    texts = [_wrapped(t, 61) for _, t in licenses.whole_texts()]
    texts += ["© 2020 me", None, "", "a\x0bb\u2028Copyright (c) x\u2029y", "(c) 1999 z\r\n\r\n\tMIT\r\nlicence text"]
    docs = frame(spark, texts)
    con = duckdb.connect()
    con.register("documents", docs.toArrow())
    want = con.execute(queries.OP3_SQL).fetchall()
    got = licenses.scan(docs).withColumn("line_licenses", F.array_join("line_licenses", ","))
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_fitting_the_field_holds_few_numbers_a_name():
    """pipeline, op1_toxicity: steps of one row of weights are dropped before the next."""
    import tracemalloc

    from tremolo.llm import crf_toxicity

    texts = [" ".join(f"{chr(97 + i % 26)}x{i * 40 + j}y{j}" for j in range(40)) for i in range(250)]
    texts = [t + (" vile" if i % 2 else " mild") for i, t in enumerate(texts)]
    tracemalloc.start()
    model = crf_toxicity.learn(texts, [i % 2 for i in range(250)], epochs=2, marking={b"vile"})
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak / len(model.names) < 300


def test_terms_of_a_word_are_made_once():
    from tremolo.llm import crf_toxicity

    known = crf_toxicity._WordTerms()
    assert set(known[b"(vilest)"]) == {b"vil", b"vile", b"viles", b"vilest"}
    assert known[b"(vilest)"] is known[b"(vilest)"]
    known.LIMIT = 2
    for word in (b"a", b"b", b"c"):
        assert known[word] == (word,)
    assert len(known) <= 2
