"""Exact round trips and brute force: op2, op5, op7, op8."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tremolo.llm import exact_dedup, piece_prefix, token_files, url_blocks
from tremolo.llm._components import components
from tremolo.llm.queries import tokenizer

DOCS = "doc_id long, text string, digest string, n long"


def odd_texts(n, seed=0):
    rng = random.Random(seed)
    letters = "aAbBeErt nds  \t\n\r\x0b.,'s1٣é́▁<s></s>|ß漢字😀　‍ﬁǅİĳ-_"
    out = [None, "", " ", "  ", "\n", "▁", "x" * 300, " " * 70 + "a", "<|endoftext|> b", "İ" * 20]
    out += ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(n)]
    return out


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], DOCS)


# -- SentencePiece


@pytest.fixture(scope="module")
def pieces():
    import sentencepiece

    path = tokenizer("piece_bpe_32k.model")
    return path, sentencepiece.SentencePieceProcessor(model_file=path)


def test_pieces_equal_the_library(spark, pieces):
    path, library = pieces
    texts = odd_texts(400) + ["The quick  brown fox.\nIt's 2024, naïve café — ok?" * 30]
    got = {r.doc_id: r for r in piece_prefix.encode_texts(frame(spark, texts), path).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        want = library.encode(text or "", add_eos=True)
        assert got[i].ids == want, repr(text)
        assert got[i].decoded == library.decode(want), repr(text)


def test_pieces_of_the_given_texts(spark, pieces):
    path, library = pieces
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60)
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in piece_prefix.encode_texts(docs, path).collect():
        assert r.ids == library.encode(texts[r.doc_id] or "", add_eos=True)


def test_decoding_any_ids(pieces):
    path, library = pieces
    enc, rng = piece_prefix.encoder(path), random.Random(3)
    for _ in range(300):
        ids = [rng.choice([rng.randrange(3, 259), rng.randrange(259, 32_000)]) for _ in range(6)]
        text = "".join(enc.text_of[i] for i in ids if i > 258)
        if all(i > 258 for i in ids) and text:
            assert enc.decode(ids) == library.decode(ids)


def test_pieces_of_an_empty_table(spark, pieces):
    assert piece_prefix.encode_texts(frame(spark, []), pieces[0]).count() == 0


# -- Exact copies


def by_hand(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    return sorted((i, max(groups[t or ""]), len(groups[t or ""]), i == max(groups[t or ""])) for i, t in rows)


@pytest.mark.parametrize("weak", [False, True])
def test_copies(spark, weak):
    rng = random.Random(1)
    texts = [rng.choice(["", None, "a", "a ", "A", "long " * 500, f"own {i}"]) for i in range(200)]
    rows = list(enumerate(texts))
    digest = (lambda t: F.sha2(F.length(t).cast("string"), 256)) if weak else exact_dedup.sha256
    got = exact_dedup.group_copies(frame(spark, texts), exact_dedup.batches(F.col("doc_id")), digest)
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got.collect()) == by_hand(rows)


def test_copies_none_and_repeated_rows(spark):
    assert exact_dedup.group_copies(frame(spark, []), F.lit(None).cast("int")).count() == 0
    twice = frame(spark, ["a", "b"]).union(frame(spark, ["a", "b"]))
    got = exact_dedup.group_copies(twice, exact_dedup.batches(F.col("doc_id"))).collect()
    assert [(r.group_size, r.kept) for r in got] == [(2, True)] * 4
    kept = exact_dedup.survivors(frame(spark, ["a", "b", "a", None, ""]), exact_dedup.batches(F.col("doc_id")))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 4]
    assert kept.columns == ["doc_id", "text", "digest", "n"]


@pytest.mark.parametrize("weak", [False, True])
def test_copies_with_null_ids_and_clashing_columns(spark, weak):
    rows = [(None, "a", "x"), (1, "a", "y"), (2, "b", "z"), (None, "c", "v"), (None, "c", "w"), (None, "d", "u")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __digest string")
    digest = (lambda t: F.sha2(F.length(t).cast("string"), 256)) if weak else exact_dedup.sha256
    for snapshot in (F.lit(None).cast("int"), F.lit(0), exact_dedup.batches(F.col("doc_id"))):
        got = exact_dedup.group_copies(docs, snapshot, digest).collect()
        found = sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got), key=str)
        assert found == sorted(
            [(None, 1, 2, False), (1, 1, 2, True), (2, 2, 1, True), (None, None, 2, True), (None, None, 2, True), (None, None, 1, True)],
            key=str,
        )
    kept = exact_dedup.survivors(docs, exact_dedup.batches(F.col("doc_id")))
    assert kept.columns == docs.columns
    assert sorted(r["__digest"] for r in kept.collect()) == ["u", "v", "w", "y", "z"]


@pytest.mark.parametrize("n", [0, 1, 2, 3, 10, 100, 5_000, 60_000])
def test_fuse_filter(n):
    rng = np.random.default_rng(n)
    keys = rng.integers(0, 2**64, n, dtype=np.uint64)
    packed = exact_dedup.FuseFilter.from_bytes(exact_dedup.FuseFilter.build(keys).to_bytes())
    assert packed.contains(keys).all()
    assert packed.contains(rng.integers(0, 2**64, 100_000, dtype=np.uint64)).mean() < 0.001


# -- Token files


def test_token_files(spark, tmp_path):
    from tokenizers import Tokenizer

    path = tokenizer("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    texts = ["Word. word, WORD; Été. été; ÉTÉ a.b .a 's. it's. Straße: ǅ. ²."] + odd_texts(300, 5) + ["many words of one text " * 3_000]
    docs = frame(spark, texts).repartition(5)
    manifest = token_files.write(docs, path, str(tmp_path / "out"), end_id=2, length=16)
    got = {r.doc_id: r for r in token_files.read_documents(manifest, str(tmp_path / "out")).collect()}
    start, stream = 0, []
    for i, text in enumerate(texts):
        ids = library.encode(text or "", add_special_tokens=False).ids + [2]
        assert (got[i].start, got[i].n_tokens) == (start, len(ids)), repr(text)
        assert got[i].ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
        stream += ids
    again = []
    for row in manifest.orderBy("file").collect():
        reader = token_files.open_file(str(tmp_path / "out"), f"{row.file}.arrow")
        for k in range(row.n_sequences):
            ids, mask = token_files.sequence(reader, k)
            assert len(ids) == len(mask) == 16 and not ids.flags.owndata
            again += ids[mask].tolist()
    assert again == stream


def test_token_files_of_nothing(spark, tmp_path):
    path = tokenizer("word_bpe_49k.json")
    manifest = token_files.write(frame(spark, []), path, str(tmp_path / "none"), end_id=2)
    assert token_files.read_documents(manifest, str(tmp_path / "none")).count() == 0


# -- URLs


def test_components(spark):
    rng = random.Random(2)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(150)] + [(0, i) for i in range(400, 500)]
    pairs += [(i, i + 1) for i in range(600, 640)]
    up = {x: x for p in pairs for x in p}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    want = {x: root(x) for a, b in pairs for x in (a, b) if any(p[0] != p[1] and x in p for p in pairs)}
    edges = spark.createDataFrame(pairs, "a long, b long")
    got = {r.node: r.component for r in components(edges, "a", "b").collect()}
    assert got == want
    assert components(edges.limit(0), "a", "b").count() == 0


def test_urls(spark):
    link = '<LINK href="{}" rel=canonical>'
    go = "<meta http-equiv='refresh' content='0; url={}'>"
    rows = [
        (1, "http://A.net/es/x", ""),  # blocked by rule
        (2, "http://b.org/1", link.format("http://A.net/es/x")),  # alias of it
        (3, "http://b.org/2", go.format("/1")),  # alias of the alias
        (4, "http://c.com/4", link.format("http://b.org/2#part")),  # own allow rule
        (5, "http://c.org/5", link.format("http://c.com/4")),  # reached through it
        (6, "http://d.org/", None), (7, None, link.format("http://A.net/es/x")), (8, "no scheme", ""),
        (2, "http://b.org/1#again", ""), (9, "http://www.example.com/en/", ""),
        (10, "http://m.example.com/en/q?x", ""), (11, "http://d.net/es", ""), (12, "http://x.com", ""),
        (13, "http://d.org/sub/", link.format("//d.org/")), (None, "http://e.net/fr/", ""),
    ]
    from tremolo.llm.queries import URL_RULES

    pages = spark.createDataFrame([(*r, "v") for r in rows], "page_id long, url string, html string, verdict string")
    got = url_blocks.judge(pages, URL_RULES).collect()
    assert len(got) == len(rows)
    verdicts = sorted(((r.page_id, r.verdict, r.rule) for r in got), key=str)
    want = [(1, "block", "net/es/"), (2, "block", None), (2, "block", None), (3, "block", None),
            (4, "allow", "com/"), (5, "block", None), (6, "allow", None), (7, "allow", None),
            (8, "allow", None), (9, "allow", "www.example.com/en/"), (10, "block", "example.com/en/"),
            (11, "allow", None), (12, "allow", None), (13, "allow", None), (None, "block", "net/fr/")]
    assert verdicts == sorted(want, key=str)


def test_long_rule_lists_are_joined(spark, monkeypatch):
    rng = random.Random(9)
    names = ["a", "b", "a.b", "b.a.b", "c.a.b", "ab", ""]
    paths = ["", "/", "/x", "/x/", "/x/y", "/y"]
    rules = [(rng.choice(["allow", "block"]), rng.choice(names[:-1]), rng.choice(paths[1:])) for _ in range(60)]
    rows = spark.createDataFrame([(h, p) for h in names for p in paths] * 2, "host string, path string")
    short = url_blocks.with_rule(rows, rules).collect()
    monkeypatch.setattr(url_blocks, "MAX_RULES", 10)
    long = url_blocks.with_rule(rows, rules).collect()
    assert sorted(map(str, short)) == sorted(map(str, long)) and any(r.match for r in short)


#: base, link, what RFC 3986 makes of it (its own list of examples and others)
RESOLVED = [
    *[("http://a/b/c/d;p?q", link, want) for link, want in [
        ("g", "http://a/b/c/g"), ("./g", "http://a/b/c/g"), ("g/", "http://a/b/c/g/"), ("/g", "http://a/g"),
        ("//g", "http://g"), ("?y", "http://a/b/c/d;p?y"), ("g?y", "http://a/b/c/g?y"), ("#s", None),
        ("g#s", "http://a/b/c/g"), (";x", "http://a/b/c/;x"), (".", "http://a/b/c/"), ("./", "http://a/b/c/"),
        ("..", "http://a/b/"), ("../", "http://a/b/"), ("../g", "http://a/b/g"), ("../..", "http://a/"),
        ("../../g", "http://a/g"), ("../../../g", "http://a/g"), ("/./g", "http://a/g"), ("/../g", "http://a/g"),
        ("g.", "http://a/b/c/g."), ("..g", "http://a/b/c/..g"), ("./g/.", "http://a/b/c/g/"),
        ("g/../h", "http://a/b/c/h"), ("g?y/../x", "http://a/b/c/g?y/../x"), ("mailto:x@y", None), ("", None)]],
    ("http://site.com", "example.com/en/x", "http://site.com/example.com/en/x"),
    ("http://site.com?q=/z", "x", "http://site.com/x"), ("no scheme", "x", None),
    ("HTTP://Site.COM/a", "HTTPS://Other.NET/b/../c?D", "https://other.net/c?D"),
    ("http://a/b", "c?x=1&amp;y=2&#38;z&#x2F;&#47;&amp;#47;", "http://a/c?x=1&y=2&z//&#47;"),
]


def test_links_are_resolved(spark):
    rows = [(k, base, f'<link rel="canonical" href="{link}">') for k, (base, link, _) in enumerate(RESOLVED)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = sorted((_lowered(b), t) for b, _, t in RESOLVED if t)
    # "&#47;" of the last row: its fragment goes
    want = [(b, t.split("#")[0]) for b, t in want]
    assert sorted((r.page, r.target) for r in url_blocks.link_edges(pages).collect()) == want


def _lowered(url):
    scheme, _, rest = url.partition("://")
    name, slash, path = rest.partition("/")
    return f"{scheme.lower()}://{name.lower()}{slash}{path}" if rest else url


def planted_pages(n, seed=4):
    """Pages on few addresses, joined by links written in many ways."""
    rng = random.Random(seed)
    hosts = ["a.net", "B.org", "c.com", "d.org", "www.example.com", "M.example.com", "e.org"]
    spots = ["/", "/es/x", "/fr/y", "/en/z", "/1", "/2/3", "/2/4?q=1", ""]
    address = lambda: rng.choice(["http://", "HTTP://"]) + rng.choice(hosts) + rng.choice(spots)
    forms = [
        "<link rel=canonical href={}>", '<LINK HREF = " {} " Rel="shortlink Canonical">', "<!-- <link rel=canonical href={}> -->",
        "<meta http-equiv='Refresh' content='0; URL={}'>", '<meta content="5;\'{}\'" http-equiv="refresh">',
        "<link rel=stylesheet href={}>", "<script>'<link rel=canonical href={}>'</script>", "<meta http-equiv=refresh content=5>",
        "<link rel=canonical data-href={} >", "<a href={}>", "<link rel='canonical' href='{}'/><link rel='canonical' href='/1'>",
    ]
    links = [address, lambda: rng.choice(["../es/x", "/1", "3", "?q=1", "//A.net/es/x", "&#x2F;2&#47;3", "./.././2/4?q=1", "#x", "mailto:a@b"])]
    rows = [(i, address(), rng.choice(forms).format(rng.choice(links)()) + "\n" * rng.randrange(2)) for i in range(n)]
    return rows + [(n, None, ""), (n + 1, "x", None), (n + 2, "http://f.org/é", "<link rel=canonical href=http://a.net/es/x")]


@pytest.mark.parametrize("n", [30, 80, 200])
def test_linked_pages_equal_sql(spark, n):
    import duckdb

    from tremolo.llm.queries import OP8_SQL, URL_RULES

    rows = planted_pages(n, seed=n)
    con = duckdb.connect()
    con.register("pages", pd.DataFrame(rows, columns=["page_id", "url", "html"]))
    got = url_blocks.judge(spark.createDataFrame(rows, "page_id long, url string, html string"), URL_RULES).collect()
    columns = ["page_id", "host", "path", "rule", "verdict", "spread"]
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({OP8_SQL})").fetchall()
    assert sorted(tuple(r[c] for c in columns) for r in got) == sorted(want)
    assert any(r.spread for r in got)


def test_url_twin(spark):
    import duckdb

    from tremolo.llm.queries import OP8_SQL, URL_RULES

    pages = pd.DataFrame(
        [(1, "http://a.net/es/x", ""), (2, "http://b.org/1", '<link rel="canonical" href="http://a.net/es/x">'),
         (3, "http://b.org/2", '<meta http-equiv="refresh" content="0;url=/1">'), (4, None, None)],
        columns=["page_id", "url", "html"],
    )
    con = duckdb.connect()
    con.register("pages", pages)
    got = url_blocks.judge(spark.createDataFrame(pages, "page_id long, url string, html string"), URL_RULES)
    want = {(r[0], r[4], bool(r[5])) for r in con.execute(OP8_SQL).fetchall()}
    assert {(r.page_id, r.verdict, r.spread) for r in got.collect()} == want


def test_chunks_equal_the_library():
    from tokenizers import Tokenizer

    path = tokenizer("word_bpe_49k.json")
    library, encoder = Tokenizer.from_file(path), token_files.ChunkEncoder(path)
    texts = odd_texts(3_000, seed=5) + [
        "J̌ H̱ W̊ É COLE l'Été'S ÀÞ×÷ÿ ŒUVRE cœur. x%%% y*** don't we'LL", "İ>* İ. <|EndOfText|> a<|endoftext|>b",
        "יִ! ª! K. ΟΔΟΣ\n\nnaïve", "\x1c\x85\xa0a　b",
    ]
    for text in texts:
        want = np.array(library.encode(text or "", add_special_tokens=False).ids, "<u4").tobytes()
        assert encoder.encode([text]) == [want], repr(text)
