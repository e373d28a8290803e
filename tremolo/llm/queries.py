"""The operators applied to the given tables, with SQL twins where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    crf_toxicity,
    decontaminate,
    exact_dedup,
    hpyp,
    language_mix,
    licenses,
    near_dedup,
    piece_prefix,
    simhash_anchors,
    target_resampling,
    token_files,
    url_blocks,
    vector_codes,
)
from ._common import folded, read

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op1_toxicity")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    model = crf_toxicity.fit(docs, labels, ~folded(F.col("doc_id"), 5, 0))
    return crf_toxicity.score(docs, model).select(
        "doc_id",
        folded(F.col("doc_id"), 5, 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        F.size("spans").alias("n_spans"),
        F.transform("spans", lambda s: F.struct(s["start"], s["end"])).alias("spans"),
    )


@query("op2_sentencepiece")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    coded = piece_prefix.encode_texts(docs, tokenizer("piece_bpe_32k.model"))
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _canonical_sql(text: str) -> str:
    found = f"lower(coalesce({text}, ''))"
    for pattern, kept in licenses.STEPS:
        found = f"regexp_replace({found}, {_quoted(pattern)}, {_quoted(kept.format(chr(92) + '1'))}, 'g')"
    found = f"trim({found})"
    for other, one in licenses.SPELLINGS:
        found = f"replace({found}, '{other}', '{one}')"
    return f"regexp_replace({found}, {_quoted(licenses.TITLE)}, '')"


_KNOWN_ROWS = ", ".join(
    f"({i}, {_quoted(name)}, {_quoted(text)})"
    for i, (name, text) in enumerate([*licenses.KNOWN, *licenses.whole_texts()])
)
OP3_SQL = f"""WITH known AS (
  SELECT sha256({_canonical_sql('t')}) AS d, min_by(name, i) AS license
  FROM (VALUES {_KNOWN_ROWS}) k(i, name, t) GROUP BY 1),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents),
lined AS (SELECT doc_id, list_sort(list_distinct(list(license))) AS line_licenses
  FROM lines JOIN known ON sha256({_canonical_sql('line')}) = d GROUP BY doc_id),
whole AS (SELECT doc_id, sha256({_canonical_sql('text')}) AS digest FROM documents)
SELECT doc_id, digest, known.license, array_to_string(coalesce(line_licenses, []), ',') AS line_licenses
FROM whole LEFT JOIN known ON digest = d LEFT JOIN lined USING (doc_id)"""


@query("op3_license_digests", OP3_SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(read(spark, sf_dir, "documents"))
    return found.withColumn("line_licenses", F.array_join("line_licenses", ","))


@query("op4_decontaminate")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for every text and benchmark item that share a passage."""
    found = decontaminate.find(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.withColumn("contaminated", F.lit(True))


@query(
    "op5_exact_dedup",
    """SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
    doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
    FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""",
)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two stored snapshots and a new batch, dealt by the id's hash."""
    docs = read(spark, sf_dir, "documents")
    groups = exact_dedup.group_copies(docs, exact_dedup.batches(F.col("doc_id")))
    return groups.withColumnRenamed("digest", "text_sha256")


@query("op6_near_dedup")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_components(read(spark, sf_dir, "documents"), size=4, percent=80)


@query("op7_token_files")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    folder = token_files.scratch_folder(spark)
    manifest = token_files.write(docs, tokenizer("word_bpe_49k.json"), folder, end_id=2)
    return token_files.read_documents(manifest, folder)


#: The rules of the query: verdict, host, start of the path.
URL_RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)

_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_RULE_ROWS = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in URL_RULES)
_SITE = r"[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*"


def _sql_value(text: str, pattern: str) -> str:
    """SQL of the three forms of a quoted or unquoted value."""
    quoted = pattern.replace("'", "''")
    return "trim(" + " || ".join(f"regexp_extract({text}, '{quoted}', {k})" for k in (1, 2, 3)) + ")"


def _sql_attribute(name: str) -> str:
    return _sql_value("tag", rf"""(?is)[\s"'/]{name}\s*=\s*(?:"([^"]*)|'([^']*)|([^\s"'>]+))""")


def _sql_node(url: str) -> str:
    site = f"translate(regexp_extract({url}, '^({_SITE})', 1), {_AZ})"
    return f"{site} || regexp_extract({url}, '^(?:{_SITE})?([^#]*)', 1)"


_NUMBERED = (
    "&#(?:0*(?:3[3-79]|[4-9][0-9]|1[01][0-9]|12[0-6])|[xX]0*(?:2[1-57-9a-fA-F]|[3-6][0-9a-fA-F]|7[0-9a-eA-E]));"
)
_REFRESHED = r"""(?is)^\s*[0-9.]+[;,\s]\s*(?:url\s*=\s*)?(?:"([^"]*)|'([^']*)|(.*))"""
OP8_SQL = rf"""WITH RECURSIVE
pages_ AS (SELECT page_id, html, url, {_sql_node("url")} AS node FROM pages),
tags AS (SELECT url, unnest(regexp_extract_all(
    regexp_replace(html, '(?is)<!--.*?(?:-->|\z)|<script\b.*?(?:</script|\z)', ' ', 'g'),
    '(?is)<(?:link|meta)\b[^>]*>')) AS tag FROM pages_ WHERE url IS NOT NULL),
written AS (SELECT url, CASE
  WHEN regexp_matches(tag, '(?i)^<link') AND regexp_matches({_sql_attribute("rel")}, '(?i)(^|\s)canonical(\s|$)')
    THEN {_sql_attribute("href")}
  WHEN regexp_matches(tag, '(?i)^<meta') AND lower({_sql_attribute("http-equiv")}) = 'refresh'
    THEN {_sql_attribute("content")} END AS value, regexp_matches(tag, '(?i)^<meta') AS refresh FROM tags),
plain AS (SELECT url, refresh, regexp_replace(list_reduce(
    list_concat([value], list_distinct(regexp_extract_all(value, '{_NUMBERED}'))),
    lambda acc, e: replace(acc, e, chr(CASE WHEN lower(e[3]) = 'x'
      THEN ('0x' || regexp_extract(e, '([0-9a-fA-F]+);', 1))::INT
      ELSE regexp_extract(e, '([0-9]+);', 1)::INT END))), '&(?:amp|#0*38|#[xX]0*26);', '&', 'g') AS value
  FROM written WHERE value <> ''),
links AS (SELECT url, CASE WHEN refresh THEN {_sql_value("value", _REFRESHED)} ELSE value END AS link FROM plain),
whole AS (SELECT url, link, regexp_extract(url, '^({_SITE})', 1) AS site,
    CASE WHEN starts_with(link, '//') THEN regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*:)//', 1) || link
      ELSE link END AS own
  FROM links WHERE link <> ''),
cut AS (SELECT *, regexp_extract(own, '^({_SITE})', 1) AS away, regexp_extract(link, '^([^?#]*)', 1) AS goal FROM whole),
placed AS (SELECT url, CASE WHEN away <> '' THEN away ELSE site END AS site, CASE
    WHEN away <> '' THEN regexp_extract(own, '://[^/?#]*([^?#]*)', 1)
    WHEN goal = '' THEN regexp_extract(url, '://[^/?#]*([^?#]*)', 1)
    WHEN starts_with(goal, '/') THEN goal
    ELSE coalesce(nullif(regexp_extract(url, '://[^/?#]*([^?#]*/)', 1), ''), '/') || goal END AS path,
    away = '' AND goal = '' AS same, regexp_extract(own, '^[^?#]*(\?[^#]*)', 1) AS query
  FROM cut WHERE site <> '' AND (away <> '' OR NOT regexp_matches(link, '^([A-Za-z][A-Za-z0-9+.-]*:|//)'))
    AND (away <> '' OR goal <> '' OR regexp_matches(link, '^\?'))),
absolute AS (SELECT url, site || CASE WHEN NOT same AND regexp_matches(path, '/\.{{1,2}}(/|$)') THEN
    list_reduce(string_split(path, '/'), lambda acc, s: CASE WHEN s = '..' THEN regexp_replace(acc, '/[^/]*$', '')
      WHEN s = '.' THEN acc ELSE acc || '/' || s END) || CASE WHEN regexp_matches(path, '/\.{{1,2}}$') THEN '/' ELSE '' END
    ELSE path END || query AS target FROM placed),
one_way AS (SELECT {_sql_node("url")} AS a, {_sql_node("target")} AS b FROM absolute),
edges AS (SELECT a, b FROM one_way WHERE a <> b UNION SELECT b, a FROM one_way WHERE a <> b),
nodes AS (SELECT node FROM pages_ WHERE node IS NOT NULL UNION SELECT a FROM edges),
split AS (SELECT node,
  translate(regexp_extract(node, '://([^/?#]*)', 1), {_AZ}) AS host,
  regexp_extract(node, '://[^/?#]*([^?#]*)', 1) AS path FROM nodes),
ruled AS (SELECT node, max_by(r.host || r.path, length(r.host || r.path)) AS rule,
  max_by(r.verdict, length(r.host || r.path)) AS verdict
  FROM split s JOIN (VALUES {_RULE_ROWS}) r(verdict, host, path)
  ON (s.host = r.host OR ends_with(s.host, '.' || r.host)) AND starts_with(s.path, r.path) GROUP BY node),
reached AS (SELECT node FROM ruled WHERE verdict = 'block' AND node IN (SELECT a FROM edges)
  UNION SELECT b FROM reached JOIN edges ON node = a)
SELECT page_id, coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), {_AZ}), '') AS host,
  coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path, rule,
  CASE WHEN verdict IS NOT NULL THEN verdict WHEN reached.node IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict,
  rule IS NULL AND reached.node IS NOT NULL AS spread
FROM pages_ LEFT JOIN ruled ON pages_.node = ruled.node LEFT JOIN reached ON pages_.node = reached.node"""


@query("op8_url_blocks", OP8_SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_blocks.judge(read(spark, sf_dir, "pages"), URL_RULES)


@query("op9_language_mix")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held_out = folded(F.col("doc_id"), 4, 2)
    languages, table = language_mix.fit(docs.where(~held_out))
    found = language_mix.identify(docs, languages, table)
    return found.select(
        "doc_id", held_out.alias("held_out"), "lang_pred", "score",
        F.transform("languages", lambda x: x["lang"]).alias("languages"),
    )


@query("op10_hpyp")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held_out = folded(F.col("doc_id"), 10, 0)
    return hpyp.score_texts(docs, ~held_out).withColumn("held_out", held_out)


def _op11_sql(parts: int = 16, entries: int = 64, rounds: int = 2) -> str:
    """Two rounds on long tables: one row per vector, part and component."""
    steps = [
        f"""b0 AS (SELECT part, rank - 1 AS entry, pos, x FROM (
            SELECT *, dense_rank() OVER (ORDER BY vec_id) AS rank FROM cells) WHERE rank <= {entries})"""
    ]
    for i in range(rounds + 1):
        steps.append(
            f"""g{i} AS MATERIALIZED (SELECT vec_id, part, entry, sum((c.x - b.x) * (c.x - b.x)) AS gap
            FROM cells c JOIN b{i} b USING (part, pos) GROUP BY ALL)"""
        )
        steps.append(
            f"""a{i} AS MATERIALIZED (SELECT vec_id, part, arg_min(entry, gap * 1000 + entry) AS entry,
            min(gap) AS gap FROM g{i} GROUP BY ALL)"""
        )
        if i < rounds:
            steps.append(
                f"""b{i + 1} AS MATERIALIZED (SELECT part, entry, pos, coalesce(m.x, b.x) AS x FROM b{i} b LEFT JOIN (
                SELECT part, entry, pos, sum(c.x) // count(*) - CASE WHEN sum(c.x) % count(*) < 0 THEN 1 ELSE 0 END AS x
                FROM cells c JOIN a{i} USING (vec_id, part) GROUP BY ALL) m USING (part, entry, pos))"""
            )
    chain = ",\n".join(steps)
    return f"""WITH kept AS (SELECT vec_id, label, embedding, len(embedding) // {parts} AS d FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
cells AS MATERIALIZED (SELECT vec_id, (i - 1) // d AS part, (i - 1) % d AS pos,
  floor(256 * embedding[i]::DOUBLE)::BIGINT AS x
  FROM (SELECT vec_id, embedding, d, unnest(range(1, len(embedding) + 1)) AS i FROM kept)),
{chain},
coded AS (SELECT vec_id, label, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(gap)::BIGINT AS error
  FROM a{rounds} JOIN kept USING (vec_id) GROUP BY ALL)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(x::BIGINT::VARCHAR, ',' ORDER BY part, entry, pos)) FROM b{rounds}) AS codebooks_sha256
FROM coded"""


@query("op11_vector_codes", _op11_sql())
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings").withColumnRenamed("embedding", "vector")
    return vector_codes.compress(vectors).drop("label")


@query("op12_simhash_anchors")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_anchors.near_components(read(spark, sf_dir, "documents"), size=4, threshold=4)


#: CRC-32 in SQL: the table by its rule, then a fold over the bytes of a word.
_WORDS_SQL = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
  'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""
OP13_SQL = rf"""WITH table_ AS (SELECT list(v ORDER BY b) AS t FROM (SELECT b, list_reduce(list_prepend(b, range(8)),
    lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(b))),
docs AS (SELECT row_number() OVER () AS row, doc_id, {_WORDS_SQL} AS words FROM documents),
items AS (SELECT {_WORDS_SQL} AS words FROM benchmark),
in_docs AS (SELECT row, unnest(words) AS word FROM docs),
in_items AS (SELECT unnest(words) AS word FROM items),
named AS (SELECT word, xor(list_reduce(list_prepend(4294967295::BIGINT,
    list_transform(range(1, 2 * strlen(word), 2), lambda i: ('0x' || substr(hex(encode(word)), i::BIGINT, 2))::BIGINT)),
    lambda c, x: xor(c >> 8, t[1 + (xor(c, x) & 255)])), 4294967295) % 10000 AS bucket
  FROM (SELECT word FROM in_docs UNION SELECT word FROM in_items), table_),
s AS (SELECT bucket, count(*) AS n FROM in_docs JOIN named USING (word) GROUP BY 1),
t AS (SELECT bucket, count(*) AS n FROM in_items JOIN named USING (word) GROUP BY 1),
gains AS (SELECT bucket, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT sum(n) FROM s) + 10000)
    / ((s.n + 1)::DOUBLE * (coalesce((SELECT sum(n) FROM t), 0) + 10000)))) AS gain
  FROM s LEFT JOIN t USING (bucket)),
weights AS (SELECT row, count(*) AS n_features, sum(gain)::BIGINT AS weight
  FROM in_docs JOIN named USING (word) JOIN gains USING (bucket) GROUP BY row),
scored AS (SELECT doc_id, len(words) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256(concat('2024:', doc_id))[:8])::BIGINT + 0.5::DOUBLE)
    / 4294967296)))::BIGINT AS score FROM docs LEFT JOIN weights USING (row)),
ordered AS (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS place,
    count(*) OVER (PARTITION BY n_words >= 20) AS n FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND place <= 10 * n // 100 THEN place END AS rank
FROM ordered"""


@query("op13_target_resampling", OP13_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, target = read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")
    return target_resampling.resample(docs, target, percent=10, seed=2024, buckets=10_000, max_words=1, least_words=20)
