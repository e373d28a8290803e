"""Every operator as a query over the given tables, with its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import decisions, structural
from ..functions import text as txt
from ..functions.hashing import hash32
from ..operators import (
    evaluation,
    imbalance,
    neighbors,
    patterns,
    postings,
    projection,
    scaling,
    splits,
    storage,
    voting,
)
from ..operators.skew import lookup
from ..sources import results, text_folders
from ..sources.materialize import materialize, scratch_path
from . import base, experiments
from . import oracle_sql as o
from .estimator import NeighborVoteClassifier

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


# --------------------------------------------------------------------------
# Inputs


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").withColumnRenamed("doc_id", "id")


def labelled(spark: SparkSession, sf: str, pooled: bool = False) -> DataFrame:
    """``(project, id, text, label)`` of the labelled documents."""
    labels = table(spark, sf, "labels").select(
        F.col("doc_id").alias("id"), F.col("toxic").alias("label")
    )
    project = F.lit("all") if pooled else F.col("source")
    docs = documents(spark, sf).select(project.alias("project"), "id", "text")
    return docs.join(labels, "id").select("project", "id", "text", "label")


def whole(spark: SparkSession, sf: str, pooled: bool = False) -> DataFrame:
    """``(project, id, text)`` of all documents."""
    project = F.lit("all") if pooled else F.col("source")
    return documents(spark, sf).select(project.alias("project"), "id", "text")


def held_out():
    """One fixed split: a fifth of the ids, by hash."""
    return hash32("held-out", F.col("id")) % 5 == 0


# Source-code-like text of an event; the same expression in both engines.
CODE = """concat(
CASE WHEN event_id % 4 = 0 THEN '@Before ' WHEN event_id % 4 = 1 THEN '@Mock ' ELSE '' END,
'public void ', event_type, 'Test', cast(user_id AS string), '() {
', CASE event_type
WHEN 'click' THEN '  synchronized (lock) { Thread.sleep(100); lock.wait (5); }
  static final int LIMIT = 3; static int count = 0;
'
WHEN 'error' THEN '  CompletableFuture<Void> f = async(); verify(f); expect (f);
  if (a) { if (b) { throw new TIMEOUT(timeout); } }
'
WHEN 'signup' THEN '  Random r = new Random(Math.random()); UUID id; r.nextInt();
  ConcurrentHashMap m; ScheduledExecutor s; Singleton x = singleton;
'
WHEN 'view' THEN '  } } Files.readAllBytes(Path.of(URI)); BufferedReader in; {{
  System.nanoTime(); System.currentTimeMillis(); when(mock(A.class));
'
ELSE '  assertEquals(1, value); AssertTrue(ok); doReturn(1); @Shared
' END,
'  total = total + ', cast(event_id % 7 AS string), ';
}')"""


def code(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events").select("event_id", "event_type", "user_id")
    return events.select("event_id", F.expr(CODE).alias("text"))


CODE_CTE = f"code AS (SELECT event_id, {CODE} AS text FROM events)"
DOCS = o.labelled()
POOL = o.labelled("'all'")
WHOLE, WHOLE_POOL = o.whole(), o.whole("'all'")


def six(*names: str) -> dict:
    return {n: F.round(n, 6) for n in names}


# --------------------------------------------------------------------------
# Sources and sinks


def _as_folder(spark: SparkSession, sf: str) -> str:
    """The labelled documents as one file per text, by project and class."""
    docs = labelled(spark, sf).where("label IS NOT NULL")
    folder = scratch_path(spark, "folders")
    name = F.when(F.col("label") == 1, text_folders.FLAKY_FOLDER).otherwise(text_folders.NON_FLAKY_FOLDER)
    text_folders.write_texts(docs.select("project", name.alias("class"), "text"), folder, ["project", "class"])
    return folder


@query(
    "s1_read_texts",
    o.sql(
        [DOCS],
        "SELECT count(*) AS n_texts, sum(length(text) + 1)::BIGINT AS n_chars FROM docs",
    ),
)
def s1_read_texts(spark, sf):
    texts = text_folders.read_texts(spark, f"{_as_folder(spark, sf)}/project=*/class=*")
    return texts.agg(
        F.count(F.lit(1)).alias("n_texts"),
        F.sum(F.length("text")).alias("n_chars"),
    )


@query(
    "s1_read_all_texts",
    o.sql(
        [WHOLE],
        "SELECT count(*) AS n_texts, sum(length(text) + 1)::BIGINT AS n_chars FROM docs",
    ),
)
def s1_read_all_texts(spark, sf):
    """All documents, also those without a label."""
    folder = scratch_path(spark, "folders")
    text_folders.write_texts(whole(spark, sf).select("project", "text"), folder, ["project"])
    return text_folders.read_texts(spark, f"{folder}/project=*").agg(
        F.count(F.lit(1)).alias("n_texts"),
        F.sum(F.length("text")).alias("n_chars"),
    )


@query(
    "s3_read_projects",
    o.sql(
        [DOCS],
        "SELECT 'project=' || project AS project, label::INTEGER AS label, "
        "count(*) AS n_texts, sum(length(text) + 1)::BIGINT AS n_chars "
        "FROM docs GROUP BY ALL",
    ),
)
def s3_read_projects(spark, sf):
    texts = text_folders.read_texts(spark, f"{_as_folder(spark, sf)}/project=*/class=*")
    found = text_folders.with_project_and_label(
        texts,
        f"class={text_folders.FLAKY_FOLDER}",
        f"class={text_folders.NON_FLAKY_FOLDER}",
    )
    return found.groupBy("project", "label").agg(
        F.count(F.lit(1)).alias("n_texts"), F.sum(F.length("text")).alias("n_chars")
    )


@query(
    "s4_combine_classes",
    o.sql(
        [DOCS],
        "SELECT id, label::INTEGER AS label, length(text)::INTEGER AS n_chars FROM docs",
    ),
)
def s4_combine_classes(spark, sf):
    docs = labelled(spark, sf).select("id", F.length("text").alias("n_chars"), "label")
    flaky = docs.where("label = 1").drop("label")
    return text_folders.combine_classes(flaky, docs.where("label = 0").drop("label"))


@query(
    "s5_projects",
    o.sql(
        [DOCS],
        "SELECT project, count(*) AS n_texts, sum(label)::BIGINT AS n_flaky "
        "FROM docs GROUP BY project",
    ),
)
def s5_projects(spark, sf):
    return labelled(spark, sf).groupBy("project").agg(
        F.count(F.lit(1)).alias("n_texts"), F.sum("label").alias("n_flaky")
    )


@query(
    "s6_paired_samples",
    o.sql(
        [
            DOCS,
            "s AS (SELECT 'p' || (id // 2 % 20) AS project, 'case' || (id // 2) AS "
            "case_id, label, 'Class' || (id % 3) AS class_name, 'm' || id AS method, "
            "text FROM docs)",
        ],
        "SELECT a.project, a.case_id, a.class_name AS flaky_class_name, a.method AS "
        "flaky_method, md5(a.text) AS flaky_md5, b.class_name AS stable_class_name, "
        "b.method AS stable_method, md5(b.text) AS stable_md5 FROM s a JOIN s b ON "
        "a.project = b.project AND a.case_id = b.case_id AND a.label = 1 AND b.label = 0",
    ),
)
def s6_paired_samples(spark, sf):
    case = F.expr("id div 2")
    path = F.concat(
        F.lit("base/p"), case % 20, F.lit("/case"), case, F.lit("/"),
        F.when(F.col("label") == 1, "f").otherwise("nf"),
        F.lit(".org.sample.Class"), F.col("id") % 3, F.lit(".m"), F.col("id"),
    )
    samples = text_folders.parse_sample_paths(
        labelled(spark, sf).select(path.alias("path"), "text")
    ).withColumn("class_name", F.regexp_replace("class_name", r"^org\.sample\.", ""))
    return text_folders.paired_samples(samples).select(
        "project", "case_id", "flaky_class_name", "flaky_method",
        F.md5("flaky_text").alias("flaky_md5"),
        "stable_class_name", "stable_method", F.md5("stable_text").alias("stable_md5"),
    )


FOLDERS = (
    "paths AS (SELECT 'data/' || coalesce(source, '') || '/' || CASE toxic WHEN 1 THEN "
    f"'{text_folders.FLAKY_FOLDER}' WHEN 0 THEN '{text_folders.NON_FLAKY_FOLDER}' ELSE "
    "'unlabelled' END || '/' || d.doc_id || '.txt' AS path, coalesce(text, '') AS text "
    "FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)"
)


def packed_folder(spark, sf) -> str:
    """All documents as containers, under the paths of text folders."""
    rows = table(spark, sf, "documents").join(
        table(spark, sf, "labels").select("doc_id", "toxic"), "doc_id", "left"
    )
    folder = (
        F.when(F.col("toxic") == 1, text_folders.FLAKY_FOLDER)
        .when(F.col("toxic") == 0, text_folders.NON_FLAKY_FOLDER)
        .otherwise("unlabelled")
    )
    name = F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))
    path = F.concat_ws("/", F.lit("data"), F.coalesce("source", F.lit("")), folder, name)
    packed = scratch_path(spark, "packed")
    text = F.coalesce("text", F.lit("")).alias("text")
    text_folders.pack(rows.select(path.alias("path"), text), packed)
    return packed


@query(
    "s2_listing_order",
    o.sql(
        [FOLDERS],
        "SELECT path, row_number() OVER (ORDER BY path) AS position, length(text)::INTEGER "
        "AS n_chars FROM paths",
    ),
)
def s2_listing_order(spark, sf):
    texts = text_folders.read_packed(spark, packed_folder(spark, sf))
    ordered = text_folders.in_listing_order(
        texts.select("path", F.length("text").alias("n_chars"))
    )
    return ordered.select("path", F.col("position").cast("long"), "n_chars")


@query(
    "s3_packed_projects",
    o.sql(
        [FOLDERS],
        "SELECT split_part(path, '/', 2) AS project, (split_part(path, '/', 3) = "
        f"'{text_folders.FLAKY_FOLDER}')::INTEGER AS label, split_part(path, '/', 4) AS file, "
        "md5(text) AS md5 FROM paths WHERE split_part(path, '/', 3) <> 'unlabelled'",
    ),
)
def s3_packed_projects(spark, sf):
    found = text_folders.read_projects(spark, packed_folder(spark, sf), packed=True)
    return found.select("project", "label", "file", F.md5("text").alias("md5"))


SIMPLE = (
    "simple AS (SELECT d.source AS project, l.toxic AS label, "
    "1 - l.quality AS prediction FROM documents d JOIN labels l USING (doc_id))"
)


def simple_predictions(spark, sf) -> DataFrame:
    """Low quality as a stand-in prediction of the label."""
    labels = table(spark, sf, "labels").withColumnRenamed("doc_id", "id")
    return documents(spark, sf).join(labels, "id").select(
        F.col("source").alias("project"),
        F.col("toxic").alias("label"),
        (1 - F.col("quality")).alias("prediction"),
    )


@query(
    "s7_results_csv",
    o.sql(
        [SIMPLE, o.metrics("project", "simple")],
        "SELECT project, (precision IS NULL)::INTEGER AS dashes, "
        "round(precision, 6) AS precision, round(recall, 6) AS recall FROM measured",
    ),
)
def s7_results_csv(spark, sf):
    metrics = evaluation.evaluate(simple_predictions(spark, sf), ["project"])
    path = scratch_path(spark, "results")
    results.write_results(metrics.select("project", "precision", "recall"), path)
    written = spark.read.csv(path, header=True)  # all strings, as in the file
    dashes = written.select(
        "project", (F.col("precision") == results.UNDEFINED).cast("int").alias("dashes")
    )
    values = results.read_results(
        spark, path, "project STRING, precision DOUBLE, recall DOUBLE"
    )
    return dashes.join(values, "project").withColumns(six("precision", "recall"))


@query(
    "s8_footprint",
    o.sql(
        [WHOLE, o.counts()],
        "SELECT count(DISTINCT id) AS n_rows, count(*) AS n_postings, "
        "count(DISTINCT id) * (count(DISTINCT term) * 8 + 8) AS dense_bytes, "
        "sum(strlen(term) + 8)::BIGINT AS posting_bytes FROM counts",
    ),
)
def s8_footprint(spark, sf):
    rows = materialize(postings.term_counts(whole(spark, sf), ["id"]), "counts")
    return storage.footprint(rows, ["id"], None)


# --------------------------------------------------------------------------
# Text


@query(
    "t1_tokens",
    "SELECT doc_id AS id, len(toks)::INTEGER AS n_tokens, "
    "md5(array_to_string(toks, ' ')) AS tokens_md5 FROM (SELECT doc_id, "
    f"regexp_extract_all(lower(text), '{o.TOKEN}') AS toks FROM documents)",
)
def t1_tokens(spark, sf):
    docs = documents(spark, sf).select("id", "text")
    toks = docs.select("id", txt.tokens(F.col("text")).alias("toks"))
    return toks.select(
        "id",
        F.size("toks").alias("n_tokens"),
        F.md5(F.array_join("toks", " ")).alias("tokens_md5"),
    )


CHECK = o.hash32("term")


@query(
    "t2_ngrams",
    o.sql(
        [o.ngram_counts("documents", "doc_id", "grams")],
        "SELECT doc_id AS id, count(*) AS n_terms, sum(tf)::BIGINT AS n_grams, "
        f"sum({CHECK} * tf)::BIGINT AS checksum FROM grams GROUP BY doc_id",
    ),
)
def t2_ngrams(spark, sf):
    grams = postings.term_counts(documents(spark, sf), ["id"], ngram_range=(1, 2))
    return grams.groupBy("id").agg(
        F.count(F.lit(1)).alias("n_terms"),
        F.sum("tf").alias("n_grams"),
        F.sum(hash32(F.col("term")) * F.col("tf")).alias("checksum"),
    )


@query("t3_term_counts", o.sql([WHOLE, o.counts()], "SELECT id, term, tf FROM counts"))
def t3_term_counts(spark, sf):
    return postings.term_counts(whole(spark, sf), ["id"])


@query(
    "t4_vocabulary",
    o.sql(
        [o.counts("documents", "doc_id")],
        "SELECT term, count(*) AS df FROM counts GROUP BY term",
    ),
)
def t4_vocabulary(spark, sf):
    return postings.vocabulary(postings.term_counts(documents(spark, sf), ["id"]))


TURN = "conversations.conv_id * 1000 + conversations.turn"


def turns(spark, sf) -> DataFrame:
    return table(spark, sf, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text"
    )


TURNS_CTE = f"turns AS (SELECT {TURN} AS id, text FROM conversations)"


@query(
    "t5_unseen_terms",
    o.sql(
        [WHOLE, TURNS_CTE, o.counts(), o.counts("turns", "id", "new")],
        "SELECT id, count(*) AS n_terms, sum(tf)::BIGINT AS n_tokens, "
        f"sum({CHECK} * tf)::BIGINT AS checksum FROM new WHERE term IN "
        "(SELECT term FROM counts) GROUP BY id",
    ),
)
def t5_unseen_terms(spark, sf):
    vocab = postings.vocabulary(postings.term_counts(whole(spark, sf), ["id"]))
    known = postings.in_vocabulary(
        postings.term_counts(turns(spark, sf), ["id"]), vocab, ["id"]
    )
    return known.groupBy("id").agg(
        F.count(F.lit(1)).alias("n_terms"),
        F.sum("tf").alias("n_tokens"),
        F.sum(hash32(F.col("term")) * F.col("tf")).alias("checksum"),
    )


IDF = (
    "n AS (SELECT count(*) AS n FROM docs),\n"
    "idf AS (SELECT term, count(*) AS df, ln((1.0::DOUBLE + n) / (1 + count(*))) + 1 "
    "AS idf FROM {counts}, n GROUP BY term, n)"
)
TFIDF = (
    "raw AS (SELECT c.id, c.term, c.tf * idf.idf AS w FROM {counts} c "
    "JOIN idf USING (term)),\n"
    "tfidf AS (SELECT id, term, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w "
    "FROM raw)"
)


@query(
    "t6_idf",
    o.sql(
        [WHOLE, o.counts(), IDF.format(counts="counts")],
        "SELECT term, df, round(idf, 6) AS idf FROM idf",
    ),
)
def t6_idf(spark, sf):
    docs = whole(spark, sf)
    idf = postings.smoothed_idf(postings.term_counts(docs, ["id"]), docs.count())
    return idf.withColumns(six("idf"))


@query(
    "t7_tfidf",
    o.sql(
        [WHOLE, o.counts(), IDF.format(counts="counts"), TFIDF.format(counts="counts")],
        "SELECT id, term, round(w, 6) AS w FROM tfidf",
    ),
)
def t7_tfidf(spark, sf):
    docs = whole(spark, sf)
    counts = materialize(postings.term_counts(docs, ["id"]), "counts")
    idf = postings.smoothed_idf(counts, docs.count())
    return postings.tfidf(counts, idf, ["id"]).withColumns(six("w"))


GRAMS = o.ngram_counts("docs", "id", "grams")
GRAM_TFIDF = [GRAMS, IDF.format(counts="grams"), TFIDF.format(counts="grams")]


@query(
    "t8_ngram_tfidf",
    o.sql(
        [WHOLE, *GRAM_TFIDF],
        "SELECT id, count(*) AS n_terms, round(sum(w), 6) AS sum_w, "
        "round(max(w), 6) AS max_w FROM tfidf GROUP BY id",
    ),
)
def t8_ngram_tfidf(spark, sf):
    docs = whole(spark, sf)
    counts = postings.term_counts(docs, ["id"], ngram_range=(1, 2))
    counts = materialize(counts, "counts")
    idf = postings.smoothed_idf(counts, docs.count())
    return postings.tfidf(counts, idf, ["id"]).groupBy("id").agg(
        F.count(F.lit(1)).alias("n_terms"),
        F.round(F.sum("w"), 6).alias("sum_w"),
        F.round(F.max("w"), 6).alias("max_w"),
    )


# --------------------------------------------------------------------------
# Rules and structure


def rules_sql(rules, text: str = "text") -> dict[str, str]:
    """Per category, the hit count: equal words for word rules, and regular
    expressions for the rest.  One rule, one term of the sum."""
    out: dict[str, list[str]] = {}
    for category, pattern in rules:
        word = patterns._WORD_RULE.fullmatch(pattern)
        if word:
            part = f"len(list_filter(words, lambda w: w = '{word[1].lower()}'))"
        else:
            part = f"len(regexp_extract_all({text}, '(?i){pattern}'))"
        out.setdefault(category, []).append(part)
    return {c: " + ".join(parts) for c, parts in out.items()}


WORDS = "list_filter(regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}_]+'), lambda x: {f})"


def words_cte(rules, source: str, key: str) -> str:
    listed = sorted(
        {m[1].lower() for _, p in rules if (m := patterns._WORD_RULE.fullmatch(p))}
    )
    keep = "x IN (" + ", ".join(f"'{w}'" for w in listed) + ")"
    return (
        f"split AS (SELECT {key}, text, {WORDS.format(text='text', f=keep)} AS words "
        f"FROM {source})"
    )


DEFAULT_SQL = rules_sql(patterns.DEFAULT_RULES)


@query(
    "p1_pattern_counts",
    o.sql(
        [CODE_CTE, words_cte(patterns.DEFAULT_RULES, "code", "event_id")],
        "SELECT event_id, "
        + ", ".join(f"({s})::DOUBLE AS {c}" for c, s in DEFAULT_SQL.items())
        + " FROM split",
    ),
)
def p1_pattern_counts(spark, sf):
    return patterns.with_pattern_counts(code(spark, sf)).drop("text")


@query(
    "p2_category_totals",
    o.sql(
        [CODE_CTE, words_cte(patterns.DEFAULT_RULES, "code", "event_id")],
        " UNION ALL ".join(
            f"SELECT {i} AS position, '{c}' AS category, sum({s})::BIGINT AS n FROM split"
            for i, (c, s) in enumerate(DEFAULT_SQL.items())
        ),
    ),
)
def p2_category_totals(spark, sf):
    hits = patterns.pattern_counts_long(code(spark, sf), ["event_id"])
    names = F.array(*[F.lit(c) for c in patterns.categories()])
    return hits.groupBy("category").agg(F.sum("n").alias("n")).select(
        (F.array_position(names, F.col("category")) - 1).cast("int").alias("position"),
        "category",
        "n",
    )


PROSE_RULES = [
    ("articles", r"\bthe\b"),
    ("articles", r"\bun\b"),
    ("articles", r"\bThe\b"),
    ("joins", r"\band\b"),
    ("joins", r"\bou\b"),
    ("joins", r"\bque\b"),
    ("marks", r"[.,;]"),
    ("marks", r"[0-9]+"),
    ("joins", r"and\s+the"),
]
PROSE_SQL = rules_sql(PROSE_RULES)


@query(
    "p3_patterns_long",
    o.sql(
        [
            "d AS (SELECT doc_id AS id, text FROM documents)",
            words_cte(PROSE_RULES, "d", "id"),
        ],
        " UNION ALL ".join(
            f"SELECT id, '{c}' AS category, ({s})::BIGINT AS n FROM split"
            for c, s in PROSE_SQL.items()
        ),
    ),
)
def p3_patterns_long(spark, sf):
    docs = documents(spark, sf).select("id", "text")
    return patterns.pattern_counts_long(docs, ["id"], rules=PROSE_RULES)


def structural_sql(source: str, key: str, text: str) -> str:
    spaces = r"[^\t-\r\x1c-\x1f\x{85}\p{Z}]+"

    def n(ch: str) -> str:
        return f"(length({text}) - length(replace({text}, '{ch}', '')))::DOUBLE"

    lines = f"(length({text}) - length(replace({text}, chr(10), '')) + 1)::DOUBLE"
    return o.sql(
        [
            f"braces AS (SELECT {key}, regexp_replace({text}, '[^{{}}]', '', 'g') AS b "
            f"FROM {source})",
            f"marks AS (SELECT {key}, i, CASE WHEN b[i] = '{{' THEN 1 ELSE -1 END AS s "
            f"FROM (SELECT {key}, b, unnest(range(1, length(b) + 1)) AS i FROM braces))",
            f"sums AS (SELECT {key}, i, sum(s) OVER (PARTITION BY {key} ORDER BY i) AS p "
            "FROM marks)",
            f"depth AS (SELECT {key}, max(p - least(0, low)) AS d FROM (SELECT {key}, p, "
            f"min(p) OVER (PARTITION BY {key} ORDER BY i) AS low FROM sums) "
            f"GROUP BY {key})",
        ],
        f"SELECT {key}, length({text})::DOUBLE AS char_count, {lines} AS line_count, "
        f"len(regexp_extract_all({text}, '{spaces}'))::DOUBLE AS token_count, "
        f"round(length({text}) / {lines}, 6) AS avg_line_length, "
        f"coalesce(d, 0)::DOUBLE AS brace_depth_max, {n('(')} AS paren_count, "
        f"{n(';')} AS semicolon_count, {n('.')} AS dot_count FROM {source} "
        f"LEFT JOIN depth USING ({key})",
    )


@query("x1_x8_structure_pages", structural_sql("pages", "page_id", "html"))
def x1_x8_structure_pages(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", "html")
    out = structural.with_structural_features(pages, "html").drop("html")
    return out.withColumns(six("avg_line_length"))


@query("x1_x8_structure_documents", structural_sql("documents", "doc_id", "text"))
def x1_x8_structure_documents(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    out = structural.with_structural_features(docs).drop("text")
    return out.withColumns(six("avg_line_length"))


@query(
    "x5_structure_code",
    "WITH " + CODE_CTE + ", " + structural_sql("code", "event_id", "text")[5:],
)
def x5_structure_code(spark, sf):
    out = structural.with_structural_features(code(spark, sf)).drop("text")
    return out.withColumns(six("avg_line_length"))


# --------------------------------------------------------------------------
# Metadata, scaling, assembly


def metadata(spark, sf) -> DataFrame:
    """Per-document metadata derived from its source; the last column has
    gaps."""
    labels = table(spark, sf, "labels").withColumnRenamed("doc_id", "id")
    docs = documents(spark, sf).join(labels, "id")
    per_source = docs.groupBy("source").agg(
        F.count(F.lit(1)).alias("file_change_count"),
        F.avg("toxic").alias("historical_flakiness_rate"),
        F.var_pop("n_chars").alias("execution_time_variance"),
    )
    quality = F.when(F.col("lang") == "en", F.col("quality").cast("double"))
    return lookup(
        docs.select("id", "source", "n_chars", quality.alias("author_flakiness_rate")),
        per_source, "source", "file_change_count", ["id"],
    ).select(
        "id", "historical_flakiness_rate",
        F.col("execution_time_variance"),
        F.col("n_chars").cast("double").alias("test_age_days"),
        F.col("file_change_count").cast("double").alias("file_change_count"),
        "author_flakiness_rate",
    )


META_CTE = """joined AS (SELECT d.doc_id AS id, source, n_chars, lang, quality, toxic
  FROM documents d JOIN labels l USING (doc_id)),
per_source AS (SELECT source, count(*)::DOUBLE AS file_change_count,
  avg(toxic) AS historical_flakiness_rate, var_pop(n_chars) AS execution_time_variance
  FROM joined GROUP BY source),
meta AS (SELECT id, historical_flakiness_rate, execution_time_variance,
  n_chars::DOUBLE AS test_age_days, file_change_count,
  CASE WHEN lang = 'en' THEN quality::DOUBLE END AS author_flakiness_rate
  FROM joined JOIN per_source USING (source))"""
META_COLUMNS = [
    "historical_flakiness_rate", "execution_time_variance", "test_age_days",
    "file_change_count", "author_flakiness_rate",
]
META_KEPT = META_COLUMNS[:-1]


@query(
    "h1_metadata",
    o.sql(
        [META_CTE],
        "SELECT doc_id AS id, "
        + ", ".join(f"round({c}, 4) AS {c}" for c in META_COLUMNS)
        + " FROM documents LEFT JOIN meta ON id = doc_id",
    ),
)
def h1_metadata(spark, sf):
    docs = documents(spark, sf).select("id")
    out = scaling.with_metadata(docs, metadata(spark, sf), "id", META_COLUMNS)
    return out.withColumns({c: F.round(c, 4) for c in META_COLUMNS})


@query(
    "h2_complete_columns",
    o.sql(
        [META_CTE],
        " UNION ALL ".join(
            f"SELECT '{c}' AS name, count({c}) AS n_values FROM meta "
            f"HAVING count({c}) = count(*)"
            for c in META_COLUMNS
        ),
    ),
)
def h2_complete_columns(spark, sf):
    docs, side = labelled(spark, sf), metadata(spark, sf)
    kept = scaling.complete_columns(docs, side, "id")
    joined = scaling.with_metadata(docs.select("id"), side, "id", kept)
    return (
        joined.agg(*[F.count(c).alias(c) for c in kept])
        .unpivot([], kept, "name", "n_values")
    )


@query(
    "h3_missing_is_mean",
    o.sql(
        [META_CTE],
        "SELECT doc_id AS id, "
        + ", ".join(
            f"round(coalesce(({c} - (SELECT avg({c}) FROM meta)) / "
            f"(SELECT stddev_pop({c}) FROM meta), 0), 6) AS {c}"
            for c in META_KEPT
        )
        + ", 0.0::DOUBLE AS author_flakiness_rate"
        " FROM documents LEFT JOIN meta ON id = doc_id",
    ),
)
def h3_missing_is_mean(spark, sf):
    side = metadata(spark, sf)
    scaler = scaling.fit_scaler(side, META_KEPT)
    docs = documents(spark, sf).select("id")
    joined = scaling.with_metadata(docs, side, "id", META_KEPT)
    absent = scaling.Scaler(
        {**scaler.means, "author_flakiness_rate": 0.0},
        {**scaler.deviations, "author_flakiness_rate": 1.0},
    )
    out = scaling.apply_scaler(joined, absent, fill_missing=True)
    return out.withColumns(six(*META_KEPT))


STRUCT_SQL = structural_sql("documents", "doc_id", "text")


@query(
    "n1_scaler",
    "WITH s AS (" + STRUCT_SQL + ") "
    + " UNION ALL ".join(
        f"SELECT '{c}' AS name, round(avg({c}), 4) AS mean, round(CASE WHEN "
        f"stddev_pop({c}) < 1e-9 THEN 1 ELSE stddev_pop({c}) END, 4) AS deviation FROM s"
        for c in structural.STRUCTURAL_FEATURES
    ),
)
def n1_scaler(spark, sf):
    docs = documents(spark, sf).select("id", "text")
    features = structural.with_structural_features(docs).withColumns(
        six("avg_line_length")
    )
    scaler = scaling.fit_scaler(features, structural.STRUCTURAL_FEATURES)
    rows = [(c, scaler.means[c], scaler.deviations[c]) for c in scaler.columns]
    out = spark.createDataFrame(rows, "name STRING, mean DOUBLE, deviation DOUBLE")
    return out.withColumns({c: F.round(c, 4) for c in ("mean", "deviation")})


@query(
    "n2_scaled_pages",
    "WITH s AS (" + STRUCT_SQL + "), p AS ("
    + structural_sql("pages", "page_id", "html")
    + ") SELECT page_id, "
    + ", ".join(
        f"round(({c} - (SELECT avg({c}) FROM s)) / (SELECT CASE WHEN stddev_pop({c}) "
        f"< 1e-9 THEN 1 ELSE stddev_pop({c}) END FROM s), 4) AS {c}"
        for c in structural.STRUCTURAL_FEATURES
    )
    + " FROM p",
)
def n2_scaled_pages(spark, sf):
    names = structural.STRUCTURAL_FEATURES
    docs = documents(spark, sf).select("id", "text")
    fitted = structural.with_structural_features(docs).withColumns(
        six("avg_line_length")
    )
    scaler = scaling.fit_scaler(fitted, names)
    pages = table(spark, sf, "pages").select("page_id", "html")
    new = structural.with_structural_features(pages, "html").drop("html")
    scaled = scaling.apply_scaler(new.withColumns(six("avg_line_length")), scaler)
    return scaled.withColumns({c: F.round(c, 4) for c in names})


ENHANCED = dict(eps=0.0, metadataCols=META_COLUMNS)


def with_meta(spark, sf) -> DataFrame:
    docs = labelled(spark, sf)
    return scaling.with_metadata(docs, metadata(spark, sf), "id", META_COLUMNS)


def block_summary(vectors: DataFrame) -> DataFrame:
    """Vectors by feature block (the letter before the colon)."""
    entry = F.inline(F.arrays_zip("terms", "weights")).alias("term", "w")
    rows = vectors.select("id", entry)
    return rows.groupBy("id", F.substring("term", 1, 1).alias("block")).agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.sum("w"), 4).alias("sum_w"),
        F.round(F.sum(F.col("w") * F.col("w")), 4).alias("sum_sq"),
    )


def block_sql(train: str, test: str, hybrid: bool) -> str:
    """Feature blocks of ``test`` rows fitted on ``train`` rows; both name a
    condition on ``id``."""
    rules = patterns.DEFAULT_RULES
    blocks = {"p": list(DEFAULT_SQL), "s": structural.STRUCTURAL_FEATURES}
    if hybrid:
        blocks["h"] = META_KEPT
    numeric = [c for columns in blocks.values() for c in columns]
    struct = structural_sql("docs", "id", "text")
    scaled = ", ".join(
        f"({c} - avg({c}) FILTER ({train}) OVER ()) / (CASE WHEN coalesce(stddev_pop({c}) "
        f"FILTER ({train}) OVER (), 0) < 1e-9 THEN 1 ELSE stddev_pop({c}) FILTER "
        f"({train}) OVER () END) AS {c}"
        for c in numeric
    )
    pieces = " UNION ALL ".join(
        f"SELECT id, '{name}' AS block, {len(columns)} AS n, "
        f"round({' + '.join(columns)}, 4) AS sum_w, "
        f"round({' + '.join(f'{c} * {c}' for c in columns)}, 4) AS sum_sq "
        f"FROM scaled WHERE {test}"
        for name, columns in blocks.items()
    )
    return o.sql(
        [
            DOCS, META_CTE, GRAMS,
            f"n AS (SELECT count(*) AS n FROM docs WHERE {train})",
            "idf AS (SELECT term, ln((1.0::DOUBLE + n) / (1 + count(*))) + 1 AS idf "
            f"FROM grams, n WHERE {train} GROUP BY term, n)",
            TFIDF.format(counts="grams"),
            words_cte(rules, "docs", "id"),
            "hits AS (SELECT id, "
            + ", ".join(f"({s})::DOUBLE AS {c}" for c, s in DEFAULT_SQL.items())
            + " FROM split)",
            f"struct AS ({struct})",
            "allf AS (SELECT * FROM hits JOIN struct USING (id) JOIN meta USING (id))",
            f"scaled AS (SELECT id, {scaled} FROM allf)",
        ],
        "SELECT id, 't' AS block, count(*) AS n, round(sum(w), 4) AS sum_w, "
        f"round(sum(w * w), 4) AS sum_sq FROM tfidf WHERE {test} GROUP BY id UNION ALL "
        + pieces,
    )


@query("n3_n4_fit_vectors", block_sql("true", "true", hybrid=True))
def n3_n4_fit_vectors(spark, sf):
    model = NeighborVoteClassifier(**ENHANCED).fit(with_meta(spark, sf))
    return block_summary(model.vectors)


@query(
    "n5_transform_vectors",
    block_sql(f"NOT {o.HELD_OUT}", o.HELD_OUT, hybrid=True),
)
def n5_transform_vectors(spark, sf):
    docs = with_meta(spark, sf)
    model = NeighborVoteClassifier(**ENHANCED).fit(docs.where(~held_out()))
    return block_summary(model.vectors_of(docs.where(held_out())))


# --------------------------------------------------------------------------
# Projection

SOME_EPS = [0.1, 0.3, 0.5, 0.9]


@query(
    "d1_d3_dimensions",
    o.sql(
        [WHOLE, o.counts(), o.sizes()],
        f"SELECT project, eps, n_rows, n_terms, {o.jl('n_rows', 'eps')} AS dim, "
        f"least(n_terms, {o.jl('n_rows', 'eps')})::BIGINT AS capped FROM sizes, "
        + o.values("eps", SOME_EPS),
    ),
)
def d1_d3_dimensions(spark, sf):
    docs = whole(spark, sf).withColumn("label", F.lit(None).cast("int"))  # not used
    sizes = experiments.load_corpus(docs).sizes
    listed = F.array(*[F.lit(e) for e in SOME_EPS])
    dim = projection.jl_dim_column(F.col("n_rows"), F.col("eps"))
    return (
        sizes.withColumn("eps", F.explode(listed))
        .withColumn("dim", dim)
        .withColumn("capped", F.least(F.col("n_terms"), F.col("dim")).cast("bigint"))
    )


SLOT_SUMMARY = (
    "SELECT id, count(*) AS n_slots, round(sum(v), 6) AS total, "
    "round(sum(v * slot), 4) AS moment, round(sum(v * v), 4) AS squares FROM {src} "
    "GROUP BY id"
)


def slot_summary(slots: DataFrame) -> DataFrame:
    v = F.col("value")
    return slots.groupBy("id").agg(
        F.count(F.lit(1)).alias("n_slots"),
        F.round(F.sum(v), 6).alias("total"),
        F.round(F.sum(v * F.col("slot")), 4).alias("moment"),
        F.round(F.sum(v * v), 4).alias("squares"),
    )


def draw_sql(new: str, seed: int, eps: float = 0.3) -> str:
    """Slots of the terms in the CTE ``new``, fitted on ``counts``."""
    return f"""fit AS (SELECT (SELECT count(*) FROM docs) AS n,
  (SELECT count(DISTINCT term) FROM counts) AS n_terms),
fitd AS (SELECT *, {o.jl('n', str(eps))} AS dim FROM fit),
fitm AS (SELECT *, {o.draws('dim', 'n_terms')} AS m FROM fitd),
{o.functions(seed, 1, '(SELECT m FROM fitm)')},
coded AS MATERIALIZED (SELECT id, tf, {o.CODE} AS x FROM {new}),
drawn_slots AS (SELECT id, {o.SLOT} AS slot, sum({o.SIGNED}) / sqrt(any_value(m)::DOUBLE)
  AS v FROM coded, fitm, fun GROUP BY ALL)"""


def fitted_projection(spark, sf):
    docs = whole(spark, sf)
    rows = materialize(base.count_vectors(docs), "vectors")
    n_terms = rows.select(F.explode("terms")).distinct().count()
    return rows, projection.jl_dim(docs.count(), 0.3), n_terms


@query(
    "d4_projection",
    o.sql([WHOLE, o.counts(), draw_sql("counts", 7)], SLOT_SUMMARY.format(src="drawn_slots")),
)
def d4_projection(spark, sf):
    rows, dim, n_terms = fitted_projection(spark, sf)
    projected = projection.project_vectors(projection.spread(rows), dim, n_terms, 7)
    return slot_summary(projection.slot_values(projected, ["id"]))


@query(
    "d4_projection_cell_tests",
    o.sql(
        [
            WHOLE, o.counts(),
            "fit AS (SELECT count(DISTINCT term) AS n_terms FROM counts)",
            "hashed AS (SELECT id, tf, i, n_terms, md5(concat_ws('|', 7, term, i)) AS h "
            "FROM (SELECT id, term, tf, n_terms, unnest(range(48)) AS i "
            "FROM counts, fit))",
            "kept AS (SELECT id, i AS slot, sum(CASE WHEN substr(h, 9, 1) < '8' THEN tf "
            "ELSE -tf END) * sqrt(sqrt(n_terms::DOUBLE) / 48) AS v FROM hashed WHERE "
            "('0x' || substr(h, 1, 8))::BIGINT < 4294967296.0::DOUBLE / "
            "sqrt(n_terms::DOUBLE) GROUP BY id, i, n_terms)",
        ],
        SLOT_SUMMARY.format(src="kept"),
    ),
)
def d4_projection_cell_tests(spark, sf):
    counts = postings.term_counts(whole(spark, sf), ["id"])
    counts = materialize(counts, "counts")
    n_terms = counts.select("term").distinct().count()
    return slot_summary(projection.cell_tests(counts, ["id"], "tf", 48, n_terms, 7))


@query(
    "d5_projection_unseen",
    o.sql(
        [
            WHOLE, TURNS_CTE, o.counts(), o.counts("turns", "id", "new"),
            "known AS (SELECT * FROM new WHERE term IN (SELECT term FROM counts))",
            draw_sql("known", 7),
        ],
        SLOT_SUMMARY.format(src="drawn_slots"),
    ),
)
def d5_projection_unseen(spark, sf):
    train, test = base.vectorize_split(whole(spark, sf), turns(spark, sf), seed=7)
    return slot_summary(projection.slot_values(test.table, ["id"]))


@query(
    "d4_projection_dense",
    o.sql(
        [
            "counts AS (SELECT vec_id AS id, i::VARCHAR AS term, "
            "embedding[i + 1]::DOUBLE AS tf "
            "FROM (SELECT *, unnest(range(64)) AS i FROM embeddings))",
            o.functions(7, 1, "4"),
            f"coded AS (SELECT id, tf, 32 AS dim, {o.CODE} AS x FROM counts)",
            f"s AS (SELECT id, {o.SLOT} AS slot, sum({o.SIGNED}) / 2 AS v "
            "FROM coded, fun GROUP BY ALL)",
        ],
        SLOT_SUMMARY.format(src="s"),
    ),
)
def d4_projection_dense(spark, sf):
    vectors = embeddings(spark, sf)
    projected = projection.project_dense(vectors, "vec", 32, 64, 7)
    return slot_summary(projection.slot_values(projected, ["id"]))


def embeddings(spark, sf) -> DataFrame:
    """``(id, label, vec)``; label 0 is the positive class."""
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("id"),
        F.when(F.col("label") == 0, 1).otherwise(0).alias("label"),
        F.col("embedding").alias("vec"),
    )


EMB = (
    "emb AS (SELECT vec_id AS id, CASE WHEN label = 0 THEN 1 ELSE 0 END AS label, "
    "embedding::DOUBLE[] AS vec FROM embeddings)"
)


# --------------------------------------------------------------------------
# Neighbours


def count_vectors(spark, sf) -> DataFrame:
    docs = labelled(spark, sf, pooled=True)
    vectors = base.count_vectors(docs)
    return materialize(vectors.join(docs.select("id", "label"), "id"), "vectors")


def near_summary(near: DataFrame, *extra: str) -> DataFrame:
    return near.select(
        *extra, "query_id", "rank", "train_id", F.round("distance", 6).alias("distance")
    )


NEAR = "SELECT query_id, rank::INTEGER AS rank, train_id, round(distance, 6) AS distance FROM near"


def fixed_candidates(distance: str, pairs: str = "pairs") -> str:
    return (
        f"cand AS (SELECT p.a AS query_id, q.label AS query_label, p.b AS train_id, "
        f"t.label AS label, {distance} AS distance FROM {pairs} p JOIN "
        f"(SELECT * FROM docs WHERE {o.HELD_OUT}) q ON q.id = p.a JOIN "
        f"(SELECT * FROM docs WHERE NOT {o.HELD_OUT}) t ON t.id = p.b)"
    )


def fixed_near(metric: str, k: int, docs: str = POOL) -> list[str]:
    """Neighbours of the held-out documents by raw counts."""
    d = o.distance_of(metric)("dot", "na", "nb")
    return [
        docs, o.counts(), o.raw_pairs(), fixed_candidates(d),
        o.ranked("1", k).replace("PARTITION BY 1, ", "PARTITION BY "),
    ]


def fixed_neighbours(spark, sf, k: int, metric: str) -> DataFrame:
    return nearest_of_held_out(count_vectors(spark, sf), k, metric)


def nearest_of_held_out(vectors: DataFrame, k: int, metric: str) -> DataFrame:
    return neighbors.knn_join(
        vectors.where(held_out()), vectors.where(~held_out()), k, metric=metric
    )


@query("k1_k3_cosine_counts", o.sql(fixed_near("cosine", 7, WHOLE_POOL), NEAR))
def k1_k3_cosine_counts(spark, sf):
    vectors = materialize(base.count_vectors(whole(spark, sf)), "vectors")
    return near_summary(nearest_of_held_out(vectors, 7, "cosine"))


@query("k1_term_index", o.sql(fixed_near("cosine", 7, WHOLE_POOL), NEAR))
def k1_term_index(spark, sf):
    """The same through an inverted index over blocks of 128 rows."""
    vectors = materialize(base.count_vectors(whole(spark, sf)), "vectors")
    return near_summary(
        neighbors.knn_join(
            vectors.where(held_out()), vectors.where(~held_out()), 7, index="terms", block_rows=128
        )
    )


@query("k2_k3_euclidean_counts", o.sql(fixed_near("euclidean", 7, WHOLE_POOL), NEAR))
def k2_k3_euclidean_counts(spark, sf):
    vectors = materialize(base.count_vectors(whole(spark, sf)), "vectors")
    return near_summary(nearest_of_held_out(vectors, 7, "euclidean"))


@query(
    "k3_benchmark_items",
    o.sql(
        [
            "docs AS (SELECT 'all' AS project, doc_id AS id, text FROM documents UNION "
            "ALL SELECT 'all', -1 - item_id, text FROM benchmark)",
            o.counts(), o.raw_pairs(),
            "cand AS (SELECT a AS query_id, b AS train_id, "
            + o.cosine("dot", "na", "nb")
            + " AS distance FROM pairs WHERE a < 0 AND b >= 0)",
            o.ranked("1", 3).replace("PARTITION BY 1, ", "PARTITION BY "),
        ],
        NEAR,
    ),
)
def k3_benchmark_items(spark, sf):
    items = table(spark, sf, "benchmark").select(
        (-1 - F.col("item_id")).alias("id"), "text"
    )

    queries = materialize(base.count_vectors(items), "vectors")
    train = materialize(base.count_vectors(documents(spark, sf)), "vectors")
    return near_summary(neighbors.knn_join(queries, train, 3))


K3_TFIDF = o.sql(
        [
            WHOLE_POOL, o.counts(), IDF.format(counts="counts"), TFIDF.format(counts="counts"),
            "dots AS (SELECT x.id AS a, y.id AS b, sum(x.w * y.w) AS dot FROM tfidf x "
            "JOIN tfidf y USING (term) GROUP BY ALL)",
            "pairs AS (SELECT p.id AS a, q.id AS b, coalesce(dot, 0) AS dot FROM docs p "
            "CROSS JOIN docs q LEFT JOIN dots ON dots.a = p.id AND dots.b = q.id)",
            fixed_candidates(
                "round(CASE WHEN 1 - dot < 1e-12 THEN 0.0 ELSE 1 - dot END, 12)"
            ),
            o.ranked("1", 7).replace("PARTITION BY 1, ", "PARTITION BY "),
        ],
        NEAR,
    )


def tfidf_rows(spark, sf) -> DataFrame:
    docs = whole(spark, sf, pooled=True)
    counts = materialize(postings.term_counts(docs, ["id"]), "counts")
    idf = postings.smoothed_idf(counts, docs.count())
    return materialize(postings.tfidf_vectors(counts, idf, ["id"]), "vectors")


@query("k3_tfidf_cosine", K3_TFIDF)
def k3_tfidf_cosine(spark, sf):
    return near_summary(nearest_of_held_out(tfidf_rows(spark, sf), 7, "cosine"))


@query("k3_term_index_tfidf", K3_TFIDF)
def k3_term_index_tfidf(spark, sf):
    vectors = tfidf_rows(spark, sf)
    near = neighbors.knn_join(
        vectors.where(held_out()), vectors.where(~held_out()), 7, index="terms", block_rows=256
    )
    return near_summary(near)


def dense_near(metric: str, k: int, where: str) -> list[str]:
    if metric == "cosine":
        d = o.cosine(
            "list_dot_product(p.vec, q.vec)",
            "list_dot_product(p.vec, p.vec)",
            "list_dot_product(q.vec, q.vec)",
        )
    else:
        d = "round(list_distance(p.vec, q.vec), 12)"
    return [
        EMB,
        f"cand AS (SELECT p.id AS query_id, q.id AS train_id, p.label AS query_label, "
        f"q.label AS label, {d} AS distance FROM emb p JOIN emb q ON {where})",
        o.ranked("1", k).replace("PARTITION BY 1, ", "PARTITION BY "),
    ]


EMB_SPLIT = (
    o.HELD_OUT.replace("id)", "p.id)") + " AND NOT " + o.HELD_OUT.replace("id)", "q.id)")
)


@query("k3_embeddings_cosine", o.sql(dense_near("cosine", 7, EMB_SPLIT), NEAR))
def k3_embeddings_cosine(spark, sf):
    vectors = embeddings(spark, sf)
    return near_summary(
        neighbors.knn_join(vectors.where(held_out()), vectors.where(~held_out()), 7)
    )


@query("k2_pivot_index", o.sql(dense_near("euclidean", 5, "p.id <> q.id"), NEAR))
def k2_pivot_index(spark, sf):
    """The nearest rows of every row, through an index with blocks of 64 rows."""
    vectors = embeddings(spark, sf).select("id", "vec")
    return near_summary(
        neighbors.knn_join(
            vectors, vectors, 5, metric="euclidean", exclude_self=True, index="pivots", block_rows=64
        )
    )


@query(
    "k3_pivot_index_projects",
    o.sql(
        [
            WHOLE, o.counts(), o.raw_pairs(),
            "cand AS (SELECT p.project, p.a AS query_id, p.b AS train_id, "
            + o.cosine("dot", "na", "nb")
            + f" AS distance FROM pairs p WHERE {o.HELD_OUT.replace('id)', 'p.a)')} "
            f"AND NOT {o.HELD_OUT.replace('id)', 'p.b)')})",
            o.ranked("project", 7),
        ],
        NEAR.replace("SELECT", "SELECT project,"),
    ),
)
def k3_pivot_index_projects(spark, sf):
    """Texts inside their project, through an index of each project."""
    vectors = materialize(base.count_vectors(whole(spark, sf), ["project", "id"]), "vectors")
    near = neighbors.knn_join(
        vectors.where(held_out()), vectors.where(~held_out()), 7, by=["project"], index="pivots", block_rows=64
    )
    return near_summary(near, "project")


@query(
    "k4_clamped_k",
    o.sql(
        [
            WHOLE, o.counts(), o.raw_pairs(),
            "cand AS (SELECT p.project, p.a AS query_id, p.b AS train_id, "
            + o.cosine("dot", "na", "nb")
            + f" AS distance FROM pairs p WHERE {o.HELD_OUT.replace('id)', 'p.a)')} "
            f"AND NOT {o.HELD_OUT.replace('id)', 'p.b)')})",
            o.ranked("project", 40),
        ],
        "SELECT project, query_id, count(*) AS n, max(rank)::INTEGER AS last, "
        "round(max(distance), 6) AS far FROM near GROUP BY ALL",
    ),
)
def k4_clamped_k(spark, sf):
    docs = whole(spark, sf)
    vectors = materialize(base.count_vectors(docs, ["project", "id"]), "vectors")
    near = neighbors.knn_join(
        vectors.where(held_out()), vectors.where(~held_out()), 40, by=["project"]
    )
    return near.groupBy("project", "query_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.max("rank").alias("last"),
        F.round(F.max("distance"), 6).alias("far"),
    )


@query(
    "k5_baseline",
    o.sql(
        fixed_near("euclidean", 1),
        "SELECT query_id, label::INTEGER AS prediction FROM near",
    ),
)
def k5_baseline(spark, sf):
    return neighbors.predict_nearest(fixed_neighbours(spark, sf, 1, "euclidean"))


@query(
    "k6_within_class",
    o.sql(
        dense_near("euclidean", 5, "p.label = 1 AND q.label = 1 AND p.id <> q.id"), NEAR
    ),
)
def k6_within_class(spark, sf):
    minority = embeddings(spark, sf).where("label = 1").select("id", "vec")
    return near_summary(
        neighbors.knn_join(
            minority, minority, 5, metric="euclidean", exclude_self=True
        )
    )


# --------------------------------------------------------------------------
# Votes and decisions


def shown_votes(tallies: DataFrame, *extra) -> DataFrame:
    """Infinite sums become flags, so that comparing needs no infinity."""

    def finite(c):
        return F.when(F.col(c) != float("inf"), F.round(c, 4)).alias(c)

    return tallies.select(*extra, "query_id", finite("phi"), finite("psi"))


FINITE = (
    "CASE WHEN phi <> 'inf'::DOUBLE THEN round(phi, 4) END AS phi, "
    "CASE WHEN psi <> 'inf'::DOUBLE THEN round(psi, 4) END AS psi"
)


@query(
    "v1_v4_uniform_votes",
    o.sql(
        [*fixed_near("cosine", 7), o.tally("query_id", "uniform")],
        f"SELECT query_id, {FINITE} FROM votes",
    ),
)
def v1_v4_uniform_votes(spark, sf):
    near = fixed_neighbours(spark, sf, 7, "cosine")
    return shown_votes(voting.tally(near, ["query_id"], "uniform"))


@query(
    "v2_v4_distance_votes",
    o.sql(
        [*fixed_near("cosine", 7), o.tally("query_id", "distance")],
        f"SELECT query_id, {FINITE} FROM votes",
    ),
)
def v2_v4_distance_votes(spark, sf):
    near = fixed_neighbours(spark, sf, 7, "cosine")
    return shown_votes(voting.tally(near, ["query_id"], "distance"))


@query(
    "v3_class_weighted_votes",
    o.sql(
        [
            *fixed_near("cosine", 7),
            o.tally("query_id", "distance", factor="CASE WHEN label = 1 THEN 3.5 ELSE 0.5 END"),
        ],
        f"SELECT query_id, {FINITE} FROM votes",
    ),
)
def v3_class_weighted_votes(spark, sf):
    near = fixed_neighbours(spark, sf, 7, "cosine")
    return shown_votes(voting.tally(near, ["query_id"], "distance", {0: 0.5, 1: 3.5}))


SIGMAS = [0.1, 0.3, 0.5, 0.95]


@query(
    "v5_base_decision",
    o.sql(
        [*fixed_near("cosine", 7), o.tally("query_id", "distance")],
        f"SELECT query_id, sigma, {o.decide('sigma')} AS prediction FROM votes, "
        + o.values("sigma", SIGMAS),
    ),
)
def v5_base_decision(spark, sf):
    near = fixed_neighbours(spark, sf, 7, "cosine")
    votes = voting.tally(near, ["query_id"], "distance")
    return voting.predictions_for_each_sigma(votes, SIGMAS).select(
        "query_id", "sigma", "prediction"
    )


# Single neighbours at distance 0 on both sides make every branch occur.
def _with_ties(votes: DataFrame) -> DataFrame:
    inf = F.lit(float("inf"))
    case = F.col("query_id") % 6
    return votes.withColumn(
        "phi", F.when(case.isin(1, 2), inf).when(case == 4, 0.0).otherwise(F.col("phi"))
    ).withColumn(
        "psi", F.when(case.isin(2, 3), inf).when(case == 4, 0.0).otherwise(F.col("psi"))
    )


TIES = (
    "tied AS (SELECT query_id, CASE WHEN query_id % 6 IN (1, 2) THEN 'inf'::DOUBLE WHEN "
    "query_id % 6 = 4 THEN 0 ELSE phi END AS phi, CASE WHEN query_id % 6 IN (2, 3) THEN "
    "'inf'::DOUBLE WHEN query_id % 6 = 4 THEN 0 ELSE psi END AS psi FROM votes)"
)


@query(
    "v6_v7_prior_decision",
    o.sql(
        [*fixed_near("cosine", 7), o.tally("query_id", "distance"), TIES],
        "SELECT query_id, "
        f"{o.decide_prior('0.3::DOUBLE', '0.4::DOUBLE', True)} AS prediction, "
        f"round({o.confidence('0.4::DOUBLE', True)}, 6) AS confidence, "
        f"{o.decide_prior('0.3::DOUBLE', '0.4::DOUBLE', False)} AS prediction_no_prior, "
        f"round({o.confidence('0.4::DOUBLE', False)}, 6) AS confidence_no_prior "
        "FROM tied",
    ),
)
def v6_v7_prior_decision(spark, sf):
    near = fixed_neighbours(spark, sf, 7, "cosine")
    votes = _with_ties(voting.tally(near, ["query_id"], "distance"))
    phi, psi = F.col("phi"), F.col("psi")
    sigma, prior = F.lit(0.3), F.lit(0.4)
    yes, no = F.lit(True), F.lit(False)
    return votes.select(
        "query_id",
        decisions.decide_with_prior(phi, psi, sigma, prior, yes).alias("prediction"),
        F.round(decisions.confidence(phi, psi, prior, yes), 6).alias("confidence"),
        decisions.decide_with_prior(phi, psi, sigma, prior, no).alias(
            "prediction_no_prior"
        ),
        F.round(decisions.confidence(phi, psi, prior, no), 6).alias(
            "confidence_no_prior"
        ),
    )


def projected_pairs(metric: str, name: str = "pairs", extra_keys: str = "") -> str:
    """All row pairs of a project and setting from projected lists."""
    dot = "list_dot_product({0}.vec, {1}.vec)"
    scale = "" if metric == "cosine" else " * x.scale * x.scale"
    return (
        f"norms AS (SELECT *, {dot.format('vecs', 'vecs')} AS n FROM vecs),\n"
        f"{name} AS (SELECT x.project, x.eps, {extra_keys}x.id AS a, y.id AS b, "
        f"{dot.format('x', 'y')}{scale} AS dot, x.n{scale} AS na, y.n{scale} AS nb "
        "FROM norms x JOIN norms y ON x.project = y.project AND x.eps = y.eps"
        f"{' AND x.split = y.split' if extra_keys else ''})"
    )


@query(
    "v8_base_classification",
    o.sql(
        [
            POOL, o.counts(), o.sizes(), o.projected([0.3], 11), projected_pairs("cosine"),
            fixed_candidates(o.cosine("dot", "na", "nb")),
            o.ranked("1", 7).replace("PARTITION BY 1, ", "PARTITION BY "),
            o.tally("query_id, query_label", "distance"),
        ],
        "SELECT query_id AS id, query_label::INTEGER AS label, "
        f"{o.decide('0.3::DOUBLE')} AS prediction FROM votes",
    ),
)
def v8_base_classification(spark, sf):
    docs = labelled(spark, sf, pooled=True)
    vectors = base.vectorize(docs, eps=0.3, seed=11).table
    rows = materialize(vectors.join(docs.select("id", "label"), "id"), "vectors")
    predicted = base.classify(
        rows.where(~held_out()), rows.where(held_out()), sigma=0.3, k=7
    )
    return predicted.select("id", "label", "prediction")


def enhanced_near(train: str, test: str, tfidf: bool = True, metric: str = "cosine") -> list[str]:
    """Neighbours of ``test`` rows by unprojected TF-IDF bigrams (or their counts) and
    scaled structural measures."""
    names = structural.STRUCTURAL_FEATURES
    scaled = ", ".join(
        f"({c} - avg({c}) FILTER ({train}) OVER ()) / (CASE WHEN stddev_pop({c}) FILTER "
        f"({train}) OVER () < 1e-9 THEN 1 ELSE stddev_pop({c}) FILTER ({train}) OVER () "
        f"END) AS {c}"
        for c in names
    )
    listed = ", ".join(names)
    return [
        POOL, GRAMS,
        f"n AS (SELECT count(*) AS n FROM docs WHERE {train})",
        "idf AS (SELECT term, ln((1.0::DOUBLE + n) / (1 + count(*))) + 1 AS idf "
        f"FROM grams, n WHERE {train} GROUP BY term, n)",
        TFIDF.format(counts="grams") if tfidf else
        "tfidf AS (SELECT id, term, tf::DOUBLE AS w FROM grams JOIN idf USING (term))",
        f"struct AS ({structural_sql('docs', 'id', 'text')})",
        f"scaled AS (SELECT id, {scaled} FROM struct)",
        f"nums AS (SELECT id, [{listed}] AS vec FROM scaled)",
        "nt AS (SELECT n.id, list_dot_product(vec, vec) + coalesce(sum(w * w), 0) AS sq "
        "FROM nums n LEFT JOIN tfidf USING (id) GROUP BY n.id, vec)",
        "dots AS (SELECT x.id AS a, y.id AS b, sum(x.w * y.w) AS dot FROM tfidf x "
        f"JOIN tfidf y USING (term) WHERE {test.replace('id)', 'x.id)')} AND "
        f"{train.replace('id)', 'y.id)')} GROUP BY ALL)",
        "pairs AS (SELECT p.id AS a, q.id AS b, coalesce(dot, 0) + "
        "list_dot_product(p.vec, q.vec) AS dot, np.sq AS na, nq.sq AS nb FROM nums p "
        "CROSS JOIN nums q JOIN nt np ON np.id = p.id JOIN nt nq ON nq.id = q.id "
        "LEFT JOIN dots ON dots.a = p.id AND dots.b = q.id)",
        fixed_candidates(o.distance_of(metric)("dot", "na", "nb")),
        o.ranked("1", 7).replace("PARTITION BY 1, ", "PARTITION BY "),
        f"pri AS (SELECT avg(label)::DOUBLE AS prior, count(*)::DOUBLE AS n, "
        f"sum(label)::DOUBLE AS n1 FROM docs WHERE {train})",
        "weighted AS (SELECT *, CASE WHEN label = 1 THEN n / (2 * n1) ELSE "
        "n / (2 * (n - n1)) END AS cw FROM near, pri)",
        *([o.tally("query_id, prior, query_label", "distance", "weighted", "cw")] if tfidf else []),
    ]


ENHANCED_VOTES = enhanced_near(f"NOT {o.HELD_OUT}", o.HELD_OUT)


def enhanced_model(spark, sf, **params):
    docs = labelled(spark, sf, pooled=True)
    settings = dict(
        eps=0.0, classWeightRatio=0.0, usePatternFeatures=False, sigma=0.4
    ) | params
    model = NeighborVoteClassifier(**settings).fit(docs.where(~held_out()))
    return model, docs.where(held_out())


@query(
    "v9_a4_a5_enhanced_predictions",
    o.sql(
        ENHANCED_VOTES,
        "SELECT query_id AS id, "
        f"{o.decide_prior('0.4::DOUBLE', 'prior', True)} AS prediction, "
        f"round({o.confidence('prior', True)}, 6) AS confidence FROM votes",
    ),
)
def v9_a4_a5_enhanced_predictions(spark, sf):
    model, test = enhanced_model(spark, sf)
    return model.transform(test).select(
        "id", "prediction", F.round("confidence", 6).alias("confidence")
    )


@query(
    "a6_a7_enhanced_scores",
    o.sql(
        [
            *ENHANCED_VOTES,
            "predicted AS (SELECT query_label AS label, "
            f"{o.decide_prior('0.4::DOUBLE', 'prior', True)} AS prediction FROM votes)",
            o.metrics("", "predicted"),
        ],
        "SELECT round(precision, 6) AS precision, round(recall, 6) AS recall, "
        "round(f1, 6) AS f1, n_flaky, n_non_flaky, n_predicted_flaky FROM measured",
    ),
)
def a6_a7_enhanced_scores(spark, sf):
    model, test = enhanced_model(spark, sf)
    return model.evaluate(test).select(
        *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")],
        "n_flaky", "n_non_flaky", "n_predicted_flaky",
    )


@query(
    "t8_count_model_predictions",
    o.sql(
        [
            *enhanced_near(f"NOT {o.HELD_OUT}", o.HELD_OUT, False, "euclidean"),
            o.tally("query_id, prior, query_label", "uniform", "weighted"),
        ],
        "SELECT query_id AS id, "
        f"{o.decide_prior('0.4::DOUBLE', 'prior', False)} AS prediction, "
        f"round({o.confidence('prior', False)}, 6) AS confidence FROM votes",
    ),
)
def t8_count_model_predictions(spark, sf):
    """Raw counts, Euclidean distances, uniform votes, no class weights and no prior."""
    model, test = enhanced_model(
        spark, sf, useTfidf=False, metric="euclidean", weights="uniform",
        handleImbalance="none", usePrior=False,
    )
    return model.transform(test).select(
        "id", "prediction", F.round("confidence", 6).alias("confidence")
    )


@query("a3_smote_model_default_projection")
def a3_smote_model_default_projection(spark, sf):
    model, test = enhanced_model(
        spark, sf, eps=0.3, handleImbalance="smote", usePatternFeatures=True
    )
    return model.predict(test).select(
        "id", "prediction", F.round("confidence", 6).alias("confidence")
    )


@query(
    "a8_vectorize",
    o.sql(
        [WHOLE_POOL, o.counts(), draw_sql("counts", 0)],
        SLOT_SUMMARY.format(src="drawn_slots"),
    ),
)
def a8_vectorize(spark, sf):
    vectors = base.vectorize(whole(spark, sf, pooled=True)).table
    return slot_summary(projection.slot_values(vectors, ["id"]))


# --------------------------------------------------------------------------
# Imbalance


@query(
    "b1_balanced_weights",
    o.sql(
        [
            DOCS,
            "n AS (SELECT project, count(*)::DOUBLE AS n, sum(label)::DOUBLE AS n1 "
            "FROM docs GROUP BY project)",
        ],
        "SELECT project, 0 AS label, round(CASE WHEN n1 = 0 OR n1 = n THEN 1 ELSE "
        "n / (2 * (n - n1)) END, 6) AS weight FROM n UNION ALL SELECT project, 1, "
        "round(CASE WHEN n1 = 0 OR n1 = n THEN 1 ELSE n / (2 * n1) END, 6) FROM n",
    ),
)
def b1_balanced_weights(spark, sf):
    out = imbalance.class_weights(labelled(spark, sf), 0.0, ["project"])
    return out.withColumns(six("weight"))


@query(
    "b2_fixed_weights",
    o.sql(
        [DOCS],
        "SELECT DISTINCT project, 0 AS label, 1.0::DOUBLE AS weight FROM docs UNION ALL "
        "SELECT DISTINCT project, 1, 5.0::DOUBLE FROM docs",
    ),
)
def b2_fixed_weights(spark, sf):
    return imbalance.class_weights(labelled(spark, sf), 5.0, ["project"])


@query(
    "b3_class_prior",
    o.sql(
        [DOCS],
        "SELECT project, round(avg(label), 6) AS prior FROM docs GROUP BY project",
    ),
)
def b3_class_prior(spark, sf):
    return imbalance.class_prior(labelled(spark, sf), ["project"]).withColumns(
        six("prior")
    )


SMOTE_SQL = [
    *dense_near("euclidean", 5, "p.label = 1 AND q.label = 1 AND p.id <> q.id"),
    "minority AS (SELECT *, row_number() OVER (ORDER BY md5(concat_ws('|', 42, 'base', "
    "id)), id) - 1 AS slot FROM emb WHERE label = 1)",
    "size AS (SELECT count(*) FILTER (label = 1) AS n1, count(*) FILTER (label = 0) AS n0 "
    "FROM emb)",
    "new AS (SELECT j, "
    f"{o.hash32('42', chr(39) + 'row' + chr(39), 'j')} % n1 AS slot, "
    f"{o.hash32('42', chr(39) + 'rank' + chr(39), 'j')} % greatest(1, least(5, n1 - 1)) + 1 "
    "AS pick, "
    f"{o.hash32('42', chr(39) + 'alpha' + chr(39), 'j')} / 4294967296.0::DOUBLE AS alpha "
    "FROM (SELECT unnest(range(n0 - n1)) AS j, n1 FROM size))",
    "made AS (SELECT -1 - j AS id, alpha, a.vec AS va, b.vec AS vb FROM new JOIN minority "
    "a USING (slot) JOIN near ON near.query_id = a.id AND near.rank = pick JOIN emb b ON "
    "b.id = near.train_id)",
]


@query(
    "b4_smote",
    o.sql(
        SMOTE_SQL,
        "SELECT id, round(sum(x + alpha * (y - x)), 5) AS total, "
        "round(sum((x + alpha * (y - x)) ** 2), 5) AS squares FROM (SELECT id, alpha, "
        "unnest(va) AS x, unnest(vb) AS y FROM made) GROUP BY id",
    ),
)
def b4_smote(spark, sf):
    rows = embeddings(spark, sf).withColumn("vec", F.col("vec").cast("array<double>"))
    made = imbalance.smote(rows).where("synthetic")
    zero = F.lit(0.0)
    return made.select(
        "id",
        F.round(F.aggregate("vec", zero, lambda a, x: a + x), 5).alias("total"),
        F.round(F.aggregate("vec", zero, lambda a, x: a + x * x), 5).alias("squares"),
    )


def between_sql(entries: str, entry: str, weight: str) -> list[str]:
    """Points between minority rows of sparse ``entries (id, entry, weight)``:
    ``made (id, entry, w)``, from the pairs of all rows."""
    return [
        "cand AS (SELECT a AS query_id, b AS train_id, "
        + o.euclid("dot", "na", "nb")
        + " AS distance FROM pairs JOIN docs x ON x.id = a JOIN docs y ON y.id = b "
        "WHERE x.label = 1 AND y.label = 1 AND a <> b)",
        o.ranked("1", 5).replace("PARTITION BY 1, ", "PARTITION BY "),
        "minority AS (SELECT id, row_number() OVER (ORDER BY md5(concat_ws('|', 42, 'base', id)), id) - 1 "
        "AS slot FROM docs WHERE label = 1)",
        "size AS (SELECT count(*) FILTER (label = 1) AS n1, count(*) FILTER (label <> 1) AS n0 FROM docs)",
        "new AS (SELECT j, "
        f"{o.hash32('42', chr(39) + 'row' + chr(39), 'j')} % n1 AS slot, "
        f"{o.hash32('42', chr(39) + 'rank' + chr(39), 'j')} % greatest(1, least(5, n1 - 1)) + 1 AS pick, "
        f"{o.hash32('42', chr(39) + 'alpha' + chr(39), 'j')} / 4294967296.0::DOUBLE AS alpha "
        "FROM (SELECT unnest(range(n0 - n1)) AS j, n1 FROM size))",
        "chosen AS (SELECT -1 - j AS new_id, alpha, a.id AS base_id, near.train_id AS other_id FROM new "
        "JOIN minority a USING (slot) JOIN near ON near.query_id = a.id AND near.rank = pick)",
        f"made AS (SELECT new_id AS id, entry, sum(w) AS w FROM (SELECT new_id, {entry} AS entry, "
        f"(1 - alpha) * {weight} AS w FROM chosen JOIN {entries} e ON e.id = base_id UNION ALL "
        f"SELECT new_id, {entry}, alpha * {weight} FROM chosen JOIN {entries} e ON e.id = other_id) GROUP BY ALL)",
    ]


MADE = (
    "SELECT id, count(*) AS n_entries, round(sum(w), 5) AS total, round(sum(w * w), 5) AS squares "
    "FROM made GROUP BY id"
)


def made_summary(entries: DataFrame, value: str) -> DataFrame:
    return entries.groupBy("id").agg(
        F.count(F.lit(1)).alias("n_entries"), F.round(F.sum(value), 5).alias("total"),
        F.round(F.sum(F.col(value) * F.col(value)), 5).alias("squares"),
    )


@query("b4_smote_sparse", o.sql([POOL, o.counts(), o.raw_pairs(), *between_sql("counts", "term", "tf")], MADE))
def b4_smote_sparse(spark, sf):
    """Synthetic rows of term counts: one entry for each term of either end."""
    docs = labelled(spark, sf, pooled=True)
    rows = materialize(postings.count_vectors(docs, ["id", "label"]), "vectors")
    made = imbalance.smote(rows).where("synthetic")
    entries = made.select("id", F.inline(F.arrays_zip("terms", "weights")).alias("term", "w"))
    return made_summary(entries, "w")


SLOT_PAIRS = """slot_sq AS (SELECT d.id, coalesce(sum(v * v), 0)::DOUBLE AS n FROM docs d
  LEFT JOIN drawn_slots USING (id) GROUP BY d.id),
slot_dots AS (SELECT x.id AS a, y.id AS b, sum(x.v * y.v) AS dot FROM drawn_slots x JOIN drawn_slots y
  USING (slot) JOIN docs p ON p.id = x.id AND p.label = 1 JOIN docs q ON q.id = y.id AND q.label = 1 GROUP BY ALL),
pairs AS (SELECT p.id AS a, q.id AS b, coalesce(dot, 0) AS dot, p.n AS na, q.n AS nb
  FROM slot_sq p CROSS JOIN slot_sq q LEFT JOIN slot_dots s ON s.a = p.id AND s.b = q.id)"""


@query(
    "b4_smote_slots",
    o.sql(
        [POOL, o.counts(), draw_sql("counts", 7), SLOT_PAIRS, *between_sql("drawn_slots", "slot", "v")],
        MADE.replace("FROM made", "FROM made WHERE abs(w) > 1e-9"),
    ),
)
def b4_smote_slots(spark, sf):
    """Synthetic rows of projected counts: the form of the default model."""
    docs = labelled(spark, sf, pooled=True)
    rows = materialize(postings.count_vectors(docs, ["id", "label"]), "vectors")
    n_terms = rows.select(F.explode("terms")).distinct().count()
    dim = projection.jl_dim(rows.count(), 0.3)
    projected = materialize(projection.project_vectors(projection.spread(rows), dim, n_terms, 7), "vectors")
    made = imbalance.smote(projected).where("synthetic")
    entries = projection.slot_values(made, ["id"])
    return made_summary(entries.where("abs(value) > 1e-9"), "value")


@query(
    "b5_smote_no_need",
    o.sql([EMB], "SELECT label, count(*) AS n, 0 AS n_new FROM (SELECT 1 - label AS label "
          "FROM emb) GROUP BY label"),
)
def b5_smote_no_need(spark, sf):
    flipped = embeddings(spark, sf).withColumn("label", 1 - F.col("label"))
    return imbalance.smote(flipped).groupBy("label").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col("synthetic").cast("int")).cast("int").alias("n_new"),
    )


@query(
    "b6_modes",
    o.sql(
        [
            EMB,
            "size AS (SELECT count(*) AS n, sum(label)::BIGINT AS n1 FROM emb)",
        ],
        "SELECT 'smote' AS mode, 2 * (n - n1) AS n_train FROM size UNION ALL "
        "SELECT 'weights', n FROM size UNION ALL SELECT 'none', n FROM size",
    ),
)
def b6_modes(spark, sf):
    rows = embeddings(spark, sf)
    out = None
    for mode in ("smote", "weights", "none"):
        used = imbalance.smote(rows) if mode == "smote" else rows
        part = used.select(F.lit(mode).alias("mode"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("mode").agg(F.count(F.lit(1)).alias("n_train"))


@query(
    "b6_fitted_modes",
    o.sql(
        [
            POOL,
            f"size AS (SELECT count(*) AS n, sum(label)::BIGINT AS n1 FROM docs WHERE NOT {o.HELD_OUT})",
        ],
        "SELECT mode, CASE WHEN mode = 'smote' THEN 2 * greatest(n1, n - n1) ELSE n END AS n_train, "
        "CASE WHEN mode = 'smote' THEN greatest(n1, n - n1) ELSE n1 END AS n_flaky, "
        "round(n1::DOUBLE / n, 9) AS prior, "
        "CASE WHEN mode = 'weights' THEN round(n / (2.0::DOUBLE * (n - n1)), 9) END AS weight_0, "
        "CASE WHEN mode = 'weights' THEN round(n / (2.0::DOUBLE * n1), 9) END AS weight_1 "
        "FROM size, (VALUES ('smote'), ('weights'), ('none')) m(mode)",
    ),
)
def b6_fitted_modes(spark, sf):
    """Training rows, prior and weights of a model fitted in each mode."""
    out = None
    for mode in ("smote", "weights", "none"):
        model, _ = enhanced_model(spark, sf, eps=0.3, handleImbalance=mode)
        state = model.fitted
        part = model.vectors.agg(
            F.lit(mode).alias("mode"), F.count(F.lit(1)).alias("n_train"),
            F.sum("label").cast("long").alias("n_flaky"),
        ).select(
            "*", F.round(F.lit(state.prior), 9).alias("prior"),
            F.round(F.lit(state.weight_0).cast("double"), 9).alias("weight_0"),
            F.round(F.lit(state.weight_1).cast("double"), 9).alias("weight_1"),
        )
        out = part if out is None else out.unionByName(part)
    return out


# --------------------------------------------------------------------------
# Evaluation


@query(
    "e1_e4_metrics",
    o.sql(
        [SIMPLE, o.metrics("project", "simple")],
        "SELECT project, tp, fp, fn, tn, round(precision, 6) AS precision, "
        "round(recall, 6) AS recall, round(f1, 6) AS f1, n_flaky, n_non_flaky, "
        "n_predicted_flaky FROM measured",
    ),
)
def e1_e4_metrics(spark, sf):
    out = evaluation.evaluate(simple_predictions(spark, sf), ["project"])
    return out.withColumns(six("precision", "recall", "f1"))


SPLITS = experiments.N_SPLITS
TEST = [experiments.TEST_SIZE]


@query(
    "e5_stratified_splits",
    o.sql(
        [DOCS, o.drawn(SPLITS, TEST, 3, True)],
        "SELECT project, split::INTEGER AS split, id, is_train FROM drawn",
    ),
)
def e5_stratified_splits(spark, sf):
    labels = labelled(spark, sf).drop("text")
    out = splits.stratified_splits(labels, SPLITS, TEST, 3, ["project"])
    return out.select("project", "split", "id", "is_train")


@query(
    "e6_shuffle_splits",
    o.sql(
        [POOL, o.drawn(SPLITS, TEST, 3, False)],
        "SELECT split::INTEGER AS split, id, is_train FROM drawn",
    ),
)
def e6_shuffle_splits(spark, sf):
    labels = labelled(spark, sf, pooled=True).drop("text", "project")
    out = splits.shuffle_splits(labels, SPLITS, TEST[0], 3)
    return out.select("split", "id", "is_train")


@query(
    "e7_e8_usable_splits",
    o.sql(
        [DOCS, o.drawn(SPLITS, TEST, 3, True), o.usable()],
        "SELECT project, count(*) AS n_splits, round(avg(train_pos), 6) AS train_pos, "
        "round(avg(train_neg), 6) AS train_neg, round(avg(test_pos), 6) AS test_pos, "
        "round(avg(test_neg), 6) AS test_neg FROM usable GROUP BY project",
    ),
)
def e7_e8_usable_splits(spark, sf):
    labels = labelled(spark, sf).drop("text")
    drawn = splits.stratified_splits(labels, SPLITS, TEST, 3, ["project"])
    usable = splits.usable_splits(drawn, ["project", "split"])
    names = ["train_pos", "train_neg", "test_pos", "test_neg"]
    return usable.groupBy("project").agg(
        F.count(F.lit(1)).alias("n_splits"),
        *[F.round(F.avg(c), 6).alias(c) for c in names],
    )


@query(
    "e9_averages",
    o.sql(
        [SIMPLE.replace("simple AS (SELECT", "simple AS (SELECT d.lang AS lang,"),
         o.metrics("project, lang", "simple")],
        "SELECT project, count(*) AS n_splits, round(avg(precision), 6) AS precision, "
        "round(avg(recall), 6) AS recall FROM measured GROUP BY project",
    ),
)
def e9_averages(spark, sf):
    labels = table(spark, sf, "labels").withColumnRenamed("doc_id", "id")
    rows = documents(spark, sf).join(labels, "id").select(
        F.col("source").alias("project"), "lang",
        F.col("toxic").alias("label"), (1 - F.col("quality")).alias("prediction"),
    )
    metrics = evaluation.evaluate(rows, ["project", "lang"])
    out = evaluation.average_over_splits(metrics, ["project"])
    return out.withColumns(six("precision", "recall"))


KEYS = "q.project, q.split"
VOTE_KEYS = "project, split, query_id, query_label"


def storage_sql(kind: str = "dim") -> str:
    return f"(n_rows * ({kind}::BIGINT * 8 + 8))::BIGINT"


def grid_votes(ks: list[int], weights: str, keys: str = VOTE_KEYS) -> str:
    return (
        f"graded AS (SELECT near.*, k FROM near JOIN {o.values('k', ks, 'INTEGER')} g "
        "ON rank <= k),\n" + o.tally(f"{keys}, k", weights, "graded")
    )


def grid_predictions(sigmas: list[float]) -> str:
    return (
        f"predicted AS (SELECT *, {o.decide('sigma')} AS prediction FROM votes, "
        + o.values("sigma", sigmas)
        + ")"
    )


def effectiveness_sql(docs: str, ks, sigmas) -> str:
    return o.sql(
        [
            docs, o.counts(), o.sizes(), o.projected([0.3], 0), projected_pairs("cosine"),
            o.drawn(SPLITS, TEST, 0, True), o.usable(),
            o.split_candidates(o.cosine("p.dot", "p.na", "p.nb"), "pairs", KEYS),
            o.ranked("project, split", max(ks)), grid_votes(ks, "distance"),
            grid_predictions(sigmas),
            o.metrics("project, split, k, sigma", "predicted", "query_label"),
            o.averages("project, k, sigma"),
        ],
        "SELECT project AS dataset, round(train_pos, 6) AS \"flakyTrain\", "
        "round(train_neg, 6) AS \"nonFlakyTrain\", round(test_pos, 6) AS \"flakyTest\", "
        "round(test_neg, 6) AS \"nonFlakyTest\", k, sigma, round(precision, 6) AS "
        f"precision, round(recall, 6) AS recall, {storage_sql()} AS storage "
        "FROM averaged JOIN dims USING (project)",
    )


AVERAGES = ["flakyTrain", "nonFlakyTrain", "flakyTest", "nonFlakyTest"]


@query("e11_one_setting", effectiveness_sql(DOCS, [7], [0.5]))
def e11_one_setting(spark, sf):
    out = experiments.effectiveness(labelled(spark, sf), [7], [0.5])
    return out.withColumns(six(*AVERAGES, "precision", "recall"))


@query("e14_effectiveness_grid", effectiveness_sql(DOCS, [3, 7], [0.5, 0.95]))
def e14_effectiveness_grid(spark, sf):
    out = experiments.effectiveness(labelled(spark, sf))
    return out.withColumns(six(*AVERAGES, "precision", "recall"))


def comparison_sql(ks, sigmas) -> str:
    raw = o.raw_pairs("raw_pairs")
    return o.sql(
        [
            POOL, o.counts(), o.sizes(), o.projected([0.3], 0), projected_pairs("cosine"),
            raw, o.drawn(SPLITS, TEST, 0, False), o.usable(),
            o.split_candidates(o.euclid("p.dot", "p.na", "p.nb"), "raw_pairs", KEYS, "rawc"),
            o.ranked("project, split", 1, "rawc", "rawn"),
            o.split_candidates(o.cosine("p.dot", "p.na", "p.nb"), "pairs", KEYS),
            o.ranked("project, split", max(ks)), grid_votes(ks, "distance"),
            grid_predictions(sigmas),
            "united AS (SELECT project, split, query_label, prediction, 'projected-k' || k "
            "|| '-sigma' || sigma AS approach FROM predicted UNION ALL SELECT project, "
            "split, query_label, label, 'nearest-baseline' FROM rawn)",
            o.metrics("project, split, approach", "united", "query_label"),
            o.averages("project, approach"),
        ],
        "SELECT project, approach, round(precision, 6) AS precision, round(recall, 6) AS "
        f"recall, CASE WHEN approach = 'nearest-baseline' THEN {storage_sql('n_terms')} "
        f"ELSE {storage_sql()} END AS storage FROM averaged JOIN dims USING (project)",
    )


@query("e12_shuffled_setting", comparison_sql([7], [0.5]))
def e12_shuffled_setting(spark, sf):
    docs = labelled(spark, sf, pooled=True)
    out = experiments.comparison(docs, [7], [0.5])
    return out.withColumns(six("precision", "recall"))


@query("e20_comparison", comparison_sql([3, 7], [0.5, 0.95]))
def e20_comparison(spark, sf):
    out = experiments.comparison(labelled(spark, sf, pooled=True))
    return out.withColumns(six("precision", "recall"))


def refit_sql(metrics: list[str], ks, sigmas) -> str:
    parts = []
    for metric in metrics:
        d = o.distance_of(metric)("p.dot", "p.na", "p.nb")
        parts += [
            o.split_candidates(
                d, f"pairs_{metric}", KEYS, f"c_{metric}", " AND p.split = q.split"
            ),
            o.ranked("project, split", max(ks), f"c_{metric}", f"n_{metric}"),
        ]
    pairs = []
    for i, metric in enumerate(metrics):
        text = projected_pairs(metric, f"pairs_{metric}", "x.split, ")
        pairs.append(text if i == 0 else text[text.index(f"pairs_{metric} AS") :])
    union = " UNION ALL ".join(
        f"SELECT *, '{m}' AS metric FROM n_{m}" for m in metrics
    )
    return o.sql(
        [
            POOL, o.counts(), o.sizes(), o.projected([0.3], 0, SPLITS), *pairs,
            o.drawn(SPLITS, TEST, 0, True), o.usable(), *parts,
            f"near AS ({union})",
            grid_votes(ks, "uniform", VOTE_KEYS + ", metric"),
            grid_predictions(sigmas),
            o.metrics("project, split, metric, k, sigma", "predicted", "query_label"),
            o.averages("project, metric, k, sigma"),
        ],
        "SELECT project, metric AS distance, k, sigma, 0.3::DOUBLE AS eps, "
        "round(precision, 6) AS precision, round(recall, 6) AS recall, "
        f"{storage_sql()} AS storage FROM averaged JOIN dims USING (project)",
    )


@query("e13_refit_per_split", refit_sql(["cosine"], [7], [0.5]))
def e13_refit_per_split(spark, sf):
    out = experiments.evaluate_refit(labelled(spark, sf, pooled=True))
    return out.withColumns(six("precision", "recall"))


@query("e15_sweep_metric", refit_sql(["cosine", "euclidean"], [3, 7], [0.5]))
def e15_sweep_metric(spark, sf):
    out = experiments.sweep_metric(labelled(spark, sf, pooled=True))
    return out.withColumns(six("precision", "recall"))


@query("e17_sweep_k", refit_sql(["cosine"], experiments.SWEEP_K, [0.5]))
def e17_sweep_k(spark, sf):
    out = experiments.sweep_k(labelled(spark, sf, pooled=True))
    return out.withColumns(six("precision", "recall"))


@query("e18_sweep_sigma", refit_sql(["cosine"], [7], experiments.SWEEP_SIGMA))
def e18_sweep_sigma(spark, sf):
    out = experiments.sweep_sigma(labelled(spark, sf, pooled=True))
    return out.withColumns(six("precision", "recall"))


def sweep_eps_sql() -> str:
    """One refit of all splits for every error, each with its own projections;
    error 0 from the raw counts."""
    d = o.cosine("p.dot", "p.na", "p.nb")

    def part(position: int, eps: float) -> str:
        if eps > 0:
            extra, sizes = " AND p.split = q.split", "JOIN dims USING (project)"
            pairs = [
                o.projected([eps], experiments.setting_seed(0, position), SPLITS),
                projected_pairs("cosine", extra_keys="x.split, "),
            ]
        else:
            extra, sizes = "", "JOIN (SELECT *, n_terms AS dim FROM sizes) USING (project)"
            pairs = [o.raw_pairs()]
        return o.sql(
            [
                POOL, o.counts(), o.sizes(), *pairs, o.drawn(SPLITS, TEST, 0, True), o.usable(),
                o.split_candidates(d, "pairs", KEYS, extra=extra),
                o.ranked("project, split", 7), o.tally(VOTE_KEYS, "uniform"),
                f"predicted AS (SELECT *, {o.decide('0.5::DOUBLE')} AS prediction FROM votes)",
                o.metrics("project, split", "predicted", "query_label"), o.averages("project"),
            ],
            f"SELECT project, 'cosine' AS distance, 7 AS k, 0.5::DOUBLE AS sigma, {eps}::DOUBLE AS eps, "
            "round(precision, 6) AS precision, round(recall, 6) AS recall, "
            f"{storage_sql()} AS storage FROM averaged {sizes}",
        )

    parts = [part(i, float(e)) for i, e in enumerate(experiments.SWEEP_EPS)]
    return " UNION ALL ".join(f"({p})" for p in parts)


@query("e16_sweep_eps", sweep_eps_sql())
def e16_sweep_eps(spark, sf):
    out = experiments.sweep_eps(labelled(spark, sf, pooled=True))
    return out.withColumns(six("precision", "recall"))


def learning_sql() -> str:
    """For every test size splits and projections of its own."""

    def part(position: int, size: float) -> str:
        seed = experiments.setting_seed(0, position)
        return o.sql(
            [
                POOL, o.counts(), o.sizes(), o.projected([0.3], seed, SPLITS),
                projected_pairs("cosine", extra_keys="x.split, "),
                o.drawn(SPLITS, [size], seed, True), o.usable("project, test_size, split"),
                o.split_candidates(
                    o.cosine("p.dot", "p.na", "p.nb"), "pairs", KEYS + ", q.test_size",
                    extra=" AND p.split = q.split",
                ),
                o.ranked("project, test_size, split", 7),
                o.tally("test_size, " + VOTE_KEYS, "uniform"),
                grid_predictions([0.5, 0.95]),
                o.metrics("project, test_size, split, sigma", "predicted", "query_label"),
                o.averages("project, test_size, sigma", "project, test_size, split"),
            ],
            "SELECT project, round(1 - test_size, 10) AS \"trainingSetSize\", 7 AS k, sigma, "
            "0.3::DOUBLE AS eps, round(precision, 6) AS precision, round(recall, 6) AS recall, "
            f"{storage_sql()} AS storage FROM averaged JOIN dims USING (project)",
        )

    parts = [part(i, t) for i, t in enumerate(experiments.LEARNING_TEST_SIZES)]
    return " UNION ALL ".join(f"({p})" for p in parts)


@query("e19_learning_curve", learning_sql())
def e19_learning_curve(spark, sf):
    out = experiments.learning_curve(labelled(spark, sf, pooled=True))
    return out.withColumns(six("precision", "recall"))


# --------------------------------------------------------------------------


@query(
    "a1_a2_flagship",
    o.sql(
        [
            *fixed_near("cosine", 7), o.tally("query_id, query_label", "distance"),
            f"predicted AS (SELECT query_label AS label, {o.decide('0.3::DOUBLE')} AS "
            "prediction FROM votes)",
            o.metrics("", "predicted"),
        ],
        "SELECT round(precision, 6) AS precision, round(recall, 6) AS recall, "
        "n_flaky, n_non_flaky, n_predicted_flaky FROM measured",
    ),
)
def flagship(spark, sf):
    """Predict the label of held-out texts and report how well it went."""
    near = fixed_neighbours(spark, sf, 7, "cosine")
    votes = voting.tally(near, ["query_id", "query_label"], "distance")
    predicted = voting.with_predictions(votes, 0.3)
    return evaluation.evaluate(predicted, label="query_label").select(
        *[F.round(c, 6).alias(c) for c in ("precision", "recall")],
        "n_flaky", "n_non_flaky", "n_predicted_flaky",
    )
