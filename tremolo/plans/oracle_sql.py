"""Building blocks for the ANSI-SQL twins of the registered queries.

Each function returns the text of one or more common table expressions; ``sql``
puts them together.  The twins are written from the definitions, not from the
Spark plans, and compute every row pair where the plans work in blocks.
"""

from __future__ import annotations

TOKEN = r"[\p{L}\p{N}_]{2,}"


def sql(ctes: list[str], select: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + select


def hash32(*parts: str) -> str:
    return f"('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 8))::BIGINT"


def labelled(project: str = "d.source") -> str:
    return (
        f"docs AS (SELECT {project} AS project, d.doc_id AS id, d.text AS text, "
        "l.toxic AS label FROM documents d JOIN labels l USING (doc_id))"
    )


def whole(project: str = "source") -> str:
    """All documents; there is a label only where ``labelled`` is used."""
    return (
        f"docs AS (SELECT {project} AS project, doc_id AS id, text, "
        "NULL::INTEGER AS label FROM documents)"
    )


HELD_OUT = f"({hash32(chr(39) + 'held-out' + chr(39), 'id')} % 5 = 0)"


def counts(docs: str = "docs", keys: str = "project, id", name: str = "counts") -> str:
    return (
        f"{name} AS (SELECT {keys}, term, count(*) AS tf FROM (SELECT {keys}, "
        f"unnest(regexp_extract_all(lower(text), '{TOKEN}')) AS term FROM {docs}) "
        "GROUP BY ALL)"
    )


def ngram_counts(docs: str, keys: str, name: str, low: int = 1, high: int = 2) -> str:
    parts = []
    for n in range(low, high + 1):
        gram = " || ' ' || ".join(f"toks[i + {j}]" for j in range(n))
        parts.append(
            f"SELECT {keys}, {gram} AS term FROM (SELECT {keys}, toks, "
            f"unnest(range(1, len(toks) - {n - 2})) AS i FROM {name}_tok)"
        )
    body = " UNION ALL ".join(parts)
    return (
        f"{name}_tok AS (SELECT {keys}, regexp_extract_all(lower(text), '{TOKEN}') "
        f"AS toks FROM {docs}),\n"
        f"{name} AS (SELECT {keys}, term, count(*) AS tf FROM ({body}) GROUP BY ALL)"
    )


def sizes() -> str:
    return (
        "n_docs AS (SELECT project, count(*) AS n_rows FROM docs GROUP BY project),\n"
        "sizes AS (SELECT project, n_rows, count(DISTINCT term) AS n_terms "
        "FROM n_docs JOIN counts USING (project) GROUP BY project, n_rows)"
    )


def jl(n: str, eps: str) -> str:
    e = f"({eps})::DOUBLE"
    return (
        f"greatest(1, floor(4.0::DOUBLE * ln({n}) / ({e} * {e} / 2 - "
        f"{e} * {e} * {e} / 3))::INTEGER)"
    )


def draws(dim: str, n_terms: str) -> str:
    return f"greatest(1, floor({dim} / sqrt({n_terms}::DOUBLE) + 0.5)::INTEGER)"


PRIME = "2147483647"
CODE = "('0x' || substr(md5(term), 1, 15))::BIGINT"


def functions(seed: int, projections: int, most: str) -> str:
    """``fun (split, i, a, b, c, d, e, f)``: the draws of each projection."""

    def part(start: int, extra: str) -> str:
        return f"('0x' || substr(h, {start}, 8))::BIGINT % {extra}"

    factor = "2147483646 + 1"
    return f"""fun AS (SELECT split, i, {part(1, factor)} AS a,
  {part(9, PRIME)} AS b, {part(17, factor)} AS c, {part(25, PRIME)} AS d,
  {part(33, factor)} AS e, {part(41, factor)} AS f
  FROM (SELECT split, i, sha256(concat_ws('|', {seed}, split, i)) AS h
  FROM range({projections}) r(split), (SELECT unnest(range({most})) AS i)))"""


SLOT = f"((a * (x // 1073741824) + e * (x % 1073741824) + b) % {PRIME}) % dim"
SIGNED = (
    f"CASE WHEN ((c * (x % 1073741824) + f * (x // 1073741824) + d) % {PRIME}) % 2 = 1 "
    "THEN -tf ELSE tf END"
)


def projected(eps: list[float], seed: int, refit: int = 0) -> str:
    """``vecs (project, eps, [split,] id, vec, scale)``: dense lists of whole
    numbers; multiply by ``scale`` for the projected values.  eps 0 is left to
    ``raw_pairs``."""
    listed = ", ".join(f"{e}::DOUBLE" for e in eps if e > 0)
    again = f", range({refit}) r(split)" if refit else ""
    s = "split, " if refit else ""
    g = "g.split, " if refit else ""
    return f"""dims AS (SELECT project, eps, n_rows, n_terms, {jl('n_rows', 'eps')} AS dim
  FROM sizes, (SELECT unnest([{listed}]) AS eps)),
draw AS (SELECT *, {draws('dim', 'n_terms')} AS m FROM dims),
most AS (SELECT max(m) AS m FROM draw),
{functions(seed, refit or 1, '(SELECT m FROM most)')},
coded AS MATERIALIZED (SELECT project, id, tf, {CODE} AS x FROM counts),
slots AS (SELECT project, eps, {s}id, {SLOT} AS slot, sum({SIGNED})::DOUBLE AS v
  FROM coded JOIN draw USING (project) JOIN fun ON fun.i < draw.m GROUP BY ALL),
grid AS (SELECT d.project, d.eps, {s}docs.id, m, unnest(range(dim)) AS slot
  FROM draw d JOIN docs USING (project){again}),
vecs AS (SELECT g.project, g.eps, {g}g.id, 1 / sqrt(any_value(g.m)::DOUBLE) AS scale,
  list(coalesce(s.v, 0) ORDER BY g.slot) AS vec
  FROM grid g LEFT JOIN slots s USING (project, eps, {s}id, slot)
  GROUP BY g.project, g.eps, {g}g.id)"""


def cosine(dot: str, na: str, nb: str) -> str:
    return (
        f"CASE WHEN {na} * {nb} = 0 THEN 1.0 ELSE round(CASE WHEN "
        f"1 - {dot} / sqrt({na} * {nb}) < 1e-12 THEN 0.0 ELSE "
        f"1 - {dot} / sqrt({na} * {nb}) END, 12) END"
    )


def euclid(dot: str, na: str, nb: str) -> str:
    return (
        f"round(sqrt(CASE WHEN {na} + {nb} - 2 * {dot} < 1e-13 * ({na} + {nb}) "
        f"THEN 0.0 ELSE {na} + {nb} - 2 * {dot} END), 12)"
    )


def distance_of(metric: str):
    return cosine if metric == "cosine" else euclid


def raw_pairs(name: str = "pairs", counts_name: str = "counts") -> str:
    """All row pairs of a project from counts: ``(project, a, b, dot, na, nb)``,
    including those that share no term."""
    return (
        f"sq AS (SELECT d.project, d.id, coalesce(sum(tf * tf), 0)::DOUBLE AS n FROM "
        f"docs d LEFT JOIN {counts_name} c USING (project, id) GROUP BY ALL),\n"
        f"dots AS (SELECT x.project, x.id AS a, y.id AS b, sum(x.tf * y.tf)::DOUBLE AS "
        f"dot FROM {counts_name} x JOIN {counts_name} y USING (project, term) "
        "GROUP BY ALL),\n"
        f"{name} AS (SELECT p.project, p.id AS a, q.id AS b, coalesce(dot, 0) AS dot, "
        "p.n AS na, q.n AS nb FROM sq p JOIN sq q USING (project) LEFT JOIN dots ON "
        "dots.project = p.project AND dots.a = p.id AND dots.b = q.id)"
    )


def drawn(n_splits: int, test_sizes: list[float], seed: int, stratified: bool) -> str:
    """``drawn (project, test_size, split, id, label, is_train)``."""
    listed = ", ".join(f"{t}::DOUBLE" for t in test_sizes)
    cls = ", label" if stratified else ""
    if stratified:
        quota = """CASE WHEN label = 1 THEN (n_train * n1) // n + CASE WHEN
    (n_train * n1) % n > (n_train * n0) % n THEN spare ELSE 0 END
    ELSE (n_train * n0) // n + CASE WHEN (n_train * n1) % n > (n_train * n0) % n
    THEN 0 ELSE spare END END"""
    else:
        quota = "n_train"
    return f"""cls AS (SELECT project, count(*) AS n, count(*) FILTER (label = 1) AS n1,
  count(*) FILTER (label <> 1) AS n0 FROM docs GROUP BY project),
quota0 AS (SELECT *, n - ceil(test_size * n)::BIGINT AS n_train FROM cls,
  (SELECT unnest([{listed}]) AS test_size)),
quota AS (SELECT *, n_train - (n_train * n0) // n - (n_train * n1) // n AS spare
  FROM quota0),
ordered AS (SELECT docs.project, id, label, split, test_size, row_number() OVER (
  PARTITION BY docs.project, test_size, split{cls}
  ORDER BY md5(concat_ws('|', {seed}, split, id)), id) AS rn
  FROM docs, range({n_splits}) r(split), (SELECT unnest([{listed}]) AS test_size)),
drawn AS (SELECT project, test_size, split, id, label, rn <= {quota} AS is_train
  FROM ordered JOIN quota USING (project, test_size))"""


def usable(keys: str = "project, split") -> str:
    return f"""usable AS (SELECT {keys},
  count(*) FILTER (is_train AND label = 1) AS train_pos,
  count(*) FILTER (is_train AND label <> 1) AS train_neg,
  count(*) FILTER (NOT is_train AND label = 1) AS test_pos,
  count(*) FILTER (NOT is_train AND label <> 1) AS test_neg
  FROM drawn GROUP BY ALL HAVING train_pos > 0 AND test_pos > 0)"""


def ranked(keys: str, k: int, source: str = "cand", name: str = "near") -> str:
    """The k first per query of ``cand (keys…, query_id, train_id, …, distance)``."""
    return (
        f"{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {keys}, "
        f"query_id ORDER BY distance, train_id) AS rank FROM {source}) "
        f"WHERE rank <= {k})"
    )


def split_candidates(
    distance: str, pairs: str, keys: str, name: str = "cand", extra: str = ""
) -> str:
    """Candidates of every split: test rows against training rows."""
    return (
        f"{name} AS (SELECT {keys}, q.id AS query_id, q.label AS query_label, "
        f"t.id AS train_id, t.label AS label, {distance} AS distance FROM drawn q "
        f"JOIN drawn t ON q.project = t.project AND q.split = t.split AND "
        f"q.test_size = t.test_size AND NOT q.is_train AND t.is_train JOIN {pairs} p "
        f"ON p.project = q.project AND p.a = q.id AND p.b = t.id{extra})"
    )


def vote(weights: str, factor: str = "1.0") -> str:
    one = (
        "1.0::DOUBLE"
        if weights == "uniform"
        else "CASE WHEN distance = 0 THEN 'inf'::DOUBLE ELSE 1 / distance END"
    )
    return f"({one}) * ({factor})"


def tally(keys: str, weights: str, source: str = "near", factor: str = "1.0") -> str:
    v = vote(weights, factor)
    return (
        f"votes AS (SELECT {keys}, sum(CASE WHEN label = 1 THEN {v} ELSE 0 END) AS phi, "
        f"sum(CASE WHEN label = 1 THEN 0 ELSE {v} END) AS psi FROM {source} "
        "GROUP BY ALL)"
    )


INF = "'inf'::DOUBLE"


def decide(sigma: str) -> str:
    return (
        f"CASE WHEN psi = {INF} THEN 0 WHEN phi = {INF} THEN 1 WHEN phi + psi = 0 "
        f"THEN 0 WHEN phi / (phi + psi) >= {sigma} THEN 1 ELSE 0 END"
    )


def decide_prior(sigma: str, prior: str, use_prior: bool) -> str:
    tie = f"CASE WHEN {prior} >= {sigma} THEN 1 ELSE 0 END" if use_prior else "0"
    return (
        f"CASE WHEN (phi = {INF} AND psi = {INF}) OR (phi = 0 AND psi = 0) THEN {tie} "
        f"ELSE {decide(sigma)} END"
    )


def confidence(prior: str, use_prior: bool) -> str:
    tie = prior if use_prior else "0.5::DOUBLE"
    return (
        f"CASE WHEN (phi = {INF} AND psi = {INF}) OR (phi = 0 AND psi = 0) THEN {tie} "
        f"WHEN phi = {INF} OR psi = {INF} THEN 1.0 ELSE "
        "greatest(phi / (phi + psi), 1 - phi / (phi + psi)) END"
    )


def metrics(keys: str, source: str, label: str = "label", name: str = "measured") -> str:
    by = f"{keys}, " if keys else ""
    group = "GROUP BY ALL" if keys else ""
    return f"""{name} AS (SELECT {by}tp, fp, fn, tn,
  tp / nullif(tp + fp, 0)::DOUBLE AS precision, tp / nullif(tp + fn, 0)::DOUBLE AS recall,
  2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE AS f1, tp + fn AS n_flaky,
  fp + tn AS n_non_flaky, tp + fp AS n_predicted_flaky FROM (SELECT {by}
  count(*) FILTER ({label} = 1 AND prediction = 1) AS tp,
  count(*) FILTER ({label} <> 1 AND prediction = 1) AS fp,
  count(*) FILTER ({label} = 1 AND prediction <> 1) AS fn,
  count(*) FILTER ({label} <> 1 AND prediction <> 1) AS tn FROM {source} {group}))"""


def averages(keys: str, split_keys: str = "project, split") -> str:
    return (
        f"averaged AS (SELECT {keys}, count(*) AS n_splits, avg(precision) AS precision, "
        "avg(recall) AS recall, avg(train_pos) AS train_pos, avg(train_neg) AS "
        "train_neg, avg(test_pos) AS test_pos, avg(test_neg) AS test_neg "
        f"FROM measured JOIN usable USING ({split_keys}) GROUP BY ALL)"
    )


def values(name: str, items: list, kind: str = "DOUBLE") -> str:
    listed = ", ".join(f"{v}::{kind}" for v in items)
    return f"(SELECT unnest([{listed}]) AS {name})"
