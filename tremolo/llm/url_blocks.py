"""URL rules whose block decisions spread over redirects and canonical links.

DataFrame functions only.  Every distinct address (page or link target, without
its fragment, scheme and host in lower case) is a node; a page's canonical links
and meta refreshes are edges.  A node has the decision of the longest rule that
fits it.  A node without one is blocked if its component holds a blocked node and
allowed otherwise; a node with an allow rule of its own stays allowed whatever its
aliases are.

Links are read as a browser reads them: comments and scripts hold none, ``rel``
is a list of words, entities of ASCII characters are decoded, and relative links
are resolved by RFC 3986, dot segments included.  A tag ends at its first ``>``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._components import components

#: Rules held in one expression; longer lists are joined by host.
MAX_RULES = 1_000

_HIDDEN = r"(?is)<!--.*?(?:-->|\z)|<script\b.*?(?:</script|\z)"
_TAGS = r"(?is)<(?:link|meta)\b[^>]*>"
_VALUE = r"""(?is)[\s"'/]{}\s*=\s*(?:"([^"]*)|'([^']*)|([^\s"'>]+))"""
#: Of a refresh: the seconds, a separator, and the address, quoted or not.
_REFRESH = r"""(?is)^\s*[0-9.]+[;,\s]\s*(?:url\s*=\s*)?(?:"([^"]*)|'([^']*)|(.*))"""
#: Numbers of printable ASCII characters but ``&``, decimal or hexadecimal.
_NUMBERED = (
    r"&#(?:0*(?:3[3-79]|[4-9][0-9]|1[01][0-9]|12[0-6])|[xX]0*(?:2[1-57-9a-fA-F]|[3-6][0-9a-fA-F]|7[0-9a-eA-E]));"
)
_AMPERSAND = r"&(?:amp|#0*38|#[xX]0*26);"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _lower(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)


def host(url: Column) -> Column:
    """Between the first ``://`` and ``/ ? #`` or the end, A-Z lower-cased."""
    return _lower(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit("")))


def path(url: Column) -> Column:
    """From the end of the host up to ``? #`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def matched_rule(rules: Sequence[tuple[str, str, str]], at: Column, to: Column) -> Column:
    """The longest fitting ``(verdict, host, path)`` as a struct, or null; of equally
    long ones the first in the list."""
    longest = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    fitting = [
        F.when(
            ((at == r_host) | at.endswith("." + r_host)) & to.startswith(r_path),
            F.struct(F.lit(r_host + r_path).alias("rule"), F.lit(verdict).alias("verdict")),
        )
        for verdict, r_host, r_path in longest
    ]
    nothing = F.lit(None).cast("struct<rule:string,verdict:string>")
    return F.coalesce(*fitting, nothing)


def with_rule(rows: DataFrame, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """``rows(host, path, …)`` with ``match``, the struct of ``matched_rule``.

    Up to ``MAX_RULES`` rules are one expression.  More are joined: each distinct
    host and path meets the rules of its host and of every parent domain.
    """
    if len(rules) <= MAX_RULES:
        return rows.withColumn("match", matched_rule(rules, F.col("host"), F.col("path")))
    listed = rows.sparkSession.createDataFrame(
        [(verdict, at, to, k) for k, (verdict, at, to) in enumerate(rules)],
        "verdict string, at string, start string, place int",
    )
    labels = F.split("host", r"\.", -1)
    parents = F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."),
    )
    asked = rows.select("host", "path").distinct().withColumn("at", F.explode(parents))
    rule = F.concat("at", "start")
    found = (
        asked.join(listed, "at")
        .where(F.col("path").startswith(F.col("start")))
        .groupBy("host", "path")
        .agg(F.max(F.struct(F.length(rule), -F.col("place"), rule.alias("rule"), "verdict")).alias("top"))
        .select("host", "path", F.struct("top.rule", "top.verdict").alias("match"))
    )
    return rows.join(found, ["host", "path"], "left")


def _value(tag: Column, name: str) -> Column:
    """The value of an attribute; empty if there is none."""
    pattern = _VALUE.format(name)
    return F.trim(F.concat(*[F.regexp_extract(tag, pattern, k) for k in (1, 2, 3)]))


def _decoded(value: Column) -> Column:
    """Entities of ASCII characters as those characters, ``&`` last."""

    def put(text: Column, entity: Column) -> Column:
        digits = F.regexp_extract(entity, r"([0-9a-fA-F]+);", 1)
        base = F.when(F.lower(entity).startswith("&#x"), F.conv(digits, 16, 10)).otherwise(digits)
        return F.replace(text, entity, F.char(base.cast("long")))

    numbers = F.array_distinct(F.regexp_extract_all(value, F.lit(_NUMBERED), 0))
    return F.regexp_replace(F.aggregate(numbers, value, put), _AMPERSAND, "&")


def _without_dots(path: Column) -> Column:
    """A path that starts with ``/``, its segments ``.`` and ``..`` resolved."""

    def put(done: Column, segment: Column) -> Column:
        return (
            F.when(segment == "..", F.regexp_replace(done, r"/[^/]*$", ""))
            .when(segment == ".", done)
            .otherwise(F.concat(done, F.lit("/"), segment))
        )

    parts = F.split(path, "/", -1)
    joined = F.aggregate(F.slice(parts, 2, F.size(parts)), F.lit(""), put)
    folder = F.when(path.rlike(r"/\.{1,2}$"), "/").otherwise("")
    return F.when(path.rlike(r"/\.{1,2}(/|$)"), F.concat(joined, folder)).otherwise(path)


def _absolute(link: Column, url: Column) -> Column:
    """The address that a link of a page at ``url`` leads to; null if the link is
    empty or of a scheme without a host, or the page has none."""
    site = F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    scheme = F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*:)//", 1)
    folder = F.regexp_extract(url, r"://[^/?#]*([^?#]*/)", 1)
    own, to = path(url), F.regexp_extract(link, r"^([^?#]*)", 1)
    query = F.regexp_extract(link, r"^[^?#]*(\?[^#]*)", 1)
    full = F.concat(scheme, link)
    whole = F.when(link.startswith("//"), full).otherwise(link)
    placed = F.when(to.startswith("/"), to).otherwise(
        F.concat(F.when(folder == "", "/").otherwise(folder), to)
    )
    away = F.regexp_extract(whole, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    there = path(whole)
    there = F.when(there == "", "").otherwise(_without_dots(there))
    rest = F.regexp_extract(whole, r"^[^?#]*(\?[^#]*)", 1)
    return (
        F.when((link == "") | (site == ""), None)
        .when(away != "", F.concat(away, there, rest))
        .when(link.rlike(r"^([A-Za-z][A-Za-z0-9+.-]*:|//)"), None)
        .when(to != "", F.concat(site, _without_dots(placed), query))
        .when(query != "", F.concat(site, own, query))
    )


def _node(url: Column) -> Column:
    """Without the fragment; scheme and host in lower case."""
    site = F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    rest = F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?([^#]*)", 1)
    return F.concat(_lower(site), rest)


def link_edges(pages: DataFrame) -> DataFrame:
    """``(page, target)``: all canonical links and meta refreshes of the pages."""
    tags = F.regexp_extract_all(F.regexp_replace("html", _HIDDEN, " "), F.lit(_TAGS), 0)
    tag = pages.where("url IS NOT NULL AND html IS NOT NULL").select("url", F.explode(tags).alias("tag"))
    one = F.col("tag")
    canonical = one.rlike(r"(?i)^<link") & _value(one, "rel").rlike(r"(?i)(^|\s)canonical(\s|$)")
    refresh = one.rlike(r"(?i)^<meta") & (F.lower(_value(one, "http-equiv")) == "refresh")
    content = _decoded(_value(one, "content"))
    address = F.concat(*[F.regexp_extract(content, _REFRESH, k) for k in (1, 2, 3)])
    links = tag.select(
        "url", F.when(canonical, _decoded(_value(one, "href"))).when(refresh, F.trim(address)).alias("link")
    ).where("link <> ''")
    target = _absolute(F.col("link"), F.col("url"))
    return links.select(_node(F.col("url")).alias("page"), _node(target).alias("target")).where(
        "target IS NOT NULL AND page <> target"
    )


def judge(
    pages: DataFrame, rules: Sequence[tuple[str, str, str]], edges: DataFrame | None = None
) -> DataFrame:
    """``(page_id, host, path, rule, verdict, spread)`` for every row of
    ``pages(page_id, url, html)``; ``spread`` tells a verdict taken from an alias.

    ``edges(page, target)`` adds known redirects (from a crawl log).  Rows are
    kept as they are: repeated ids and urls give one row each; a null url has an
    empty host and path, no rule and no aliases; other columns are not looked at.
    """
    pages = pages.select("page_id", "url", "html")
    links = link_edges(pages)
    if edges is not None:
        links = links.union(edges.select(_node(F.col("page")), _node(F.col("target"))))
    member = components(links, "page", "target")
    placed = member.withColumns({"host": host(F.col("node")), "path": path(F.col("node"))})
    hit = with_rule(placed, rules).where("match.verdict = 'block'").select("component").distinct()
    aliases = member.join(hit, "component").select("node").distinct()
    addressed = pages.select(
        "page_id", _node(F.col("url")).alias("node"),
        host(F.col("url")).alias("host"), path(F.col("url")).alias("path"),
    )
    judged = with_rule(addressed, rules)
    joined = judged.join(aliases.withColumn("alias", F.lit(True)), "node", "left")
    spread = F.col("match").isNull() & F.coalesce(F.col("alias"), F.lit(False))
    verdict = F.when(spread, "block").otherwise(F.lit("allow"))
    return joined.select(
        "page_id", "host", "path", F.col("match.rule").alias("rule"),
        F.coalesce(F.col("match.verdict"), verdict).alias("verdict"), spread.alias("spread"),
    )
