"""URL filters by rules, with block decisions carried over to aliases.

Only DataFrame and SQL functions. URLs are nodes. Redirects and canonical links (in the pages and,
where given, in a table) are edges between them and nothing else is; connected components are sets of
aliases. A URL that a rule fits gets the verdict of the longest rule; any other is blocked if a rule
blocks one of its aliases and none allows one.
"""

from __future__ import annotations

from collections.abc import Sequence
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, functions as F

from lumenspan.llm.components import components

_REL = r"""\srel\s*=\s*(?:"(?:[^">]*\s)?canonical(?:\s[^">]*)?"|'(?:[^'>]*\s)?canonical(?:\s[^'>]*)?'|canonical(?=[\s/>]))"""
_HREF = r"""\shref\s*=\s*["']?([^"'\s>]+)"""
_LINK = rf"(?is)<link\b(?=[^>]*{_REL})[^>]*?{_HREF}"
_REFRESH = r"""(?is)<meta\b(?=[^>]*\shttp-equiv\s*=\s*["']?refresh\b)[^>]*\burl\s*=\s*["']?([^"'\s>;]+)"""
#: Parts of a query that only tell where a visit came from. The whole part, lines and all; letters of any case.
_TRACKING = r"(?isu)^(utm_[^=]*|ref|fbclid|gclid|msclkid|mc_cid|mc_eid)(=.*)?\z"
#: What declares nothing: comments, scripts, styles and text areas, to their end or that of the page.
_SILENT = r"(?is)<!--.*?(?:-->|\z)|<script\b.*?(?:</script\b|\z)|<style\b.*?(?:</style\b|\z)|<textarea\b.*?(?:</textarea\b|\z)"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, ascii_uppercase, ascii_lowercase)


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end; else empty."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def node_of(url: Column) -> Column:
    """A URL with its scheme and host in lower case, which are the same in any; null where there is no ``://``."""
    scheme = F.translate(F.regexp_extract(url, r"(?s)^(.*?)://", 1), ascii_uppercase, ascii_lowercase)
    rest = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*(.*)$", 1)
    return F.when(url.contains("://"), F.concat(scheme, F.lit("://"), host_of(url), rest))


def spelling_of(url: Column) -> Column:
    """The form that all spellings of a page's URL share; null where there is no ``://``.

    Scheme, fragment, tracking parameters and final slashes don't count. Wider than ``node_of``: captures of one
    page are looked up by it, nothing is judged by it.
    """
    query = F.split(F.regexp_extract(url, r"(?s)^.*?://[^?#]*\?([^#]*)", 1), "&")
    query = F.array_join(F.filter(query, lambda part: ~part.rlike(_TRACKING)), "&")
    path = F.regexp_replace(path_of(url), r"/+\z", "")
    return F.when(url.contains("://"), F.concat(host_of(url), path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")))


def _undotted(path: Column) -> Column:
    """A path without ``.`` and ``..``, the latter with the part before it."""
    parts = F.split(path, "/")
    last = F.element_at(parts, -1).isin(".", "..")
    step = lambda seen, x: (
        F.when(x == ".", seen).when(x == "..", F.when(F.size(seen) > 1, F.slice(seen, F.lit(1), F.size(seen) - 1)).otherwise(seen)).otherwise(F.array_append(seen, x))
    )
    kept = F.aggregate(parts, F.array().cast("array<string>"), step)
    return F.when(path.contains("/."), F.concat(F.array_join(kept, "/"), F.when(last, "/").otherwise(""))).otherwise(path)


def resolved(base: Column, target: Column) -> Column:
    """``target`` as a full URL, seen from the page ``base``; null if it is empty, a fragment, or no page's."""
    scheme = F.concat(F.regexp_extract(base, r"(?s)^(.*?)://", 1), F.lit(":"))
    site = F.concat(scheme, F.lit("//"), host_of(base))
    folder = F.regexp_extract(path_of(base), r"(?s)^(.*/)", 1)
    full = (
        F.when(F.coalesce(target, F.lit("")).rlike("^(#|$)"), F.lit(None))
        .when(target.rlike(r"(?i)^[a-z][a-z0-9+.-]*://"), target)
        .when(target.rlike(r"(?i)^[a-z][a-z0-9+.-]*:"), F.lit(None))
        .when(target.startswith("//"), F.concat(scheme, target))
        .when(target.startswith("/"), F.concat(site, target))
        .when(target.startswith("?"), F.concat(site, path_of(base), target))
        .otherwise(F.concat(site, F.when(folder == "", "/").otherwise(folder), target))
    )
    head, tail = F.regexp_extract(full, r"(?s)^(.*?://[^/?#]*)", 1), F.regexp_extract(full, r"(?s)^.*?://[^/?#]*[^?#]*(.*)$", 1)
    return F.when(full.isNotNull(), F.concat(head, _undotted(path_of(full)), tail))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """The longest rule, allow before block, that fits as ``struct(rule, verdict)``; null if none.

    Rules are (verdict, host, path); one fits its host and all subdomains where the path starts
    with the rule's. They become one expression, so there should be hundreds, not millions.
    """
    out = F.lit(None).cast("struct<rule: string, verdict: string>")
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[0] == "allow")):
        fits = ((host == rule_host) | host.endswith(f".{rule_host}")) & path.startswith(rule_path)
        out = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def links_of(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(source, target)``: canonical links and redirects that the pages declare, outside comments and scripts.

    The first of each kind counts. Null and empty html and null urls declare nothing; repeated rows declare
    the same again.
    """
    html, url = F.coalesce(F.col(html_col), F.lit("")), F.col(url_col)
    loud = F.regexp_replace(html, _SILENT, " ")
    declared = [F.when(html.rlike(f"(?i){word}"), F.regexp_extract(loud, pattern, 1)) for word, pattern in (("canonical", _LINK), ("refresh", _REFRESH))]
    targets = F.array(*[resolved(url, F.replace(t, F.lit("&amp;"), F.lit("&"))) for t in declared])
    return pages.select(url.alias("source"), F.explode(F.array_compact(targets)).alias("target"))


def judge(
    pages: DataFrame,
    rules: Sequence[tuple[str, str, str]],
    redirects: DataFrame | None = None,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
) -> DataFrame:
    """One row for each row of ``pages``: ``id_col``, ``host``, ``path``, ``rule``, ``verdict``.

    ``redirects`` may hold more edges as ``(source, target)`` URLs, of pages or not. A null URL and
    one without ``://`` have empty host and path, no aliases, and are allowed. Null html declares
    nothing. Repeated rows stay repeated; empty tables give no rows. Other columns aren't read.
    """
    edges = links_of(pages, url_col, html_col)
    if redirects is not None:
        edges = edges.union(redirects.select("source", "target"))
    ends = edges.select(F.explode(F.array("source", "target")).alias("url"))
    ruled = (
        pages.select(F.col(url_col).alias("url"))
        .union(ends)
        .select(node_of(F.col("url")).alias("name"), rule_of(host_of(F.col("url")), path_of(F.col("url")), rules).verdict.alias("verdict"))
        .where("name is not null and verdict is not null")
        .groupBy("name")
        .agg(F.bool_or(F.col("verdict") == "allow").alias("allow"), F.bool_or(F.col("verdict") == "block").alias("block"))
    )
    alias = components(edges.select(node_of(F.col("source")).alias("a"), node_of(F.col("target")).alias("b")))
    known = ruled.join(alias, F.col("name") == F.col("node"), "left").select(F.coalesce("root", "name").alias("root"), "allow", "block")
    blocked = known.groupBy("root").agg(F.bool_or("allow").alias("allow"), F.bool_or("block").alias("block")).where("block and not allow")
    carried = (
        blocked.join(alias, "root", "left").select(F.explode(F.array_distinct(F.array("root", F.coalesce("node", "root")))).alias("blocked")).distinct()
    )
    judged = pages.select(
        F.col(id_col),
        host_of(F.col(url_col)).alias("host"),
        path_of(F.col(url_col)).alias("path"),
        node_of(F.col(url_col)).alias("own_node"),
        rule_of(host_of(F.col(url_col)), path_of(F.col(url_col)), rules).alias("fit"),
    )
    return judged.join(carried, F.col("own_node") == F.col("blocked"), "left").select(
        id_col,
        "host",
        "path",
        F.col("fit.rule").alias("rule"),
        F.coalesce("fit.verdict", F.when(F.col("blocked").isNotNull(), "block").otherwise("allow")).alias("verdict"),
    )


#: The rules of ``op10``.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))

#: Components are walked from every URL; links are read in both orders of their attributes.
ORACLE = r"""
WITH RECURSIVE
rules AS (SELECT * FROM (VALUES ('allow','org','/'), ('block','example.org','/es/'), ('block','example.org','/en/1'), ('allow','com','/fr/'), ('block','com','/de/')) v(verdict, h, p)),
raw AS (
  SELECT page_id, url, regexp_replace(coalesce(html, ''), '(?is)<!--.*?(?:-->|\z)|<script\b.*?(?:</script\b|\z)|<style\b.*?(?:</style\b|\z)|<textarea\b.*?(?:</textarea\b|\z)', ' ', 'g') AS html
  FROM pages),
tags AS (
  SELECT url AS source, regexp_extract_all(html, '(?is)<link\b[^>]*>') AS links,
    replace(regexp_extract(html, '(?is)<meta\b[^>]*\shttp-equiv\s*=\s*["'']?refresh\b[^>]*\burl\s*=\s*["'']?([^"''\s>;]+)', 1), '&amp;', '&') AS refresh FROM raw),
told AS (
  SELECT source, refresh AS t FROM tags UNION ALL
  SELECT source, replace(regexp_extract(list_filter(links, lambda x: regexp_matches(x, '(?is)\srel\s*=\s*("([^"]*\s)?canonical(\s[^"]*)?"|''([^'']*\s)?canonical(\s[^'']*)?''|canonical[\s/>])')
    AND regexp_matches(x, '(?is)\shref\s*=\s*["'']?[^"''\s>]'))[1], '(?is)\shref\s*=\s*["'']?([^"''\s>]+)', 1), '&amp;', '&') FROM tags),
split AS (
  SELECT source, t, regexp_extract(source, '(?s)^(.*?)://', 1) || ':' AS scheme, regexp_extract(source, '(?s)^(.*?://[^/?#]*)', 1) AS site,
    regexp_extract(source, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM told WHERE t <> '' AND NOT starts_with(t, '#')),
joined AS (
  SELECT source, CASE WHEN regexp_matches(t, '(?i)^[a-z][a-z0-9+.-]*://') THEN t WHEN regexp_matches(t, '(?i)^[a-z][a-z0-9+.-]*:') THEN NULL
    WHEN starts_with(t, '//') THEN scheme || t WHEN starts_with(t, '/') THEN site || t WHEN starts_with(t, '?') THEN site || path || t
    ELSE site || coalesce(nullif(regexp_extract(path, '(?s)^(.*/)', 1), ''), '/') || t END AS whole FROM split),
parts AS (
  SELECT source, regexp_extract(whole, '(?s)^(.*?://[^/?#]*)', 1) AS head, string_split(regexp_extract(whole, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '/') AS segments,
    regexp_extract(whole, '(?s)^.*?://[^/?#]*[^?#]*(.*)$', 1) AS tail FROM joined WHERE whole IS NOT NULL),
links AS (
  SELECT source, head || array_to_string(list_reduce(list_transform(segments, lambda x: [x]), lambda seen, x: CASE WHEN x[1] = '.' THEN seen
      WHEN x[1] = '..' THEN CASE WHEN len(seen) > 1 THEN seen[:len(seen) - 1] ELSE seen END ELSE list_concat(seen, x) END), '/')
    || CASE WHEN segments[-1] IN ('.', '..') THEN '/' ELSE '' END || tail AS target FROM parts),
urls AS (SELECT DISTINCT url FROM raw WHERE url IS NOT NULL UNION SELECT source FROM links UNION SELECT target FROM links),
named AS (
  SELECT url, translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path,
    CASE WHEN contains(url, '://') THEN translate(regexp_extract(url, '(?s)^(.*?)://', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || '://' || host
      || regexp_extract(url, '(?s)^.*?://[^/?#]*(.*)$', 1) END AS node
  FROM urls),
fits AS (
  SELECT url, arg_max(struct_pack(rule := h || p, verdict := verdict), length(h || p) * 2 + (verdict = 'allow')::INT) AS fit
  FROM named JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY url),
edges AS (
  SELECT a.node AS x, b.node AS y FROM links JOIN named a ON a.url = source JOIN named b ON b.url = target
  UNION SELECT b.node, a.node FROM links JOIN named a ON a.url = source JOIN named b ON b.url = target),
walk AS (SELECT DISTINCT x, x AS y FROM edges UNION SELECT walk.x, edges.y FROM walk JOIN edges ON walk.y = edges.x),
aliases AS (SELECT node AS x, node AS y FROM named WHERE node IS NOT NULL UNION SELECT x, y FROM walk),
decided AS (
  SELECT aliases.x AS node, bool_or(fit.verdict = 'block') AND NOT bool_or(fit.verdict = 'allow') AS blocked
  FROM aliases JOIN named ON named.node = aliases.y JOIN fits USING (url) GROUP BY 1)
SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, fit.rule AS rule,
  coalesce(fit.verdict, CASE WHEN blocked THEN 'block' ELSE 'allow' END) AS verdict
FROM raw LEFT JOIN named USING (url) LEFT JOIN fits USING (url) LEFT JOIN decided USING (node)
"""
