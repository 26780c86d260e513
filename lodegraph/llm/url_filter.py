"""URL filtering with redirect equivalence, in DataFrame functions only.

A rule (host, path, verdict) fits its host and all subdomains if the url's path starts with the rule's
path; the longest rule that fits wins (host and path together, then the longer host, then allow).
Urls that no rule fits may be aliases of others: redirects and canonical links are edges between
urls, and connected components over them carry decisions across. In a component, an explicit allow of
any member takes precedence over its blocks; a block without one reaches every member that no rule
fits; with neither, urls are allowed. A url's own rule always stands.

Urls are compared as host, path (an empty one is ``/``) and query; scheme and fragment don't matter. Edges
come from a table (``source``, ``target``) and from every ``<link rel=... canonical ...>`` and ``<meta
http-equiv=refresh>`` of the pages outside comments, scripts and other raw text, with character
references decoded (all numeric ones, and those that urls need) and references resolved as RFC 3986 says.

Null urls and urls without ``://``: empty host and path, no rule, no edges, allowed. Null html has no links.
Empty tables give an empty result. Repeated rows and urls each get their row. Other columns are ignored.

Scale: up to ``INLINE_RULES`` rules are matched row by row without a shuffle; more of them meet the
distinct (host, path) of the urls in equality joins on host suffix and path prefix. Only urls that have
an edge take part in the components; pages outside them aren't joined but pass a left join on the
url, where null urls are spread. A hub of redirects is handled by the components' stars.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .components import connected_components

INLINE_RULES = 64
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
_BEST = "struct<length:int,host_length:int,allow:int,rule:string,verdict:string>"
_RAW = "script|style|template|textarea|title|noscript|iframe|svg|math|select|object"
_NAMED = (("&quot;", '"'), ("&apos;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"))


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    raw = F.regexp_extract(_rest(url), "^[^/?#]*", 0)
    return F.coalesce(F.translate(raw, string.ascii_uppercase, string.ascii_lowercase), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def alias_key(url: Column) -> Column:
    """What urls are compared by; null where there is no host."""
    host, rest = host_of(url), F.regexp_extract(_rest(url), "^[^/?#]*([^#]*)", 1)
    return F.when(host != "", F.concat(host, F.when(F.startswith(rest, F.lit("/")), rest).otherwise(F.concat(F.lit("/"), rest))))


def _struct(host: Column, path: Column, verdict: Column) -> Column:
    return F.struct(
        (F.length(host) + F.length(path)).alias("length"), F.length(host).alias("host_length"), (verdict == "allow").cast("int").alias("allow"), F.concat(host, path).alias("rule"), verdict.alias("verdict")
    )


def best_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """Struct (length, host_length, allow, rule, verdict) of the rule that wins, or null."""
    found = []
    for h, p, v in rules:
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        found.append(F.when(fits, _struct(F.lit(h), F.lit(p), F.lit(v))))
    if not found:
        return F.lit(None).cast(_BEST)
    return found[0] if len(found) == 1 else F.greatest(*found)


def with_best_rule(rows: DataFrame, rules: list[tuple[str, str, str]] | DataFrame) -> DataFrame:
    """Add ``best`` to rows that have ``host`` and ``path``. ``rules``: a list, or a table (host, path, verdict) of any size."""
    if isinstance(rules, list) and len(rules) <= INLINE_RULES:
        return rows.withColumn("best", best_rule(F.col("host"), F.col("path"), rules))
    table = rules if isinstance(rules, DataFrame) else rows.sparkSession.createDataFrame(rules, "host string, path string, verdict string")
    table = table.select(F.col("host").alias("rule_host"), F.col("path").alias("prefix"), "verdict").distinct()
    sizes = table.groupBy("rule_host").agg(F.collect_set(F.length("prefix")).alias("sizes"))  # bounded by the longest path
    labels = F.split("host", "[.]")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    urls = rows.select("host", "path").distinct().select("host", "path", F.explode(suffixes).alias("rule_host")).join(sizes, "rule_host")
    urls = urls.select("host", "path", "rule_host", F.explode(F.filter("sizes", lambda n: n <= F.length("path"))).alias("n")).withColumn("prefix", F.substring(F.col("path"), F.lit(1), F.col("n")))
    best = urls.join(table, ["rule_host", "prefix"]).groupBy("host", "path").agg(F.max(_struct(F.col("rule_host"), F.col("prefix"), F.col("verdict"))).alias("best"))
    return rows.join(best, ["host", "path"], "left")


def _decoded(text: Column) -> Column:
    """Character references of an attribute's value: numeric ones, and the named ones that urls need."""

    def char(part: Column) -> Column:
        digits, hexed = F.regexp_extract(part, "^([0-9]{1,7});?", 1), F.regexp_extract(part, "^[xX]([0-9a-fA-F]{1,6});?", 1)
        code = F.when(digits != "", digits.cast("int")).when(hexed != "", F.conv(hexed, 16, 10).cast("int")).otherwise(-1)
        valid = (code > 0) & (code < 0x110000) & ~code.between(0xD800, 0xDFFF)
        rest = F.regexp_replace(part, "^(?:[0-9]{1,7}|[xX][0-9a-fA-F]{1,6});?", "")
        return F.when(valid, F.concat(F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"), rest)).otherwise(F.concat(F.lit("&#"), part))

    parts = F.split(text, "&#")
    out = F.concat(F.get(parts, 0), F.array_join(F.transform(F.slice(parts, 2, F.size(parts)), char), ""))
    for name, plain in _NAMED:
        out = F.replace(out, F.lit(name), F.lit(plain))
    return out


def _attribute(tag: Column, name: str) -> Column:
    raw = F.regexp_extract(tag, rf"(?is)[\s\"'/]{name}\s*=\s*(\"[^\"]*+\"|'[^']*+'|[^\s\"'>]++)", 1)
    return F.btrim(raw, F.lit("\"'"))


def _without_dots(path: Column) -> Column:
    """RFC 3986, 5.2.4."""
    parts = F.split(path, "/")
    step = lambda a, x: F.when(x == ".", a).when(x == "..", F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(1)))).otherwise(F.concat(a, F.array(x)))
    kept = F.aggregate(F.slice(parts, 2, F.size(parts)), F.slice(parts, 1, 1), step)
    return F.concat(F.array_join(kept, "/"), F.when(F.element_at(parts, -1).isin(".", "..") | (F.size(kept) == 1), "/").otherwise(""))


def page_links(pages: DataFrame) -> DataFrame:
    """(source, target) urls of all canonical links and refreshes in the pages' html."""
    html = F.regexp_replace(F.col("html"), rf"(?is)<!--.*?(?:-->|\z)|<({_RAW})\b[^>]*+>.*?(?:</\1\s*>|\z)", " ")
    tags = pages.select(F.col("url").cast("string").alias("source"), F.col("html").cast("string").alias("html")).where("source IS NOT NULL AND html RLIKE '(?i)canonical|refresh'")
    tags = tags.select("source", F.explode(F.regexp_extract_all(html, F.lit(r"(?is)<(?:link|meta)\b[^>]*+>"), 0)).alias("tag"))
    # each part a column of its own: inlined into every branch, the expressions outgrow a compiled method
    rel = F.array_contains(F.split(F.lower(_attribute(F.col("tag"), "rel")), r"\s+"), "canonical")
    to = F.when(F.col("tag").rlike("(?i)^<link") & rel, _attribute(F.col("tag"), "href"))
    refresh = F.lower(F.trim(_attribute(F.col("tag"), "http-equiv"))) == "refresh"
    content = F.regexp_extract(tags["tag"], r"(?is)[\s\"'/]content\s*=\s*(\"[^\"]*+\"|'[^']*+'|[^\s\"'>]++)", 1)
    moved = F.regexp_extract(content, r"(?is)\burl\s*=\s*[\"']?([^\"']+)", 1)
    both = tags.withColumn("to", to).withColumn("moved", F.when(F.col("tag").rlike("(?i)^<meta") & refresh, moved))
    both = both.select("source", F.coalesce("to", "moved").alias("target")).where("target <> ''").withColumn("target", F.trim(_decoded(F.col("target"))))
    both = both.where("target <> '' AND NOT startswith(target, '#')").withColumn("target", F.regexp_extract("target", "^[^#]*", 0))
    both = both.withColumn("scheme", F.substring_index("source", "://", 1)).withColumn("host", host_of(F.col("source"))).withColumn("base", path_of(F.col("source")))
    root = F.concat("scheme", F.lit("://"), "host")
    path, query = F.regexp_extract("target", "^[^?]*", 0), F.regexp_extract("target", "[?].*$", 0)
    both = both.withColumn("root", root).withColumn("path", path).withColumn("query", query)
    merged = F.when(F.startswith("path", F.lit("/")), F.col("path")).otherwise(F.concat(F.coalesce(F.nullif(F.regexp_extract("base", "^(.*/)", 1), F.lit("")), F.lit("/")), "path"))
    both = both.withColumn("merged", merged)
    whole = (
        F.when(F.col("target").rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), F.col("target"))
        .when(F.startswith("target", F.lit("//")), F.concat("scheme", F.lit(":"), "target"))
        .when(F.col("target").rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None))
        .when(F.col("path") == "", F.concat("root", "base", "query"))
        .otherwise(F.concat("root", _without_dots(F.col("merged")), "query"))
    )
    return both.where("host <> ''").select("source", whole.alias("target"))


def component_verdicts(links: DataFrame, rules: list[tuple[str, str, str]] | DataFrame) -> DataFrame:
    """(alias, spread): for every url that has an edge, what its component's explicit decisions give a member without a rule."""
    keyed = materialize(links.select(alias_key(F.col("source")).alias("u"), alias_key(F.col("target")).alias("v")), "links")
    as_url = F.concat(F.lit("x://"), F.col("node"))
    members = connected_components(keyed).withColumn("host", host_of(as_url)).withColumn("path", path_of(as_url))
    ruled = materialize(with_best_rule(members, rules).select("node", "component", F.col("best.verdict").alias("verdict")), "members")
    said = ruled.groupBy("component").agg(F.coalesce(F.bool_or(F.col("verdict") == "allow"), F.lit(False)).alias("allowed"), F.coalesce(F.bool_or(F.col("verdict") == "block"), F.lit(False)).alias("blocked"))
    blocked = said.where("blocked AND NOT allowed").select("component")
    return ruled.join(blocked, "component").select(F.col("node").alias("alias"), F.lit("block").alias("spread"))


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] | DataFrame = RULES, redirects: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict for every row of ``pages`` (page_id, url, html)."""
    links = page_links(pages)
    if redirects is not None:
        links = links.unionByName(redirects.select(F.col("source").cast("string").alias("source"), F.col("target").cast("string").alias("target")))
    spread = component_verdicts(links, rules)
    url = F.col("url").cast("string")
    nobody = F.concat(F.lit("\x00"), F.xxhash64("page_id").cast("string"))  # urls without a host are nobody's alias: spread over the tasks
    rows = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), F.coalesce(alias_key(url), nobody).alias("alias"))
    return with_best_rule(rows, rules).join(spread, "alias", "left").select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce(F.col("best.verdict"), "spread", F.lit("allow")).alias("verdict")
    )


def oracle_sql(rules: list[tuple[str, str, str]] = RULES) -> str:
    """DuckDB SQL for ``judge``, with the components by recursion; it reads links whose targets are whole urls or begin with ``/``."""
    values = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in rules)
    attribute = lambda name: f"""trim(regexp_extract(tag, '[\\s"''/]{name}\\s*=\\s*("[^"]*"|''[^'']*''|[^\\s"''>]+)', 1, 'is'), '"''')"""
    rest = lambda u: f"CASE WHEN instr({u}, '://') > 0 THEN substr({u}, instr({u}, '://') + 3) ELSE '' END"
    host = lambda t: f"translate(regexp_extract({t}, '^[^/?#]*'), '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
    raw = "|".join(f"<{t}\\b[^>]*>.*?(</{t}\\s*>|\\z)" for t in _RAW.split("|"))
    key = lambda t: f"""CASE WHEN {host(t)} <> '' THEN {host(t)} || CASE WHEN regexp_matches({t}, '^[^/?#]*/') THEN '' ELSE '/' END || regexp_extract({t}, '^[^/?#]*([^#]*)', 1) END"""
    best = lambda source: f"""FROM {source} LEFT JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)"""
    return f"""
WITH RECURSIVE r(rh, rp, rv) AS (VALUES {values}),
cut AS (SELECT page_id, html, url, {host("t")} AS host, regexp_extract(t, '^[^/?#]*([^?#]*)', 1) AS path, {key("t")} AS alias
        FROM (SELECT page_id, html, url, {rest("url")} AS t FROM pages)),
tags AS (SELECT url, host, alias, unnest(regexp_extract_all(regexp_replace(html, '<!--.*?(-->|\\z)|{raw}', ' ', 'gis'), '<(?:link|meta)\\b[^>]*>', 0, 'is')) AS tag
         FROM cut WHERE host <> '' AND regexp_matches(html, 'canonical|refresh', 'i')),
named AS (SELECT url, host, alias, CASE WHEN regexp_matches(tag, '^<link', 'i') AND list_contains(regexp_split_to_array(lower({attribute("rel")}), '\\s+'), 'canonical') THEN {attribute("href")}
          WHEN regexp_matches(tag, '^<meta', 'i') AND lower(trim({attribute("http-equiv")})) = 'refresh'
          THEN regexp_extract(regexp_extract(tag, '[\\s"''/]content\\s*=\\s*("[^"]*"|''[^'']*''|[^\\s"''>]+)', 1, 'is'), '\\burl\\s*=\\s*["'']?([^"'']+)', 1, 'is') END AS raw FROM tags),
links AS (SELECT alias AS u, {rest("target")} AS t FROM (
            SELECT alias, CASE WHEN starts_with(plain, '//') THEN 'x:' || plain WHEN starts_with(plain, '/') THEN 'x://' || host || plain ELSE plain END AS target
            FROM (SELECT alias, host, trim(replace(raw, '&amp;', '&')) AS plain FROM named WHERE raw <> ''))),
edges AS MATERIALIZED (SELECT u, {key("t")} AS v FROM links WHERE {key("t")} IS NOT NULL),
sides AS MATERIALIZED (SELECT u AS a, v AS b FROM edges UNION SELECT v, u FROM edges),
reach(node, other) AS (SELECT a, a FROM sides UNION SELECT node, b FROM reach JOIN sides ON other = a),
members AS (SELECT node, other, regexp_extract(other, '^[^/?#]*') AS host, regexp_extract(other, '^[^/?#]*([^?#]*)', 1) AS path FROM reach),
said AS (SELECT node, rv FROM (SELECT node, rv, row_number() OVER (PARTITION BY node, other ORDER BY length(rh || rp) DESC, length(rh) DESC, rv) AS n {best("members")}) WHERE n = 1),
spread AS (SELECT node FROM said GROUP BY node HAVING coalesce(bool_or(rv = 'block'), false) AND NOT coalesce(bool_or(rv = 'allow'), false)),
-- repeated pages are one row each: rules are found for the distinct host and path
ruled AS (SELECT host, path, rule, rv FROM (
            SELECT host, path, rh || rp AS rule, rv, row_number() OVER (PARTITION BY host, path ORDER BY length(rh || rp) DESC, length(rh) DESC, rv) AS n
            {best("(SELECT DISTINCT host, path FROM cut)")}) WHERE n = 1)
SELECT page_id, cut.host, cut.path, rule, coalesce(rv, CASE WHEN node IS NOT NULL THEN 'block' END, 'allow') AS verdict
FROM cut JOIN ruled USING (host, path) LEFT JOIN spread ON alias = node
"""
