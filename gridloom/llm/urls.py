"""URL filter: host and path rules, and block decisions that spread over redirect and canonical-link edges.

DataFrame functions only. Targets are resolved against the page's url (RFC 3986, without base elements); links in comments, scripts and
styles don't count. Edge cases: a null url, or one without '://', has an empty host and path, no rule and no links; null html has no
links; very long pages are read whole; repeated rows get one result each; of rules of equal length block goes before allow; empty
tables give empty results; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, components, table, text_of

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (host, path, verdict)
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def plain_path(path: Column) -> Column:
    """The path without '.' and '..' segments."""
    parts = F.split(path, "/")
    tail = F.when(F.element_at(parts, -1).isin(".", ".."), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
    up = lambda acc: F.when(F.size(acc) > 1, F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(acc)
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, x: F.when(x == "..", up(acc)).when(x == ".", acc).otherwise(F.concat(acc, F.array(x))))
    return F.when(path.contains("/."), F.array_join(F.concat(kept, tail), "/")).otherwise(path)


def node_of(url: Column) -> Column:
    """The name of a url in the graph: without fragment, scheme and host in small letters, no dot segments; null without '://'."""
    u = F.regexp_replace(F.trim(url), r"(?s)#.*$", "")
    head, path = F.regexp_extract(u, r"(?s)^(.*?://[^/?#]*)", 1), F.regexp_extract(u, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    rest = F.regexp_extract(u, r"(?s)^.*?://[^?#]*(.*)$", 1)
    return F.when(u.contains("://"), F.concat(F.translate(head, UPPER, LOWER), plain_path(path), rest))


def resolved(target: Column, base: Column) -> Column:
    """The absolute url that a reference names on a page of url `base`; null for other schemes."""
    scheme, root = F.regexp_extract(base, r"(?s)^(.*?):", 1), F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*)", 1)
    path = path_of(base)
    folder = F.when(path == "", F.lit("/")).otherwise(F.regexp_extract(path, r"(?s)^(.*/)[^/]*$", 1))
    return (
        F.when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), target).when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), None).when(target.startswith("//"), F.concat(scheme, F.lit(":"), target))
        .when(target.startswith("/"), F.concat(root, target)).when(target.startswith("?"), F.concat(root, path, target)).when(target.startswith("#"), base).otherwise(F.concat(root, folder, target))
    )


def ruled(pages: DataFrame, rules=RULES) -> DataFrame:
    """pages with host, path, rule and decision; of the rules that fit, the longest host and path wins, block before allow in a tie.

    Rules are a fixed list; each is one comparison in the generated code, so nothing is shuffled.
    """
    best = F.lit(None).cast("string")
    verdict = F.lit(None).cast("string")
    for host, path, says in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), r[2] == "block")):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        best, verdict = F.when(fits, F.lit(host + path)).otherwise(best), F.when(fits, F.lit(says)).otherwise(verdict)
    return pages.withColumn("rule", best).withColumn("decision", verdict)


HIDDEN = r"(?is)<!--.*?(?:-->|$)|<script\b.*?(?:</script\s*>|$)|<style\b.*?(?:</style\s*>|$)"
LINK, META = r"(?is)<link\b[^>]*>", r"(?is)<meta\b[^>]*>"
CANONICAL, REFRESH = r"(?is)\brel\s*=\s*[\"']?canonical\b", r"(?is)\bhttp-equiv\s*=\s*[\"']?refresh\b"
HREF, TO = r"""(?is)\bhref\s*=\s*["']?([^"'\s>]+)""", r"""(?is)\burl\s*=\s*["']?([^"'\s>;]+)"""


def links(pages: DataFrame) -> DataFrame:
    """(a, b): each page's node and the nodes that all its canonical links and redirects name."""
    some = pages.where(F.col("url").contains("://") & F.col("html").rlike(r"(?i)canonical|http-equiv")).select(F.trim("url").alias("url"), F.regexp_replace("html", HIDDEN, " ").alias("html"))
    found = lambda tag, kind, value: F.transform(F.filter(F.regexp_extract_all("html", F.lit(tag), F.lit(0)), lambda t: t.rlike(kind)), lambda t: F.regexp_extract(t, value, 1))
    both = some.select("url", F.explode(F.concat(found(LINK, CANONICAL, HREF), found(META, REFRESH, TO))).alias("to")).where("to <> ''")
    full = resolved(F.regexp_replace("to", "&amp;", "&"), F.col("url"))
    return both.select(node_of(F.col("url")).alias("a"), node_of(full).alias("b")).where("a is not null and b is not null and a <> b")


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict.

    A page's own rule decides. Else it takes part in its component of linked urls: block if some url there is blocked and
    none is explicitly allowed, else allow.
    """
    src = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    own = ruled(src.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")), rules).withColumn("node", node_of(F.col("url")))
    named = components(links(src).distinct()).select(F.col("id").alias("node"), "component")
    # targets that are no pages here still have a decision of their own
    group = ruled(named.select("node", "component", host_of(F.col("node")).alias("host"), path_of(F.col("node")).alias("path")), rules)
    group = group.groupBy("component").agg(F.max(F.col("decision") == "block").alias("blocked"), F.max(F.col("decision") == "allow").alias("allowed"))
    spread = checkpoint(named.join(group.where("blocked and not coalesce(allowed, false)"), "component").select("node"))
    out = own.join(spread.withColumn("spread", F.lit(True)), "node", "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("decision", F.when(F.col("spread"), F.lit("block")), F.lit("allow")).alias("verdict"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))


_HOST = r"regexp_extract(coalesce({u},''), '(?s)^.*?://([^/?#]*)', 1)"
_PATH = r"regexp_extract(coalesce({u},''), '(?s)^.*?://[^/?#]*([^?#]*)', 1)"
_RULE = "max_by({what}, length(r.host) + length(r.path)) FILTER (WHERE (t.host = r.host OR suffix(t.host, '.' || r.host)) AND starts_with(t.path, r.path))"
_FOUND = "list_transform(list_filter(regexp_extract_all(h, '{tag}', 0), lambda t: regexp_matches(t, '{kind}')), lambda t: regexp_extract(t, '{value}', 1))"
_SQ = lambda x: x.replace("'", "''")
_DOTS = """array_to_string(list_concat(list_reduce(list_transform(string_split({p}, '/'), lambda x: [x]), lambda acc, x: CASE x[1] WHEN '..' THEN CASE WHEN len(acc) > 1 THEN acc[:-2] ELSE acc END WHEN '.' THEN acc ELSE list_concat(acc, x) END),
  CASE WHEN string_split({p}, '/')[-1] IN ('.', '..') THEN [''] ELSE [] END), '/')"""


def _node(u: str) -> str:
    bare = f"regexp_replace(trim({u}), '(?s)#.*$', '')"
    return (
        f"CASE WHEN {bare} LIKE '%://%' THEN translate(regexp_extract({bare}, '(?s)^(.*?://[^/?#]*)', 1), '{UPPER}', '{LOWER}') || {_DOTS.format(p=_PATH.format(u=bare))}"
        f" || regexp_extract({bare}, '(?s)^.*?://[^?#]*(.*)$', 1) END"
    )


SQL = {
    "op9_url_filter": f"""
WITH RECURSIVE r(host, path, says) AS (VALUES ('org','/','allow'), ('example.org','/es/','block'), ('example.org','/en/1','block'), ('com','/fr/','allow'), ('com','/de/','block')),
pg AS (SELECT row_number() OVER () AS n, page_id, url, html, translate({_HOST.format(u='url')}, '{UPPER}', '{LOWER}') AS host, {_PATH.format(u='url')} AS path, {_node('url')} AS node FROM pages),
own AS (SELECT t.page_id, t.host, t.path, t.node, {_RULE.format(what='r.host || r.path')} AS rule, {_RULE.format(what='r.says')} AS decision FROM pg t, r GROUP BY t.n, t.page_id, t.host, t.path, t.node),
seen AS (SELECT trim(url) AS url, node, path, regexp_extract(trim(url), '(?s)^(.*?://[^/?#]*)', 1) AS root, regexp_replace(html, '{HIDDEN}', ' ', 'g') AS h FROM pg WHERE url LIKE '%://%'),
tags AS (SELECT url, node, path, root, replace(unnest(list_concat({_FOUND.format(tag=LINK, kind=_SQ(CANONICAL), value=_SQ(HREF))}, {_FOUND.format(tag=META, kind=_SQ(REFRESH), value=_SQ(TO))})), '&amp;', '&') AS t FROM seen),
refs AS (SELECT node AS a, CASE WHEN regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN t WHEN regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN NULL WHEN t LIKE '//%' THEN regexp_extract(url, '(?s)^(.*?):', 1) || ':' || t
  WHEN t LIKE '/%' THEN root || t WHEN t LIKE '?%' THEN root || path || t WHEN t LIKE '#%' THEN url ELSE root || (CASE WHEN path = '' THEN '/' ELSE regexp_extract(path, '(?s)^(.*/)[^/]*$', 1) END) || t END AS u FROM tags WHERE t <> ''),
raw AS (SELECT a, {_node('u')} AS b FROM refs),
e AS (SELECT a, b FROM raw WHERE b IS NOT NULL AND a IS NOT NULL UNION SELECT b, a FROM raw WHERE b IS NOT NULL AND a IS NOT NULL),
reach(a, b) AS (SELECT a, a FROM e UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a),
said AS (SELECT t.b AS node, {_RULE.format(what='r.says')} AS decision FROM (SELECT b, translate({_HOST.format(u='b')}, '{UPPER}', '{LOWER}') AS host, {_PATH.format(u='b')} AS path FROM (SELECT DISTINCT b FROM reach)) t, r GROUP BY t.b),
spread AS (SELECT reach.a AS node, bool_or(decision = 'block') AND NOT coalesce(bool_or(decision = 'allow'), false) AS blocked FROM reach JOIN said ON reach.b = said.node GROUP BY reach.a)
SELECT own.page_id, own.host, own.path, own.rule, coalesce(own.decision, CASE WHEN spread.blocked THEN 'block' END, 'allow') AS verdict FROM own LEFT JOIN spread USING (node)
"""
}
