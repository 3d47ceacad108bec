"""URL filter with redirect equivalence (operator 1), with DataFrame functions
only.

Rules allow or block a host with all its subdomains and the paths that start
with the rule's path; the longest fitting rule decides a URL.  URLs without a
rule take the decision of their aliases: redirect and canonical-link edges make
an undirected graph over URLs, and in each connected component an explicit
allow of any member stands before a block of any member (`default` if there is
neither).  A URL's own rule always stands before its aliases'.

Edges come from an edge table and, for pages, from the HTML: canonical links
and `refresh` redirects to an absolute URL, and the page's address without its
fragment, its tracking query and a closing slash or `.html`, and with https,
which servers redirect to.  URLs of one page that repeat are one node.

Degenerate input: a null URL or one without `://` has an empty host and path,
fits no rule, has no aliases and gets the default; an empty HTML has no links;
rows that repeat are judged alike; of equally long rules allow stands first;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from divaug.llm.common import register, table
from divaug.llm.components import connected_components

# The rules of the query, (verdict, host, path).
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
         ("allow", "com", "/fr/"), ("block", "com", "/de/")]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ADDRESS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z in lower case."""
    return F.coalesce(F.translate(F.regexp_extract(url, ADDRESS, 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, ADDRESS, 2), F.lit(""))


def deciding_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, its verdict) of the longest fitting rule, nulls without one.  The
    rules are a parameter of bounded size, so they are part of the expression;
    rows of one host suffix need no join."""
    best, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    # the last to be wrapped is tested first: longest, then allow, then by name
    for kind, h, p in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r[0] == "allow", r[1], r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        best, verdict = F.when(fits, h + p).otherwise(best), F.when(fits, kind).otherwise(verdict)
    return best, verdict


def canonical_form(url: Column) -> Column:
    """https, host in lower case, path without a closing slash or .html, and
    the query without tracking parameters; null without ://."""
    query = F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1)
    kept = F.array_join(F.array_sort(F.filter(F.split(query, "&"), lambda q: (q != "") & ~q.rlike("^(?:utm_|ref=|fbclid=|gclid=)"))), "&")
    path = F.regexp_replace(path_of(url), r"(?:/|\.html?)$", "")
    return F.when(url.contains("://"), F.concat(F.lit("https://"), host_of(url), path,
                                                F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise("")))


def html_target(html: Column) -> tuple[Column, Column]:
    """The absolute URLs of the canonical link and of the refresh redirect."""
    link = F.regexp_extract(html, r"(?is)<link\b(?=[^>]*\brel\s*=\s*[\"']?canonical\b)[^>]*\bhref\s*=\s*[\"']?([a-z][a-z0-9+.-]*://[^\"'\s>]+)", 1)
    refresh = F.regexp_extract(html, r"(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b)[^>]*\burl\s*=\s*[\"']?([a-z][a-z0-9+.-]*://[^\"'\s>]+)", 1)
    none = F.lit(None).cast("string")
    return F.when(link != "", link).otherwise(none), F.when(refresh != "", refresh).otherwise(none)


def page_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(src, dst): the alias edges of the pages."""
    url, html = pages[url_col].cast("string"), pages[html_col].cast("string")
    link, refresh = html_target(html)
    both = pages.select(url.alias("src"), F.explode(F.array(canonical_form(url), link, refresh)).alias("dst"))
    # a target that is written in another form is an alias of its canonical form
    forms = both.select(F.col("dst").alias("src"), canonical_form(F.col("dst")).alias("dst"))
    return both.union(forms).filter("src is not null and dst is not null and src <> dst and src like '%://%'").distinct()


def judge(urls: DataFrame, edges: DataFrame, rules: list[tuple[str, str, str]], url_col: str = "url",
          default: str = "allow") -> DataFrame:
    """``urls`` with host, path, rule, verdict and component (the least URL of
    its aliases, or itself).  Aliases that occur in ``edges`` only take part."""
    comps = connected_components(edges.select(F.col("src").alias("a"), F.col("dst").alias("b")))
    members = comps.select("node", "component").unionByName(
        comps.select(F.col("component").alias("node"), "component").distinct())
    _, own = deciding_rule(host_of(F.col("node")), path_of(F.col("node")), rules)
    # least of allow and block: an explicit allow stands first
    by_component = members.groupBy("component").agg(F.min(own).alias("shared")).filter("shared is not null")
    named = members.join(by_component, "component", "left")
    out = urls.drop("host", "path", "rule", "verdict", "component")
    url = F.col(url_col).cast("string")
    rule, verdict = deciding_rule(F.col("host"), F.col("path"), rules)
    out = out.withColumn("host", host_of(url)).withColumn("path", path_of(url))
    out = out.join(named.select(F.col("node").alias("__node"), F.col("component").alias("__c"), "shared"),
                   url == F.col("__node"), "left")
    return out.select(*[c for c in out.columns if c not in ("__node", "__c", "shared")], rule.alias("rule"),
                      F.coalesce(verdict, "shared", F.lit(default)).alias("verdict"),
                      F.coalesce("__c", url).alias("component"))


ORACLE = """
WITH RECURSIVE p AS (
  SELECT page_id, url, html,
    CASE WHEN strpos(url, '://') > 0 THEN translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
    CASE WHEN strpos(url, '://') > 0 THEN regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2) ELSE '' END AS path
  FROM pages),
c AS (SELECT *, list_sort(list_filter(string_split(regexp_extract(url, '(?s)^[^?#]*\\?([^#]*)', 1), '&'),
    lambda q: q <> '' AND NOT regexp_matches(q, '^(?:utm_|ref=|fbclid=|gclid=)'))) AS kept FROM p),
f AS (SELECT DISTINCT url, 'https://' || host || regexp_replace(path, '(?:/|\\.html?)$', '')
    || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END AS form FROM c WHERE strpos(url, '://') > 0),
links AS (SELECT url, regexp_extract(html, '(?is)<link\\b[^>]*\\brel\\s*=\\s*["'']?canonical\\b[^>]*\\bhref\\s*=\\s*["'']?([a-z][a-z0-9+.-]*://[^"''\\s>]+)', 1) AS form FROM c
    WHERE strpos(url, '://') > 0),
edges AS (SELECT url AS a, form AS b FROM f WHERE url <> form
    UNION SELECT url, form FROM links WHERE form <> '' AND form <> url),
both_ways AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
nodes AS (SELECT DISTINCT a AS node FROM both_ways),
addressed AS (SELECT node, translate(regexp_extract(node, '(?s)^.*?://([^/?#]*)([^?#]*)', 1),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(node, '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM nodes),
rules(kind, h, q) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
    ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
decided AS (SELECT node, arg_max(kind, length(h) + length(q)) AS kind FROM addressed, rules
    WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q) GROUP BY node),
reached(node, kind) AS (SELECT node, kind FROM decided
    UNION SELECT e.b, r.kind FROM reached r JOIN both_ways e ON e.a = r.node),
shared AS (SELECT node, min(kind) AS kind FROM reached GROUP BY node),
own AS (SELECT page_id, host, path, arg_max(h || q, length(h) + length(q)) AS rule, arg_max(kind, length(h) + length(q)) AS kind
    FROM p, rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q) GROUP BY page_id, host, path)
SELECT p.page_id, p.host, p.path, own.rule, coalesce(own.kind, shared.kind, 'allow') AS verdict
FROM p LEFT JOIN own ON own.page_id = p.page_id AND own.host = p.host AND own.path = p.path
LEFT JOIN shared ON shared.node = p.url
"""


@register("op1_url_aliases", ORACLE)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return judge(pages.select("page_id", "url"), page_edges(pages), RULES).select("page_id", "host", "path", "rule", "verdict")
