"""URL filters with redirect equivalence.

A page's own rule decides first. Redirects and canonical links make urls aliases: connected
components over those edges carry a block decision to every alias that has no rule of its own,
unless some alias is explicitly allowed. Links are taken as a browser would: relative to the page's url,
schemes and hosts whatever their case.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, components, table, written

URL = r"(?s)\A.*?://([^/?#]*)([^?#]*)"
#: block and allow rules of the registered query: (host and path, verdict)
RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]
CANONICAL = r"""(?is)<link\s[^>]*?rel\s*=\s*["']?canonical["']?[^>]*>"""
REFRESH = r"""(?is)<meta\s[^>]*?http-equiv\s*=\s*["']?refresh["']?[^>]*>"""
HREF = r"""(?is)\shref\s*=\s*["']?\s*([^"'\s>]+)"""
REFRESH_URL = r"""(?is)url\s*=\s*["']?\s*([^"'\s>]+)"""
#: scheme, host and port, path, query
PARTS = r"(?s)\A([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?"
SCHEME = r"\A[A-Za-z][A-Za-z0-9+.\-]*:"


def url_host(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), URL, 1), UPPER, LOWER)


def url_path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), URL, 2)


def without_fragment(url: Column) -> Column:
    return F.regexp_extract(url, r"(?s)\A([^#]*)", 1)


def url_node(url: Column) -> Column:
    """A url as aliases are compared: without fragment, scheme and host in lower case."""
    parts = lambda i: F.regexp_extract(url, PARTS, i)
    known = F.concat(F.lower(parts(1)), F.lit("://"), F.translate(parts(2), UPPER, LOWER), parts(3), parts(4))
    return F.when(parts(1) != "", known).otherwise(without_fragment(url))


def without_dots(path: Column) -> Column:
    """A path with its segments . and .. worked off."""
    step = lambda done, x: F.when(x == ".", done).when(x == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(1)))).otherwise(F.concat(done, F.array(x)))
    parts = F.split(path, "/")
    short = F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")
    closed = F.when(F.element_at(parts, -1).isin(".", ".."), F.concat(short, F.lit("/"))).otherwise(short)
    return F.when(F.contains(path, F.lit("/.")), closed).otherwise(path)


def resolved(base: Column, link: Column) -> Column:
    """A link in a page of the url base, as an absolute url; null if it leads nowhere (mailto:, javascript:, a
    fragment alone) or base is none."""
    scheme, host, path = (F.regexp_extract(base, PARTS, i) for i in (1, 2, 3))
    link = F.regexp_replace(without_fragment(link), "&amp;", "&")
    target, query = F.regexp_extract(link, r"(?s)\A([^?]*)", 1), F.regexp_extract(link, r"(?s)\A[^?]*(\?.*)", 1)
    root = F.concat(scheme, F.lit("://"), host)
    folder = F.regexp_extract(path, r"(?s)\A(.*/)", 1)
    folder = F.when(folder == "", "/").otherwise(folder)
    return (
        F.when(F.regexp_like(link, F.lit(r"\A[A-Za-z][A-Za-z0-9+.\-]*://")), link)
        .when((scheme == "") | (link == "") | F.regexp_like(link, F.lit(SCHEME)), F.lit(None))
        .when(F.startswith(link, F.lit("//")), F.concat(scheme, F.lit(":"), link))
        .when(F.startswith(link, F.lit("?")), F.concat(root, path, link))
        .when(F.startswith(link, F.lit("/")), F.concat(root, without_dots(target), query))
        .otherwise(F.concat(root, without_dots(F.concat(folder, target)), query))
    )


def html_links(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(src, dst): all canonical links and meta refreshes in the pages' html, as nodes. A link of a page to itself is
    left out."""
    html = F.coalesce(F.col(html_col), F.lit(""))
    tags = lambda tag, at: F.transform(F.regexp_extract_all(html, F.lit(tag), F.lit(0)), lambda t: F.regexp_extract(t, at, 1))
    return (
        pages.where(F.col(url_col).isNotNull())
        .select(F.col(url_col).alias("base"), F.explode(F.concat(tags(CANONICAL, HREF), tags(REFRESH, REFRESH_URL))).alias("link"))
        .select(url_node(F.col("base")).alias("src"), url_node(resolved(F.col("base"), F.col("link"))).alias("dst"))
        .where("dst is not null and src <> dst")
        .distinct()
    )


def rule_hits(urls: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """urls(node) -> (node, rule, ruled): the longest rule whose host is the url's host or a parent
    domain of it and whose path starts the url's path. Every host suffix of a url is looked up, so
    the work is a join on hosts however long the rule list is."""
    spark = urls.sparkSession
    rows = [(r.partition("/")[0].lower(), "/" + r.partition("/")[2], r, v) for r, v in rules]
    known = spark.createDataFrame(rows, "rule_host string, rule_path string, rule string, ruled string")
    labels = F.split("host", r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size("labels")), lambda i: F.array_join(F.slice("labels", i, F.size("labels")), ".")
    )
    wide = (
        urls.select("node", url_host(F.col("node")).alias("host"), url_path(F.col("node")).alias("path"))
        .where("host <> ''")
        .withColumn("labels", labels)
        .select("node", "path", F.explode(suffixes).alias("rule_host"))
    )
    best = F.max(F.struct(F.length("rule").alias("n"), F.length("rule_host").alias("h"), "rule", "ruled")).alias("best")
    return (
        wide.join(known, "rule_host")
        .where(F.expr("startswith(path, rule_path)"))
        .groupBy("node")
        .agg(best)
        .select("node", "best.rule", "best.ruled")
    )


def judge_urls(
    pages: DataFrame,
    rules: list[tuple[str, str]],
    links: DataFrame | None = None,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str | None = "html",
) -> DataFrame:
    """page_id, host, path, rule, verdict, via for every row of pages (repeated rows each get one).

    via is 'rule', 'alias' (a block came over links) or 'default' (allow). links(src, dst) adds known
    redirects, absolute urls, to those in the html; null ends are dropped. A url without '://' or a null url has
    empty host and path, no rule and no aliases: allow. Urls are compared as url_node has them, query included;
    an empty path and / differ. Urls only seen as link targets count
    as aliases too. A component that holds an explicit allow does not pass blocks on. Texts are searched whole
    whatever their length. An empty table gives no rows. Other columns are ignored.
    """
    cols = [F.col(id_col).alias("page_id"), F.col(url_col).alias("url")]
    page = pages.select(*cols, url_node(F.col(url_col)).alias("node"))
    edges = html_links(pages, url_col, html_col) if html_col else None
    if links is not None:
        known = links.select(url_node(F.col("src")).alias("src"), url_node(F.col("dst")).alias("dst")).where("src is not null and dst is not null")
        edges = known if edges is None else edges.unionByName(known)
    # a url's own rule goes by the url as it stands; nodes are for aliases
    own = rule_hits(page.select(F.col("url").alias("node")).where("node is not null").distinct(), rules)
    out = page.join(own.withColumnRenamed("node", "url"), "url", "left")
    if edges is not None:
        edges = written(edges, "links")
    if edges is not None and edges.rows:
        comp = written(components(edges), "aliases")
        hits = rule_hits(comp.select("node"), rules)
        spread = (
            comp.join(hits, "node")
            .groupBy("component")
            .agg(F.max(F.col("ruled") == "block").alias("blocks"), F.max(F.col("ruled") == "allow").alias("allows"))
            .where("blocks and not allows")
            .select("component")
        )
        spread = comp.join(spread, "component").select("node", F.lit(True).alias("aliased"))
        out = out.join(spread, "node", "left")
    else:
        out = out.withColumn("aliased", F.lit(None).cast("boolean"))
    aliased = F.coalesce("aliased", F.lit(False))
    return out.select(
        "page_id",
        url_host(F.col("url")).alias("host"),
        url_path(F.col("url")).alias("path"),
        "rule",
        F.coalesce("ruled", F.when(aliased, "block").otherwise("allow")).alias("verdict"),
        F.when(F.col("ruled").isNotNull(), "rule").when(aliased, "alias").otherwise("default").alias("via"),
    )


def op4_url_filter(spark, sf_dir: str) -> DataFrame:
    """page_id, host, path, rule, verdict of every page by RULES and the links in its html."""
    return judge_urls(table(spark, sf_dir, "pages"), RULES).select("page_id", "host", "path", "rule", "verdict")


# Pages of the test tables hold no canonical link and no refresh, so rules alone decide here;
# tests/llm holds alias components against brute force.
OP4_SQL = r"""
WITH p AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
r(rule_host, rule_path, rule, ruled) AS (VALUES ('net', '/', 'net/', 'block'), ('example.net', '/en/', 'example.net/en/', 'allow'),
  ('example.com', '/de/', 'example.com/de/', 'block'), ('org', '/fr/', 'org/fr/', 'allow')),
j AS (SELECT p.*, (SELECT max({'n': length(r.rule), 'rule': r.rule, 'ruled': r.ruled}) FROM r
    WHERE (p.host = r.rule_host OR ends_with(p.host, '.' || r.rule_host)) AND starts_with(p.path, r.rule_path)) AS best FROM p)
SELECT page_id, host, path, best.rule AS rule, coalesce(best.ruled, 'allow') AS verdict FROM j
"""
