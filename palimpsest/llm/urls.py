"""URL filters with redirect equivalence.

A rule names a host (with its subdomains) and a path prefix. Urls that redirect
to one another or name a common canonical url are one: a block decision reaches
the urls of the component that no rule fits, unless one of them is explicitly
allowed. Scheme, letter case of the host, default port and fragment make no other
url; a url and its plain form (no www or m host, tracking parameters or slash at
the end), to which servers redirect, are linked like any redirect.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.common import ascii_lower, cut
from palimpsest.llm.components import connected_components

#: Rule tables up to so many rows are broadcast; larger ones are joined by host.
BROADCAST_RULES = 100_000
#: Query parameters that only track, and parts of a page that hold no tags of its own.
TRACKING = r"^(?:utm_[^=]*|ref|fbclid|gclid)(?:=|$)"
HIDDEN = r"(?is)<!--.*?-->|<script\b.*?</script>|<style\b.*?</style>"


def host_of(url: Column) -> Column:
    """From after the first :// up to /, ?, # or the end, A-Z lower-cased; else empty."""
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    """From after the host up to ?, # or the end; empty without ://."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def alias_key(url: Column) -> Column:
    """The url as a node of the links, ``://host/path?query``; null without ://."""
    query = F.regexp_extract(url, r"(?s)^.*?://[^?#]*\?([^#]*)", 1)
    host = F.regexp_replace(host_of(url), r":(?:80|443)$", "")
    return F.when(F.contains(url, F.lit("://")), F.concat(F.lit("://"), host, path_of(url), F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")))


def plain_key(key: Column) -> Column:
    """The node of the plain form of a node's url."""
    host = F.regexp_replace(host_of(key), r"^(?:www|m)\.([^.]+\..+)$", "$1")
    query = F.array_join(F.filter(F.split(F.regexp_extract(key, r"(?s)\?(.*)$", 1), "&"), lambda q: (q != "") & ~q.rlike(TRACKING)), "&")
    return F.concat(F.lit("://"), host, F.regexp_replace(path_of(key), "/+$", ""), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def resolve(base: Column, link: Column) -> Column:
    """The absolute url of a link on the page ``base``; null for links to no other page."""
    origin, path = F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*)", 1), path_of(base)
    folder = F.regexp_replace(path, r"[^/]*$", "")
    joined = (
        F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), link)
        .when(link.startswith("//"), F.concat(F.regexp_extract(base, r"(?s)^(.*?:)//", 1), link))
        .when((link == "") | link.startswith("#") | link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), None)
        .when(link.startswith("/"), F.concat(origin, link))
        .when(link.startswith("?"), F.concat(origin, path, link))
        .otherwise(F.concat(origin, F.when(folder == "", "/").otherwise(folder), link))
    )
    return F.when(joined.rlike(r"/\.\.?(?:[/?#]|$)"), _without_dots(joined)).otherwise(joined)


def _without_dots(url: Column) -> Column:
    """The url with the steps . and .. of its path taken."""
    head, rest = F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*)", 1), F.regexp_extract(url, r"(?s)^.*?://[^?#]*([?#].*)$", 1)
    steps = F.slice(F.split(path_of(url), "/"), 2, 1_000_000)
    none = F.array().cast("array<string>")
    walk = lambda out, x: F.when(x == ".", out).when((x == "..") & (F.size(out) > 0), F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0)))).when(x == "..", none).otherwise(F.array_append(out, x))
    return F.concat(head, F.lit("/"), F.array_join(F.aggregate(steps, none, walk), "/"), rest)


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Rules from (verdict, host, path) triples."""
    return spark.createDataFrame(rules, "verdict string, host string, path string")


def match(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, path, rule, verdict): the longest fitting rule of each distinct (host, path).

    A url meets rules by its host and each of its parent domains, an equality
    join. Of rules of equal length the lesser text wins, and allow over block.
    Urls that no rule fits are left out. Rules with a null are passed over.
    """
    rules = rules.where("verdict is not null and host is not null and path is not null").select(F.col("host").alias("suffix"), F.col("path").alias("prefix"), "verdict").distinct()
    labels = F.split("host", r"\.")
    n = F.size(labels)
    suffixes = F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(labels, i, n), "."))
    keys = urls.select("host", "path").where("host <> ''").distinct().select("host", "path", F.explode(suffixes).alias("suffix"))
    if rules.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES:
        rules = F.broadcast(rules)
    fits = keys.join(rules, "suffix").where(F.col("path").startswith(F.col("prefix")))
    rule = F.concat("suffix", "prefix")
    best = F.min(F.struct((-F.length(rule)).alias("n"), rule.alias("rule"), F.col("verdict").alias("verdict")))
    return fits.groupBy("host", "path").agg(best.alias("best")).select("host", "path", "best.rule", "best.verdict")


def html_links(pages: DataFrame) -> DataFrame:
    """(src, dst): canonical links and refresh redirects found in the pages' html, as absolute urls.

    Comments and scripts are passed over, and ``&amp;`` is an ampersand.
    """
    attr = lambda tag, name: F.regexp_extract(tag, rf"(?is)\b{name}\s*=\s*[\"']?([^\"'>\s]+)", 1)
    html = pages.where(F.col("url").isNotNull() & F.col("html").rlike("(?i)canonical|refresh"))
    seen = F.regexp_replace("html", HIDDEN, " ")
    tags = html.select("url", F.explode(F.regexp_extract_all(seen, F.lit(r"(?is)<(?:link|meta)\b[^>]*>"), F.lit(0))).alias("tag"))
    canonical = F.when(F.col("tag").rlike(r"(?is)^<link\b.*\brel\s*=\s*[\"']?canonical\b"), attr(F.col("tag"), "href"))
    refresh = F.when(F.col("tag").rlike(r"(?is)^<meta\b.*\bhttp-equiv\s*=\s*[\"']?refresh\b"), F.regexp_extract("tag", r"(?is)\burl\s*=\s*[\"']?([^\"'>\s]+)", 1))
    target = F.replace(F.coalesce(canonical, refresh), F.lit("&amp;"), F.lit("&"))
    return tags.select(F.col("url").alias("src"), target.alias("link")).where("link is not null").select("src", resolve(F.col("src"), F.col("link")).alias("dst"))


def judge(pages: DataFrame, rules: DataFrame, links: DataFrame | None = None, default: str = "allow") -> DataFrame:
    """(page_id, url, host, path, rule, verdict), a row for each row of ``pages``.

    ``links`` (src, dst) adds redirects to the links in the pages' html and those
    to plain forms. A url that a rule fits has that rule's verdict. Any other takes
    from its component of links: allow if a member is allowed by a rule, block if
    one is blocked, else ``default``; urls that only links name count as members.
    Null urls, or urls without ://, have an empty host and path and the default.
    Repeated pages each keep a row. Columns other than page_id, url and html are
    not read.
    """
    url = F.col("url")
    base = pages.select("page_id", "url", host_of(url).alias("host"), path_of(url).alias("path"), alias_key(url).alias("node"))
    redirects = html_links(pages)
    if links is not None:
        redirects = redirects.unionByName(links.select("src", "dst"))
    redirects = cut(redirects.select(alias_key(F.col("src")).alias("src"), alias_key(F.col("dst")).alias("dst")).where("src is not null and dst is not null").distinct())
    named = base.where("node is not null").select("node").union(redirects.select("src")).union(redirects.select("dst")).distinct()
    edges = cut(redirects.union(named.select("node", plain_key(F.col("node")))).where("src <> dst").distinct())
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    classes = cut(connected_components(edges, "src", "dst"))
    fits = cut(match(base.select("host", "path").union(ends.select(host_of(F.col("node")).alias("host"), path_of(F.col("node")).alias("path"))), rules))
    out = base.join(fits, ["host", "path"], "left")
    ruled = classes.select("component", host_of(F.col("node")).alias("host"), path_of(F.col("node")).alias("path")).join(fits, ["host", "path"])
    # written out, so that the join below deals both sides anew and may split a large component
    passed = cut(ruled.groupBy("component").agg(F.max(F.col("verdict") == "allow").alias("allowed"), F.max(F.col("verdict") == "block").alias("blocked")))
    passed = classes.join(passed, "component").select("node", F.when(F.col("allowed"), "allow").when(F.col("blocked"), "block").alias("passed"))
    return out.join(passed, "node", "left").select("page_id", "url", "host", "path", "rule", F.coalesce("verdict", "passed", F.lit(default)).alias("verdict"))
