"""URL rules whose block decisions reach aliases through redirect and canonical links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .util import ascii_lower, let, materialize

#: (verdict, host, path)
DEFAULT_RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))


def url_host(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def url_node(url: Column) -> Column:
    """What two urls of one page share: lower-case scheme and host, path and query, no fragment; null if there is no host."""

    def build(u: Column) -> Column:
        rest = F.regexp_extract(u, r"(?s)^.*?://[^/?#]*([^#]*)", 1)
        rest = F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest))
        return F.when(url_host(u) != "", F.concat(F.lower(F.regexp_extract(u, r"(?s)^(.*?)://", 1)), F.lit("://"), url_host(u), rest))

    return let(F.trim(url), build)


def absolute(base: Column, href: Column) -> Column:
    """href as seen from the page base."""
    h = F.replace(F.trim(href), F.lit("&amp;"), F.lit("&"))
    scheme = F.regexp_extract(base, r"(?s)^(.*?)://", 1)
    site = F.regexp_extract(base, r"(?s)^.*?://[^/?#]*", 0)
    folder = F.coalesce(F.nullif(F.regexp_extract(url_path(base), r"(?s)^.*/", 0), F.lit("")), F.lit("/"))
    return (
        F.when(h.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://"), h)
        .when(h.startswith("//"), F.concat(scheme, F.lit(":"), h))
        .when(h.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), F.lit(None).cast("string"))
        .when(h.startswith("/"), F.concat(site, h))
        .when(h.startswith("?"), F.concat(site, url_path(base), h))
        .when((h == "") | h.startswith("#"), base)
        .otherwise(F.concat(site, folder, h))
    )


def alias_links(pages: DataFrame) -> DataFrame:
    """(from_node, to_node) of the canonical links and meta refreshes in the pages' html."""
    attr = lambda tag, name: F.regexp_extract(tag, rf"(?is)\b{name}\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", 0)
    value = lambda a: F.regexp_replace(F.regexp_replace(a, r"(?s)^[^=]*=\s*", ""), r"^[\"']|[\"']$", "")
    links = F.filter(F.regexp_extract_all("html", F.lit(r"(?is)<link\b[^>]*>"), F.lit(0)), lambda t: F.lower(value(attr(t, "rel"))).rlike(r"(^|\s)canonical(\s|$)"))
    moves = F.filter(F.regexp_extract_all("html", F.lit(r"(?is)<meta\b[^>]*>"), F.lit(0)), lambda t: F.lower(value(attr(t, "http-equiv"))) == "refresh")
    links = F.transform(links, lambda t: value(attr(t, "href")))
    moves = F.transform(moves, lambda t: F.regexp_replace(F.regexp_extract(value(attr(t, "content")), r"(?is)url\s*=\s*(.*)$", 1), r"^[\"']|[\"']$", ""))
    found = pages.filter("url is not null and html is not null").filter(F.lower("html").rlike("canonical|refresh"))
    found = found.select("url", F.explode(F.concat(links, moves)).alias("href")).filter("href != ''")
    return found.select(url_node(F.col("url")).alias("from_node"), url_node(let(F.col("href"), lambda h: absolute(F.col("url"), h))).alias("to_node")).filter("from_node is not null and to_node is not null")


def best_rule(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...]) -> Column:
    """The longest rule that fits (a struct of rule and verdict), null if none does; of equals an allow goes first."""
    order = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[0] != "allow", r[1] + r[2]))
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in reversed(order):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def judge_urls(pages: DataFrame, rules: tuple[tuple[str, str, str], ...] = DEFAULT_RULES, redirects: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict of every page, and its alias component.

    A page's own longest rule decides. A page without one takes the decision of its
    aliases: urls joined to it, at any distance, by canonical links, meta refreshes or
    rows of redirects (from_url, to_url). One explicitly allowed url among them allows
    it; else one blocked url blocks it; else it is allowed. Link targets need not be pages.
    Null urls and urls without :// have empty host and path, no aliases and so verdict
    allow; null html has no links; pages may repeat; other columns are ignored; an empty
    table gives an empty one.
    """
    links = alias_links(pages.select("url", "html"))
    if redirects is not None:
        more = redirects.select(url_node(F.col("from_url")).alias("from_node"), url_node(F.col("to_url")).alias("to_node"))
        links = links.unionByName(more)
    nodes = materialize(connected_components(links), "aliases")
    own = best_rule(url_host(F.col("node")), url_path(F.col("node")), rules)["verdict"]
    groups = nodes.withColumn("own", own).groupBy("component").agg(F.bool_or(F.col("own") == "allow").alias("allows"), F.bool_or(F.col("own") == "block").alias("blocks"))
    groups = materialize(groups, "aliasgroups")  # both sides of the next join are then plain exchanges
    decided = materialize(nodes.join(groups, "component").select("node", "component", F.when(F.col("allows"), "allow").when(F.col("blocks"), "block").alias("of_aliases")), "decided")
    host, path = url_host(F.col("url")), url_path(F.col("url"))
    mine = pages.select("page_id", host.alias("host"), path.alias("path"), url_node(F.col("url")).alias("node"))
    mine = mine.withColumn("best", best_rule(F.col("host"), F.col("path"), rules))
    # urls without a host have no aliases: each meets the join under a name of its own, not all under null
    mine = mine.withColumn("node", F.coalesce("node", F.concat(F.lit("\x00"), F.monotonically_increasing_id().cast("string"))))
    met = mine.join(decided, "node", "left")
    return met.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", "of_aliases", F.lit("allow")).alias("verdict"), F.col("component").alias("alias_component"))
