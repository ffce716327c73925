"""URL filters (operator 3): redirect equivalence, with DataFrame functions only.

Rules allow or block a host (and its subdomains) and a path prefix; the longest that fits
decides. Urls that no rule fits take part in redirect equivalence: redirects (meta refresh,
or given pairs) and canonical links are edges, distributed connected components join aliases,
and a component that holds a blocked url is blocked, unless it holds an explicitly allowed
one: allow takes precedence. Targets are read with their entities decoded, and relative ones
against the url of their page.

Scale: rules are a parameter of at most MAX_RULES, evaluated as an expression. Pages without
an edge never shuffle beyond one join on their url; components are found on edges alone.

Defined cases: null urls and urls without `://` have empty host and path and are allowed by
default; null or empty html has no links; urls that repeat are judged alike; empty tables give
empty ones. Only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import connected_components

MAX_RULES = 1000
ENTITIES = {"&amp;": "&", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'"}
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Fixed values: (rule, verdict) of the production query.
RULES = [("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block")]


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def node_of(url: Column) -> Column:
    """What stands for a url in the graph: its host, path and query, without scheme and fragment."""
    return F.concat(host_of(url), F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^#]*)", 1))


def best_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """struct(size, allow, rule) of the longest rule that fits, or null; of equally long ones allow wins."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"at most {MAX_RULES} rules")
    fits = []
    for rule, verdict in rules:
        name, slash, rest = rule.partition("/")
        fit = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        fits.append(F.when(fit, F.struct(F.lit(len(rule)).alias("size"), F.lit(int(verdict == "allow")).alias("allow"), F.lit(rule).alias("rule"))))
    return F.array_max(F.array(*fits)) if fits else F.lit(None).cast("struct<size:int,allow:int,rule:string>")


def decoded(text: Column) -> Column:
    """text with its entities, the five of XML and numeric ones, read once; others stay."""
    code = lambda x: F.when(x.rlike("^&#[xX]"), F.conv(F.regexp_extract(x, "^&#[xX]([0-9a-fA-F]+)", 1), 16, 10)).otherwise(F.regexp_extract(x, "^&#([0-9]+)", 1)).cast("long")

    def one(x: Column) -> Column:
        out = F.when(x.rlike("^&#"), F.when(code(x).between(1, 0xD7FF) | code(x).between(0xE000, 0x10FFFF), F.decode(F.unhex(F.lpad(F.hex(code(x)), 8, "0")), "UTF-32")).otherwise(x))
        for name, sign in ENTITIES.items():
            out = out.when(x == name, sign)
        return out.otherwise(x)

    parts = F.regexp_extract_all(text, F.lit("(?s)&(?:#[xX][0-9a-fA-F]{1,6}|#[0-9]{1,7}|amp|lt|gt|quot|apos);|[^&]+|&"), F.lit(0))
    return F.when(text.contains("&"), F.array_join(F.transform(parts, one), "")).otherwise(text)


def without_dots(path: Column) -> Column:
    """A path from its root, `.` and `..` worked off; one `..` too many stays at the root."""
    parts = F.split(F.substring(path, F.lit(2), F.length(path)), "/", -1)
    step = lambda kept, x: F.when(x == "..", F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0)))).when(x == ".", kept).otherwise(F.array_append(kept, x))
    kept = F.aggregate(parts, F.array().cast("array<string>"), step)
    folder = F.element_at(parts, -1).isin(".", "..") & (F.size(kept) > 0)
    return F.concat(F.lit("/"), F.array_join(kept, "/"), F.when(folder, "/").otherwise(""))


def resolved(target: Column, url: Column) -> Column:
    """The url that a link's target names on the page url; null where it has another scheme's form (mailto:, data:)."""
    root, path = F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*)", 1), path_of(url)
    own, rest = F.regexp_extract(target, r"(?s)^([^?#]*)", 1), F.regexp_extract(target, r"(?s)^[^?#]*(.*)$", 1)
    beside = F.concat(F.lit("/"), F.regexp_extract(path, r"(?s)^/(.*/)?", 1), own)
    return (
        F.when(target.rlike(r"^(?:[A-Za-z][A-Za-z0-9+.-]*)?://"), target)
        .when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None).cast("string"))
        .when(target.startswith("//"), F.concat(F.regexp_extract(url, r"(?s)^(.*?:)//", 1), target))
        .when(target.startswith("/"), F.concat(root, without_dots(own), rest))
        .when(target.startswith("?"), F.concat(root, path, target))
        .when(target.startswith("#"), F.concat(F.regexp_extract(url, r"(?s)^([^#]*)", 1), target))
        .otherwise(F.concat(root, without_dots(beside), rest))
    )


def link_targets(html: Column, url: Column) -> Column:
    """Absolute targets of canonical links and of meta refreshes, as an array; null where there is none."""
    tag = F.regexp_extract_all(html, F.lit(r"(?is)<(?:link|meta)\b[^>]*>"), F.lit(0))
    canonical = F.filter(tag, lambda t: t.rlike(r"(?is)^<link\b[^>]*\brel\s*=\s*[\"']?canonical\b"))
    refresh = F.filter(tag, lambda t: t.rlike(r"(?is)^<meta\b[^>]*http-equiv\s*=\s*[\"']?refresh\b"))
    found = F.concat(
        F.transform(canonical, lambda t: F.regexp_extract(t, r"(?is)\bhref\s*=\s*[\"']?([^\"'\s>]+)", 1)),
        F.transform(refresh, lambda t: F.regexp_extract(t, r"(?is)\burl\s*=\s*[\"']?([^\"'\s>]+)", 1)),
    )
    return F.transform(F.filter(found, lambda t: t != ""), lambda t: resolved(decoded(t), url))


def page_links(pages: DataFrame) -> DataFrame:
    """(source, target) urls of pages (url, html)."""
    some = F.col("html").rlike(r"(?i)canonical|refresh")
    return pages.where(some & F.col("url").contains("://")).select(F.col("url").alias("source"), F.explode(link_targets(F.col("html"), F.col("url"))).alias("target")).where("target is not null")


def url_filter(pages: DataFrame, rules: list[tuple[str, str]] = RULES, redirects: DataFrame | None = None, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """(page_id, host, path, rule, verdict, reason) of every page. redirects: more edges (source, target)."""
    own = pages.select(F.col(id_column).alias("page_id"), F.col(url_column).alias("url"), F.col(html_column).alias("html"))
    links = page_links(own)
    if redirects is not None:
        links = links.unionAll(redirects.select(F.col(redirects.columns[0]), F.col(redirects.columns[1])))
    edges = links.select(node_of(F.col("source")).alias("a"), node_of(F.col("target")).alias("b")).where("a != '' and b != ''")
    members = connected_components(edges)
    decided = best_rule(host_of(F.concat(F.lit("://"), F.col("node"))), path_of(F.concat(F.lit("://"), F.col("node"))), rules)
    classes = members.withColumn("r", decided).groupBy("component").agg(F.max("r.allow").alias("allowed"), F.min("r.allow").alias("least"))
    blocked = members.join(classes.where("least = 0 and allowed = 0").select("component"), "component", "left_semi").select("node", F.lit(True).alias("alias_blocked"))
    judged = own.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")).withColumn("r", best_rule(F.col("host"), F.col("path"), rules))
    out = ["page_id", "host", "path", "rule", "verdict", "reason"]
    ruled = judged.where("r is not null").select("page_id", "host", "path", F.col("r.rule").alias("rule"), F.when(F.col("r.allow") == 1, "allow").otherwise("block").alias("verdict"), F.lit("rule").alias("reason"))
    open_ = judged.where("r is null").withColumn("node", F.coalesce(node_of(F.col("url")), F.lit("")))
    rest = open_.join(blocked, "node", "left").select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.when(F.col("alias_blocked"), "block").otherwise("allow").alias("verdict"), F.when(F.col("alias_blocked"), "alias").otherwise("default").alias("reason"))
    return ruled.select(out).unionAll(rest.select(out))
