"""URL filter with redirect equivalence: aliases of a blocked URL are blocked, too.

* A rule is a host suffix, a path prefix and a verdict; the longest rule that fits a URL decides.
* A page ties its URL to the target of its canonical link and of its refresh redirect; a table
  of redirects (from_url, to_url) may add more. Connected components over these ties, found
  in Spark, are URLs that mean the same page.
* A URL that no rule fits: allowed if a URL of its component is explicitly allowed, else
  blocked if one is blocked, else allowed. A URL's own rule always comes first.

Scheme and fragment make no difference between URLs; A-Z in hosts is lower-cased. Components
are computed on 64-bit hashes of the URLs that have ties. Built-in functions only.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheetgrid.llm.common import components, plain, stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Attribute values may be quoted or bare.
_VALUE = r"""\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)


def _after_scheme(url: Column) -> Column:
    """What follows the first '://'; null without one."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3, F.length(url)))


def host_of(url: Column) -> Column:
    found = F.regexp_extract(_after_scheme(url), "^[^/?#]*", 0)
    return F.coalesce(F.translate(found, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_after_scheme(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def url_key(url: Column) -> Column:
    """Host, path and query: what two URLs share if they are the same but for scheme and fragment.

    Null without a scheme.
    """
    rest = F.regexp_extract(_after_scheme(url), "^[^/?#]*([^#]*)", 1)
    return F.when(F.contains(url, F.lit("://")), F.concat(host_of(url), rest))


def decide(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, else null.

    The rules are a list on the driver, part of the expression.
    """
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule in sorted(rules, key=lambda r: len(r.name)):
        fits = ((host == rule.host) | F.endswith(host, F.lit("." + rule.host))) & F.startswith(path, F.lit(rule.path))
        found = F.when(fits, F.struct(F.lit(rule.name).alias("rule"), F.lit(rule.verdict).alias("verdict"))).otherwise(found)
    return found


def _attribute(tag: Column, name: str) -> Column:
    pattern = rf"(?is)\s{name}{_VALUE}"
    return F.coalesce(*[F.nullif(F.regexp_extract(tag, pattern, i), F.lit("")) for i in (1, 2, 3)])


def targets_of(html: Column) -> Column:
    """Targets of the canonical links and refresh redirects of a page, as written."""
    links = F.regexp_extract_all(html, F.lit(r"(?is)<link\b[^>]*>"), F.lit(0))
    canonical = F.transform(
        F.filter(links, lambda t: F.array_contains(F.split(F.lower(F.coalesce(_attribute(t, "rel"), F.lit(""))), r"\s+"), "canonical")),
        lambda t: _attribute(t, "href"),
    )
    metas = F.regexp_extract_all(html, F.lit(r"(?is)<meta\b[^>]*>"), F.lit(0))
    refresh = F.transform(
        F.filter(metas, lambda t: F.lower(F.coalesce(_attribute(t, "http-equiv"), F.lit(""))) == "refresh"),
        lambda t: F.regexp_extract(_attribute(t, "content"), r"(?is)^\s*[\d.]*\s*[;,]\s*(?:url\s*=\s*)?['\"]?([^'\"]*)", 1),
    )
    both = F.concat(F.coalesce(canonical, F.array().cast("array<string>")), F.coalesce(refresh, F.array().cast("array<string>")))
    return F.filter(F.transform(both, lambda u: F.trim(F.replace(u, F.lit("&amp;"), F.lit("&")))), lambda u: u.isNotNull() & (u != ""))


def absolute(target: Column, url: Column) -> Column:
    """A link's target as an absolute URL: with scheme, '//host/..', '/path', '?query' or relative."""
    scheme = F.regexp_extract(url, r"^(?s)(.*?://)", 1)
    site = F.concat(scheme, host_of(url))
    folder = F.regexp_replace(path_of(url), "[^/]*$", "")
    return (
        F.when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), target)
        .when(F.startswith(target, F.lit("//")), F.concat(F.regexp_extract(scheme, "^(?s)(.*:)", 1), target))
        .when(F.startswith(target, F.lit("/")), F.concat(site, target))
        .when(F.startswith(target, F.lit("#")), url)
        .when(F.startswith(target, F.lit("?")), F.concat(site, path_of(url), target))
        .otherwise(F.concat(site, F.when(folder == "", F.lit("/")).otherwise(folder), target))
    )


def filter_urls(pages: DataFrame, rules: Sequence[Rule] = RULES, redirects: DataFrame | None = None) -> DataFrame:
    """Per page: page_id, host, path, rule, verdict, aliases_blocked.

    aliases_blocked: whether a URL of the page's component is blocked by rule. Null url, or one
    without '://': host and path empty, no rule, no ties, allowed. Null or empty html: no
    ties. Rows that repeat a page_id or url are judged one by one. Other columns are ignored.
    """
    source = plain(pages, "page_id", "url", "html")
    ties = source.where(F.contains("url", F.lit("://")) & F.col("html").rlike(r"(?i)<link|<meta")).select(
        F.col("url").alias("from_url"), F.explode(targets_of(F.col("html"))).alias("target")
    ).select("from_url", absolute(F.col("target"), F.col("from_url")).alias("to_url"))
    if redirects is not None:
        ties = ties.unionByName(plain(redirects, "from_url", "to_url"))
    keys = stored(
        ties.select(url_key(F.col("from_url")).alias("x"), url_key(F.col("to_url")).alias("y")).where("x <> y").distinct()
    )
    edges = keys.select(F.xxhash64("x").alias("a"), F.xxhash64("y").alias("b"))
    groups = stored(components(edges))
    urls = keys.select(F.explode(F.array("x", "y")).alias("key")).distinct()
    split = F.concat(F.lit("x://"), F.col("key"))
    own = decide(host_of(split), path_of(split), rules)["verdict"]
    judged = urls.select(F.xxhash64("key").alias("node"), own.alias("own")).join(groups, "node")
    verdicts = stored(
        judged.groupBy("component").agg(F.max(F.col("own") == "allow").alias("allowed"), F.max(F.col("own") == "block").alias("blocked"))
    )
    known = stored(
        groups.join(verdicts, "component").select("node", F.coalesce("allowed", F.lit(False)).alias("allowed"), F.coalesce("blocked", F.lit(False)).alias("blocked"))
    )
    url = F.col("url")
    rows = source.select(
        "page_id", host_of(url).alias("host"), path_of(url).alias("path"), F.xxhash64(url_key(url)).alias("_node")
    ).withColumn("_own", decide(F.col("host"), F.col("path"), rules))
    aliases = F.when(F.col("blocked") & ~F.col("allowed"), "block").otherwise("allow")
    return rows.join(known, F.col("_node") == F.col("node"), "left").select(
        "page_id",
        "host",
        "path",
        F.col("_own.rule").alias("rule"),
        F.coalesce("_own.verdict", aliases, F.lit("allow")).alias("verdict"),
        F.coalesce("blocked", F.lit(False)).alias("aliases_blocked"),
    )
