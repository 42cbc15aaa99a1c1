"""URL rules with redirect equivalence: pages joined by redirects or canonical links are aliases, and a block spreads to them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .components import components

URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
CANONICAL = r"""(?is)<link\b[^>]*\brel\s*=\s*["']?canonical\b[^>]*>"""
HREF = r"""(?is)\bhref\s*=\s*["']?([^"'\s>]+)"""
REFRESH = r"""(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["']?refresh\b[^>]*>"""
REFRESH_URL = r"""(?is)\burl\s*=\s*['"]?([^"'\s>]+)"""
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class UrlRule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path

    def fits(self, host: Column, path: Column) -> Column:
        return ((host == self.host) | host.endswith("." + self.host)) & path.startswith(self.path)


RULES = (UrlRule("block", "net", "/"), UrlRule("allow", "example.net", "/en/"), UrlRule("block", "example.com", "/de/"), UrlRule("allow", "org", "/fr/"))


def host_of(url: Column) -> Column:
    """What stands after the first :// up to / ? # or the end, A-Z lower-cased; null or no :// gives ''."""
    return F.translate(F.coalesce(F.regexp_extract(url, URL, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[UrlRule, ...]) -> Column:
    """(rule, verdict) of the longest rule that fits, else null; among rules of one length the first in code point order."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (-len(r.name), r.name), reverse=True):
        out = F.when(r.fits(host, path), F.struct(F.lit(r.name).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def identity(url: Column) -> Column:
    """Two spellings of a page's address are one node if this is equal: no fragment, scheme and host in lower case."""
    bare = F.regexp_replace(url, "(?s)#.*$", "")
    head = F.regexp_extract(bare, r"(?s)^.*?://[^/?]*", 0)
    return F.concat(F.translate(head, UPPER, LOWER), F.substr(bare, F.length(head) + 1))


def page_edges(pages: DataFrame) -> DataFrame:
    """(a, b): a page's address and the address its canonical link or refresh names. Relative addresses are resolved
    against the page's host or folder."""
    tag = F.regexp_extract("html", CANONICAL, 0), F.regexp_extract("html", REFRESH, 0)
    to = F.explode(F.array(F.regexp_extract(tag[0], HREF, 1), F.regexp_extract(tag[1], REFRESH_URL, 1)))
    found = pages.where(F.col("html").rlike("(?i)canonical|http-equiv") & F.col("url").isNotNull()).select("url", to.alias("to")).where("to <> ''")
    origin = F.regexp_extract("url", r"(?s)^.*?://[^/?#]*", 0)
    folder = F.concat(origin, F.coalesce(F.nullif(F.regexp_extract(path_of(F.col("url")), "(?s)^.*/", 0), F.lit("")), F.lit("/")))
    link = F.regexp_replace("to", "&amp;", "&")
    full = (
        F.when(link.contains("://"), link)
        .when(link.startswith("//"), F.concat(F.regexp_extract("url", r"(?s)^(.*?:)//", 1), link))
        .when(link.startswith("/"), F.concat(origin, link))
        .otherwise(F.concat(folder, link))
    )
    return found.select(identity(F.col("url")).alias("a"), identity(full).alias("b"))


def judge_urls(pages: DataFrame, rules: tuple[UrlRule, ...] = RULES, redirects: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict and by (rule, alias or default) for every page.

    A page's own rule decides, block or allow. A page without a rule is blocked if a page it is equivalent to, over any
    chain of `redirects` (from_url, to_url), canonical links and refreshes, is blocked by rule; an explicit allow of the
    page itself comes before that. All other pages are allowed. Addresses that are only named by links count as members.
    Null url: empty host and path, no rule, no alias, allowed. Null html: no links. Repeated pages are judged each.
    Empty table: no rows. Other columns are ignored.
    """
    spark = pages.sparkSession
    pages = pages.select("page_id", "url", "html")
    edges = page_edges(pages)
    if redirects is not None:
        edges = edges.unionByName(redirects.select(identity(F.col("from_url")).alias("a"), identity(F.col("to_url")).alias("b")))
    scratch = Scratch(spark, "urls")
    member = components(scratch.write(edges, "links"), scratch)
    own = rule_of(host_of(F.col("node")), path_of(F.col("node")), rules)
    blocked = member.where(own["verdict"] == "block").select("component").distinct()
    aliases = member.join(blocked, "component", "left_semi").select(F.col("node").alias("alias"))
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    judged = pages.select("page_id", identity(F.col("url")).alias("node"), host.alias("host"), path.alias("path"))
    judged = judged.withColumn("own", rule_of(F.col("host"), F.col("path"), rules)).join(aliases, F.col("node") == F.col("alias"), "left")
    return judged.select(
        "page_id", "host", "path", F.col("own.rule").alias("rule"),
        F.coalesce("own.verdict", F.when(F.col("alias").isNotNull(), "block").otherwise("allow")).alias("verdict"),
        F.when(F.col("own").isNotNull(), "rule").when(F.col("alias").isNotNull(), "alias").otherwise("default").alias("by"),
    )
