"""URL functions as Column expressions. Only http(s) addresses with a host are understood; all else is null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: query parameters that only track visitors
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "fbclid", "gclid", "msclkid", "_ga", "mc_cid", "mc_eid", "ref", "source", "campaign_id", "ad_id")

PARTS = r"^(?i)(https?)://(?:[^/?#@]*@)?([^/?#:]+)(?::(\d+))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def part(url: Column, i: int) -> Column:
    return F.regexp_extract(F.trim(url), PARTS, i)


def scheme(url: Column) -> Column:
    return F.lower(part(url, 1))


def host(url: Column) -> Column:
    return F.nullif(F.lower(part(url, 2)), F.lit(""))


def port(url: Column) -> Column:
    """':8080', or '' for the scheme's own port."""
    p, s = part(url, 3), scheme(url)
    usual = (p == "") | ((s == "https") & (p == "443")) | ((s == "http") & (p == "80"))
    return F.when(usual, "").otherwise(F.concat(F.lit(":"), p))


def bare_path(url: Column) -> Column:
    """The path without slashes at its end."""
    return F.regexp_replace(part(url, 4), "/+$", "")


def origin(url: Column) -> Column:
    return F.when(host(url).isNotNull(), F.concat(scheme(url), F.lit("://"), host(url), port(url)))


def normalize(url: Column) -> Column:
    """One spelling: no fragment, default port or tracking parameter, no slash at the end, parameters sorted by key and value."""
    pairs = F.transform(
        F.filter(F.split(part(url, 5), "&"), lambda x: x != ""),
        lambda x: F.struct(F.substring_index(x, "=", 1).alias("k"), F.when(x.contains("="), F.substr(x, F.length(F.substring_index(x, "=", 1)) + 2)).otherwise("").alias("v")),
    )
    kept = F.array_sort(F.filter(pairs, lambda p: ~p["k"].isin(*TRACKING)))
    query = F.array_join(F.transform(kept, lambda p: F.concat(p["k"], F.lit("="), p["v"])), "&")
    path = F.when(bare_path(url) == "", "/").otherwise(bare_path(url))
    return F.concat(origin(url), path, F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))


def display(url: Column) -> Column:
    return F.coalesce(F.concat(host(url), bare_path(url)), url)


def within(h: Column, domain: Column | str) -> Column:
    """The host is the domain or one below it."""
    d = F.lit(domain) if isinstance(domain, str) else domain
    return (h == d) | h.endswith(F.concat(F.lit("."), d))


def in_scope(h: Column, anchor: Column, scope: Column) -> Column:
    """`any`, `same_host`, or else the same domain."""
    h, a = F.lower(h), F.lower(anchor)
    return F.when(scope == "any", True).when(a.isNull(), False).when(scope == "same_host", h == a).otherwise(within(h, a))


def domain_input(text: Column) -> Column:
    """The host that a user typed, with or without a scheme."""
    t = F.trim(text)
    return F.coalesce(host(t), host(F.concat(F.lit("https://"), t)))


def network(url: Column) -> Column:
    return F.when(F.coalesce(host(url), F.lit("")).endswith(".onion"), "tor").otherwise("clearnet")


def trusted_canonical(hint: Column, final: Column) -> Column:
    """The normalised hint if one of both hosts lies within the other's domain."""
    a, b = host(hint), host(final)
    return F.when(within(a, b) | within(b, a), normalize(hint))


def page_budget_filter(urls: Column, anchor: Column, scope: Column, most: int) -> Column:
    """The first `most` discovered URLs that the scope admits, in order."""
    return F.slice(F.filter(urls, lambda u: in_scope(host(u), anchor, scope)), 1, most)
