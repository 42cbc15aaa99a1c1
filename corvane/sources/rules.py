"""Site rules compiled to one conditional expression: no join at run time."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import urls


@dataclass(frozen=True)
class PageRule:
    name: str
    action: str
    reason: str = ""
    hosts: tuple[str, ...] = ()
    host_suffixes: tuple[str, ...] = ()
    path_exacts: tuple[str, ...] = ()
    path_prefixes: tuple[str, ...] = ()
    path_regex: str | None = None
    query_keys: tuple[str, ...] = ()
    query_values: tuple[str, ...] = ()

    def fits(self, url: Column) -> Column:
        """All groups that are given must match; in a group any entry may."""
        h, path, query = urls.host(url), urls.part(url, 4), F.split(urls.part(url, 5), "&")
        keys = F.transform(query, lambda x: F.substring_index(x, "=", 1))
        groups = [
            [h == x for x in self.hosts], [urls.within(h, x) for x in self.host_suffixes], [path == x for x in self.path_exacts],
            [path.startswith(x) if x.endswith("/") else (path == x) | path.startswith(x + "/") for x in self.path_prefixes],
            [path.rlike(self.path_regex)] if self.path_regex else [], [F.array_contains(keys, k) for k in self.query_keys], [F.array_contains(query, v) for v in self.query_values],
        ]
        out = F.lit(True)
        for g in filter(None, groups):
            any_of = g[0]
            for c in g[1:]:
                any_of = any_of | c
            out = out & any_of
        return out


@dataclass
class RuleRegistry:
    rules: list[PageRule] = field(default_factory=list)
    default: str = "index"

    @classmethod
    def from_toml(cls, text: str) -> RuleRegistry:
        raw = tomllib.loads(text)
        rules = [PageRule(**{k: tuple(v) if isinstance(v, list) else v for k, v in r.items()}) for r in raw.get("rules", [])]
        for r in rules:
            if any("=" not in v for v in r.query_values):
                raise ValueError(f"{r.name}: query_values must be key=value")
        return cls(rules, raw.get("default", "index"))

    def decide(self, url: Column) -> Column:
        """struct(action, rule) of the first rule that fits."""
        out = F.struct(F.lit(self.default).alias("action"), F.lit(None).cast("string").alias("rule"))
        for r in reversed(self.rules):
            out = F.when(r.fits(url), F.struct(F.lit(r.action).alias("action"), F.lit(r.name).alias("rule"))).otherwise(out)
        return out


def discovery_sources(origin: Column, sources: list[str]) -> Column:
    """Absolute addresses of {origin}, absolute, rooted and relative source entries."""
    one = lambda s: F.lit(s) if "://" in s and "{origin}" not in s else F.concat(origin, F.lit(s.replace("{origin}", "") if "{origin}" in s else "/" + s.lstrip("/")))
    return F.array_distinct(F.array(*map(one, sources)))
