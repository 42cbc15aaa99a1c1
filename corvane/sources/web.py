"""Pages, sitemaps and robots files: parsers that need a document tree or a line machine, over Arrow batches."""

from __future__ import annotations

import gzip
import re
import xml.etree.ElementTree as ET
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


STR = T.StringType()
PAGE = struct(title=STR, snippet=STR, body=STR, links=T.ArrayType(STR), canonical=STR, noindex=T.BooleanType(), nofollow=T.BooleanType())
ENTRY = struct(loc=STR, lastmod=STR, changefreq=STR, priority=T.DoubleType(), kind=STR)

# fixed values: elements, ids and classes whose text is not content; elements that end a line; where content is looked for
SKIP_TAGS = {"script", "style", "noscript", "nav", "footer", "header", "aside", "form", "button", "svg", "canvas", "iframe"}
SKIP_IDS = {"toc", "catlinks", "footer", "sitenotice"}
SKIP_CLASSES = {"navbox", "navbar", "noprint", "nomobile", "infobox", "metadata", "catlinks", "toc", "colorededit", "plainlinks", "sistersitebox", "portalbox"}
ROOTS = ("#mw-content-text", "article", "main", "[role=main]", ".mw-parser-output", ".article-content", ".entry-content", ".post-content", ".article-body", "#content", "#main-content", ".mw-body-content", "body")
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
NOISE = ("RLSTATE=", "RLPAGEMODULES=", ".mw-parser-output", "Wikiplus-Edit-EveryWhereBtn")


class Page(HTMLParser):
    """One pass over a page. Text is gathered for every content root that is open; the root that comes first in ROOTS wins."""

    def __init__(self, agent: str = ""):
        super().__init__()
        self.agent, self.stack, self.skip, self.title, self.in_title = agent.lower(), [], 0, "", False
        self.meta, self.links, self.canonical, self.robots, self.text = {}, [], None, set(), {}

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        if tag == "meta":
            key = a.get("property") or a.get("name", "").lower()
            self.meta.setdefault(key, a.get("content", ""))
            if a.get("name", "").lower() in ("robots", self.agent) and a.get("name"):
                self.robots |= directives(a.get("content", ""))
        elif tag == "link" and a.get("rel", "").lower() == "canonical":
            self.canonical = self.canonical or a.get("href")
        elif tag == "a" and a.get("href"):
            self.links.append(a["href"])
        elif tag == "title":
            self.in_title = True
        if tag in VOID:
            return
        style = a.get("style", "").lower().replace(" ", "")
        hidden = tag in SKIP_TAGS or "hidden" in a or a.get("aria-hidden", "").lower() == "true" or "display:none" in style or "visibility:hidden" in style
        hidden = hidden or any(set(re.split(r"[\s\-_:]+", a.get(k, "").lower())) & names for k, names in (("id", SKIP_IDS), ("class", SKIP_CLASSES)))
        classes = a.get("class", "").split()
        roots = [r for r in ROOTS if r == tag or r == "#" + a.get("id", "") or r[1:] in classes and r[0] == "." or r == "[role=main]" and a.get("role") == "main"]
        roots = [r for r in roots if r not in self.text]
        for r in roots:
            self.text[r] = []
        self.stack.append((tag, hidden, roots))
        self.skip += hidden

    def handle_endtag(self, tag):
        if tag == "title":
            self.in_title = False
        if any(t == tag for t, _, _ in self.stack):
            while self.stack:
                t, hidden, _ = self.stack.pop()
                self.skip -= hidden
                if t == tag:
                    break

    def handle_data(self, data):
        if self.in_title:
            self.title += data
            return
        words = " ".join(data.split())
        if not words or self.skip or any(n in words for n in NOISE) or all(c in words for c in "{}:"):
            return
        for _, _, roots in self.stack:
            for r in roots:
                self.text[r].append(words)

    def body(self) -> str:
        for r in ROOTS:
            if r in self.text:
                return " ".join(self.text[r])
        return ""


def directives(value: str) -> set[str]:
    found = {x.strip().lower() for x in re.split("[,;]", value)}
    return (found & {"noindex", "nofollow"}) | ({"noindex", "nofollow"} if "none" in found else set())


def parse_page(url: str | None, html: str | None, agent: str = "") -> dict:
    p = Page(agent)
    p.feed(html or "")
    body, base = p.body(), url or ""
    snippet = p.meta.get("og:description") or p.meta.get("description") or ""
    links = sorted({urljoin(base, h).split("#")[0] for h in p.links if urljoin(base, h).startswith(("http://", "https://"))})
    return {
        "title": " ".join((p.meta.get("og:title") or p.title).split()), "snippet": " ".join(snippet.split()) or body[:200], "body": body, "links": links,
        "canonical": urljoin(base, p.canonical) if p.canonical else None, "noindex": "noindex" in p.robots, "nofollow": "nofollow" in p.robots,
    }


@F.pandas_udf(PAGE)
def parse_html(url: pd.Series, html: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([parse_page(u, h) for u, h in zip(url, html)], columns=PAGE.names)


def native_links(html: Column) -> Column:
    """Site-relative links without a tree: cheap, and enough for a link graph."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(html, F.lit('href="(/[^"#?]*)'), 1)))


def x_robots(values: list[str], agent: str) -> set[str]:
    """X-Robots-Tag: a segment that names an agent holds for what follows."""
    found, who = set(), None
    for value in values:
        for segment in value.split(","):
            name, colon, rest = segment.partition(":")
            if colon:
                who, segment = name.strip().lower(), rest
            if who in (None, "*", agent.lower()):
                found |= directives(segment)
    return found


def parse_sitemap(raw: bytes | str | None) -> list[tuple[str, str | None, str | None, float | None, str]]:
    """(loc, lastmod, changefreq, priority, kind) of a urlset, sitemap index, RSS or Atom file, gzipped or not. Reading stops at an
    error; what came before it counts."""
    if raw is None:
        return []
    data = raw.encode() if isinstance(raw, str) else bytes(raw)
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    parser, out = ET.XMLPullParser(["end"]), []
    try:
        parser.feed(data)
        for _, node in parser.read_events():
            tag = node.tag.rpartition("}")[2]
            child = {c.tag.rpartition("}")[2]: c for c in node}
            text = lambda k: (child[k].text or "").strip() if k in child else None
            if tag in ("url", "sitemap") and text("loc"):
                p = text("priority")
                out.append((text("loc"), text("lastmod"), text("changefreq"), float(p) if p and re.fullmatch(r"\d*\.?\d+", p) else None, "index" if tag == "sitemap" else "url"))
            elif tag == "item" and text("link"):
                out.append((text("link"), text("pubDate"), None, None, "url"))
            elif tag == "entry" and "link" in child:
                out.append((child["link"].get("href", ""), text("updated"), None, None, "url"))
    except ET.ParseError:
        pass
    return [x for x in out if x[0].startswith(("http://", "https://"))]


@F.pandas_udf(T.ArrayType(ENTRY))
def sitemap_entries(raw: pd.Series) -> pd.Series:
    return pd.Series([[dict(zip(ENTRY.names, e)) for e in parse_sitemap(r)] for r in raw])


class Robots:
    """robots.txt: groups of agents, rules by longest match (allow wins ties), whole-second delays, sitemaps."""

    def __init__(self, text: str | None):
        self.groups, self.sitemaps, agents, fresh = [], [], [], False
        for line in (text or "").splitlines():
            key, colon, value = line.split("#")[0].partition(":")
            key, value = key.strip().lower(), value.strip()
            if not colon:
                continue
            if key == "user-agent":
                agents = [*agents, value.lower()] if fresh else [value.lower()]
                if not fresh:
                    self.groups.append((agents, []))
                self.groups[-1] = (agents, self.groups[-1][1])
                fresh = True
            elif key == "sitemap":
                if value.startswith(("http://", "https://")):
                    self.sitemaps.append(value)
            elif self.groups:
                fresh = False
                self.groups[-1][1].append((key, value))
        self.sitemaps = sorted(set(self.sitemaps))

    def rules(self, agent: str) -> list[tuple[str, str]]:
        own = [r for names, r in self.groups if agent.lower() in names]
        return [x for r in own or [r for names, r in self.groups if "*" in names] for x in r]

    def delay(self, agent: str) -> int | None:
        """Of the first group for the agent that has a delay, or else of the first for all agents, the last whole number."""
        for name in (agent.lower(), "*"):
            for names, rules in self.groups:
                found = [int(v) for k, v in rules if k == "crawl-delay" and v.isascii() and v.isdigit()]
                if name in names and found:
                    return found[-1]
        return None

    def allowed(self, agent: str, path: str) -> bool:
        best = (-1, True)
        for k, v in self.rules(agent):
            if k in ("allow", "disallow") and v and re.match(re.escape(v).replace(r"\*", ".*").replace(r"\$", "$"), path):
                best = max(best, (len(v), k == "allow"))
        return best[1]


@F.pandas_udf(T.BooleanType())
def robots_allowed(robots: pd.Series, agent: pd.Series, path: pd.Series) -> pd.Series:
    return pd.Series([Robots(r).allowed(a, p) for r, a, p in zip(robots, agent, path)], dtype=bool)


@F.pandas_udf(T.IntegerType())
def robots_delay(robots: pd.Series, agent: pd.Series) -> pd.Series:
    return pd.Series([Robots(r).delay(a) for r, a in zip(robots, agent)], dtype="Int32")


# fixed values: frequent short words of some languages
STOP_WORDS = {"eng": "the of and to in is that for it was", "deu": "der die und das von zu mit ist nicht den", "fra": "le la les de des et un une est que", "spa": "el la los de que en un una por con"}


@F.pandas_udf(STR)
def detect_language(text: pd.Series) -> pd.Series:
    tables = {k: set(v.split()) for k, v in STOP_WORDS.items()}

    def one(t):
        words = re.findall(r"[^\W\d_]+", (t or "").lower())
        hits = {k: sum(w in s for w in words) for k, s in tables.items()}
        best = max(sorted(hits), key=hits.get)
        return best if hits[best] else "unknown"

    return text.map(one)
