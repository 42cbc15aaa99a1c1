"""Text functions as Column expressions. Thresholds in bytes are bytes, truncations are in characters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"[\p{L}\p{N}]+"

# fixed values: the spaces of Unicode (category Zs)
SPACES = " \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"

# fixed values: spellings and their corrections
CORRECTIONS = {
    "serach": "search", "seach": "search", "serch": "search", "documnet": "document", "docuemnt": "document", "teh": "the", "taht": "that", "wiht": "with",
    "thier": "their", "recieve": "receive", "occured": "occurred", "seperate": "separate", "definately": "definitely", "goverment": "government", "enviroment": "environment",
}

# fixed values: marks of scripts that leak into text
NOISE = ("RLSTATE=", "RLPAGEMODULES=", ".mw-parser-output", "Wikiplus-Edit-EveryWhereBtn")

# fixed values: marks of a page with content of its own, and of an empty shell that scripts fill
CONTENT_MARKS = (
    "<article", "<main", 'role="main"', 'itemprop="articleBody"', 'class="article-content"', 'class="entry-content"', 'class="post-content"',
    'class="article-body"', 'id="content"', 'id="main-content"',
)
SHELL_MARKS = ("data-reactroot", "ng-app", 'id="app"', 'id="root"', "data-svelte", "data-sveltekit")


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(f"({TOKEN})"), 1)


def stripped(text: Column) -> Column:
    """Without spaces at the ends, of whatever width; line breaks and tabs stay."""
    return F.trim(text, F.lit(SPACES))


def squeeze(text: Column) -> Column:
    """White space runs become one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    """Words lie between spaces, tabs, line breaks and form feeds; a vertical tab is part of a word, as in SQL."""
    return F.regexp_count(text, F.lit(r"[^ \t\n\f\r]+")).cast("long")


def derive_terms(title: Column, body: Column) -> Column:
    """The first 12 distinct lower-case tokens of four bytes or more, then sorted."""
    found = F.filter(F.concat(tokens(title), tokens(body)), lambda t: F.octet_length(t) >= 4)
    return F.array_sort(F.slice(F.array_distinct(found), 1, 12))


def correct_spelling(query: Column) -> Column:
    """Each known misspelling replaced, words joined by single spaces; null if nothing changes."""
    table = F.create_map(*[F.lit(x) for kv in CORRECTIONS.items() for x in kv])
    out = F.array_join(F.transform(words(query), lambda w: F.coalesce(table[F.lower(w)], w)), " ")
    changed = F.exists(words(query), lambda w: F.lower(w).isin(*CORRECTIONS))
    return F.when(changed, out)


def is_noise(text: Column) -> Column:
    out = text.contains("{") & text.contains("}") & text.contains(":")
    for mark in NOISE:
        out = out | text.contains(mark)
    return out


def needs_script(html: Column, body: Column) -> Column:
    """Whether a page's text only comes with scripts run."""

    def has(marks):
        return F.exists(F.array(*map(F.lit, marks)), lambda m: html.contains(m))

    size, root = F.octet_length(body), has(CONTENT_MARKS)
    return F.when((size >= 600) | (root & (size >= 120)), False).when(has(SHELL_MARKS), True).otherwise((size < 40) & html.contains("<script") & ~root)


def spam_flags(body: Column) -> dict[str, Column]:
    w, sentences = words(body), F.split(body, r"\.")
    return {
        "stuffing": (F.size(w) >= 10) & (F.size(F.array_distinct(w)) / F.greatest(F.size(w), F.lit(1)) < 0.3),
        "links": (F.size(w) >= 50) & (F.regexp_count(body, F.lit("http")) / F.greatest(F.size(w), F.lit(1)) > 0.1),
        "short": F.octet_length(body) < 100,
        "repetitive": (F.size(sentences) >= 5) & (F.size(F.array_distinct(sentences)) / F.greatest(F.size(sentences), F.lit(1)) < 0.5),
    }


def is_spam(body: Column) -> Column:
    """Weights of 3, 2, 2 and 3 tenths, more than 5 in all; counted in whole tenths."""
    f = {k: v.cast("int") for k, v in spam_flags(body).items()}
    return 3 * f["stuffing"] + 2 * f["links"] + 2 * f["short"] + 3 * f["repetitive"] > 5


def suggest_inputs(title: Column, host: Column, terms: Column) -> Column:
    every = F.concat(F.array(F.lower(title), F.lower(host)), terms)
    return F.slice(F.array_sort(F.array_distinct(F.filter(every, lambda t: F.trim(t) != ""))), 1, 12)


def highlight(text: Column, query: str) -> Column:
    """Query terms marked, longer ones first, whatever their case."""
    import re

    terms = sorted(dict.fromkeys(query.split()), key=lambda t: (-len(t), t))
    return F.regexp_replace(text, "(?i)(" + "|".join(map(re.escape, terms)) + ")", "<mark>$1</mark>") if terms else text
