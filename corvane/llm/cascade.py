"""Quality rules as a short-circuit cascade: cost and selectivity of each rule are estimated on a sample, the rules are put in
order of rejection per cost, and a document meets the next rule only if it passed the ones before."""

from __future__ import annotations

import re
import time
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, doc_columns, slices, small_batches

SPACE, SYMBOLS = " \t\n\v\f\r", "#*$%&|<>"
NOT_SPACE = re.compile(r"[^\x20\x09-\x0D]")


class Features:
    """Features of one text, each computed when first asked for."""

    def __init__(self, text: str):
        self.text = text

    def __getattr__(self, name: str):
        value = getattr(type(self), "_" + name)(self)
        setattr(self, name, value)
        return value

    def _words(self) -> list[bytes]:
        return self.text.encode("utf-8", "replace").split()  # bytes are split at the six ASCII spaces and nowhere else

    def _n_words(self) -> int:
        return len(self.words)

    def _word_chars(self) -> int:
        return len(self.text) - sum(map(self.text.count, SPACE))

    def _n_symbols(self) -> int:
        return sum(map(self.text.count, SYMBOLS))

    def _lines(self) -> list[str]:
        return [x for x in self.text.split("\n") if NOT_SPACE.search(x)]

    def _n_lines(self) -> int:
        return len(self.lines)

    def _n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    def _n_repeat_words(self) -> int:
        w = self.words
        grams = list(zip(w, w[1:], w[2:], w[3:], w[4:]))
        if len(set(grams)) == len(grams):
            return 0
        n, total, end = Counter(grams), 0, 0
        for i, g in enumerate(grams):
            if n[g] > 1:
                total += i + 5 - max(i, end)
                end = i + 5
        return total


@dataclass(frozen=True)
class Rule:
    """Rejects a document where `bad` holds for its features."""

    name: str
    bad: Callable[[Features], bool]


#: The base, then what else makes a text poor. Integers only, so that SQL gives the same verdicts.
RULES = (
    Rule("few_words", lambda f: f.n_words < 10),
    Rule("repeated_windows", lambda f: 100 * f.n_repeat_words > 20 * f.n_words),
    Rule("symbols", lambda f: 100 * f.n_symbols > 60 * f.n_words),
    Rule("repeated_lines", lambda f: 100 * f.n_dup_lines > 50 * f.n_lines),
    Rule("short_words", lambda f: f.word_chars < 2 * f.n_words),
    Rule("long_words", lambda f: f.word_chars > 25 * f.n_words),
)


def plan(texts: list[str], rules: tuple[Rule, ...] = RULES) -> list[tuple[Rule, float, float]]:
    """The rules in order, each with its seconds a document and its share of rejections among what reaches it.

    Greedy: the next rule is the one that rejects most of the sample's survivors for its cost on them, where features that an
    earlier rule has computed cost nothing any more.
    """
    alive, left, order = [Features(t) for t in texts], list(rules), []
    while left:
        best = None
        for rule in left:
            fresh = [Features(f.text) for f in alive]
            for new, old in zip(fresh, alive):
                new.__dict__.update(old.__dict__)
            began = time.perf_counter()
            bad = [rule.bad(f) for f in fresh]
            cost = (time.perf_counter() - began) / max(1, len(fresh)) + 1e-9
            share = sum(bad) / max(1, len(bad))
            if best is None or share / cost > best[0]:
                best = share / cost, rule, cost, share, [f for f, b in zip(fresh, bad) if not b]
        _, rule, cost, share, alive = best
        left.remove(rule)
        order.append((rule, cost, share))
    return order


def first_failure(f: Features, rules: list[Rule]) -> str | None:
    for r in rules:
        if r.bad(f):
            return r.name
    return None


def ordered_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_docs: int = 400, sample_bytes: int = 1 << 16) -> list[str]:
    """Names of the rules in the order in which the cascade asks them, from about `sample_docs` documents chosen by a
    hash, of `sample_bytes` at most. The order decides the work, never the verdict."""
    texts = doc_columns(docs, "doc_id", "text")
    short = texts.where(F.coalesce(F.octet_length("text"), F.lit(0)) <= sample_bytes)
    some = bounded_sample(short, sample_docs / max(1, texts.count()), 2 * sample_docs, 3)
    return [r.name for r, _, _ in plan([row["text"] or "" for row in some], rules)]


SCHEMA = "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean"


def judge(docs: DataFrame, features: bool = True) -> DataFrame:
    """A row for each document. kept is the cascade's verdict. With `features` the features are given for every document;
    else only those that the cascade came to, the others null (which these are hangs on the order, so on measured times).

    Null text: no words, so it fails the base. Null and repeated doc_ids keep their rows. Empty table: no rows. Other
    columns are ignored.
    """
    names = ordered_rules(docs)
    cols = [c.split()[0] for c in SCHEMA.split(", ")]

    def run(batches):
        rules = sorted(RULES, key=lambda r: names.index(r.name))
        for b in batches:
            rows = []
            for _, _, texts in slices(b):
                for t in texts:
                    f = Features(t)
                    failed = first_failure(f, rules)
                    if features:
                        base = f.n_words < 10 or 100 * f.n_repeat_words > 20 * f.n_words
                        rows.append((f.n_words, f.word_chars, f.n_symbols, f.n_dup_lines, f.n_repeat_words, base, failed is None))
                    else:
                        got = f.__dict__.get
                        rows.append((got("n_words"), got("word_chars"), got("n_symbols"), got("n_dup_lines"), got("n_repeat_words"), None, failed is None))
            out = list(zip(*rows)) if rows else [[]] * 7
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(x, pa.int64()) for x in out[:5]], *[pa.array(x, pa.bool_()) for x in out[5:]]], names=cols)

    return doc_columns(docs, "doc_id", "text").mapInArrow(run, SCHEMA)


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents, all columns, that pass the cascade. Null and empty texts have too few words and go. Null ids, ties and
    repeated rows are judged each by its text alone. Empty table: no rows."""
    names = ordered_rules(docs)

    def run(batches):
        rules = sorted(RULES, key=lambda r: names.index(r.name))
        for b in batches:
            keep = [first_failure(Features(t), rules) is None for _, _, texts in slices(b) for t in texts]
            yield b.filter(pa.array(keep, pa.bool_()))

    small_batches(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)
