"""Language identification by prediction by partial matching with frozen statistics.

Each language has a variable-order context tree over bytes. The probability of a byte is its share in the longest known
context; where the context has not seen it, an escape is paid and the next shorter context asked (escape method C: a
context seen n times with d different successors escapes with d / (n + d)), down to equal shares. The statistics are
frozen after training, so the code length of every (context, byte) is known beforehand: the trees of all languages are
laid over each other and compiled into one table of code lengths, and a text's exact code length in each language is a sum
of table entries. The language with the shortest code is predicted.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, doc_columns, id_crc, slices, small_batches

LETTER = re.compile(r"[^\W\d_]")
UNKNOWN = "und"
#: Positions worked on at once.
STEP = 1 << 17


@dataclass(frozen=True)
class Params:
    order: int = 4
    #: Bounds of the training sample: documents of each language, bytes of each document (longer ones are identified, not learned
    #: from), and languages, the most frequent ones.
    docs_per_lang: int = 400
    doc_bytes: int = 1 << 16
    max_langs: int = 256
    #: Bounds of the compiled table: contexts, and how often a context must occur to be one.
    max_contexts: int = 24_000
    min_count: int = 6
    #: The score weighs a text as if it had this many bytes at most; so it tells how clear the decision is, not how long the text.
    score_bytes: int = 48


def symbols(texts: list[str], pad: int) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the lower-cased texts, every run of non-letters below 0x80 as one space, each text after `pad` spaces;
    and the text's number for each byte."""
    raw = [b" " * pad + t.lower().encode("utf-8", "replace") for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    owner = np.repeat(np.arange(len(raw)), [len(r) for r in raw])
    first = np.zeros(len(data), bool)
    starts = np.cumsum([0, *map(len, raw)])[:-1]
    for k in range(pad):
        first[starts + k] = True
    data = np.where((data >= 0x80) | ((data >= 97) & (data <= 122)), data, 32).astype(np.uint8)
    keep = np.ones(len(data), bool)
    keep[1:] = (data[1:] != 32) | (data[:-1] != 32)
    keep |= first
    return data[keep], owner[keep]


class Model:
    """The compiled trees. child[node, symbol] leads to the context one byte longer, or to the node's twin (node + n), which
    leads to itself; cost[node, symbol, language] is a code length in bits."""

    def __init__(self, langs: list[str], rank: np.ndarray, child: np.ndarray, cost: np.ndarray, params: Params):
        self.langs, self.rank, self.child, self.cost, self.params = langs, rank, child, cost, params

    @classmethod
    def fit(cls, samples: dict[str, list[str]], params: Params = Params()) -> Model:
        langs, order = sorted(samples), params.order
        if not langs:  # nothing to learn from: every text will be `und`
            return cls([], np.zeros(256, np.int32), np.zeros((2, 1), np.int32), np.zeros((1, 1, 0), np.float32), params)
        seqs = [symbols(samples[lang], order)[0] for lang in langs]
        seen = np.unique(np.concatenate([*seqs, np.array([32], np.uint8)]))
        rank = np.full(256, len(seen), np.int32)  # bytes never seen share one symbol
        rank[seen] = np.arange(len(seen))
        a = len(seen) + 1
        seqs = [rank[s].astype(np.int64) for s in seqs]
        keys, parents = [np.zeros(1, np.int64)], [np.zeros(1, np.int64)]
        where: list[dict[int, int]] = [{0: 0}]
        total = 1
        for k in range(1, order + 1):  # contexts of k bytes, coded with the nearest byte as the highest digit
            codes = np.concatenate([cls._context(s, k, a)[k - 1 :] for s in seqs])
            code, n = np.unique(codes, return_counts=True)
            n = np.where(n >= params.min_count, n, 0)
            known = np.isin(code // a, keys[-1])
            code, n = code[known & (n > 0)], n[known & (n > 0)]
            room = max(0, params.max_contexts - total)
            if len(code) > room:
                code = np.sort(code[np.argsort(-n, kind="stable")[:room]])
            above = where[-1]
            parents.append(np.array([above[c // a] for c in code.tolist()], np.int64))
            where.append({c: total + i for i, c in enumerate(code.tolist())})
            keys.append(code)
            total += len(code)
        child = np.tile(np.arange(total, 2 * total, dtype=np.int32)[:, None], (1, a))
        for code, parent, place in zip(keys[1:], parents[1:], where[1:]):
            child[parent, code % a] = [place[c] for c in code.tolist()]
        child = np.concatenate([child, np.tile(np.arange(total, 2 * total, dtype=np.int32)[:, None], (1, a))])
        cost = np.empty((total, a, len(langs)), np.float32)
        for j, s in enumerate(seqs):
            above = np.full((1, a), np.log2(a))
            levels = []
            for k in range(order + 1):
                code, place = keys[k], where[k]
                count = np.zeros((len(code), a))
                if len(code):
                    ctx = cls._context(s, k, a)[max(0, k - 1) : -1] if k else np.zeros(len(s), np.int64)
                    nxt = s[k:] if k else s
                    at = np.searchsorted(code, ctx)
                    ok = (at < len(code)) & (code[np.minimum(at, len(code) - 1)] == ctx)
                    np.add.at(count, (at[ok], nxt[ok]), 1)
                base = above if k == 0 else above[[i - first for i in parents[k].tolist()]]
                n, d = count.sum(1, keepdims=True), (count > 0).sum(1, keepdims=True)
                with np.errstate(divide="ignore", invalid="ignore"):
                    bits = np.where(count > 0, np.log2((n + d) / count), np.log2((n + d) / d) + base)
                above = np.where(n > 0, bits, base)  # a context that this language lacks costs nothing
                first = min(place.values()) if place else 0
                levels.append(above)
            cost[:, :, j] = np.concatenate(levels)
        return cls(langs, rank, child, cost, params)

    @staticmethod
    def _context(s: np.ndarray, k: int, a: int) -> np.ndarray:
        """At i the code of the k symbols that end at i, nearest last in the walk but lowest digit the farthest."""
        code = np.zeros(len(s), np.int64)
        for back in range(k):
            shifted = np.zeros(len(s), np.int64)
            shifted[back:] = s[: len(s) - back] if back else s
            code = code * a + shifted
        return code

    def bits(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(texts x languages) code lengths, and how many bytes were coded."""
        order, n = self.params.order, self.cost.shape[0]
        data, owner = symbols(texts, order)
        s = self.rank[data]
        total, coded = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts))
        for lo in range(0, len(s), STEP):
            hi = min(len(s), lo + STEP)
            at = np.arange(max(lo, order), hi)
            at = at[owner[at] == owner[at - order]]  # not the spaces in front
            if not len(at):
                continue
            node = np.zeros(len(at), np.int32)
            for back in range(1, order + 1):
                node = self.child[node, s[at - back]]
            cost = self.cost[node % n, s[at]]
            own = owner[at]
            lo_own, width = own[0], own[-1] - own[0] + 1
            for j in range(len(self.langs)):
                total[lo_own : lo_own + width, j] += np.bincount(own - lo_own, cost[:, j], width)
            coded[lo_own : lo_own + width] += np.bincount(own - lo_own, minlength=width)
        return total, coded

    def predict(self, texts: list[str]) -> list[tuple[str, float, float]]:
        """(language, score, bits a byte) of each text. The score is the language's share of probability under all trees."""
        if not self.langs:
            return [(UNKNOWN, 0.0, 0.0)] * len(texts)
        total, coded = self.bits(texts)
        rate = total / np.maximum(coded, 1)[:, None]
        logp = -rate * np.minimum(coded, self.params.score_bytes)[:, None] * np.log(2)
        p = np.exp(logp - logp.max(1, keepdims=True))
        best, share = rate.argmin(1), (p / p.sum(1, keepdims=True)).max(1)
        return [(self.langs[b], float(x), float(r)) if LETTER.search(t) else (UNKNOWN, 0.0, 0.0) for t, b, x, r in zip(texts, best.tolist(), share.tolist(), rate.min(1).tolist())]


def sample(docs: DataFrame, params: Params, learn: Column) -> dict[str, list[str]]:
    """Texts by language: about docs_per_lang documents of each, chosen by a hash of doc_id and text, of doc_bytes at most."""
    known = doc_columns(docs, "doc_id", "text", "lang").where(learn & F.col("lang").isNotNull() & (F.octet_length("text").between(1, params.doc_bytes)))
    n = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(params.max_langs).collect()}
    out: dict[str, list[str]] = {lang: [] for lang in n}
    if n:
        share = F.create_map(*[F.lit(x) for lang, k in sorted(n.items()) for x in (lang, int(1e6 * min(1.0, params.docs_per_lang / k)))])
        for r in bounded_sample(known, share[F.col("lang")], 2 * params.docs_per_lang * len(n), 1):
            out[r["lang"]].append(r["text"])
    return {lang: sorted(t) for lang, t in out.items() if t}


def fit(docs: DataFrame, params: Params = Params(), learn: Column | None = None) -> Model:
    """Learn from the rows where `learn` holds (default: all) and lang is not null; nothing else of a row is used."""
    return Model.fit(sample(docs, params, F.lit(True) if learn is None else learn), params)


SCHEMA = "doc_id bigint, lang_pred string, score double, bits_per_byte double"


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """A row for each document: doc_id, lang_pred, score, bits_per_byte. Null text or no letter: `und`, score 0.
    Null and repeated doc_ids keep their rows; ties go to the language that sorts first; other columns are ignored."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            found = [x for _, _, texts in slices(b) for x in held.value.predict(texts)]
            lang, score, rate = map(list, zip(*found)) if found else ([], [], [])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rate, pa.float64())], names=["doc_id", "lang_pred", "score", "bits_per_byte"])

    return doc_columns(docs, "doc_id", "text").mapInArrow(run, SCHEMA)


def keep_identified(docs: DataFrame, model: Model, max_bits: float = 6.0) -> DataFrame:
    """The documents, all columns, whose language is known: not `und`, and coded in at most max_bits a byte, which is what the
    bytes of a text in none of the languages cost about (equal shares of some 80 symbols). Null and empty texts and texts without
    a letter go. Null ids, ties and repeated rows are judged each by its text alone. Empty table: no rows."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            keep = [lang != UNKNOWN and rate <= max_bits for _, _, texts in slices(b) for lang, _, rate in held.value.predict(texts)]
            yield b.filter(pa.array(keep, pa.bool_()))

    small_batches(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)


def held_out() -> Column:
    """Rows of which nothing is learned."""
    return F.pmod(id_crc(F.col("doc_id")), F.lit(4)) == 2
