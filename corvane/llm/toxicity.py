"""Toxicity by compression distance: windows of a text are compressed with a zstandard dictionary of toxic text and with one of
ordinary text, and thresholds on how much shorter the toxic dictionary makes them are calibrated on labelled documents.

Both dictionaries begin with the same two parts: one that zstandard trains on windows of ordinary documents, one that it trains
on hard ordinary windows, those that a first pair of dictionaries took for toxic though they hold nothing that toxic documents
have in excess. The toxic dictionary ends in what zstandard trains on the telling words of toxic documents: one-word windows with a
byte span whose document frequency exceeds the ordinary one significantly (after a correction for the number of spans
tested, and not just because it lies across a stronger span). The ordinary one ends in as many bytes of its hard part.
Equal lengths, equal parameters and equal offsets of what is common leave a difference of the compressed lengths where a window
holds such words.

Every byte stands twice in what is compressed, the second time in an alphabet that tells its place in the word (the first PLACES
bytes each have one, all later ones another). A match costs some 3 bytes, whatever its length, so it pays for a stretch of 5
bytes only when these would cost 10; and the beginning of a word is no match for the same bytes inside one.

Weights are fitted on documents that their dictionaries have not seen.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from dataclasses import dataclass
from itertools import accumulate
from statistics import NormalDist

import numpy as np
import pyarrow as pa
import zstandard as zs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, doc_columns, id_crc, slices


@dataclass(frozen=True)
class Params:
    #: Bounds of the training sample: documents of either label, and bytes of each document. Longer documents are scored, not learned from.
    toxic_docs: int = 1000
    ordinary_docs: int = 2000
    doc_bytes: int = 1 << 16
    window_words: int = 3
    #: Windows that the ordinary parts are trained on at most, evenly spread over the sample.
    train_windows: int = 40_000
    #: Bytes of the part trained on ordinary windows, of the toxic part, and of a span that is tested.
    body_bytes: int = 1500
    dict_bytes: int = 1500
    span_bytes: int = 6
    #: Bytes of the doubled text that zstandard takes into the toxic dictionary at a time.
    segment: int = 32
    #: Shortest match, in bytes of the doubled text.
    min_match: int = 6
    #: Chance that any span at all passes although the labels have nothing to do with it.
    false_spans: float = 0.05
    #: Rounds in which hard windows are sought, and bytes saved that make one.
    hard_rounds: int = 2
    hard_saved: int = 4
    #: Thresholds, in bytes saved in a window, whose counts the document's score weighs.
    thresholds: tuple[int, ...] = (1, 2, 3, 4, 6, 8, 10, 13)


#: Places in a word that are told apart, and what the second copy of a byte is combined with there.
PLACES = 5
MARKS = np.array([0x11, 0x36, 0x53, 0x74, 0x92, 0xA5], np.uint8)


def doubled(text: bytes) -> bytes:
    """Two bytes for each one of a lower-cased text. A word is a run of a to z and bytes from 0x80."""
    x = np.frombuffer(text, np.uint8)
    at = np.arange(len(x))
    letter = (x >= 0x80) | (x >= 97) & (x <= 122)
    place = at - np.maximum.accumulate(np.where(letter, -1, at)) - 1 if len(x) else at
    out = np.empty(2 * len(x), np.uint8)
    out[::2], out[1::2] = x, x ^ MARKS[np.where(letter, np.minimum(place, PLACES), PLACES)]
    return out.tobytes()


def joined(text: str) -> bytes:
    """The words of a text, lower-cased, with a space before, between and behind."""
    return b" ".join([b"", *text.lower().encode("utf-8", "replace").split(), b""])


def windows(text: str, words: int) -> list[bytes]:
    """The doubled windows of `words` words of a lower-cased text, each with the spaces around it."""
    w = text.lower().encode("utf-8", "replace").split()
    if not w:
        return []
    ends = list(accumulate([len(x) + 1 for x in w]))  # of each word in the joined text, the space before it counted
    whole = doubled(joined(text))
    cuts = [0, *ends[words - 1 : -1 : words], ends[-1]]
    return [whole[2 * i : 2 * j + 2] for i, j in zip(cuts, cuts[1:])]


#: Buckets in which spans are counted, a power of two.
BUCKET_BITS = 24


def spans(text: bytes, size: int) -> np.ndarray:
    """The bucket of the span of `size` pairs at each pair of a doubled text."""
    x = np.frombuffer(text, np.uint16).astype(np.uint64)
    n = max(0, len(x) - size + 1)
    v = np.zeros(n, np.uint64)
    for i in range(size):
        v = (v ^ x[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        v ^= v >> np.uint64(29)
    return ((v * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def without_copies(texts: list[str]) -> list[str]:
    """One text of each group of near copies: those that share one of the 4 least hashes of five words in a row."""
    seen, out = set(), []
    for t in texts:
        w = t.lower().split()
        grams = {" ".join(w[i : i + 5]).encode("utf-8", "replace") for i in range(max(1, len(w) - 4))}
        least = {(i, min(zlib.crc32(g, i) for g in grams)) for i in range(4)}
        if not least & seen:
            out.append(t)
        seen |= least
    return out


class Excess:
    """What toxic documents have in significant excess (log-likelihood ratio of document frequencies, near copies counted once)."""

    def __init__(self, toxic: list[str], ordinary: list[str], params: Params):
        self.size = params.span_bytes
        texts = [[doubled(joined(t)) for t in without_copies(x)] for x in (toxic, ordinary)]
        p, n = (max(1, len(x)) for x in texts)

        def ratios(count: np.ndarray) -> np.ndarray:
            held = np.flatnonzero(count.any(axis=0))
            a, b = count[:, held].astype(float)
            e, f = (a + b) * p / (p + n), (a + b) * n / (p + n)
            ratio = 2 * (a * np.log(np.maximum(a, 1) / e) + b * np.log(np.maximum(b, 1) / f))
            bar = NormalDist().inv_cdf(1 - params.false_spans / 2 / max(1, len(held))) ** 2
            out = np.zeros(1 << BUCKET_BITS, np.float32)
            out[held] = np.where((ratio >= bar) & (a > e), ratio, 0)
            return out

        count = np.zeros((2, 1 << BUCKET_BITS), np.uint16)
        for side, every in zip(count, texts):
            for t in every:
                side[np.unique(spans(t, self.size))] += 1
        self.ratio = ratios(count)
        alone = np.zeros_like(count)  # where no stronger span overlaps
        for side, every in zip(alone, texts):
            for t in every:
                s = spans(t, self.size)
                at = self.ratio[s]
                side[np.unique(s[(at > 0) & (at >= self.around(at))])] += 1
        self.kept = ratios(alone) > 0

    def around(self, at: np.ndarray) -> np.ndarray:
        """At each place the largest value of the spans that overlap the one there."""
        wide = np.pad(at, self.size - 1)
        return np.max([wide[i : i + len(at)] for i in range(2 * self.size - 1)], axis=0) if len(at) else at

    def holds(self, window: bytes) -> bool:
        """Whether a doubled window has a kept span."""
        return bool(self.kept[spans(window, self.size)].any())


def trained(size: int, samples: list[bytes], most: int, **how: int) -> bytes:
    """The content of a dictionary that zstandard trains on samples, `most` at most; of too few to train on, the samples themselves."""
    some = samples[:: max(1, len(samples) // most)]
    try:
        return zs.train_dictionary(size, some, **how).as_bytes()
    except zs.ZstdError:
        return b" ".join(dict.fromkeys(some))[:size]


def dictionaries(toxic: list[str], ordinary: list[str], params: Params) -> tuple[bytes, bytes]:
    """The toxic and the ordinary dictionary, of equal length."""
    every = [w for t in ordinary for w in windows(t, params.window_words)]
    body = trained(2 * params.body_bytes, every, params.train_windows)
    found = Excess(toxic, ordinary, params)
    words = [w for t in without_copies(toxic) for w in windows(t, 1)]
    telling = {w for w in set(words) if found.holds(w)}
    part = trained(2 * params.dict_bytes, [w for w in words if w in telling], params.train_windows, k=params.segment, d=6)[-2 * params.dict_bytes :] if telling else b""
    filler = (body * (len(part) // max(1, len(body)) + 1))[: len(part)].ljust(len(part), b" ")
    some, hard = every[:: max(1, len(every) // params.train_windows)], []
    for _ in range(params.hard_rounds if part else 0):
        try_out = Model(body + filler + part, body + filler + filler, np.zeros(0), params)
        hard += [w for w in some if try_out.saved(w) >= params.hard_saved and not found.holds(w)]
        filler = (trained(len(part), hard, params.train_windows, k=64, d=6)[-len(part) :] + filler)[: len(part)]
    return body + filler + part, body + filler + filler


class Model:
    def __init__(self, toxic: bytes, ordinary: bytes, weights: np.ndarray, params: Params):
        self.dicts, self.weights, self.params, self._pair = (toxic, ordinary), weights, params, None

    def __getstate__(self):
        return self.__dict__ | {"_pair": None}

    @property
    def pair(self):
        """Compressors with the toxic and with the ordinary dictionary."""
        if self._pair is None:
            how = zs.ZstdCompressionParameters(window_log=15, hash_log=14, chain_log=14, search_log=5, min_match=self.params.min_match, strategy=zs.STRATEGY_GREEDY, write_content_size=False, write_checksum=False, write_dict_id=False)
            held = [zs.ZstdCompressionDict(d, dict_type=zs.DICT_TYPE_RAWCONTENT) for d in self.dicts]
            for d in held:
                d.precompute_compress(compression_params=how)
            self._pair = [zs.ZstdCompressor(dict_data=d, compression_params=how).compress for d in held]
        return self._pair

    def saved(self, window: bytes) -> int:
        """Bytes by which the toxic dictionary makes a window shorter than the ordinary one."""
        toxic, ordinary = self.pair
        return len(ordinary(window)) - len(toxic(window))

    def features(self, text: str) -> list[float]:
        toxic, ordinary = self.pair
        saved = Counter([len(ordinary(w)) - len(toxic(w)) for w in windows(text, self.params.window_words)])
        total, top = max(1, sum(saved.values())), max(saved, default=0)
        above = [sum(n for x, n in saved.items() if x >= t) for t in self.params.thresholds]
        gain = sum(n * x for x, n in saved.items() if x > 0)
        return [1.0, *map(math.log1p, above), *[math.sqrt(n / total) for n in above], max(0, min(20, top)) / 10, math.log(total), math.sqrt(gain / total)]

    def score(self, texts: list[str]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        z = np.array([self.features(t) for t in texts]) @ self.weights
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    @classmethod
    def fit(cls, toxic: list[str], ordinary: list[str], params: Params = Params()) -> Model:
        """Both labels weigh the same, however many documents of either there are."""
        model = cls(*dictionaries(toxic, ordinary, params), np.zeros(2 * len(params.thresholds) + 4), params)
        if toxic and ordinary:
            half = [cls(*dictionaries(toxic[i::2], ordinary[i::2], params), model.weights, params) for i in (1, 0)]  # each for the other's documents
            x = np.array([half[i % 2].features(t) for texts in (toxic, ordinary) for i, t in enumerate(texts)])
            y = np.array([1.0] * len(toxic) + [0.0] * len(ordinary))
            model.weights = logistic(x, y, np.where(y > 0, len(ordinary) / len(toxic), 1.0))
        else:
            model.weights[0] = -30.0 if not toxic else 30.0
        return model


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-4, rounds: int = 60) -> np.ndarray:
    """Weighted ridge logistic regression by Newton's method."""
    w, weight = np.zeros(x.shape[1]), weight / weight.mean()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (weight * (p - y)) + ridge * len(y) * w * np.array([0, *[1] * (len(w) - 1)])
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + np.eye(len(w)) * ridge * len(y)
        step = np.linalg.solve(h, g)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w


def held_out() -> Column:
    """Rows whose labels are not learned from."""
    return F.pmod(id_crc(F.col("doc_id")), F.lit(3)) == 1


def fit(docs: DataFrame, labels: DataFrame, params: Params = Params(), learn: Column | None = None) -> Model:
    """Learn from the labelled documents where `learn` holds (default: those not held out), a bounded sample chosen by a hash of
    doc_id and text. A document that is labelled more than once is toxic if any label says so; null ids and null labels teach nothing."""
    known = labels.where(~held_out() if learn is None else learn).where("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = {r[0]: r[1] for r in known.groupBy("toxic").count().collect()}
    want = {1: params.toxic_docs, 0: params.ordinary_docs}
    texts = doc_columns(docs, "doc_id", "text").where(F.octet_length("text").between(1, params.doc_bytes))
    sides = []
    for label in (1, 0):
        ids = known.where(F.col("toxic") == label).where(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1_000_000)) < int(1e6 * min(1, 1.1 * want[label] / n.get(label, 1))))
        sides.append(sorted(r["text"] for r in bounded_sample(texts.join(ids, "doc_id", "left_semi"), 1.0, want[label], 6)))
    return Model.fit(*sides, params)


def score(docs: DataFrame, model: Model, least: float = 0.7) -> DataFrame:
    """doc_id, score and predicted (1 if score >= least) of every document. Only the text is looked at. Null or empty text: the
    score of a text without windows. Null and repeated doc_ids keep their rows. Other columns are ignored."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            parts = [held.value.score(texts) for _, _, texts in slices(b)]
            s = np.concatenate(parts) if parts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s), pa.array((s >= least).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return doc_columns(docs, "doc_id", "text").mapInArrow(run, "doc_id bigint, score double, predicted int")
