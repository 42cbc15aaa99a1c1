"""Periodic runs in the words of a text, found by counting matches at every lag.

A run of period q is a stretch in which words q apart are identical, so at lag q it is an island of consecutive matches. An island
that makes a run of at least `least` words and two periods is max(least - q, q) matches long, so a lag with fewer matches in
all holds none. The matches of all lags are counted at once: a frequent (heavy) word by the autocorrelation of its places, the
heavy words' spectra added up before one inverse transform; a rare (light) one by the differences of its pairs of places.
Matches that lie in runs already found, of a period that divides the lag, don't count again. Only the lags that are left get a
scan: a few evenly spaced places first, as a long island can't avoid them, then every place where these hold out.

Both counts are exact (rounded sums of 0 and 1), and so are the runs: nothing is sampled or capped.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_slices, doc_columns

#: Shortest run, in words.
LEAST = 12


def lag_counts(ids: np.ndarray, heavy: int | None = None) -> np.ndarray:
    """How many places i have ids[i] == ids[i + q], for each lag q up to half the words. A word is heavy beyond `heavy` places, by
    default the square root of the words' number."""
    n = len(ids)
    top = n // 2
    heavy = max(4, int(n**0.5)) if heavy is None else heavy
    sizes = np.bincount(ids)
    total = np.zeros(top + 1, np.int64)
    big = np.flatnonzero(sizes > heavy)
    if len(big):
        width = 1 << (n + top).bit_length()
        power = np.zeros(width // 2 + 1)
        for word in big.tolist():
            f = np.fft.rfft(ids == word, width)
            power += f.real**2 + f.imag**2
        total += np.rint(np.fft.irfft(power, width)[: top + 1]).astype(np.int64)
    places = np.argsort(ids, kind="stable")
    places = places[sizes[ids[places]] <= heavy]
    words, k = ids[places], 1
    same = np.ones(max(0, len(places) - 1), bool)
    while len(same):  # pairs k apart among a word's places; no light word has more than `heavy` of them
        same = words[k:] == words[:-k]
        if not same.any():
            break
        lags = (places[k:] - places[:-k])[same]
        total += np.bincount(lags[lags <= top], minlength=top + 1)
        k += 1
    return total


def islands(same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the stretches of True begin and end."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], same.view(np.int8), [0]))))
    return edges[::2], edges[1::2]


def runs(ids: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, smallest period) of every maximal run of at least `least` words and two periods, by start and period."""
    n = len(ids)
    if n < least:
        return []
    count = lag_counts(ids)
    q = np.arange(len(count))
    need = np.maximum(least - q, q)
    told = np.zeros(len(count), np.int64)  # matches inside runs whose period divides the lag
    found: dict[tuple[int, int], int] = {}
    for lag in (np.flatnonzero(count[1:] >= need[1:]) + 1).tolist():
        size = int(need[lag])
        if count[lag] - told[lag] < size:
            continue
        for start, end in candidates(ids, lag, size):
            length = end + lag - start
            if (start, length) not in found:  # else a divisor of the lag is a period of this stretch
                found[start, length] = lag
                more = np.arange(2 * lag, min(length // 2, len(count) - 1) + 1, lag)
                told[more] += length - more
    return sorted((s, n, p) for (s, n), p in found.items())


def candidates(ids: np.ndarray, lag: int, size: int) -> list[tuple[int, int]]:
    """The islands of at least `size` matches at a lag: [start, end) of their places."""
    step = max(1, size // 16)
    if step > 1:  # an island holds size // step places of the coarse grid, one after the other
        grid = ids[: len(ids) - lag : step] == ids[lag::step]
        a, b = islands(grid)
        long = b - a >= size // step
        spans = [(max(0, (x - 1) * step), min(len(ids) - lag, y * step + 1)) for x, y in zip(a[long].tolist(), b[long].tolist())]
    else:
        spans = [(0, len(ids) - lag)]
    out = []
    for x, y in spans:  # grid islands lie a miss apart, so no island is in two spans
        a, b = islands(ids[x:y] == ids[x + lag : y + lag])
        long = b - a >= size
        out += [(x + i, x + j) for i, j in zip(a[long].tolist(), b[long].tolist())]
    return out


def kept(n: int, found: list[tuple[int, int, int]]) -> np.ndarray:
    """Which words stay: all but those of a run behind its first period."""
    change = np.zeros(n + 1, np.int64)
    for start, length, period in found:
        change[start + period] += 1
        change[start + length] -= 1
    return np.cumsum(change[:n]) == 0


def word_ids(words: list[bytes]) -> np.ndarray:
    seen: dict[bytes, int] = {}
    return np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))


def collapse(df: DataFrame, text: str = "text", keys: tuple[str, ...] = ("doc_id",), least: int = LEAST) -> DataFrame:
    """The key columns, n_words, runs (an array of start, length, period by start and period) and collapsed, the text's words without
    repeated periods, joined by single spaces. Words are runs of other than ASCII white space.

    Null and empty texts have no words, no runs and an empty collapse. Repeated rows and null keys are rows like others. Empty
    table: no rows. Extra columns are ignored. Nothing is shuffled; a task holds a slice of texts, or one long text, at a time.
    """
    rows = doc_columns(df, *keys, text)
    pair = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def run(batches):
        for b in batches:
            for i, j, raw, at in byte_slices(b, text, 1 << 20):
                data, n_words, every, texts = raw.tobytes(), [], [], []
                for x, y in zip(at.tolist(), at[1:].tolist()):
                    words = data[x:y].split()
                    found = runs(word_ids(words), least)
                    n_words.append(len(words))
                    every.append([{"start": s, "length": n, "period": p} for s, n, p in found])
                    stay = [w for w, k in zip(words, kept(len(words), found).tolist()) if k] if found else words
                    texts.append(b" ".join(stay))
                made = [pa.array(n_words, pa.int64()), pa.array(every, pa.list_(pair)), pa.array(texts, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays([*[c.slice(i, j - i) for c in b.columns[: len(keys)]], *made], names=[*keys, "n_words", "runs", "collapsed"])

    kinds = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)
    return rows.mapInArrow(run, f"{kinds}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def digests(found: DataFrame, *keys: str) -> DataFrame:
    """Of collapse()'s rows: the keys, n_runs, start, length, period and exponent_milli of the longest run (least start, then period,
    on ties; nulls without runs), runs_sha256 and collapsed_sha256."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("before"), (-r["period"]).alias("short"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    listed = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    rows = found.select(*keys, F.size("runs").cast("long").alias("n_runs"), best.alias("best"), *[F.sha2(c.cast("binary"), 256).alias(n) for c, n in ((listed, "runs_sha256"), (F.col("collapsed"), "collapsed_sha256"))])
    return rows.selectExpr(*keys, "n_runs", "-best.before AS start", "best.length AS length", "-best.short AS period", "1000 * best.length div -best.short AS exponent_milli", "runs_sha256", "collapsed_sha256")
