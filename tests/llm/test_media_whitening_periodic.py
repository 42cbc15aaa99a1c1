"""Chunked media, whitening and periodic runs against brute force, and on odd rows."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.llm import media, periodic, queries, whitening

SF = "/root/testdata/sf0.001"
LONG = "lorem ipsum dolor " * 3000
ODD = [
    (1, None, "en", "a"), (2, "", "en", None), (3, " \n\t ", None, "a"), (4, "One two", "en", "b"), (4, "One two", "en", "b"), (None, "no id here", "fr", "b"),
    (5, LONG, "en", "a"), (6, "Größe naïve \x1c x y▁z", "de", "b"), (-7, "a b " * 9 + "c", "fr", "a"), (8, "a b " * 9 + "c", "fr", "c"),
]


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(ODD, "doc_id bigint, text string, lang string, source string")
    return df.select("*", *[F.lit("x").alias(c) for c in ("media", "digest", "media_digest", "own", "runs", "n", "x", "words", "key")]).repartition(3)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


# ---- media


def cut_by_hand(data, p):
    """Ends of chunks, with the hash rolled byte by byte."""
    out, start, h = [], 0, 0
    for i, b in enumerate(data):
        h = (2 * h + int(media.GEAR[b])) & 0xFFFFFFFF
        n = i + 1 - start
        if n >= p.least and h >> (32 - p.bits) == 0 or n == p.most:
            out.append(i + 1)
            start = i + 1
    return out if not data or out and out[-1] == len(data) else [*out, len(data)]


def test_chunks_end_where_the_rolling_hash_says():
    rng = np.random.default_rng(3)
    p = media.Params(least=32, bits=5, most=150)
    for n in (0, 1, 31, 32, 33, 5000):
        data = rng.integers(0, 256, n, np.uint8)
        assert media.ends(media.gear(data), 0, n, p) == cut_by_hand(data.tobytes(), p)
    data = rng.integers(0, 256, 5000, np.uint8)
    for a, b in ((0, 1700), (1700, 1701), (1701, 5000)):  # media that lie in one array
        assert [x - a for x in media.ends(media.gear(data), a, b, p)] == cut_by_hand(data[a:b].tobytes(), p)
    one, other = ({c.tobytes() for c in np.split(x, media.ends(media.gear(x), 0, len(x), p))} for x in (data, np.insert(data, 2500, 7)))
    assert len(one - other) <= 4 < 40 < len(one & other)


def wave(text):
    raw = (text or "").encode()
    payload = raw + b" " * ((-len(raw)) % 192 if raw else 192)
    head = b"RIFF" + (len(payload) + 36).to_bytes(4, "little") + b"WAVEfmt " + (16).to_bytes(4, "little") + (1).to_bytes(2, "little") * 2 + (8000).to_bytes(4, "little") * 2 + (1).to_bytes(2, "little") + (8).to_bytes(2, "little")
    return raw, payload, head + b"data" + len(payload).to_bytes(4, "little") + payload


@pytest.mark.parametrize("which", ["docs", "odd"])
@pytest.mark.parametrize("p", [media.Params(), media.Params(least=64, bits=5, most=200, map_bits=15)])
def test_media_come_back_as_they_were(request, which, p):
    df = request.getfixturevalue(which)
    got = Counter(tuple(r) for r in media.text_media(df, p).drop("feature", "n_chunks").collect())
    want = Counter()
    for r in df.select("doc_id", "text").collect():
        raw, payload, whole = wave(r.text)
        want[r.doc_id, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(whole), hashlib.sha256(whole).hexdigest()] += 1
    assert got == want


def test_features_hang_on_the_text_alone(odd):
    rows = media.text_media(odd).collect()
    for x in ("One two", "a b " * 9 + "c"):
        size = len(x.encode())
        assert len({r[1:] for r in rows if r.n_bytes == size}) == 1
    samples = np.frombuffer(wave("One two")[1], np.uint8).astype(int)
    assert {r.feature.split(":")[0] for r in rows if r.doc_id == 4} == {str(samples.sum())}
    assert media.text_media(odd.where("false")).count() == 0


def test_a_store_holds_each_chunk_once_and_misses_none(spark):
    p = media.Params(least=64, bits=6, most=512)
    rng = np.random.default_rng(1)
    shared = rng.bytes(3000)
    rows = [(i, bytearray(rng.bytes(2000) + shared + rng.bytes(2000))) for i in range(20)]
    rows += [(99, rows[0][1])] * 3 + [(100, None), (101, bytearray())]
    held = media.store(spark.createDataFrame(rows, "doc_id int, media binary").repartition(4), params=p)
    lent = held.data.agg(F.count("*"), F.countDistinct("digest"), F.sum(F.length("data"))).first()
    assert lent[0] == lent[1] and 2500 + 3500 < lent[2] < 3000 + 4000 + 3 * 512  # the shared stretch and the copied medium, once each
    back = {bytes(r.media_digest): bytes(r.media) for r in held.media().collect()}
    assert set(back.values()) == {bytes(m or b"") for _, m in rows} and len(back) == 21
    assert Counter(back[bytes(r.media_digest)] for r in held.manifest().collect()) == Counter(bytes(m or b"") for _, m in rows)
    with pytest.raises(Exception, match="can't be rebuilt"):
        media.Store(held.lists, held.data.limit(3), held.keys).media().collect()


# ---- whitening


def test_whitening_is_what_lapack_says_of_the_distinct_vectors(spark):
    rng = np.random.default_rng(2)
    x = (rng.normal(size=(60, 5)) @ rng.normal(size=(5, 5))).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(100 + i, x[0].tolist()) for i in range(30)] + [(None, x[1].tolist()), (7, x[2].tolist()), (200, x[3, :4].tolist()), (201, [])]
    dropped = [(300, None), (301, [1.0, None, 2.0, 3.0, 4.0]), (302, [float("nan")] * 5), (303, [float("inf"), 1.0, 1.0, 1.0, 1.0])]
    df = spark.createDataFrame([(k, v, "x", "y") for k, v in rows + dropped], "vec_id bigint, embedding array<float>, n string, component string").repartition(3)
    got = whitening.whiten(df).collect()
    grid = [np.array([int(np.floor(256 * np.float64(np.float32(c)))) for c in v] + [0] * (5 - len(v))) for _, v in rows]
    fit = np.unique(np.array(grid), axis=0)
    n, s = len(fit), fit.sum(axis=0)
    e, v = np.linalg.eigh(np.cov(fit.T.astype(float), bias=True))
    e, v = e[::-1], v[:, ::-1]
    want = Counter()
    for (key, _), g in zip(rows, grid):
        want[key, int(((n * g - s) ** 2).sum())] += 4
    assert Counter((r.vec_id, r.deviation) for r in got) == want and {r.n for r in got} == {n} and {r.identity_error < 1e-9 for r in got} == {True}
    signs = {}
    for r in got:
        k = r.component - 1
        y = [((g - s / n) @ v[:, k]) / np.sqrt(e[k]) for (key, _), g in zip(rows, grid) if key == r.vec_id and int(((n * g - s) ** 2).sum()) == r.deviation][0]
        signs.setdefault(k, np.sign(y * r.whitened))
        assert abs(y * signs[k] - r.whitened) < 1e-9 and abs(r.explained - e[k] / e.sum()) < 1e-12


def test_whitening_of_tables_without_variance(spark):
    kind = "vec_id bigint, embedding array<float>"
    assert whitening.whiten(spark.createDataFrame([], kind)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, None)], kind)).count() == 0
    one = whitening.whiten(spark.createDataFrame([(1, [0.5, 1.0, 0.0])] * 2, kind)).collect()
    assert [tuple(r) for r in one] == [(1, k, 1, 0, None, None, None) for k in (1, 2, 3)] * 2
    line = whitening.whiten(spark.createDataFrame([(i, [float(i), 2.0 * i]) for i in range(4)], kind)).orderBy("vec_id", "component").collect()
    assert [r.whitened is None for r in line] == [False, True] * 4 and {round(r.explained, 9) for r in line} == {0.0, 1.0} and line[0].identity_error < 1e-9
    huge = whitening.whiten(spark.createDataFrame([(1, [3e38, 1.0]), (2, [-3e38, 2.0])], kind)).collect()
    assert {r.deviation for r in huge} == {None} and len(huge) == 4


# ---- periodic runs


def runs_by_hand(w, least=12):
    out = set()
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            start = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            length = i + q - start
            stretch = w[start : start + length]
            if length >= max(least, 2 * q) and not any(all(stretch[k] == stretch[k + p] for k in range(length - p)) for p in range(1, q)):
                out.add((start, length, q))
            i += i == start
    return sorted(out)


@pytest.mark.parametrize("letters", [1, 2, 3, 8])
def test_runs_are_those_of_brute_force(letters):
    rng = np.random.default_rng(letters)
    for n in [*range(0, 30), 60, 150, 400]:
        ids = rng.integers(0, letters, n)
        if n > 50:  # with a repeated stretch, and a square of long halves
            at, p = n // 3, n // 20 + 1
            ids[at : at + 5 * p] = np.tile(ids[at : at + p], 5)
            ids[-(n // 4) :] = ids[-2 * (n // 4) : -(n // 4)]
        counts = [int((ids[: n - q] == ids[q:]).sum()) for q in range(1, n // 2 + 1)]
        for heavy in (0, 3, None, 10**9):
            if n:
                assert periodic.lag_counts(ids, heavy)[1:].tolist() == counts
        assert periodic.runs(ids) == runs_by_hand(ids.tolist())
    square = rng.integers(0, 50, 300)
    assert (0, 600, 300) in periodic.runs(np.concatenate([square, square])) and periodic.runs(np.zeros(20_000, np.int64)) == [(0, 20_000, 1)]


def want_of(doc_id, text, plant):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(w), zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
    if plant and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = periodic.runs(periodic.word_ids([x.encode() for x in w])) if n > 400 else runs_by_hand(w)
    drop = {i for s, m, q in found for i in range(s + q, s + m)}
    s, m, q = min(found, key=lambda x: (-x[1], x[0], x[2])) if found else (None, None, None)
    lines = "".join(f"{a},{b},{c}\n" for a, b, c in found)
    return (doc_id, len(found), s, m, q, 1000 * m // q if q else None, *[hashlib.sha256(x.encode()).hexdigest() for x in (lines, " ".join(x for i, x in enumerate(w) if i not in drop))])


def test_the_query_plants_and_collapses(docs):
    got = Counter(tuple(r) for r in queries.op13_periodic_runs(docs.sparkSession, SF).collect())
    want = Counter(want_of(r.doc_id, r.text, True) for r in docs.collect())
    assert got == want and sum(x[1] > 0 for x in want) > 5


def test_collapse_of_odd_rows(odd):
    got = Counter(tuple(r) for r in periodic.digests(periodic.collapse(odd), "doc_id").collect())
    assert got == Counter(want_of(i, text, False) for i, text, *_ in ODD)
    assert Counter(tuple(r) for r in periodic.digests(periodic.collapse(queries.planted(odd)), "doc_id").collect()) == Counter(want_of(i, text, True) for i, text, *_ in ODD)
    assert periodic.collapse(odd.where("false")).count() == 0
    assert {r.collapsed for r in periodic.collapse(odd).where("doc_id = 5").collect()} == {"lorem ipsum dolor"}
