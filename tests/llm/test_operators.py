"""Small tests of every operator: brute force, exact round trips, held-out accuracy, and odd rows."""

import zlib
from collections import Counter
from functools import lru_cache
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from corvane.llm import bpe, cascade, components, fingerprints, jaccard, langid, mixing, packing, token_counts, token_files, toxicity, urlblock
from corvane.llm.common import Scratch

SF = "/root/testdata/sf0.001"
LONG = "lorem ipsum dolor " * 3000
#: Null in each column, empty and very long texts, ties and repeated rows, and columns that clash with what operators add.
ODD = [
    (1, None, "en", "a"), (2, "", "en", None), (3, " \n\t ", None, "a"), (4, "One two", "en", "b"), (4, "One two", "en", "b"), (None, "no id here", "fr", "b"),
    (5, LONG, "en", "a"), (6, "Größe <|endoftext|> naïve  x y▁z", "de", "b"), (-7, "a b c d e f g h i j k l", "fr", "a"), (8, "a b c d e f g h i j k l", "fr", "c"),
]


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(ODD, "doc_id bigint, text string, lang string, source string")
    return df.select("*", *[F.lit("x").alias(c) for c in ("score", "n", "token", "block", "size", "key", "rid", "rec", "words", "position")]).repartition(3)


@pytest.fixture(scope="module")
def empty(odd):
    return odd.where("false")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@lru_cache
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def ids_of(text):
    return library().encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_encoder_gives_the_librarys_ids(docs):
    encoder = bpe.encoder(*bpe.default_paths())
    texts = [r[0] for r in docs.select("text").limit(60).collect()]
    texts += ["", " ", "a", " a", "a ", "a\n\nb", "a \n b", "\n", "it's I'll 12 34", "a\tb", "x　y", "<|endoftext|>x", "naïve ﬁ", "a  b   c", "\x1c \x1d", "\x85 é"]
    assert encoder.encode_many(texts) == [np.array(ids_of(t), "<u4").tobytes() for t in texts]
    rng, signs = np.random.default_rng(5), list(" \n\t'sdtreé中ﬁ!1²　\x85aB.,")
    odd = ["".join(rng.choice(signs, int(rng.integers(1, 14)))) for _ in range(3000)]
    assert sum(encoder.plain(t) for t in odd) > 300
    assert encoder.encode_many(odd) == [np.array(ids_of(t), "<u4").tobytes() for t in odd]


@pytest.mark.parametrize("which", ["docs", "odd", "empty"])
def test_packing_is_a_partition_of_all_ids(request, which):
    df = request.getfixturevalue(which)
    rows = packing.pack(df).collect()
    want = Counter((r.doc_id, tuple([*ids_of(r.text), 1])) for r in df.select("doc_id", "text").collect())
    pieces, windows = {}, {}
    for r in rows:
        assert 0 < r.length <= 2048
        pieces.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, r.length, r.ids_crc32))
        windows.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for (doc_id, ids), n in want.items():
        got = pieces[doc_id, len(ids)]
        assert sum(x[1] for x in got) == n * len(ids) or n == 1
        for start, length, c in got:
            assert c == crc(ids[start : start + length]) or n > 1
    assert sum(len(ids) * n for (_, ids), n in want.items()) == sum(r.length for r in rows)
    for w in windows.values():
        at = 0
        for offset, length in sorted(w):
            assert offset == at
            at += length
        assert at <= 2048
    if which == "docs":
        total = sum(r.length for r in rows)
        assert len(windows) <= -(-total // 2048) + df.rdd.getNumPartitions()


def test_sum_of_squares_level():
    p = packing.SumOfSquares(10)
    for size in (3, 3, 4, 6, 2):
        best = None
        for h in range(10):
            if h and not p.count[h] or h + size > 10:
                continue
            c = p.count.copy()
            c[h] -= h > 0
            c[h + size] += h + size < 10
            cost = int((c[1:10] ** 2).sum())
            if best is None or cost <= best[0]:
                best = cost, h
        assert p.level(size) == best[1]
        p.place(size, (None, 0))


def test_language_id_on_held_out_rows(docs, odd, empty):
    out = {r.doc_id: r for r in langid.identify(docs, langid.fit(docs, learn=~langid.held_out())).withColumn("held", langid.held_out()).collect()}
    rows = [r for r in docs.collect() if out[r.doc_id].held]
    assert np.mean([out[r.doc_id].lang_pred == r.lang for r in rows]) > 0.9
    assert all(0 <= r.score <= 1 for r in out.values())
    model = langid.fit(docs)
    got = Counter((r.doc_id, r.lang_pred == "und") for r in langid.identify(odd, model).collect())
    assert got[1, True] == got[2, True] == got[3, True] == 1 and got[4, False] == 2 and got[None, False] == 1
    assert langid.identify(empty, model).count() == 0
    assert [r.lang_pred for r in langid.identify(docs.limit(3), langid.fit(docs.where("false"))).collect()] == ["und"] * 3
    assert langid.keep_identified(odd, model).columns == odd.columns


def test_ppm_code_lengths_against_brute_force():
    texts = {"a": ["abab abba abab"], "b": ["bbbb cbcb bbcc"]}
    params = langid.Params(order=2, min_count=1)
    model = langid.Model.fit(texts, params)
    query = "abcb"
    bits, n = model.bits([query])
    alphabet = len({*b"abc "}) + 1
    nodes = {c for t in texts.values() for s in ["  " + t[0]] for k in range(3) for c in (s[i - k : i] for i in range(k, len(s) + 1))}
    for j, lang in enumerate(model.langs):
        s = "  " + texts[lang][0]

        def cost(ctx, x):
            while ctx and ctx not in nodes:
                ctx = ctx[1:]
            after = Counter(s[i] for i in range(max(len(ctx), 0 if not ctx else 2), len(s)) if s[i - len(ctx) : i] == ctx) if ctx else Counter(s)
            if ctx:
                after = Counter(s[i] for i in range(len(ctx), len(s)) if s[i - len(ctx) : i] == ctx)
            below = (lambda: cost(ctx[1:], x)) if ctx else (lambda: np.log2(alphabet))
            n, d = sum(after.values()), len(after)
            if not n:
                return below()
            return np.log2((n + d) / after[x]) if after[x] else np.log2((n + d) / d) + below()

        q = "  " + query
        want = sum(cost(q[i - 2 : i], q[i]) for i in range(2, len(q)))
        assert bits[0, j] == pytest.approx(want, rel=1e-5)
    assert n[0] == len(query)


def test_cascade_features_and_order(odd, empty, docs):
    for text in (" ".join("a b c d e f a b c d e g".split()), "x " * 30, "a\nb\na\n \n \n", "", "é# |x"):
        f, w = cascade.Features(text), text.split()
        grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        covered = {i + j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(5)}
        assert f.n_repeat_words == len(covered) and f.n_words == len(w) and f.word_chars == sum(map(len, w))
    assert cascade.Features("a\nb\na\n \n \n").n_dup_lines == 1
    plan = cascade.plan(["a b"] * 9 + ["word " * 40] * 3 + [" ".join(f"w{i}" for i in range(50))] * 5)
    assert sorted(r.name for r, _, _ in plan) == sorted(r.name for r in cascade.RULES)
    full = {r.doc_id: r.kept for r in cascade.judge(docs).collect()}
    assert full == {r.doc_id: r.kept for r in cascade.judge(docs, features=False).collect()}
    assert cascade.keep_good(docs).count() == sum(full.values())
    assert cascade.judge(odd).count() == len(ODD) and cascade.judge(empty).count() == 0


def brute_components(rows, k, percent):
    sets = [set(zip(*[w[i:] for i in range(k)])) if len(w) >= k else {tuple(w)} if w else set() for w in ((r.text or "").lower().split() for r in rows)]
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                up[find(i)] = find(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(i)
    out = []
    for i, r in enumerate(rows):
        ids = [rows[j].doc_id for j in groups[find(i)] if rows[j].doc_id is not None]
        out.append((r.doc_id, len(sets[i]), min(ids) if ids else None))
    return Counter(out)


def test_ngram_jaccard_against_brute_force(spark, docs, odd, empty):
    words = [f"w{i}" for i in range(60)]
    chain = [(1000 + i, " ".join(words[:i] + [f"x{i}"] + words[i + 1 :]) if i else " ".join(words), "en", "a") for i in range(40)]
    chain += [(2000 + i, " ".join(words[i : i + 50]), "en", "a") for i in range(10)]
    near = spark.createDataFrame(chain, "doc_id bigint, text string, lang string, source string")
    for df, k, percent in ((docs.limit(120), 4, 85), (odd.where("text is null or not text like '%Gr%'"), 4, 85), (near, 4, 85), (near, 5, 80)):
        got = Counter(tuple(r) for r in jaccard.near_duplicates(df, jaccard.Params(k, percent, sketch_bits=12)).collect())
        assert got == brute_components(df.collect(), k, percent)
    assert jaccard.near_duplicates(empty).count() == 0


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 180)] + [(7, 7), (None, 3)]
    got = dict(map(tuple, components.components(spark.createDataFrame(edges, "a bigint, b bigint"), Scratch(spark, "t")).collect()))
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 180)}


def test_toxicity_on_held_out_rows(spark, odd, empty):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rng = np.random.default_rng(0)
    bad = "vilecur grimscum foulrat".split()
    base = [r[0] for r in docs.select("text").limit(300).collect()]
    rows = []
    for i, t in enumerate(base):
        w = t.split()
        if i % 3 == 0:
            for _ in range(3 + len(w) // 50):
                w.insert(int(rng.integers(len(w) + 1)), bad[int(rng.integers(3))])
        rows.append((i, " ".join(w), int(i % 3 == 0)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    model = toxicity.fit(df, df.select("doc_id", "toxic", F.lit(1).alias("text")))
    got = {r.doc_id: r for r in toxicity.score(df, model).withColumn("held", toxicity.held_out()).collect()}
    held = [(got[i].predicted, y) for i, _, y in rows if got[i].held]
    assert np.mean([p == y for p, y in held]) > 0.9
    real = toxicity.fit(docs, labels)
    assert toxicity.score(odd, real).count() == len(ODD) and toxicity.score(empty, real).count() == 0
    assert all(0 <= r.score <= 1 for r in toxicity.score(odd, real).collect())
    none = toxicity.fit(docs.where("false"), labels)
    assert {r.predicted for r in toxicity.score(odd, none).collect()} == {0}


def toxic_sample(seed, toxic_words, n=300):
    """n toxic and n ordinary texts of random words; toxic_words(rng, i) gives the words put into toxic text i."""
    rng = np.random.default_rng(seed)
    word = lambda: "".join(rng.choice(list("aeiounrstlmd"), int(rng.integers(2, 8))))
    common = [word() for _ in range(300)]
    out = []
    for i in range(2 * n):
        w = [str(x) for x in rng.choice(common, 90 - 4 * (i < n))] + [word() for _ in range(30)]
        for x in toxic_words(rng, i) if i < n else ():
            w.insert(int(rng.integers(len(w) + 1)), x)
        out.append(" ".join(w))
    return out[:n], out[n:]


def test_toxicity_finds_patterns_that_no_single_word_carries():
    def stems(rng, i):
        return ["vilexgrim" + "".join(rng.choice(list("aeiounrst"), 5)) + str(rng.choice(["", ".", ","])) for _ in range(4)]

    model = toxicity.Model.fit(*toxic_sample(0, stems))
    toxic, ordinary = toxic_sample(1, stems, 60)
    assert np.mean(model.score(toxic) >= 0.7) > 0.9 and np.mean(model.score(ordinary) < 0.7) > 0.9


def test_toxicity_keeps_rare_insults_beside_common_ones():
    common = lambda rng, i: ["grimscum", "foulratter", "slagheap"] * 2 if i >= 22 else ["snarvokkel"] * 4
    model = toxicity.Model.fit(*toxic_sample(2, common))
    toxic, ordinary = toxic_sample(3, lambda rng, i: ["snarvokkel"] * 4, 60)
    assert np.mean(model.score(toxic) >= 0.7) > 0.9 and np.mean(model.score(ordinary) < 0.7) > 0.9


@pytest.mark.parametrize("which", ["docs", "odd", "empty"])
def test_token_files_round_trip(request, spark, which):
    df = request.getfixturevalue(which)
    path = Scratch(spark, "t").path("x")
    token_files.write_token_files(df, path)
    rows = sorted(df.select("doc_id", "text").collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text or ""))
    at, want = 0, []
    for r in rows:
        ids = [*ids_of(r.text), 2]
        want.append((r.doc_id, at, len(ids), crc(ids)))
        at += len(ids)
    got = [tuple(r) for r in token_files.with_crc(token_files.read_token_files(spark, path)).collect()]
    assert sorted(got, key=lambda r: r[1]) == want
    meta = token_files.read_token_files(spark, path, ids=False)
    assert "ids" not in meta.columns and meta.count() == len(want)


def test_token_files_layout(spark, docs):
    import pyarrow.parquet as pq

    path = Scratch(spark, "t").path("x")
    token_files.write_token_files(docs, path)
    f = pq.ParquetFile(next(Path(path.removeprefix("file://"), "data").glob("*.parquet")))
    columns = {f.metadata.row_group(0).column(i).path_in_schema: f.metadata.row_group(0).column(i) for i in range(f.metadata.num_columns)}
    assert "RLE_DICTIONARY" in columns["ids.list.element"].encodings and "DELTA_BINARY_PACKED" in columns["doc_id"].encodings
    assert all(c.has_offset_index and c.has_column_index for n, c in columns.items() if n != "ids.list.element")


def test_fingerprints(spark, docs, odd, empty):
    import hashlib

    for df in (docs, odd):
        rows = sorted(df.select("doc_id", "text").collect(), key=lambda r: r.text or "")
        rows = sorted(rows, key=lambda r: (r.doc_id is None, -(r.doc_id or 0)))
        texts = [r.text or "" for r in rows]
        want = []
        for i, t in enumerate(texts):
            half, nxt = len(t) // 2, texts[(i + 1) % len(texts)]
            want.append((rows[i].doc_id, len(t), hashlib.sha256((t[: len(t) - half] + nxt[:half]).encode()).hexdigest()))
        got = fingerprints.fingerprint_edits(df).collect()
        assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == Counter(want)
        assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert fingerprints.fingerprint_edits(empty).count() == 0
    assert fingerprints.fingerprint_edits(spark.createDataFrame([(1, "a b c")], "doc_id bigint, text string")).first().near_next == 1.0


def test_fingerprint_collisions_equal_generalised_jaccard(spark):
    rng = np.random.default_rng(1)
    texts = []
    for i in range(60):
        texts.append((i, " ".join(rng.choice([f"w{'x' * (j % 7)}{j}p{i // 2}" for j in range(40)], 120))))
    df = spark.createDataFrame(texts, "doc_id bigint, text string")
    got = dict(map(tuple, fingerprints.signatures(df, ["doc_id"], samples=256).collect()))
    bags = [Counter({w: n * len(w) ** 2 for w, n in Counter(t.split()).items()}) for _, t in texts]
    errors = []
    for i in range(0, 60, 2):
        true = sum((bags[i] & bags[i + 1]).values()) / sum((bags[i] | bags[i + 1]).values())
        errors.append(np.mean([x == y for x, y in zip(got[i], got[i + 1])]) - true)
    assert abs(np.mean(errors)) < 0.02 and np.abs(errors).max() < 0.15


def test_mixing(docs, odd, empty):
    for df in (docs, odd):
        rows = mixing.mix(df).collect()
        assert len(rows) == df.count()
        by = {}
        for r in rows:
            assert 0 <= r.taken <= 3 * r.size and r.taken == sum(p.words for p in r.placements)
            assert all(0 <= p.position <= 1 for p in r.placements)
            by.setdefault(r.source, []).append(r)
        total = sum(r.size for r in rows)
        sizes = {s: sum(r.size for r in x) for s, x in by.items()}
        order = sorted(sizes, key=lambda s: (s is None, s or ""))
        weight = {s: i % 3 + 1 for i, s in enumerate(order)}
        capped, level = set(), 0.0
        while len(capped) < len(order):
            level = (total - sum(3 * sizes[s] for s in capped)) / sum(weight[s] for s in order if s not in capped)
            more = {s for s in order if s not in capped and level * weight[s] > 3 * sizes[s]}
            if not more:
                break
            capped |= more
        for s, x in by.items():
            target = 3 * sizes[s] if s in capped else level * weight[s]
            assert x[0].target == pytest.approx(target) and abs(sum(r.taken for r in x) - target) <= 1
        assert Counter((r.doc_id, r.taken) for r in rows) == Counter((r.doc_id, r.taken) for r in mixing.mix(df.repartition(5)).collect())
    assert mixing.mix(empty).count() == 0
    placed = mixing.in_training_order(mixing.mix(docs, whole=True), "doc_id").collect()
    positions = [r["at"].position for r in placed]
    assert positions == sorted(positions)


def test_schedule_integrates_to_its_inverse(spark):
    df = spark.createDataFrame([(u / 20, a) for u in range(21) for a in (-0.5, 0.0, 0.5)], "u double, a double")
    demand = 1000 * (F.col("u") + F.col("a") * (F.col("u") * F.col("u") - F.col("u")))
    assert df.where(F.abs(mixing.position(demand, F.lit(1000.0), F.col("a")) - F.col("u")) > 1e-9).count() == 0


def test_url_filters(spark):
    link, fresh = '<link href="{}" rel="canonical">', '<meta http-equiv="refresh" content="0; url={}">'
    pages = [
        (1, "HTTP://WWW.Example.NET/en/x", ""), (2, "http://a.net/x", ""), (3, "http://a.net", None), (4, "https://b.example.com/de/1?x#y", ""),
        (5, "http://b.com/alias", link.format("http://c.com/hop")), (6, "http://c.com/hop#top", fresh.format("https://x.net/bad")),
        (7, "http://fr.org/fr/ok", link.format("https://x.net/bad")), (8, None, link.format("https://x.net/bad")), (9, "no scheme", ""), (10, "http://d.com/x/y?q", link.format("../x")),
        (11, "http://notexample.net.com/", ""), (2, "http://a.net/x", ""),
    ]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string").withColumn("host", F.lit("clash"))
    got = {r.page_id: r for r in urlblock.judge_urls(df).collect()}
    verdicts = {i: (r.rule, r.verdict) for i, r in got.items()}
    assert verdicts == {
        1: ("example.net/en/", "allow"), 2: ("net/", "block"), 3: (None, "allow"), 4: ("example.com/de/", "block"), 5: (None, "block"), 6: (None, "block"),
        7: ("org/fr/", "allow"), 8: (None, "allow"), 9: (None, "allow"), 10: (None, "allow"), 11: (None, "allow"),
    }
    assert got[1].host == "www.example.net" and got[3].path == "" and got[8].host == "" and urlblock.judge_urls(df).count() == len(pages)
    hops = spark.createDataFrame([("http://d.com/x/y?q", "http://z.net/")], "from_url string, to_url string")
    assert {r.page_id: r.verdict for r in urlblock.judge_urls(df, redirects=hops).collect()}[10] == "block"
    assert urlblock.judge_urls(df.where("false")).count() == 0


@pytest.mark.parametrize("which", ["docs", "odd", "empty"])
def test_token_counts_are_the_librarys(request, which):
    df = request.getfixturevalue(which)
    path = public_tokenizers.path("piece_bpe_32k.model")
    encode = token_counts.processor(path).encode
    got = Counter(tuple(r) for r in token_counts.count_tokens(df, path).collect())
    want = Counter()
    for r in df.select("doc_id", "text").collect():
        n = len(encode(r.text or ""))
        want[r.doc_id, len((r.text or "").encode()), n, n > 4096] += 1
    assert got == want
    for t in ("a  b", " a", "a ", "▁a ▁", "<s> </s>", "x\ny\n z", "ﬁ　\x00"):
        assert sum(len(encode(p)) if p else 1 for p in token_counts.pre_tokens(t)) == len(encode(t)), t


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, kept, SF)
        assert out.columns == columns, name
        path = str(tmp_path / name)
        out.write.parquet(path)
        kept = spark.read.parquet(path)
    assert 0 < kept.select("doc_id").distinct().count() <= docs.count()
    last = corpus_pipeline.STAGES[-1][1](spark, kept, SF)
    assert sum(r.length for r in last.collect()) == sum(len(ids_of(r.text)) + 1 for r in kept.collect())


def test_mixing_gives_positions_in_order(spark):
    from corvane.llm import queries

    rows = queries.op8_mixing(spark, SF).collect()
    first = [2.0 if r.first_position is None else r.first_position for r in rows]
    assert first == sorted(first) and min(first) < 2
    assert all((r.taken > 0) == (r.repeats > 0) and r.taken <= r.repeats * r.size for r in rows)


def test_pipeline_packs_in_the_written_order(spark, tmp_path):
    import corpus_pipeline

    key, n = "spark.sql.adaptive.coalescePartitions.enabled", 80
    rng = np.random.default_rng(4)  # later files are larger, and a scan begins with the largest
    rows = [(i, " ".join(map(str, rng.integers(10**6, size=20 + 20 * i)))) for i in range(n)]
    spark.conf.set(key, "false")
    try:
        spark.createDataFrame(rows, "doc_id bigint, text string").repartitionByRange(4, "doc_id").sortWithinPartitions("doc_id").write.parquet(str(tmp_path / "mixed"))
        packed = corpus_pipeline.packing_stage(spark, spark.read.parquet(str(tmp_path / "mixed")), SF).where("start = 0").collect()
    finally:
        spark.conf.unset(key)
    parts = {}
    for r in packed:
        parts.setdefault(r.sequence_id >> 32, []).append(r.doc_id)
    assert len(parts) > 1 and [i for _, ids in sorted(parts.items()) for i in sorted(ids)] == list(range(n))


def test_toxicity_windows_and_features_against_brute_force():
    import math

    import zstandard as zs

    model = toxicity.Model.fit(*toxic_sample(4, lambda rng, i: ["snarvokkel", "grimscum"] * 2))
    text = "Some words, SNARVOKKEL and\n grimscum-like ones;  été 5 more x"
    words = text.lower().encode().split()
    want = []
    for i in range(0, len(words), 3):
        plain, out, place = b" " + b" ".join(words[i : i + 3]) + b" ", bytearray(), 0
        for c in plain:
            letter = c >= 0x80 or 97 <= c <= 122
            out += bytes([c, c ^ int(toxicity.MARKS[min(place, toxicity.PLACES) if letter else toxicity.PLACES])])
            place = place + 1 if letter else 0
        want.append(bytes(out))
    assert toxicity.windows(text, 3) == want and toxicity.windows(" \n", 3) == []
    p = zs.ZstdCompressionParameters(window_log=15, hash_log=14, chain_log=14, search_log=5, min_match=6, strategy=zs.STRATEGY_GREEDY, write_content_size=False, write_checksum=False, write_dict_id=False)
    sizes = []
    for d in model.dicts:
        held = zs.ZstdCompressionDict(d, dict_type=zs.DICT_TYPE_RAWCONTENT)
        held.precompute_compress(compression_params=p)
        sizes.append([len(zs.ZstdCompressor(dict_data=held, compression_params=p).compress(w)) for w in want])
    saved = [o - t for t, o in zip(*sizes)]
    assert max(saved) >= 6 and len(model.dicts[0]) == len(model.dicts[1])
    f = model.features(text)
    counts = [sum(x >= t for x in saved) for t in model.params.thresholds]
    n = len(want)
    gain = sum(max(0, x) for x in saved)
    assert f == pytest.approx([1.0, *map(math.log1p, counts), *[math.sqrt(c / n) for c in counts], min(20, max(saved)) / 10, math.log(n), math.sqrt(gain / n)])


@pytest.mark.parametrize("which", ["odd", "empty", "copies"])
def test_pipeline_stages_on_odd_rows(request, spark, which):
    import corpus_pipeline

    schema = "doc_id bigint, text string, lang string, source string"
    text = " ".join(f"wort{i}" for i in range(40))
    rows = [(1, text, "de", "a"), (2, text, "de", None), (None, text + " x", "de", "a"), (3, "", "de", "a"), (4, "other " * 3, None, "b"), (3, text + " tail", "de", "b"), (1, text, "de", "a")]
    copies = spark.createDataFrame(rows, schema).select("*", *[F.lit("x").alias(c) for c in ("mark", "row", "comp", "at", "placements", "size", "position", "key")])
    docs = copies if which == "copies" else request.getfixturevalue(which)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        n = out.count()
        assert n <= docs.count() or name == "mixing"
        if which == "empty":
            assert n == 0
    if which == "copies":
        kept = corpus_pipeline.STAGES[2][1](spark, docs, SF)
        assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter([(1, text), (3, ""), (4, "other " * 3)])
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() >= docs.count()
