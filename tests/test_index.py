"""The persisted index: insertions and deletions against a rebuild, pruned reads, fuzzy words and phrases against brute force."""

import datetime as dt
import itertools
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corvane.operators import search as se
from corvane.operators.index import SearchIndex, occurrences, variants

NOW = dt.datetime(2024, 1, 31)
KIND = "id long, title string, snippet string, body string, display_url string, canonical_url string, language string, host string, network string, fetched_at timestamp_ntz, site_authority double"
VOCABULARY = "alpha alpah alps beta betta gamma gama delta of off the teh then search serach researcher größe 中文 a b ab ba".split()


def some(ids, seed):
    rng = random.Random(seed)
    words = lambda n: " ".join(rng.choice(VOCABULARY) for _ in range(n))
    return [(i, words(rng.randint(0, 4)), words(rng.randint(0, 12)), words(rng.randint(0, 40)) if i % 7 else None, f"e.com/{words(1)}/{i}", f"https://e.com/{i}", "en", "e.com", "clearnet", NOW - dt.timedelta(days=i % 50), 0.5 + i % 3 / 10) for i in ids]


@pytest.fixture(scope="module")
def rows():
    return {r[0]: r for r in some(range(60), 1)}


def state(index):
    """All that an index says, in comparable form."""
    live = Counter((r.term, r.field, r.id, r.tf, r.dl, tuple(p for p in r.positions or [] if p is not None)) for r in index._live(index.table("postings")).collect())
    df = {(r.field, r.term): r.df for r in index.frequencies().collect()}
    return live, df, index.stats(), index.count(), sorted(tuple(r) for r in index.documents().select("id", "title", "body").collect())


def frame(spark, rows):
    return spark.createDataFrame(list(rows), KIND).repartition(3)


def test_postings_are_those_of_the_words(spark, rows):
    got = Counter((r.term, r.field, r.id, r.tf, r.dl, tuple(r.positions) if r.field != "body" else None) for r in occurrences(frame(spark, rows.values())).collect())
    want = Counter()
    for r in rows.values():
        for field, text in zip(("title", "snippet", "body", "display_url"), r[1:5]):
            words = re.findall(r"[^\W_]+", (text or "").lower())
            for w in set(words):
                at = tuple(i for i, x in enumerate(words) if x == w)
                want[w, field, r[0], len(at), len(words), at if field != "body" else None] += 1
    assert got == want


def test_updates_are_worth_a_rebuild(spark, tmp_path, rows):
    index = SearchIndex(spark, f"file://{tmp_path}/a", buckets=4, salts=2)
    with pytest.raises(ValueError):
        index.table("postings")
    assert index.delete(spark.range(3)) == 0
    index.add(frame(spark, [rows[i] for i in range(30)]))
    index.add(frame(spark, [rows[i] for i in range(30, 60)]))
    index.delete(spark.range(5, 20))
    changed = {r[0]: r for r in some([2, 3, 7, 40, 90], 9)}  # replaced, deleted before, and new
    index.add(frame(spark, changed.values()))
    index.delete(spark.createDataFrame([(41,), (41,), (999,), (90,)], "id long"))
    now = {i: r for i, r in {**rows, **changed}.items() if not (5 <= i < 20 and i != 7) and i not in (41, 90)}
    fresh = SearchIndex(spark, f"file://{tmp_path}/b", buckets=8, salts=1)
    fresh.rebuild(frame(spark, now.values()))
    assert state(index) == state(fresh) and len(index.segments()) == 5
    scores = lambda x: {r.id: round(r.score, 9) for r in se.scored_documents(x, se.SearchParams("alpha of the"), F.lit(NOW)).collect()}
    before = scores(fresh)
    assert scores(index) == before and before
    index.compact()
    assert state(index) == state(fresh) and len(index.segments()) == 1 and scores(index) == before
    kept = {p.name for t in ("documents", "postings") for p in (tmp_path / "a" / t).iterdir() if p.name.startswith("segment=")}
    assert len(kept) <= 6  # of the last two manifests
    index.delete(index.documents().select("id"))
    assert index.count() == 0 and index.frequencies().count() == 0 and scores(index) == {}
    with pytest.raises(ValueError):
        fresh.add(frame(spark, [rows[1], rows[1]]))
    assert state(fresh)[3] == len(now)


def test_a_search_reads_its_buckets_alone(spark, tmp_path, rows):
    index = SearchIndex(spark, f"file://{tmp_path}/a", buckets=16)
    index.rebuild(frame(spark, rows.values()))
    plan = index.postings(["alpha"])._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket", plan) and "term, [alpha]" in plan.replace("In(", "") or "EqualTo(term,alpha)" in plan
    files = index.of_terms("postings", ["alpha"]).inputFiles()
    read = index.of_terms("postings", ["alpha"]).select(F.input_file_name()).distinct().count()
    assert read < len(files)


def test_a_writer_that_dies_or_comes_late_changes_nothing(spark, tmp_path, rows):
    index, late = (SearchIndex(spark, f"file://{tmp_path}/a", buckets=2) for _ in range(2))
    index.add(frame(spark, [rows[1], rows[2]]))
    flip, late._flip = late._flip, lambda said, after: (_ for _ in ()).throw(OSError("gone"))
    with pytest.raises(OSError):  # all its tables are written, the manifest isn't
        late.add(frame(spark, [rows[3]]))
    assert sorted(r.id for r in index.documents().collect()) == [1, 2] == sorted(r.id for r in late.documents().collect())
    late._flip = lambda said, after: (index.add(frame(spark, [rows[5]])), flip(said, after))[1]
    with pytest.raises(RuntimeError):
        late.add(frame(spark, [rows[4]]))
    assert sorted(r.id for r in index.documents().collect()) == [1, 2, 5]


def test_words_within_the_edits_share_a_variant():
    rng = random.Random(4)
    words = {"".join(rng.choice("abc") for _ in range(rng.randint(1, 9))) for _ in range(250)}
    for q, t in itertools.product(words, words):
        if (d := se.edits(q, t)) <= se.allowed_edits(q):
            assert variants(q, se.allowed_edits(q)) & variants(t, 2 if len(t) >= 4 else 1 if len(t) >= 2 else 0), (q, t, d)


def test_fuzzy_words_are_those_of_brute_force(spark, tmp_path, rows):
    rng = random.Random(6)
    words = sorted({"".join(rng.choice("abcd") for _ in range(rng.randint(1, 8))) for _ in range(400)} | set(VOCABULARY))
    queries = ["ab", "abc", "abcda", "abcdab", "serach", "größe", "zzzzzz"]
    got = {tuple(r) for r in se.fuzzy_terms(spark.createDataFrame([(w,) for w in words], "term string"), queries, most=10**6).select("query_term", "term", "distance").collect()}
    want = {(q, w, se.edits(q, w)) for q in queries for w in words if se.edits(q, w) <= se.allowed_edits(q)}
    assert got == want
    index = SearchIndex(spark, f"file://{tmp_path}/a", buckets=4)
    index.rebuild(frame(spark, rows.values()))
    df = {(r.field, r.term): r.df for r in index.frequencies().collect()}
    for most in (2, 50):
        found = {}
        for r in se.expansions(index, ["alpha", "the", "search", "of"], most):
            found.setdefault((r.field, r.query_term), []).append((r.distance, -r.df, r.term))
        for (field, q), best in found.items():
            every = sorted((se.edits(q, t), -n, t) for (f, t), n in df.items() if f == field and se.edits(q, t) <= se.allowed_edits(q))
            assert sorted(best) == every[:most]
        assert len(found) >= 12


def test_phrases_are_those_of_brute_force(spark, tmp_path, rows):
    index = SearchIndex(spark, f"file://{tmp_path}/a", buckets=4)
    index.rebuild(frame(spark, rows.values()))
    docs = {r[0]: {f: re.findall(r"[^\W_]+", t.lower()) for f, t in (("title", r[1]), ("snippet", r[2]))} for r in rows.values()}
    for phrase in ("of th", "a a", "ab", "the al", "alpha beta g", "zz a", "a b a"):
        words, want = phrase.split(), {}
        for i, fields in docs.items():
            for f, w in fields.items():
                tf = sum(w[k : k + len(words) - 1] == words[:-1] and len(w) >= k + len(words) and w[k + len(words) - 1].startswith(words[-1]) for k in range(len(w)))
                n, avg = index.stats()[f]
                held = lambda t: sum(t in d[f] for d in docs.values())  # noqa: E731, B023
                ends = sorted({x for d in docs.values() for x in d[f] if x.startswith(words[-1])})  # noqa: B023
                total = sum(se.idf(n, held(t)) for t in [*words[:-1], *ends])
                if tf:
                    score = se.PHRASE[f] * total * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / avg))
                    want[i] = max(want.get(i, 0), score)
        got = {r.id: r.score for r in se.phrase_prefix(index, words).collect()}
        assert got.keys() == want.keys() and all(abs(got[i] - s) < 1e-9 for i, s in want.items()), phrase


def test_postings_and_neighbours_are_written_without_sorting_rows(spark, tmp_path, rows):
    found = lambda: spark._jsparkSession.sharedState().statusStore().executionsList()
    before = found().size()
    index = SearchIndex(spark, f"file://{tmp_path}/a", buckets=4)
    index.rebuild(frame(spark, rows.values()))
    plans = [found().apply(i).physicalPlanDescription() for i in range(before, found().size())]
    made = [p for p in plans if "MapInArrow" in p and "InsertIntoHadoopFsRelationCommand" in p]
    assert len(made) == 2 and not [p for p in made if re.search(r"\bSort\b", p)]
    for table, column in (("postings", "term"), ("neighbours", "variant")):  # what is looked up lies in order in its file
        for file in (tmp_path / "a" / table).rglob("*.parquet"):
            values = [r[0] for r in spark.read.parquet(f"file://{file}").select(column).coalesce(1).collect()]
            assert values == sorted(values, key=str.encode)
