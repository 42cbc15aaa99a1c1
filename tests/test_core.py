"""Input and output pairs, state transitions and metamorphic properties of the engine."""

import datetime as dt
import gzip
import json

import pytest
from pyspark.sql import functions as F

from corvane.functions import status as st
from corvane.functions import text as tx
from corvane.functions import urls
from corvane.operators import documents as dx
from corvane.operators import frontier as fr
from corvane.operators import search as se
from corvane.sources import rules as ru
from corvane.sources import web

NOW = dt.datetime(2024, 1, 31)


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def lit(x):
    return F.lit(x).cast("string")


@pytest.mark.parametrize(("url", "want"), [
    ("https://example.com:443/page/?utm_source=test&id=1", "https://example.com/page?id=1"), ("https://example.com/?b=2&a=1", "https://example.com/?a=1&b=2"),
    ("https://example.com/a#fragment", "https://example.com/a"), ("ftp://example.com/file", None), ("HTTP://Example.COM", "http://example.com/"), ("https://e.com/?a=2&a=1&ab=0", "https://e.com/?a=1&a=2&ab=0"), (None, None), ("", None),
])
def test_normalize_url(spark, url, want):
    got = one(spark, urls.normalize(lit(url)))
    assert got == want
    assert got is None or one(spark, urls.normalize(lit(got))) == got


def test_url_parts(spark):
    assert one(spark, urls.display(lit("https://example.com/a/b/"))) == "example.com/a/b"
    assert one(spark, urls.host(lit("https://Docs.Example.com/path"))) == "docs.example.com"
    assert one(spark, urls.origin(lit("https://docs.example.com:8443/path?q=1"))) == "https://docs.example.com:8443"
    assert one(spark, urls.origin(lit("https://docs.example.com:443/path"))) == "https://docs.example.com"
    assert one(spark, urls.domain_input(lit("sub.example.com/docs"))) == "sub.example.com" and one(spark, urls.domain_input(lit(""))) is None
    assert one(spark, urls.in_scope(lit("docs.example.com"), lit("example.com"), lit("same_domain"))) is True
    assert one(spark, urls.in_scope(lit("example.net"), lit("example.com"), lit("same_domain"))) is False
    assert one(spark, urls.trusted_canonical(lit("https://other.com/x"), lit("https://example.com/x"))) is None
    assert one(spark, urls.network(lit("http://abc.onion/x"))) == "tor"


def test_text(spark):
    assert one(spark, tx.word_count(lit("one two   three"))) == 3 and one(spark, tx.word_count(lit(" "))) == 0
    assert one(spark, tx.derive_terms(lit("Big Data"), lit("data lakes and größe tiny"))) == ["data", "größe", "lakes", "tiny"]
    assert one(spark, tx.correct_spelling(lit("teh  Serach now"))) == "the search now" and one(spark, tx.correct_spelling(lit("the search"))) is None
    assert one(spark, tx.needs_script(lit("<article>" + "x" * 200), lit("x" * 200))) is False
    assert one(spark, tx.needs_script(lit('<div id="root"></div><script>'), lit(""))) is True
    stuffed = "spam " * 12
    assert one(spark, tx.is_spam(lit(stuffed))) is False
    assert one(spark, tx.is_spam(lit("buy. " * 12))) is True
    assert one(spark, tx.highlight(lit("The thesis"), "the these")) == "<mark>The</mark> <mark>the</mark>sis"


def test_status(spark):
    assert one(spark, st.failure_kind(F.lit(599))) == "network_error" and one(spark, st.failure_kind(F.lit(503))) == "http_5xx" and one(spark, st.failure_kind(F.lit(418))) == "http_418"
    assert [one(spark, st.backoff_seconds(F.lit(n))) for n in (0, 1, 2, 3)] == [30, 30, 120, 300]
    assert one(spark, st.origin_wait_seconds(F.lit(429), lit(None), F.lit(3), F.lit(120))) == 120
    assert one(spark, st.depth_priority(F.lit(0))) == 80 and one(spark, st.depth_priority(F.lit(12))) == 50


@pytest.mark.parametrize(("row", "want"), [
    ((304, None, None, True, None, 1, 3), "filtered"), ((200, "page_noindex", None, True, None, 1, 3), "filtered"), ((200, None, False, True, None, 1, 3), "filtered"), ((200, None, None, True, None, 1, 3), "succeeded"),
    ((200, None, None, False, None, 1, 3), "unindexable"), ((410, None, None, False, None, 1, 3), "gone"), ((599, "robots", None, False, None, 1, 3), "blocked"), ((200, "requires_js_render", None, False, None, 1, 3), "requires_js"),
    ((599, "network_error", None, False, None, 2, 3), "retry"), ((599, "network_error", None, False, None, 3, 3), "dead_letter"), ((418, None, None, False, None, 1, 3), "failed"),
])
def test_outcome(spark, row, want):
    df = spark.createDataFrame([row], "status_code int, error_kind string, llm_should_index boolean, indexable boolean, retryable boolean, attempt_count int, max_attempts int")
    assert df.select(st.outcome()).first()[0] == want


def test_claim_never_exceeds_concurrency(spark):
    jobs = [("a1", "A", "claimed", 80, 1, None, False), ("a2", "A", "queued", 80, 1, None, False), ("b1", "B", "queued", 80, 2, None, False), ("b2", "B", "queued", 77, 2, None, False), ("b3", "B", "queued", 77, 2, None, False),
            ("c1", "C", "queued", 80, 2, None, False), ("d1", "D", "queued", 80, 2, NOW + dt.timedelta(days=1), False), ("d2", "D", "queued", 80, 2, None, True)]
    df = spark.createDataFrame([(*j, NOW, "me") for j in jobs], "id string, origin_key string, status string, priority int, same_origin_concurrency int, next_retry_at timestamp_ntz, requires_js boolean, discovered_at timestamp_ntz, owner string")
    known = [(o, NOW + dt.timedelta(days=1 if o == "C" else -1), who) for o in "ABCD" for who in ("me", "you")]  # an origin that two owners know
    origins = spark.createDataFrame(known, "origin_key string, next_allowed_at timestamp_ntz, owner string")
    now = F.expr("timestamp_ntz'2024-01-31 00:00:00'")
    assert [r.id for r in fr.claim(df, origins, now, 10).collect()] == ["b1", "b2"]
    assert {r.id for r in fr.claim(df, origins, now, 10, with_js=True).collect()} == {"b1", "b2", "d2"}


def test_enqueue_budget(spark):
    found = spark.createDataFrame([("o", i, u, 3) for i, u in enumerate(["x", "x", "old", "y", "z"])], "owner string, position int, url string, max_pages int")
    known, used = spark.createDataFrame([("o", "old")], "owner string, url string"), spark.createDataFrame([("o", 1)], "owner string, used int")
    assert sorted(r.url for r in fr.enqueue(found, known, used).collect()) == ["x", "y"]


def test_stale_and_health(spark):
    now = F.expr("timestamp_ntz'2024-01-31 00:00:00'")
    rows = [("a", "claimed", NOW - dt.timedelta(seconds=301), 2, 3, None), ("b", "claimed", NOW - dt.timedelta(seconds=301), 3, 3, None), ("c", "claimed", NOW - dt.timedelta(seconds=299), 3, 3, None), ("d", "queued", None, 0, 3, NOW)]
    df = spark.createDataFrame(rows, "id string, status string, claimed_at timestamp_ntz, attempt_count int, max_attempts int, next_retry_at timestamp_ntz")
    retry = {r.id: r.next_retry_at for r in fr.requeue_stale(df, now, 300, "claimed", "claim_timeout").collect()}
    assert retry == {"a": NOW + dt.timedelta(seconds=30), "b": None, "c": None, "d": NOW}
    assert {r.id: r.status for r in fr.requeue_stale(df, now, 300, "claimed", "claim_timeout").collect()} == {"a": "queued", "b": "dead_letter", "c": "claimed", "d": "queued"}
    for fails, want in ((4, "healthy"), (5, "degraded"), (9, "degraded"), (10, "unhealthy")):
        ev = [("d", NOW + dt.timedelta(seconds=i), i, i == 0) for i in range(fails + 1)]
        e = spark.createDataFrame(ev, "domain string, at timestamp_ntz, id int, ok boolean")
        assert fr.domain_health(e).first().health == want
        ok = spark.createDataFrame([*ev, ("d", NOW + dt.timedelta(days=1), 99, True)], e.schema)
        assert fr.domain_health(ok).first().health == "healthy"


def test_duplicates_are_idempotent(spark):
    df = spark.createDataFrame([(1, "h", NOW, "u1"), (2, "h", NOW, "u2"), (3, "h", NOW - dt.timedelta(days=1), "u2"), (4, "g", NOW, "u3")], "id int, content_hash string, fetched_at timestamp_ntz, canonical_url string")
    marked = dx.mark_duplicates(df)
    assert {r.id: r.duplicate_of for r in marked.collect()} == {1: 3, 2: 3, 3: None, 4: None}
    assert marked.where("duplicate_of is null").count() == dx.mark_duplicates(marked.where("duplicate_of is null").drop("duplicate_of")).where("duplicate_of is null").count()
    assert {r.id for r in dx.latest_per_canonical(df).collect()} == {1, 2, 4}


def test_search_edges(spark):
    assert [se.edits(*x) for x in (("serach", "search"), ("ca", "abc"), ("a", ""), ("same", "same"))] == [1, 3, 1, 0]
    assert se.cache_key(se.SearchParams(" Ranking ")) == "search:ranking:10" and se.cache_key(se.SearchParams("x", lang="en")) is None
    with pytest.raises(ValueError):
        se.search(None, se.SearchParams(" "), None)
    df = spark.createDataFrame([(["beta", "alpha", "alps"],), (["alpha"],)], "suggest_input array<string>")
    assert [r[0] for r in se.suggest(df, " AL").collect()] == ["alpha", "alps"]


def test_html(spark):
    html = """<html><head><title>T &amp; x</title><meta name="robots" content="noindex, nofollow"><link rel="canonical" href="/c"></head><body><nav>menu</nav><p>Hello <b>there</b></p>
    <script>var x</script><div style="display: none">no</div><div class="navbox">no</div><a href="/docs#x">d</a><a href="mailto:x@y">m</a></body></html>"""
    p = web.parse_page("https://example.com/a", html)
    assert (p["title"], p["body"], p["links"], p["canonical"], p["noindex"], p["nofollow"]) == ("T & x", "Hello there d m", ["https://example.com/docs"], "https://example.com/c", True, True)
    assert web.parse_page("u", "<body>x<main>in</main></body>")["body"] == "in" and web.parse_page(None, None)["body"] == ""
    assert web.x_robots(["noindex", "ours: nofollow", "googlebot: none"], "ours") == {"noindex", "nofollow"}
    assert one(spark, web.detect_language(lit("the cat is in the house and it was to be"))) == "eng" and one(spark, web.detect_language(lit(""))) == "unknown"


def test_sitemaps():
    xml = "<urlset><url><loc> https://e.com/a\n</loc><priority>0.8</priority></url><url><loc>bad</loc></url><url><loc>https://e.com/b</loc></url>"
    assert [(e[0], e[3]) for e in web.parse_sitemap(xml)] == [("https://e.com/a", 0.8), ("https://e.com/b", None)]
    assert web.parse_sitemap(gzip.compress(b"<sitemapindex><sitemap><loc>https://e.com/s</loc></sitemap></sitemapindex>"))[0][4] == "index"
    assert web.parse_sitemap("<rss><channel><item><link>https://e.com/r</link></item></channel></rss>")[0][0] == "https://e.com/r"
    assert web.parse_sitemap('<feed xmlns="http://www.w3.org/2005/Atom"><entry><link href="https://e.com/t"/></entry></feed>')[0][0] == "https://e.com/t"
    assert web.parse_sitemap("nonsense") == [] and web.parse_sitemap(None) == []


def test_robots():
    r = web.Robots("User-agent: ours # us\nCrawl-delay: 5\nUser-agent: *\nCrawl-delay: 2\nDisallow: /private\nAllow: /private/open\nSitemap: https://e.com/b\nSitemap: https://e.com/a")
    assert r.delay("ours") == 5 and r.delay("other") == 2 and r.sitemaps == ["https://e.com/a", "https://e.com/b"]
    assert r.allowed("other", "/private/open/x") and not r.allowed("other", "/private/x") and r.allowed("ours", "/private/x")
    assert web.Robots("User-agent: ours\nDisallow: /x\nUser-agent: *\nCrawl-delay: 4").delay("ours") == 4  # its own group has none
    assert web.Robots("User-agent: a\nUser-agent: b\nCrawl-delay: 4").delay("b") == 4 and web.Robots("User-agent: a\nCrawl-delay: 4").delay("b") is None


def test_rules(spark):
    r = ru.RuleRegistry.from_toml('default = "deny"\n[[rules]]\nname = "docs"\naction = "index"\nhosts = ["e.com"]\npath_prefixes = ["/docs"]\n[[rules]]\nname = "tab"\naction = "discover_only"\nquery_values = ["tab=code"]')
    decide = lambda u: tuple(one(spark, r.decide(lit(u))))
    assert decide("https://e.com/docs/x") == ("index", "docs") and decide("https://e.com/docsx") == ("deny", None) and decide("https://x.com/?tab=code") == ("discover_only", "tab")
    with pytest.raises(ValueError):
        ru.RuleRegistry.from_toml('[[rules]]\nname = "x"\naction = "index"\nquery_values = ["tab"]')


def test_quota_and_rate(spark):
    df = spark.createDataFrame([(1, 7, NOW, " "), (2, 7, NOW, "q"), (3, 7, NOW, "q")], "id int, user_id int, ts timestamp_ntz, q string")
    assert [r.verdict for r in fr.quota_verdicts(df, 1).orderBy("id").collect()] == ["rejected", "served", "exceeded"]
    df = spark.createDataFrame([(i, "ip", NOW + dt.timedelta(seconds=i * 20)) for i in range(4)], "id int, ip string, ts timestamp_ntz")
    assert [r.allowed for r in fr.rate_verdicts(df, 2).orderBy("id").collect()] == [True, True, False, True]


def test_streaming_projection_replays_without_change(spark, tmp_path):
    from corvane.streaming import ingest

    body = " ".join(f"word{i}." if i % 9 == 0 else f"word{i}" for i in range(40))
    rows = [{"lease_id": "l", "job_id": f"j{i}", "url": f"https://e.com/{i}", "final_url": f"https://e.com/{i}", "status_code": code, "fetched_at": f"2024-01-0{i + 1} 00:00:00", "title": "t", "body": b, "attempt_count": 1, "max_attempts": 3}
            for i, (code, b) in enumerate([(200, body), (200, body), (404, None), (503, None), (200, "")])]
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text("\n".join(map(json.dumps, rows)))
    docs, jobs = (dx.Snapshots(spark, f"file://{tmp_path}/{n}") for n in ("docs", "jobs"))

    def run(n):
        ingest.start_projector(spark, f"file://{tmp_path}/in", docs, jobs, f"file://{tmp_path}/ck{n}").awaitTermination()
        return sorted(map(str, docs.read().collect())), sorted(map(str, jobs.read().collect()))

    first = run(1)
    assert {r.job_id: r.outcome for r in jobs.read().collect()} == {"j0": "succeeded", "j1": "succeeded", "j2": "gone", "j3": "retry", "j4": "unindexable"}
    assert docs.read().count() == 2 and docs.read().where("duplicate_of is not null").count() == 1
    assert run(2) == first


def test_windows_on_a_stream(spark, tmp_path):
    from corvane.streaming import ingest

    (tmp_path / "a.json").write_text("\n".join(json.dumps({"ts": f"2024-01-01T00:00:{s:02d}", "ip": "a", "user_id": 1}) for s in range(5)))
    stream = spark.readStream.schema("ts timestamp, ip string, user_id int").json(f"file://{tmp_path}")
    q = ingest.rate_windows(stream, limit=3).writeStream.format("memory").queryName("rates").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r["count"], r.over) for r in spark.table("rates").collect()] == [(5, True)]


def test_registry_has_an_oracle_for_what_sql_can_say():
    from corvane.plans import registry

    assert set(registry.QUERIES) - set(registry.ORACLES) == {"html_parse", "sitemap_parse", "robots_delay", "detect_lang"}


def test_entry_imports_without_the_corpus_operators(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).parents[1]
    shutil.copytree(root / "corvane", tmp_path / "corvane", ignore=lambda d, names: [n for n in names if n in ("llm", "__pycache__")])
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), 'pipeline' in e.queries())"], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin"})
    assert out.stdout.split()[1] == "False", out.stderr


def test_search_fuzzy_keeps_terms_with_other_letters_and_digits(spark, tmp_path):
    from corvane.plans import registry

    words = "étion çtion tioné tion2 tion thing thıng thin9 on ön nation tino".split()
    spark.createDataFrame([(i, w) for i, w in enumerate(words)], "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {tuple(r) for r in registry.search_fuzzy(spark, str(tmp_path)).collect()}
    want = {(q, w, se.edits(q, w)) for q in ("thing", "tion", "on") for w in words if se.edits(q, w) <= (0 if len(q) <= 2 else 1)}
    assert got == want and ("tion", "étion", 1) in got and ("tion", "tion2", 1) in got


def test_suggest_inputs_read_the_whole_text(spark, tmp_path):
    from corvane.plans import registry

    text = "title\n" + " ".join(f"word{i:05d}" for i in range(2500)) + " aardvark"
    spark.createDataFrame([(1, text, "en", "src1")], "doc_id bigint, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    assert registry.suggest_inputs(spark, str(tmp_path)).first().suggest_input.startswith("aardvark|")
    assert [r[0] for r in registry.se.suggest(registry.inputs(spark, str(tmp_path)), "aa").collect()] == ["aardvark"]


def test_a_writer_that_dies_before_its_pointer_leaves_the_table_whole(spark, tmp_path):
    table = dx.Snapshots(spark, f"file://{tmp_path}/t")
    assert table.version() is None
    assert table.write(spark.range(3)) == 1
    spark.range(9).write.parquet(f"file://{tmp_path}/t/{'0' * 32}")  # data without a pointer
    (tmp_path / "t/versions/_draft").write_text("0" * 32)
    assert table.version() == 1 and table.read().count() == 3
    for n in (2, 3, 4):
        assert table.write(spark.range(n)) == n
    assert table.read().count() == 4 and len([p for p in (tmp_path / "t/versions").iterdir() if p.name.isdigit()]) == 2


def test_projector_quarantines_and_never_goes_back(spark, tmp_path):
    from corvane.streaming import ingest

    body = " ".join(f"word{i}." if i % 9 == 0 else f"word{i}" for i in range(40))
    row = {"job_id": "j", "url": "https://e.com/", "final_url": "https://e.com/", "status_code": 200, "title": "new", "body": body, "attempt_count": 1, "max_attempts": 3}
    new, old, nameless = row | {"lease_id": "b", "fetched_at": "2024-01-02 00:00:00"}, row | {"lease_id": "a", "title": "old", "fetched_at": "2024-01-01 00:00:00"}, row | {"lease_id": None, "fetched_at": "2024-01-03 00:00:00"}
    docs, jobs = (dx.Snapshots(spark, f"file://{tmp_path}/{n}") for n in ("docs", "jobs"))
    (tmp_path / "in").mkdir()
    for n, lines in enumerate(([json.dumps(new), "{broken", json.dumps(nameless)], [json.dumps(old)])):
        (tmp_path / f"in/{n}.json").write_text("\n".join(lines))
        ingest.start_projector(spark, f"file://{tmp_path}/in", docs, jobs, f"file://{tmp_path}/ck", quarantine=f"file://{tmp_path}/bad").awaitTermination()
    assert [r.title for r in docs.read().collect()] == ["new"] and [r.lease_id for r in jobs.read().collect()] == ["b"]
    assert spark.read.parquet(f"file://{tmp_path}/bad").count() == 2


def test_an_offline_crawl_as_files(spark, tmp_path):
    from corvane.sources import batch

    root = f"file://{tmp_path}"
    (tmp_path / "seeds.json").write_text(json.dumps({"seeds": [{"name": "a", "url": "https://a.com/", "sitemap": "https://a.com/map"}, {"name": "b", "url": "https://b.com/"}]}))
    seeds = batch.read_seeds(spark, f"{root}/seeds.json")
    page = '<html><head><title>T</title></head><body><main><p>' + "some words here " * 30 + '</p><a href="https://b.com/">b</a><a href="/x">x</a><a href="/y">y</a></main></body></html>'
    pages = spark.createDataFrame([("https://a.com/", page)], "url string, html string")
    xml = "<urlset><url><loc>https://a.com/s1</loc></url><url><loc>https://a.com/s2</loc></url><url><loc>https://a.com/s3</loc></url></urlset>"
    maps = spark.createDataFrame([("https://a.com/map", bytearray(xml.encode()))], "url string, raw binary")
    found = [tuple(r) for r in batch.discover(seeds, pages, maps, 2).collect()]
    assert found == [("https://a.com/", "a"), ("https://a.com/s1", "a"), ("https://a.com/s2", "a"), ("https://a.com/x", "a"), ("https://a.com/y", "a"), ("https://b.com/", "b")]
    batch.write_frontier(spark.createDataFrame([(u, s, "2024-01-01") for u, s in found], batch.FRONTIER).coalesce(1), f"{root}/frontier")
    assert [r.url for r in batch.read_frontier(spark, f"{root}/frontier", 2).collect()] == [u for u, _ in found[:2]]
    (tmp_path / "crawl").mkdir()
    (tmp_path / "crawl/1.html").write_text(page)
    (tmp_path / "crawl/2.html").write_text("<html></html>")
    lines = [{"url": f"https://a.com/{i}", "fetched_at": "2024-01-01", "content_type": "text/html", "storage_path": f"{i}.html"} for i in (1, 2, 3)]
    (tmp_path / "crawl/manifest.jsonl").write_text("\n".join(map(json.dumps, lines)))
    built = batch.build_index(batch.read_pages(spark, f"{root}/crawl"))
    assert [(r.url, r.title, r.word_count >= 90) for r in built.collect()] == [("https://a.com/1", "T", True)]
    batch.write_index(built, f"{root}/index")
    assert batch.read_index(spark, f"{root}/index").count() == 1 and batch.read_index(spark, f"{root}/none").count() == 0
    (tmp_path / "array.json").write_text(json.dumps([{"id": "1"}, {"id": "2"}]))
    assert batch.read_index(spark, f"{root}/array.json").count() == 2


def test_a_response_has_totals_and_stops_at_the_deepest_page(spark):
    from corvane.plans import tables as t

    docs = t.docs(spark, "/root/testdata/sf0.001")
    page = se.respond(docs, se.SearchParams("the of", limit=5), t.now())
    assert len(page["results"]) == 5 and page["next_offset"] == 5 < page["total"] and page["did_you_mean"] is None
    scores = [r["score"] for r in page["results"]]
    assert scores == sorted(scores, reverse=True)
    last = se.respond(docs, se.SearchParams("the of", limit=20, offset=page["total"] - 3), t.now())
    assert len(last["results"]) == 3 and last["next_offset"] is None
    for p in (se.SearchParams("the", limit=20, offset=9990), se.SearchParams(" - ")):
        assert se.respond(docs, p, t.now())["results"] == []
    assert se.respond(docs, se.SearchParams("teh", offset=9999), t.now())["did_you_mean"] == "the"


def test_a_late_report_does_not_bring_a_document_back(spark, tmp_path):
    from corvane.streaming import ingest

    body = " ".join(f"word{i}." if i % 9 == 0 else f"word{i}" for i in range(40))
    row = {"url": "https://e.com/", "final_url": "https://e.com/", "title": "t", "attempt_count": 1, "max_attempts": 3}
    docs, jobs = (dx.Snapshots(spark, f"file://{tmp_path}/{n}") for n in ("docs", "jobs"))
    (tmp_path / "in").mkdir()
    for n, (day, code) in enumerate(((1, 200), (5, 404), (3, 200), (6, 200))):
        (tmp_path / f"in/{n}.json").write_text(json.dumps(row | {"lease_id": f"l{n}", "job_id": f"j{n}", "status_code": code, "fetched_at": f"2024-01-0{day} 00:00:00", "body": body if code == 200 else None}))
        ingest.start_projector(spark, f"file://{tmp_path}/in", docs, jobs, f"file://{tmp_path}/ck").awaitTermination()
        assert docs.read().count() == [1, 0, 0, 1][n]


def test_odd_documents_are_normalized_as_in_sql(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    from corvane.plans import registry

    wide = "\u00a0"
    texts = [None, "", " ", wide, "\nbody", f"{wide}title\u3000\nbody", " " * 230 + "far", "x" * 219 + wide + "tail", "x" * 219 + " tail", "a\x0bb c", f"a{wide}b c\r\nd", "y" * 8000 + " z"]
    rows = [(n, x, "en", "src0") for n, x in enumerate(texts)] + [(None, "no id", "en", "src0"), (0, "id again", "en", "src0"), (0, "id again", "en", "src0")]
    rows += [(100 + n, "\ntext", *x) for n, x in enumerate([(None, "src0"), ("en", None), ("", ""), (f" EN{wide}", " S0 "), ("İΣ", "u@h"), ("a?b=2&a=1&ref=x", "s:443"), ("f#g", "SRC")])]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, registry.QUERIES["doc_normalize"](spark, str(tmp_path)).collect()), key=str)
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert got == sorted(c.execute(registry.ORACLES["doc_normalize"]).fetchall(), key=str) and len(got) == len(rows)


def test_normalize_fills_what_is_missing_and_keeps_what_is_given(spark):
    rows = [("http://E.com/a/", None, None, " ", " ", "  body"), ("u", "HTTP://E.com/b/", " h ", "t", " s ", "b"), ("ftp://x", None, None, None, None, " ")]
    df = spark.createDataFrame([(n, *r, "EN", None, 7) for n, r in enumerate(rows)], "id int, url string, canonical_url string, host string, title string, snippet string, body string, language string, site_authority double, more int")
    got = [(r.canonical_url, r.host, r.title, r.snippet, r.more) for r in dx.normalize(df).orderBy("id").collect()]
    assert got == [("http://e.com/a", "e.com", "http://e.com/a", "body", 7), ("HTTP://E.com/b/", " h ", "t", "s", 7), ("ftp://x", None, "ftp://x", "", 7)]
