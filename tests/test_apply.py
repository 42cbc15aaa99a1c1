"""Reports applied to all tables at once, against a plain version over dicts; crashes, replays, late reports, maintenance."""

import datetime as dt
import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from corvane.operators.store import Change, Table, Tables, ranked
from corvane.plans import applied as made
from corvane.streaming import apply as ap

T0 = dt.datetime(2024, 1, 1)
NOW = dt.datetime(2024, 1, 31)
BODY = {k: " ".join(f"{k}{i}." if i % 9 == 0 else f"{k}{i}" for i in range(40)) for k in "abcdefgh"}


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def now():
    return F.lit(NOW).cast("timestamp_ntz")


def new_job(owner, url, **more):
    base = {f.split()[0]: None for f in ap.JOB.split(", ")}
    host = url.split("/")[2]
    return base | {"id": sha(f"{owner}\n{url}"), "owner": owner, "url": url, "origin_key": f"https://{host}", "status": "ingesting", "lease_id": "l", "claimed_at": T0, "attempt_count": 1, "max_attempts": 3, "depth": 0, "max_depth": 1, "budget_id": "b", "max_pages": 6,
                   "discovery_scope": "same_domain", "discovery_host": host, "same_origin_concurrency": 1, "max_discovered": 3, "priority": 80, "requires_js": False, "network": "clearnet", "discovered_at": T0} | more


def new_report(job, at, **more):
    base = {f.split()[0]: None for f in ap.REPORT.replace("array<string>", "x").split(", ")}
    return base | {"job_id": job["id"], "lease_id": "l", "url": job["url"], "status_code": 200, "fetched_at": T0 + dt.timedelta(hours=at), "title": "t", "language": "EN "} | more


def rows(spark, dicts, ddl):
    names = spark.createDataFrame([], ddl).schema.names
    return spark.createDataFrame([tuple(d[n] for n in names) for d in dicts], ddl)


def load(spark, tables, jobs, origins=()):
    tables.commit({"jobs": Change(rows(spark, jobs, ap.JOB)), "origins": Change(rows(spark, origins, ap.TABLES["origins"].columns))})


def listed(spark, *domains):
    return spark.createDataFrame([(d,) for d in domains], "domain string")


def state(tables):
    return {n: sorted(map(str, tables.read(n).collect())) for n in tables.tables}


def test_tables_change_together_or_not_at_all(spark, tmp_path):
    shape = {"a": Table("k int, v string", ("k",)), "log": Table("v string")}
    t = Tables(spark, f"file://{tmp_path}", shape, buckets=4)
    frame = lambda *x: spark.createDataFrame(list(x), "k int, v string")
    assert t.read("a").count() == 0 and t.commit({"a": Change(frame(*[(i, "x") for i in range(40)])), "log": Change(frame((1, "one")).select("v"))}, {"s": 1}) == 1
    files = {p.name for p in (tmp_path / "a").iterdir()}
    t.commit({"a": Change(frame((1, "y"), (50, "z")), frame((2, ""), (1, ""), (99, "")).select("k")), "log": Change(frame((1, "two")).select("v"))})
    got = {r.k: r.v for r in t.read("a").collect()}
    assert got == {i: "x" for i in range(40) if i != 2} | {1: "y", 50: "z"} and sorted(r.v for r in t.read("log").collect()) == ["one", "two"] and t.note() == {"s": 1}
    assert files < {p.name for p in (tmp_path / "a").iterdir()}  # untouched buckets stay where they are
    late, flip = Tables(spark, f"file://{tmp_path}", shape), t.manifest.commit
    t.manifest.commit = lambda *x: (_ for _ in ()).throw(OSError("gone"))
    with pytest.raises(OSError):
        t.commit({"a": Change(frame((1, "lost"))), "log": Change(frame((1, "lost")).select("v"))})
    assert {r.k: r.v for r in late.read("a").collect()} == got and late.read("log").count() == 2
    t.manifest.commit = lambda said, after: (late.commit({"log": Change(frame((1, "three")).select("v"))}), flip(said, after))[1]
    with pytest.raises(RuntimeError):
        t.commit({"a": Change(frame((1, "lost")))})
    assert {r.k: r.v for r in t.read("a").collect()} == got and t.read("log").count() == 3


def test_ranks_without_sorting_a_group_in_one_task(spark, tmp_path):
    t = Tables(spark, f"file://{tmp_path}", {})
    data = [(i % 3 if i % 5 else 0, (i * 7919) % 1000, i) for i in range(600)]
    got = ranked(t, spark.createDataFrame(data, "g int, x int, i int").repartition(5), ["g"], [F.col("x").desc(), F.col("i")])
    want = {}
    for g in range(3):
        for nth, r in enumerate(sorted((d for d in data if d[0] == g), key=lambda d: (-d[1], d[2])), 1):
            want[r[2]] = nth
    assert {r.i: r.nth for r in got.collect()} == want


def test_jobs_origins_domains_and_links(spark, tmp_path):
    t = ap.open_tables(spark, f"file://{tmp_path}", buckets=2)
    j = [new_job("o", f"https://e.com/{i}") for i in range(9)] + [new_job("o", "https://bad.org/x"), new_job("o", "https://e.com/held", lease_id="other"), new_job("o", "https://e.com/idle", status="queued")]
    j[6]["attempt_count"] = 3
    j[1]["depth"] = 1
    load(spark, t, j, [{"owner": "o", "origin_key": "https://e.com", "next_allowed_at": T0, "in_flight_count": 20, "consecutive_failures": 4, "last_status": None, "crawl_delay": 7, "last_request_at": None}])
    found = ["https://e.com/0?utm_source=x", "https://sub.e.com/new/", "https://other.net/", "https://ads.bad.org/", "https://e.com/n1#f", "https://e.com/n2", "https://e.com/n3"]
    r = [
        new_report(j[0], 1, body=BODY["a"], discovered_urls=found, title=" T "), new_report(j[1], 2, body=BODY["b"], discovered_urls=found), new_report(j[2], 3, status_code=503), new_report(j[3], 4, status_code=404),
        new_report(j[4], 5, status_code=403), new_report(j[5], 6, error_kind="requires_js_render"), new_report(j[6], 7, status_code=599, error_kind="network_error", error_message="no route"), new_report(j[7], 8, status_code=200, body=""),
        new_report(j[8], 9, status_code=429, retry_after=900, final_url="https://moved.net/z"), new_report(j[9], 1, body=BODY["c"], discovered_urls=found), new_report(j[10], 1, body=BODY["d"]), new_report(j[11], 1, body=BODY["d"]),
        new_report(j[0], 1.5, status_code=500), new_report(j[0] | {"id": "nobody"}, 1), new_report(j[1] | {"url": "https://e.com/wrong"}, 1),
    ]
    assert ap.apply_reports(t, rows(spark, r, ap.REPORT), listed(spark, "bad.org"), now(), ("s", 0)) == {"applied": 10, "rejected": 4}
    jobs = {x.url: x for x in t.read("jobs").collect()}
    want = ["succeeded", "succeeded", "queued", "failed", "blocked", "queued", "dead_letter", "failed", "queued"]
    assert [jobs[f"https://e.com/{i}"].status for i in range(9)] == want and jobs["https://bad.org/x"].status == "succeeded" and jobs["https://bad.org/x"].document_id is None
    assert jobs["https://e.com/held"].status == "ingesting" and jobs["https://e.com/idle"].status == "queued"
    assert jobs["https://e.com/2"].next_retry_at == T0 + dt.timedelta(hours=3, seconds=30) and jobs["https://e.com/2"].lease_id is None and jobs["https://e.com/5"].requires_js
    assert jobs["https://e.com/6"].failure_message == "no route; retries exhausted" and jobs["https://e.com/7"].failure_kind == "unindexable_document" and jobs["https://e.com/0"].document_id == sha("https://e.com/0")
    # the first three links in scope of page 0: itself is known, page 1 is at its depth's end
    assert {u for u in jobs if u not in {x["url"] for x in j}} == {"https://sub.e.com/new", "https://e.com/n1"}
    assert (jobs["https://sub.e.com/new"].depth, jobs["https://sub.e.com/new"].priority, jobs["https://sub.e.com/new"].source) == (1, 77, "https://e.com/0")
    assert {(x.source, x.target) for x in t.read("links").collect()} == {("https://e.com/0", u) for u in ("https://e.com/0?utm_source=x", "https://sub.e.com/new/", "https://e.com/n1#f")}
    assert [(x.owner, x.budget_id, x.used) for x in t.read("budgets").collect()] == [("o", "b", 2)]
    origins = {x.origin_key: x for x in t.read("origins").collect()}
    e = origins["https://e.com"]  # nine of its jobs reported; the last that wasn't trouble came at hour 8
    assert (e.in_flight_count, e.consecutive_failures, e.crawl_delay, e.last_status, e.next_allowed_at) == (11, 1, 7, 429, T0 + dt.timedelta(hours=9, seconds=900))
    assert origins["https://moved.net"].consecutive_failures == 1 and origins["https://moved.net"].in_flight_count == 0 and origins["https://sub.e.com"].next_allowed_at == NOW and origins["https://bad.org"].in_flight_count == 0
    d = {x.domain: x for x in t.read("domains").collect()}["e.com"]
    assert (d.pages, d.failed, d.streak, d.health, d.checks, d.changes, d.hours) == (2, 3, 3, "healthy", 2, 2, 168.0)
    assert sorted(x.kind for x in t.read("events").collect()) == sorted(["job-succeeded", "job-succeeded", "job-requeued", "job-gone", "job-blocked", "job-requires-js", "job-dead-lettered", "job-failed", "job-requeued", "job-filtered"])
    before = state(t)
    assert ap.apply_reports(t, rows(spark, r, ap.REPORT), listed(spark, "bad.org"), now(), ("s", 0)) == {"applied": 0, "rejected": 0}
    assert ap.apply_reports(t, rows(spark, r, ap.REPORT), listed(spark, "bad.org"), now())["applied"] == 0  # no job is held any more
    after = state(t)
    assert {n: after[n] for n in after if n != "events"} == {n: before[n] for n in before if n != "events"}


def test_domains_go_on_from_what_is_stored(spark, tmp_path):
    t = ap.open_tables(spark, f"file://{tmp_path}", buckets=2)
    j = [new_job("o", f"https://e.com/{i}") for i in range(12)]
    load(spark, t, j)
    none = listed(spark)
    batches = ([404] * 4, [404], [404] * 5, [200, 404])
    for batch, codes in enumerate(batches):
        done = sum(map(len, batches[:batch]))
        r = [new_report(j[done + i], done + i, status_code=c, body=BODY["a"] if c == 200 else None) for i, c in enumerate(codes)]
        ap.apply_reports(t, rows(spark, r, ap.REPORT), none, now())
        d = t.read("domains").first()
        assert (d.streak, d.health) == [(4, "healthy"), (5, "degraded"), (10, "unhealthy"), (1, "healthy")][batch]


class Plain:
    """The rules of document_changes, a batch at a time, over dicts."""

    def __init__(self):
        self.docs, self.winners, self.addresses = {}, {}, {}

    def batch(self, said):
        told = {}
        for s in sorted((s for s in said if s["what"] != "same"), key=lambda s: (s["at"], s["what"])):
            told[s["id"]] = s
        told = {i: s for i, s in told.items() if i not in self.docs or s["at"] >= self.docs[i]["at"]}
        old = dict(self.docs)
        for i, s in told.items():
            h = old.get(i, {}).get("hash")
            if h and (s["what"] == "gone" or s["hash"] != h) and self.winners.get(h) == i:
                del self.winners[h]
            for a in [a for a, x in self.addresses.items() if x == i]:
                del self.addresses[a]
        live = {i: s for i, s in told.items() if s["what"] == "seen"}
        for i, s in sorted(live.items(), key=lambda x: (x[1]["at"], x[0])):
            self.winners.setdefault(s["hash"], i)
        for i, s in told.items():
            self.docs[i] = {"gone": True, "at": s["at"]} if s["what"] == "gone" else s | {"gone": False, "dup": None if self.winners[s["hash"]] == i else self.winners[s["hash"]]}
        for i, s in live.items():
            if not self.docs[i]["dup"]:
                there = [i, *([self.addresses[s["url"]]] if s["url"] in self.addresses else [])]
                self.addresses[s["url"]] = max(there, key=lambda x: (self.docs[x]["at"], x))
                for x in set(there) - {self.addresses[s["url"]]}:
                    if self.winners.get(self.docs[x]["hash"]) == x:
                        del self.winners[self.docs[x]["hash"]]
                    self.docs[x] = {"gone": True, "at": self.docs[self.addresses[s["url"]]]["at"]}
        for s in said:
            d = self.docs.get(s["id"])
            if s["what"] == "same" and d and not d["gone"] and s["id"] not in told and s["at"] > d["at"]:
                self.docs[s["id"]] = d | {"at": s["at"]}

    def state(self):
        return {(i, d["at"], d["gone"], d.get("dup")) for i, d in self.docs.items()}, set(self.winners.items()), set(self.addresses.items())


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_documents_follow_the_rules(spark, tmp_path, seed):
    rng, plain = random.Random(seed), Plain()
    t = ap.open_tables(spark, f"file://{tmp_path}", buckets=3)
    kind = "id string, canonical_url string, host string, title string, snippet string, body string, language string, content_hash string, fetched_at timestamp_ntz, what string"
    for _ in range(4):
        said = []
        for _ in range(14):
            what, i = rng.choice(["seen"] * 6 + ["gone", "same"]), rng.randint(0, 9)
            said.append({"id": f"d{i}", "url": f"u{i // 2 if rng.random() < 0.3 else i + 100}", "hash": f"h{rng.randint(0, 4)}", "at": T0 + dt.timedelta(minutes=rng.randint(0, 400), microseconds=len(said)), "what": what})
        # two documents of a batch at one address: the order between them would matter
        seen = set()
        said = [s for s in said if not (s["what"] == "seen" and (s["url"], "x") in seen) and not seen.add((s["url"], "x"))]
        frame = spark.createDataFrame([(s["id"], *((s["url"], "h", "t", "s", "b", "en", s["hash"]) if s["what"] == "seen" else (None,) * 7), s["at"], s["what"]) for s in said], kind)
        t.commit(ap.document_changes(t, t.stage(frame)))
        plain.batch(said)
        got = ({(r.id, r.fetched_at, r.gone, r.duplicate_of) for r in t.read("documents").collect()}, {(r.content_hash, r.id) for r in t.read("winners").collect()}, {(r.canonical_url, r.id) for r in t.read("addresses").collect()})
        assert got == plain.state()


def test_a_late_report_does_not_bring_a_document_back(spark, tmp_path):
    t = ap.open_tables(spark, f"file://{tmp_path}", buckets=2)
    j = [new_job(o, "https://e.com/x") for o in ("a", "b", "c")]
    load(spark, t, j)
    for k, (day, code) in enumerate(((1, 200), (5, 404), (3, 200))):
        ap.apply_reports(t, rows(spark, [new_report(j[k], 24 * day, status_code=code, body=BODY["a"] if code == 200 else None)], ap.REPORT), listed(spark), now(), ("s", k))
        alive = t.read("documents").where("NOT gone").count()
        assert alive == [1, 0, 0][k]


def test_a_stream_of_reports(spark, tmp_path):
    t = ap.open_tables(spark, f"file://{tmp_path}/t", buckets=2)
    j = [new_job("o", f"https://e.com/{i}") for i in range(4)]
    load(spark, t, j)
    (tmp_path / "in").mkdir()
    for n in range(2):
        lines = [new_report(j[2 * n + i], i, body=BODY["ab"[i]]) | {"discovered_urls": []} for i in range(2)]
        (tmp_path / f"in/{n}.json").write_text("\n".join(json.dumps(x, default=lambda d: d.isoformat(" ")) for x in lines))
    stream = spark.readStream.schema(ap.REPORT).option("maxFilesPerTrigger", 1).json(f"file://{tmp_path}/in")
    for check in ("c1", "c1", "c2"):  # the second has nothing to do, the third comes again from the start
        ap.start(spark, stream, t, listed(spark), "reports", f"file://{tmp_path}/{check}", now()).awaitTermination()
        assert {r.status for r in t.read("jobs").collect()} == {"succeeded"} and t.read("documents").where("duplicate_of IS NULL").count() == 2 and t.read("events").count() == 4


def test_maintenance_in_its_order(spark, tmp_path):
    t = ap.open_tables(spark, f"file://{tmp_path}", buckets=2)
    old = NOW - dt.timedelta(seconds=400)
    j = [new_job("o", "https://e.com/done", status="succeeded", document_id=sha("https://e.com/done")), new_job("o", "https://e.com/stuck", status="claimed", claimed_at=old), new_job("o", "https://e.com/spent", status="ingesting", claimed_at=old, attempt_count=3),
         new_job("o", "https://e.com/busy", status="claimed", claimed_at=NOW), new_job("o", "https://bad.org/q", status="queued"), new_job("o", "https://bad.org/c", status="claimed", claimed_at=NOW), new_job("p", "https://x.bad.org/", status="queued")]
    origin = lambda o, h, n: {"owner": o, "origin_key": f"https://{h}", "next_allowed_at": T0, "in_flight_count": n, "consecutive_failures": 0, "last_status": None, "crawl_delay": None, "last_request_at": None}
    load(spark, t, j, [origin("o", "e.com", 3), origin("o", "bad.org", 1), origin("p", "x.bad.org", 0)])
    doc = {f.name: None for f in t.read("documents").schema}
    docs = [doc | {"id": sha(f"https://{u}"), "canonical_url": f"https://{u}", "host": u.split("/")[0], "content_hash": u, "fetched_at": NOW - dt.timedelta(days=d), "gone": False} for u, d in (("e.com/done", 9), ("e.com/new", 1), ("bad.org/d", 1))]
    t.commit({"documents": Change(rows(spark, docs, ap.TABLES["documents"].columns)), "winners": Change(spark.createDataFrame([(d["content_hash"], d["id"]) for d in docs], "content_hash string, id string")),
              "addresses": Change(spark.createDataFrame([(d["canonical_url"], d["id"], d["fetched_at"]) for d in docs], "canonical_url string, id string, fetched_at timestamp_ntz")),
              "events": Change(spark.createDataFrame([("o", "k", "ok", "m", f"u{i}", T0 + dt.timedelta(minutes=i)) for i in range(9)], ap.TABLES["events"].columns))})
    rules = spark.createDataFrame([("r1", "o", "https://e.com/seed", True, 60, None, 1, 5, 1, "same_domain", None, 5), ("r2", "o", "https://e.com/off", False, 60, None, 1, 5, 1, "same_domain", None, 5), ("r3", "o", "https://e.com/done", True, 60, NOW - dt.timedelta(minutes=5), 1, 5, 1, "same_domain", None, 5)],
                                  "id string, owner string, seed_url string, enabled boolean, interval_minutes int, last_enqueued_at timestamp_ntz, max_depth int, max_pages int, same_origin_concurrency int, discovery_scope string, discovery_host string, max_discovered int")
    stamped = ap.maintain(t, rules, listed(spark, "bad.org"), now(), keep_events=4)
    assert {r.id: r.last_enqueued_at for r in stamped.collect()} == {"r1": NOW, "r2": None, "r3": NOW - dt.timedelta(minutes=5)}
    got = {r.url: r for r in t.read("jobs").collect()}
    assert {u: r.status for u, r in got.items()} == {"https://e.com/done": "queued", "https://e.com/stuck": "queued", "https://e.com/spent": "dead_letter", "https://e.com/busy": "claimed", "https://bad.org/c": "claimed", "https://e.com/seed": "queued"}
    assert got["https://e.com/done"].source == "recrawl" and got["https://e.com/stuck"].next_retry_at == NOW + dt.timedelta(seconds=30) and got["https://e.com/spent"].failure_kind == "ingest_timeout"
    assert {(r.owner, r.origin_key): r.in_flight_count for r in t.read("origins").collect()} == {("o", "https://e.com"): 1, ("o", "https://bad.org"): 1}
    assert {r.canonical_url for r in t.read("documents").where("NOT gone").collect()} == {"https://e.com/done", "https://e.com/new"} == {r.canonical_url for r in t.read("addresses").collect()} and t.read("winners").count() == 2
    assert sorted(r.url for r in t.read("events").collect()) == ["u5", "u6", "u7", "u8"]


def page(url, word):
    return url, f"<html><head><title>{word}</title></head><body>" + " ".join(f"{word}{i}." if i % 9 == 0 else f"{word}{i}" for i in range(40)) + "</body></html>"


def test_pages_that_share_an_address_have_a_row_each_as_in_sql(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    # by number 3 and 10 are gone, the others are fetched
    data = {15: page("https://a.com/x", "f"), 3: page("https://a.com/x", "g"), 4: page("https://a.com/y", "h"), 10: page("https://a.com/y", "i"), 8: page("https://b.com/", "j"), 14: page("https://b.com/", "k"), 1: page("https://c.com/", "l"), 16: page("https://d.com/", "l")}
    spark.createDataFrame([(i, *x) for i, x in data.items()], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted(map(tuple, made.apply_documents(spark, str(tmp_path)).collect()), key=str)
    from corvane.plans import registry

    c = duckdb.connect()
    c.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    want = sorted(c.execute(registry.ORACLES["apply_documents"]).fetchall(), key=str)
    assert got == want and len(want) == 8 and any(r[2] for r in want)


def plans(spark):
    """What Spark has run so far, by number."""
    found = spark._jsparkSession.sharedState().statusStore().executionsList()
    return {found.apply(i).executionId(): found.apply(i).physicalPlanDescription() for i in range(found.size())}


def test_no_side_of_a_join_goes_through_the_driver(spark, tmp_path):
    t = ap.open_tables(spark, f"file://{tmp_path}", buckets=2)
    j = [new_job("o", f"https://e.com/{i}") for i in range(4)]
    load(spark, t, j)
    sizes = [spark.conf.get(k, None) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")]
    before = plans(spark)
    for n in range(2):
        r = [new_report(j[2 * n + i], i, body=BODY["ab"[i]], discovered_urls=["https://e.com/n"]) for i in range(2)]
        ap.apply_reports(t, rows(spark, r, ap.REPORT), listed(spark, "bad.org"), now())
    ran = {n: p for n, p in plans(spark).items() if n not in before}
    assert sum("Join" in p for p in ran.values()) > 20 and not [p for p in ran.values() if "Broadcast" in p]
    assert sizes == [spark.conf.get(k, None) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")]
