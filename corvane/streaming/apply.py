"""Crawl reports applied to all tables at once: jobs, origins, budgets, documents, their duplicates and addresses, links, domains and
events change in one commit, bucket by bucket, or not at all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import status as st
from ..functions import text as tx
from ..functions import urls
from ..operators import frontier as fr
from ..operators import housekeeping as hk
from ..operators.documents import filled, gate
from ..operators.store import Change, Table, Tables, merged_joins, ranked

JOB = (
    "id string, owner string, url string, origin_key string, status string, lease_id string, claimed_at timestamp_ntz, attempt_count int, max_attempts int, depth int, max_depth int, "
    "budget_id string, max_pages int, discovery_scope string, discovery_host string, same_origin_concurrency int, max_discovered int, priority int, requires_js boolean, source string, "
    "network string, discovered_at timestamp_ntz, next_retry_at timestamp_ntz, failure_kind string, failure_message string, finished_at timestamp_ntz, final_url string, http_status int, "
    "discovered_count int, document_id string, decision string"
)
TABLES = {
    "jobs": Table(JOB, ("id",)),
    "budgets": Table("owner string, budget_id string, used long", ("owner", "budget_id")),
    "origins": Table("owner string, origin_key string, next_allowed_at timestamp_ntz, in_flight_count long, consecutive_failures long, last_status int, crawl_delay long, last_request_at timestamp_ntz", ("owner", "origin_key")),
    # a row with `gone` is a tombstone: it keeps the time after which a report must have been made to bring the document back
    "documents": Table("id string, canonical_url string, host string, title string, snippet string, body string, language string, content_hash string, fetched_at timestamp_ntz, duplicate_of string, gone boolean", ("id",)),
    "winners": Table("content_hash string, id string", ("content_hash",)),
    "addresses": Table("canonical_url string, id string, fetched_at timestamp_ntz", ("canonical_url",)),
    "links": Table("source string, target string, discovered_at timestamp_ntz", ("source", "target")),
    "domains": Table("domain string, pages long, failed long, streak long, health string, checks long, changes long, hours double, last_success_at timestamp_ntz, last_failure_at timestamp_ntz", ("domain",)),
    "events": Table("owner string, kind string, status string, message string, url string, created_at timestamp_ntz"),
}
REPORT = (
    "job_id string, lease_id string, url string, final_url string, status_code int, fetched_at timestamp_ntz, title string, snippet string, body string, language string, error_kind string, error_message string, "
    "canonical_hint string, discovered_urls array<string>, llm_should_index boolean, llm_should_discover boolean, retryable boolean, crawl_delay long, retry_after long"
)
# fixed values: statuses of jobs, kinds of events
JOB_STATUS = {"succeeded": "succeeded", "filtered": "succeeded", "retry": "queued", "requires_js": "queued", "blocked": "blocked", "unindexable": "failed", "failed": "failed", "gone": "failed", "dead_letter": "dead_letter"}
EVENT = {"succeeded": "job-succeeded", "filtered": "job-filtered", "retry": "job-requeued", "requires_js": "job-requires-js", "blocked": "job-blocked", "unindexable": "job-failed", "failed": "job-failed", "gone": "job-gone", "dead_letter": "job-dead-lettered"}
FAILURES = ("unindexable", "failed", "gone", "dead_letter")
TERMINAL = ("succeeded", "failed", "blocked", "dead_letter")


def open_tables(spark: SparkSession, root: str, buckets: int = 16) -> Tables:
    return Tables(spark, root, TABLES, buckets)


def job_id(owner: Column, url: Column) -> Column:
    """A job is an address of an owner."""
    return F.sha2(F.concat_ws("\n", owner, url), 256)


def by(mapping: dict, c: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv]), c)


def listed(rows: DataFrame, id: str, hosts: list[Column], domains: DataFrame) -> DataFrame:
    """ids of the rows one of whose hosts is a domain of the list or below one, met by equal suffixes."""
    every = rows.select(id, F.explode(F.array_distinct(F.flatten(F.array(*[F.coalesce(hk.suffixes(h), F.array().cast("array<string>")) for h in hosts])))).alias("domain"))
    return every.join(domains.select(F.lower("domain").alias("domain")).distinct(), "domain", "left_semi").select(id).distinct()


def last(rows: DataFrame, key: list[str], *order: str, largest: bool = True) -> DataFrame:
    """One row of each key, the last (or first) in the order, by an aggregation."""
    pick = (F.max_by if largest else F.min_by)(F.struct(*rows.columns), F.struct(*order))
    return rows.groupBy(*[F.col(k).alias(f"_{k}") for k in key]).agg(pick.alias("x")).select("x.*")


def enqueue(tables: Tables, found: DataFrame, domains: DataFrame, now: Column, jobs: DataFrame | None = None, revisit: bool = False) -> dict[str, Change]:
    """Addresses to fetch, as changes of jobs, budgets and origins. found: owner, position (an orderable struct), url, source, depth,
    max_depth, budget_id, max_pages, same_origin_concurrency, discovery_scope, discovery_host, max_discovered. In order of position:
    addresses that can't be normalised and those on the list are passed over, an address that the owner has is no news (with
    `revisit`, one whose job is over is taken anew), and each new one takes a page of its budget while there is any.
    jobs: the stored ones that could be meant, if they are known."""
    rows = found.withColumn("url", urls.normalize(F.col("url"))).withColumn("origin_key", urls.origin(F.col("url"))).where("url IS NOT NULL AND origin_key IS NOT NULL")
    rows = rows.withColumn("id", job_id(F.col("owner"), F.col("url")))
    rows = tables.stage(last(rows, ["id"], "position", largest=False))
    rows = rows.join(listed(rows, "id", [urls.host(F.col("url"))], domains), "id", "left_anti")
    known = (tables.read("jobs", near=rows) if jobs is None else jobs).select("id", "status")
    again = known.where(F.col("status").isin(*TERMINAL)).select("id", F.lit(1).alias("again")) if revisit else known.where("false").select("id", F.lit(1).alias("again"))
    new = rows.join(known.join(again, "id", "left_anti"), "id", "left_anti").join(again, "id", "left")
    budgets = tables.read("budgets", near=rows)
    counted = ranked(tables, new, ["owner", "budget_id"], [F.col("position")]).join(budgets, ["owner", "budget_id"], "left")
    fits = tables.stage(counted.where(F.col("nth") <= F.greatest("max_pages", F.lit(1)) - F.coalesce("used", F.lit(0))))
    jobs_new = fits.select(
        "id", "owner", "url", "origin_key", F.lit("queued").alias("status"), F.lit(0).alias("attempt_count"), F.lit(3).alias("max_attempts"), "depth", "max_depth", "budget_id", "max_pages", "discovery_scope",
        F.coalesce("discovery_host", urls.host(F.col("url"))).alias("discovery_host"), F.greatest("same_origin_concurrency", F.lit(1)).alias("same_origin_concurrency"), F.greatest("max_discovered", F.lit(1)).alias("max_discovered"),
        st.depth_priority(F.col("depth")).alias("priority"), F.lit(False).alias("requires_js"), "source", urls.network(F.col("url")).alias("network"), now.alias("discovered_at"),
    )
    spent = fits.groupBy("owner", "budget_id").agg((F.count("*") - F.count("again")).alias("more"))
    budgets_new = spent.join(budgets, ["owner", "budget_id"], "left").select("owner", "budget_id", (F.col("more") + F.coalesce("used", F.lit(0))).alias("used"))
    keys = fits.select("owner", "origin_key").distinct()
    origins_new = keys.join(tables.read("origins", near=keys), ["owner", "origin_key"], "left_anti").select("*", now.alias("next_allowed_at"), F.lit(0).cast("long").alias("in_flight_count"), F.lit(0).cast("long").alias("consecutive_failures"))
    return {"jobs": Change(complete(jobs_new, "jobs")), "budgets": Change(budgets_new), "origins": Change(complete(origins_new, "origins"))}


def complete(rows: DataFrame, name: str) -> DataFrame:
    """Rows with all of a table's columns in order; those they lack are null."""
    kinds = rows.sparkSession.createDataFrame([], TABLES[name].columns).schema
    return rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in kinds])


def judge(tables: Tables, reports: DataFrame, domains: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The reports that count, with their job's columns and an outcome, and the others. A report counts if its job is held under its
    lease and for its address; the first of a lease counts. A page of a listed domain is filtered, whatever else it says."""
    jobs = tables.read("jobs", near=reports.select(F.col("job_id").alias("id"))).select(
        F.col("id").alias("job_id"), F.col("lease_id").alias("_lease"), F.col("url").alias("_url"), F.col("status").alias("_status"), "owner", "origin_key", "attempt_count", "max_attempts", "depth", "max_depth",
        "budget_id", "max_pages", "discovery_scope", "discovery_host", "same_origin_concurrency", "max_discovered",
    )
    fits = F.col("_status").isin("claimed", "ingesting") & (F.col("_lease") == F.col("lease_id")) & (F.col("_url") == F.col("url")) & F.col("fetched_at").isNotNull()
    met = reports.join(jobs, "job_id", "left").withColumn("_fits", F.coalesce(fits, F.lit(False)))
    good = last(met.where("_fits"), ["job_id"], "fetched_at", "status_code", "final_url", largest=False).drop("_fits", "_lease", "_url", "_status")
    good = good.withColumn("final_url", F.coalesce("final_url", "url"))
    off = listed(good, "job_id", [urls.host(F.col("url")), urls.host(F.col("final_url"))], domains).withColumn("off", F.lit(True))
    good = good.withColumn("indexable", gate(good) & ~F.coalesce(tx.is_spam(F.col("body")), F.lit(True))).join(off, "job_id", "left")
    return good.withColumn("outcome", F.when(F.col("off"), "filtered").otherwise(st.outcome())), met.where("NOT _fits")


def document_rows(c: DataFrame) -> DataFrame:
    """What reports say of documents: their new state, that they are gone (under any of their addresses), or that they haven't changed."""
    final = F.col("final_url")
    canonical = F.coalesce(urls.trusted_canonical(F.col("canonical_hint"), final), urls.normalize(final), final)
    seen = c.where("outcome = 'succeeded'").select(
        F.sha2(final, 256).alias("id"), canonical.alias("canonical_url"), urls.host(canonical).alias("host"), F.trim("title").alias("title"), F.left(filled(F.col("snippet"), F.col("body")), F.lit(220)).alias("snippet"),
        F.left("body", F.lit(8000)).alias("body"), F.lower(F.trim("language")).alias("language"), F.sha2(F.col("body").cast("binary"), 256).alias("content_hash"), "fetched_at", F.lit("seen").alias("what"),
    )
    lost = c.where("outcome = 'gone'").select(F.explode(F.array_distinct(F.array(final, F.col("url"), F.coalesce("canonical_hint", final)))).alias("u"), "fetched_at")
    same = c.where("status_code = 304").select(F.sha2(final, 256).alias("id"), "fetched_at", F.lit("same").alias("what"))
    return seen.unionByName(lost.select(F.sha2("u", 256).alias("id"), "fetched_at", F.lit("gone").alias("what")), allowMissingColumns=True).unionByName(same, allowMissingColumns=True)


def document_changes(tables: Tables, said: DataFrame) -> dict[str, Change]:
    """Documents, winners and addresses after what reports say of documents. The last report decides; an older one than what is stored,
    a tombstone included, changes nothing. A document is a duplicate of the one that first had its content and still has it,
    if that is another; the stored one stays the winner when it is fetched anew. The last document at a canonical address
    that is no duplicate removes the others there. (Spark meets large tables of winners through a Bloom filter of its own.)"""
    keys = said.select("id").distinct()
    old = tables.read("documents", near=keys).join(keys, "id", "left_semi")
    stored = old.select("id", F.col("fetched_at").alias("_at"), F.col("content_hash").alias("_hash"), F.col("duplicate_of").alias("_dup"), F.col("gone").alias("_gone"), F.col("canonical_url").alias("_canonical"))
    # what the reports come to: the last that isn't just a touch, and the last of all
    told = last(said.where("what <> 'same'"), ["id"], "fetched_at", "what").join(stored, "id", "left").where("_at IS NULL OR fetched_at >= _at")
    told = tables.stage(told)
    live = told.where("what = 'seen'")
    # winners: stored ones that this batch neither changes nor removes stay
    hashes = live.select("content_hash").unionByName(told.where("_hash IS NOT NULL").select(F.col("_hash").alias("content_hash"))).distinct()
    held = tables.read("winners", near=hashes).join(hashes, "content_hash", "left_semi").select("content_hash", F.col("id").alias("winner"))
    moved = told.where("_hash IS NOT NULL AND (what = 'gone' OR content_hash <> _hash)").select(F.col("_hash").alias("content_hash"), F.col("id").alias("winner"))
    held = held.join(moved, ["content_hash", "winner"], "left_anti")
    first = last(live.join(held, "content_hash", "left_anti").select("content_hash", "fetched_at", "id"), ["content_hash"], "fetched_at", "id", largest=False).select("content_hash", F.col("id").alias("winner"))
    winners = tables.stage(held.unionByName(first))
    live = tables.stage(live.join(winners, "content_hash", "left").withColumn("duplicate_of", F.when(F.col("winner") != F.col("id"), F.col("winner"))).drop("winner"))
    # addresses: the last document there, of those stored and those of the batch
    at = live.where("duplicate_of IS NULL").select("canonical_url", "id", "fetched_at")
    where = told.where("_canonical IS NOT NULL").select(F.col("_canonical").alias("canonical_url")).unionByName(at.select("canonical_url")).distinct()
    there = tables.read("addresses", near=where).join(where, "canonical_url", "left_semi").join(told.select("id"), "id", "left_anti").select("canonical_url", "id", "fetched_at")
    every = tables.stage(there.unionByName(at))
    owner = last(every, ["canonical_url"], "fetched_at", "id")
    replaced = tables.stage(every.join(owner.select("canonical_url", F.col("id").alias("_by"), F.col("fetched_at").alias("_when")), "canonical_url").where("id <> _by").select("id", F.col("_when").alias("fetched_at")))
    # documents that lost their address go, and with them what they won
    kept = live.join(replaced, "id", "left_anti").withColumn("gone", F.lit(False))
    dead = told.where("what = 'gone'").select("id", "fetched_at").unionByName(replaced).groupBy("id").agg(F.max("fetched_at").alias("fetched_at")).withColumn("gone", F.lit(True))
    touched = last(said.where("what = 'same'").select("id", "fetched_at"), ["id"], "fetched_at").select("id", F.col("fetched_at").alias("_touch"))
    rows = complete(kept, "documents").unionByName(complete(dead, "documents"))
    idle = old.where("NOT gone").join(rows.select("id"), "id", "left_anti").join(touched, "id").where("_touch > fetched_at").withColumn("fetched_at", F.col("_touch")).drop("_touch")
    lost = winners.join(replaced.select(F.col("id").alias("winner")), "winner", "left_semi").select("content_hash")
    none = hashes.join(winners.select("content_hash"), "content_hash", "left_anti").unionByName(lost)
    gone_addresses = where.join(owner.select("canonical_url"), "canonical_url", "left_anti")
    return {
        "documents": Change(rows.unionByName(idle)),
        "winners": Change(winners.join(lost, "content_hash", "left_anti").select("content_hash", F.col("winner").alias("id")), none),
        "addresses": Change(owner, gone_addresses),
    }


def domain_rows(tables: Tables, c: DataFrame) -> DataFrame:
    """Domains after the reports, in order of time, going on from what is stored."""
    r = c.select("job_id", "final_url", "outcome", "fetched_at", urls.host(F.col("final_url")).alias("domain"), F.sha2("final_url", 256).alias("id"), F.when(F.col("outcome") == "succeeded", F.sha2(F.col("body").cast("binary"), 256)).alias("hash"))
    r = r.where("domain IS NOT NULL AND outcome IN ('succeeded', 'unindexable', 'failed', 'gone', 'dead_letter')")
    ok = F.col("outcome") == "succeeded"
    before = tables.read("documents", near=r.select("id")).where("NOT gone").select("id", F.col("content_hash").alias("_hash"))
    prior = F.lag("hash").over(Window.partitionBy("id").orderBy("fetched_at", "job_id"))  # reports of one address in one batch
    checked = r.where(ok).withColumn("_prior", prior).join(before, "id", "left").select("domain", (~F.col("hash").eqNullSafe(F.coalesce("_prior", "_hash"))).alias("changed"))
    checks = checked.groupBy("domain").agg(F.count("*").alias("_checks"), F.count_if("changed").alias("_changes"))
    good = r.where(ok).groupBy("domain").agg(F.max(F.struct("fetched_at", "job_id")).alias("_ok"))
    bad = ~ok
    since = bad & (F.col("_ok").isNull() | (F.struct("fetched_at", "job_id") > F.col("_ok")))
    n = r.join(good, "domain", "left").groupBy("domain").agg(F.count_if(ok).alias("_pages"), F.count_if(bad).alias("_failed"), F.count_if(since).alias("_since"), F.max("_ok.fetched_at").alias("_good"), F.max(F.when(bad, F.col("fetched_at"))).alias("_bad"))
    out = n.join(checks, "domain", "left").join(tables.read("domains", near=n), "domain", "left")
    zero = lambda x: F.coalesce(x, F.lit(0))
    streak = F.when(F.col("_good").isNotNull(), 0).otherwise(zero("streak")) + F.col("_since")
    checked_now, changed_now = zero("checks") + zero("_checks"), zero("changes") + zero("_changes")
    return out.select(
        "domain", (zero("pages") + F.col("_pages")).alias("pages"), (zero("failed") + F.col("_failed")).alias("failed"), streak.alias("streak"),
        F.when(streak >= 10, "unhealthy").when(streak >= 5, "degraded").when(F.col("_good").isNotNull(), "healthy").otherwise(F.coalesce("health", F.lit("healthy"))).alias("health"),
        checked_now.alias("checks"), changed_now.alias("changes"), F.when(zero("_checks") == 0, F.col("hours")).when(checked_now > 1, changed_now / checked_now * 168.0).alias("hours"),
        F.coalesce("_good", "last_success_at").alias("last_success_at"), F.coalesce("_bad", "last_failure_at").alias("last_failure_at"),
    )


def origin_rows(tables: Tables, c: DataFrame) -> DataFrame:
    """Origins after the reports: fewer in flight where they were asked, a rest and failures in a row there and where redirects led.
    Origins that weren't known are made."""
    wait = st.origin_wait_seconds(F.col("status_code"), F.col("error_kind"), F.col("crawl_delay"), F.col("retry_after"))
    bad = F.col("status_code").isin(429) | F.col("status_code").between(500, 599) | (F.coalesce("error_kind", F.lit("")) == "network_error")
    base = c.select("owner", "job_id", "fetched_at", "status_code", "crawl_delay", bad.alias("bad"), (F.col("fetched_at") + F.make_dt_interval(secs=wait)).alias("ready"), F.col("origin_key").alias("asked"), urls.origin(F.col("final_url")).alias("led"))
    mine = base.select("*", F.col("asked").alias("origin_key"), F.lit(1).alias("done"))
    other = base.where("led IS NOT NULL AND led <> asked").select("*", F.col("led").alias("origin_key"), F.lit(0).alias("done"))
    r = mine.unionByName(other)
    key = ["owner", "origin_key"]
    ok = r.where("NOT bad").groupBy(*key).agg(F.max(F.struct("fetched_at", "job_id")).alias("_ok"))
    since = F.col("bad") & (F.col("_ok").isNull() | (F.struct("fetched_at", "job_id") > F.col("_ok")))
    n = r.join(ok, key, "left").groupBy(*key).agg(
        F.sum("done").alias("_done"), F.max("ready").alias("_ready"), F.count_if(since).alias("_since"), F.max("_ok.job_id").alias("_had"), F.max_by("status_code", F.struct("fetched_at", "job_id")).alias("last_status"),
        F.max_by("crawl_delay", F.when(F.col("crawl_delay").isNotNull(), F.struct("fetched_at", "job_id"))).alias("_delay"), F.max("fetched_at").alias("_asked"),
    )
    out = n.join(tables.read("origins", near=n).drop("last_status"), key, "left")
    return out.select(
        *key, F.greatest("next_allowed_at", "_ready").alias("next_allowed_at"), F.greatest(F.coalesce("in_flight_count", F.lit(0)) - F.col("_done"), F.lit(0)).alias("in_flight_count"),
        (F.when(F.col("_had").isNotNull(), 0).otherwise(F.coalesce("consecutive_failures", F.lit(0))) + F.col("_since")).alias("consecutive_failures"),
        "last_status", F.coalesce("_delay", "crawl_delay").alias("crawl_delay"), F.greatest("last_request_at", "_asked").alias("last_request_at"),
    )


def job_rows(tables: Tables, c: DataFrame) -> DataFrame:
    """The reports' jobs in their new state."""
    o, kind = F.col("outcome"), F.coalesce("error_kind", st.failure_kind(F.col("status_code")))
    good = o.isin("succeeded", "filtered", "requires_js")
    decision = F.when(F.col("llm_should_index").isNotNull() | F.col("llm_should_discover").isNotNull(), st.llm_decision(F.coalesce("llm_should_index", F.lit(True)), F.coalesce("llm_should_discover", F.lit(True))))
    new = c.select(
        F.col("job_id").alias("id"), by(JOB_STATUS, o).alias("_status"), o.alias("_outcome"), F.when(~good, F.when(o == "unindexable", "unindexable_document").otherwise(kind)).alias("_kind"),
        F.when(~good, F.concat(F.coalesce("error_message", kind), F.when(o == "dead_letter", "; retries exhausted").otherwise(""))).alias("_message"), F.col("fetched_at").alias("_at"), F.col("final_url").alias("_final"), F.col("status_code").alias("_http"),
        F.size("_found").alias("_count"), F.when(o == "succeeded", F.sha2("final_url", 256)).alias("_document"), decision.alias("_decision"),
    )
    again = F.col("_status") == "queued"
    out = tables.read("jobs", near=new).join(new, "id")
    return out.withColumns({
        "status": F.col("_status"), "failure_kind": F.col("_kind"), "failure_message": F.col("_message"), "final_url": F.col("_final"), "http_status": F.col("_http"), "discovered_count": F.col("_count"), "document_id": F.col("_document"), "decision": F.col("_decision"),
        "lease_id": F.when(~again, F.col("lease_id")), "claimed_at": F.when(~again, F.col("claimed_at")), "finished_at": F.when(~again, F.col("_at")), "requires_js": (F.col("_outcome") == "requires_js") | F.coalesce("requires_js", F.lit(False)),
        "next_retry_at": F.when(F.col("_outcome") == "retry", F.col("_at") + F.make_dt_interval(secs=st.backoff_seconds(F.col("attempt_count")))),
    }).drop(*new.columns[1:])


def apply_reports(tables: Tables, reports: DataFrame, domains: DataFrame, now: Column, batch: tuple[str, int] | None = None) -> dict[str, int]:
    """Apply reports (REPORT) to the tables (TABLES) in one commit; how many counted and how many didn't, as a mapping. domains: the
    blacklist (domain). batch: the name of a stream and the number of its batch; one that was applied before changes nothing, whether
    it comes again whole or after a crash at any point."""
    if batch and tables.note().get(batch[0], -1) >= batch[1]:
        return {"applied": 0, "rejected": 0}
    good, other = judge(tables, reports, domains)
    scoped = F.when(F.col("off"), F.array().cast("array<string>")).otherwise(F.filter(F.coalesce("discovered_urls", F.array().cast("array<string>")), lambda u: F.coalesce(urls.in_scope(urls.host(u), F.col("discovery_host"), F.col("discovery_scope")), F.lit(False))))
    c = tables.stage(good.withColumn("_found", F.slice(scoped, F.lit(1), F.greatest("max_discovered", F.lit(1)))))
    links = c.select("job_id", F.posexplode("_found").alias("_i", "link")).withColumn("_k", F.concat_ws("\n", "job_id", F.col("_i").cast("string")))
    bad_links = listed(links, "_k", [urls.host(F.col("link"))], domains)
    kept = links.join(bad_links, "_k", "left_anti").groupBy("job_id").agg(F.sort_array(F.collect_list(F.struct("_i", "link"))).alias("_kept"))  # max_discovered links of a page
    c = tables.stage(c.join(kept, "job_id", "left").withColumn("_found", F.coalesce(F.transform("_kept", lambda x: x["link"]), F.array().cast("array<string>"))).drop("_kept"))
    deeper = c.where("depth < max_depth AND outcome IN ('succeeded', 'filtered')")
    found = deeper.select("owner", F.posexplode("_found").alias("_i", "url"), F.col("final_url").alias("source"), (F.col("depth") + 1).alias("depth"), "max_depth", "budget_id", "max_pages", "same_origin_concurrency", "discovery_scope", "discovery_host", "max_discovered", "fetched_at", "job_id")
    found = found.withColumn("position", F.struct("fetched_at", "job_id", "_i")).drop("fetched_at", "job_id", "_i")
    new = enqueue(tables, found, domains, now)
    edges = deeper.where("outcome = 'succeeded'").select(F.col("final_url").alias("source"), F.explode(F.array_distinct("_found")).alias("target"), "fetched_at").groupBy("source", "target").agg(F.max("fetched_at").alias("discovered_at"))
    origins, fresh = origin_rows(tables, c), new["origins"].rows
    # an origin that is both reported on and met for the first time is one row
    origins = origins.unionByName(fresh.join(origins.select("owner", "origin_key"), ["owner", "origin_key"], "left_anti"))
    events = c.select("owner", by(EVENT, F.col("outcome")).alias("kind"), F.when(F.col("outcome").isin("succeeded", "filtered", "requires_js"), "ok").otherwise("error").alias("status"), F.coalesce("error_message", "outcome").alias("message"), F.col("final_url").alias("url"), F.col("fetched_at").alias("created_at"))
    changes = {
        "jobs": Change(complete(job_rows(tables, c), "jobs").unionByName(new["jobs"].rows)), "budgets": new["budgets"], "origins": Change(complete(origins, "origins")), "links": Change(edges),
        "domains": Change(complete(domain_rows(tables, c), "domains")), "events": Change(events), **document_changes(tables, tables.stage(document_rows(c))),
    }
    with merged_joins(tables.spark):
        counts = {"applied": c.count(), "rejected": other.count()}
    tables.commit(changes, {batch[0]: batch[1]} if batch else None)
    return counts


def start(spark: SparkSession, reports: DataFrame, tables: Tables, domains: DataFrame, name: str, checkpoint: str, now: Column | None = None, available_now: bool = True):
    """A stream of reports, applied batch by batch."""
    writer = reports.writeStream.foreachBatch(lambda df, n: apply_reports(tables, df, domains, F.localtimestamp() if now is None else now, (name, n)) and None).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="2 seconds")).start()


def maintain(tables: Tables, rules: DataFrame, domains: DataFrame, now: Column, claim_timeout_s: int = 300, keep_events: int = 400) -> DataFrame:
    """One round of maintenance, in this order and in one commit each: seeds of due rules, claims and ingests that have been held too long,
    the blacklist, old events, documents due for another fetch. Returns the rules with the time they were last used.
    rules: id, owner, seed_url, enabled, interval_minutes, last_enqueued_at, and a job's limits as in `enqueue`."""
    _, rest = hk.expand_due(rules, now)
    due = fr.due_rules(rules, now)
    seeds = due.select("owner", F.struct(F.col("id").alias("id")).alias("position"), F.col("seed_url").alias("url"), F.lit("rule").alias("source"), F.lit(0).alias("depth"), F.least("max_depth", F.lit(10)).alias("max_depth"), F.concat(F.lit("rule:"), "id").alias("budget_id"), "max_pages", "same_origin_concurrency", "discovery_scope", "discovery_host", "max_discovered")
    tables.commit(enqueue(tables, seeds, domains, now, revisit=True))
    jobs = tables.read("jobs")
    for status, reason in (("claimed", "claim_timeout"), ("ingesting", "ingest_timeout")):
        stale = (F.col("status") == status) & (F.col("claimed_at") < now - F.make_dt_interval(secs=F.lit(claim_timeout_s)))
        out = tables.stage(hk.release(jobs, stale, now, reason, F.lit(reason)).where("released"))
        held = tables.read("origins", near=out)
        given = hk.give_back(held, out, now).join(held.drop("in_flight_count", "next_allowed_at"), ["owner", "origin_key"]).join(out.select("owner", "origin_key").distinct(), ["owner", "origin_key"], "left_semi")
        tables.commit({"jobs": Change(complete(out.withColumn("lease_id", F.lit(None)), "jobs")), "origins": Change(complete(given, "origins"))})
        jobs = tables.read("jobs")
    idle = jobs.where(~F.col("status").isin("claimed", "ingesting"))
    off = tables.stage(listed(idle, "id", [urls.host(F.col("url"))], domains))
    docs = tables.read("documents").where("NOT gone")
    bad = tables.stage(docs.join(listed(docs, "id", [F.col("host")], domains), "id", "left_semi").select("id", "content_hash", "canonical_url", "duplicate_of", "fetched_at"))
    left = jobs.join(off, "id", "left_anti")
    bare = tables.read("origins").join(left, ["owner", "origin_key"], "left_anti").join(jobs.join(off, "id", "left_semi"), ["owner", "origin_key"], "left_semi").select("owner", "origin_key")
    won = bad.where("duplicate_of IS NULL")
    tables.commit({
        "jobs": Change(gone=off), "origins": Change(gone=bare), "documents": Change(complete(bad.select("id", "fetched_at", F.lit(True).alias("gone")), "documents")),
        "winners": Change(gone=won.select("content_hash").where("content_hash IS NOT NULL")), "addresses": Change(gone=won.select("canonical_url").where("canonical_url IS NOT NULL")),
    })
    trim(tables, keep_events)
    old = tables.read("documents").where("NOT gone AND duplicate_of IS NULL").join(tables.read("domains").select(F.col("domain").alias("host"), "hours"), "host", "left")
    hours = F.rint(F.least(F.greatest(F.coalesce("hours", F.lit(168.0)), F.lit(24.0)), F.lit(720.0))).cast("int")
    late = old.where(F.col("fetched_at") < now - F.make_dt_interval(hours=hours)).orderBy("fetched_at", "id").limit(100)
    owners = tables.read("jobs").where("document_id IS NOT NULL").select(F.col("document_id").alias("id"), "owner", "max_depth", "max_pages", "same_origin_concurrency", "discovery_scope", "discovery_host", "max_discovered")
    again = late.select("id", F.col("canonical_url").alias("url"), "fetched_at").join(last(owners, ["id"], "owner", largest=False), "id")
    tables.commit(enqueue(tables, again.select("owner", F.struct("fetched_at", "id").alias("position"), "url", F.lit("recrawl").alias("source"), F.lit(0).alias("depth"), "max_depth", F.concat(F.lit("recrawl:"), "owner").alias("budget_id"), F.lit(2**31 - 1).alias("max_pages"), "same_origin_concurrency", "discovery_scope", "discovery_host", "max_discovered"), domains, now, revisit=True))
    return rest


def trim(tables: Tables, keep: int) -> None:
    """Only the last events of each owner stay; the whole table is written anew, as it is small then."""
    events = tables.read("events")
    counted = ranked(tables, events, ["owner"], [F.col("created_at").desc(), F.col("kind"), F.col("url")])
    kept = counted.where(F.col("nth") <= keep).drop("nth")
    replace(tables, "events", kept)


def replace(tables: Tables, name: str, rows: DataFrame) -> None:
    """All rows of a table that is otherwise only added to."""
    rows = tables.stage(rows)
    after = tables.manifest.number()
    said = tables.manifest.read(after)
    said["tables"][name] = {}
    tables.manifest.commit(said, after)
    tables.commit({name: Change(rows)})
