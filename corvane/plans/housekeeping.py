"""Registered queries over jobs, origins, staged items, rules, workers and accounts, beside their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import clean, urls
from ..operators import frontier as fr
from ..operators import housekeeping as hk
from . import tables as t
from .registry import NOW, query, sql_stamp, stamp


def jobs(spark, d):
    i, s = F.col("id"), F.col("status")
    status = F.when((s == "claimed") & (i % 3 == 0), "ingesting").when((s == "succeeded") & (i % 10 == 1), "failed").when((s == "succeeded") & (i % 10 == 2), "blocked").otherwise(s)
    host = F.concat(F.lit("h"), i % 50, F.lit(".example"), i % 3, F.lit(".com"))
    null = F.lit(None).cast("string")
    return t.jobs(spark, d).withColumn("finished_at", F.when(s == "succeeded", F.col("discovered_at") + t.days(F.lit(1)))).select(
        "*", host.alias("host"), F.concat(F.lit("https://"), host, F.lit("/"), i).alias("url"), F.when((s == "succeeded") & (i % 4 > 0), i).alias("accepted_document_id"),
        null.alias("failure_kind"), null.alias("failure_message"),
    ).withColumn("status", status)


JOBS = f"""{t.JOBS}, full_jobs AS (SELECT * EXCLUDE (status), CASE WHEN status = 'claimed' AND id % 3 = 0 THEN 'ingesting' WHEN status = 'succeeded' AND id % 10 = 1 THEN 'failed' WHEN status = 'succeeded' AND id % 10 = 2 THEN 'blocked' ELSE status END AS status,
 CASE WHEN status = 'succeeded' THEN discovered_at + to_days(1) END AS finished_at, 'h' || (id % 50) || '.example' || (id % 3) || '.com' AS host, 'https://h' || (id % 50) || '.example' || (id % 3) || '.com/' || id AS url,
 CASE WHEN status = 'succeeded' AND id % 4 > 0 THEN id END AS accepted_document_id FROM jobs)"""


def released_sql(which: str, reason: str, message: str) -> str:
    dead = f"({which}) AND greatest(max_attempts, 1) <= greatest(attempt_count, 1)"
    return f"""WITH {JOBS} SELECT id, CASE WHEN {dead} THEN 'dead_letter' WHEN {which} THEN 'queued' ELSE status END AS status,
 CASE WHEN {dead} THEN NULL WHEN {which} THEN '2024-01-31 00:00:30' ELSE {sql_stamp('next_retry_at')} END AS next_retry_at, CASE WHEN {dead} THEN '{reason}' END AS failure_kind, CASE WHEN {dead} THEN {message} END AS failure_message FROM full_jobs"""


def released(df):
    return df.select("id", "status", stamp("next_retry_at").alias("next_retry_at"), "failure_kind", "failure_message")


STUCK = f"status = 'ingesting' AND claimed_at < {NOW} - to_seconds(300)"


def stuck():
    return (F.col("status") == "ingesting") & (F.col("claimed_at") < t.now() - F.make_dt_interval(secs=F.lit(300)))


@query(released_sql(STUCK, "ingest_timeout", "'ingest timed out after ' || greatest(attempt_count, 1) || ' attempts'"))
def recover_ingesting(spark, d):
    message = F.concat(F.lit("ingest timed out after "), F.greatest("attempt_count", F.lit(1)), F.lit(" attempts"))
    return released(hk.release(jobs(spark, d), stuck(), t.now(), "ingest_timeout", message))


@query(f"""WITH {JOBS}, {t.ORIGINS}, n AS (SELECT owner, origin_key, count(*) AS n FROM full_jobs WHERE {STUCK} GROUP BY 1, 2)
 SELECT owner, origin_key, greatest(in_flight_count - coalesce(n, 0), 0)::BIGINT AS in_flight_count, {sql_stamp(f"CASE WHEN n IS NULL THEN next_allowed_at ELSE greatest(next_allowed_at, {NOW} + to_seconds(30)) END")} AS next_allowed_at
 FROM origins LEFT JOIN n USING (owner, origin_key)""")
def origins_after_release(spark, d):
    out = hk.release(jobs(spark, d), stuck(), t.now(), "ingest_timeout", F.lit(""))
    return hk.give_back(t.origins(spark, d), out, t.now()).withColumn("next_allowed_at", stamp("next_allowed_at")).withColumn("in_flight_count", F.col("in_flight_count").cast("long"))


@query(f"""WITH {JOBS} SELECT count(*) FILTER (WHERE greatest(max_attempts, 1) > greatest(attempt_count, 1))::BIGINT AS requeued, count(*) FILTER (WHERE greatest(max_attempts, 1) <= greatest(attempt_count, 1))::BIGINT AS dead_letter
 FROM full_jobs WHERE status = 'claimed' AND owner % 5 = 3""")
def release_worker(spark, d):
    out = hk.release(jobs(spark, d), (F.col("status") == "claimed") & (F.col("owner") % 5 == 3), t.now(), "crawler_deleted", F.lit("crawler was deleted while the job was still claimed"))
    return out.where("released").agg(F.count_if(F.col("status") == "queued").alias("requeued"), F.count_if(F.col("status") == "dead_letter").alias("dead_letter"))


CLAIM = f"""{t.JOBS}, {t.ORIGINS}, active AS (SELECT owner, origin_key, count(*) AS n FROM jobs WHERE status IN ('claimed', 'ingesting') GROUP BY 1, 2),
 ready AS (SELECT j.*, o.next_allowed_at, coalesce(a.n, 0) + row_number() OVER (PARTITION BY j.owner, j.origin_key ORDER BY priority DESC, discovered_at, id) <= greatest(same_origin_concurrency, 1) AS fair
  FROM jobs j JOIN origins o USING (owner, origin_key) LEFT JOIN active a USING (owner, origin_key) WHERE status = 'queued' AND (next_retry_at IS NULL OR next_retry_at <= {NOW}) AND NOT requires_js AND o.next_allowed_at <= {NOW}),
 mine AS (SELECT owner, origin_key, id FROM ready WHERE fair ORDER BY next_allowed_at, priority DESC, discovered_at, id LIMIT 50)"""


@query(f"""WITH {CLAIM} SELECT id, CASE WHEN m.id IS NULL THEN status ELSE 'claimed' END AS status, (attempt_count + (m.id IS NOT NULL)::INT)::BIGINT AS attempt_count, CASE WHEN m.id IS NOT NULL THEN 'lease-1' END AS lease_id
 FROM jobs j LEFT JOIN mine m USING (id)""".replace("m.id", "m.owner"))
def claim_jobs(spark, d):
    j, o = t.jobs(spark, d), t.origins(spark, d)
    return hk.take(fr.claim(j, o, t.now(), 50), j, o, t.now(), "lease-1")[0].select("id", "status", F.col("attempt_count").cast("long").alias("attempt_count"), "lease_id")


@query(f"WITH {CLAIM}, n AS (SELECT owner, origin_key, count(*) AS n FROM mine GROUP BY 1, 2) SELECT owner, origin_key, (in_flight_count + coalesce(n, 0))::BIGINT AS in_flight_count FROM origins LEFT JOIN n USING (owner, origin_key)")
def claim_origins(spark, d):
    j, o = t.jobs(spark, d), t.origins(spark, d)
    return hk.take(fr.claim(j, o, t.now(), 50), j, o, t.now(), "lease-1")[1].select("owner", "origin_key", F.col("in_flight_count").cast("long").alias("in_flight_count"))


# ---- staged items: an event is a report, the job it is about one of 500


def items(spark, d):
    i = F.col("event_id")
    return t.read(spark, d, "events").select(
        i.alias("report_id"), (i % 500).alias("job_id"), F.concat(F.lit("l"), i % 7).alias("lease_id"), F.col("ts").alias("staged_at"), F.concat(F.lit("u"), F.when(i % 11 == 0, i).otherwise(i % 500)).alias("url"),
        F.get(F.array(F.lit("pending"), F.lit("processing"), F.lit("completed")), (i % 3).cast("int")).alias("status"), F.when(i % 3 == 1, t.now() - F.make_dt_interval(secs=i % 900)).alias("started_at"), F.lit(None).cast("string").alias("error_message"),
    )


def leased(spark):
    i = F.col("id")
    status = F.get(F.array(*map(F.lit, ("ingesting", "succeeded", "ingesting", "dead_letter"))), (i % 4).cast("int"))
    return spark.range(480).select("id", F.when(i % 9 > 0, F.concat(F.lit("l"), i % 7)).alias("lease_id"), F.concat(F.lit("u"), i).alias("url"), status.alias("status"))


ITEMS = f"""items AS (SELECT event_id AS report_id, event_id % 500 AS job_id, 'l' || (event_id % 7) AS lease_id, ts AS staged_at, 'u' || CASE WHEN event_id % 11 = 0 THEN event_id ELSE event_id % 500 END AS url,
 ['pending', 'processing', 'completed'][event_id % 3 + 1] AS status, CASE WHEN event_id % 3 = 1 THEN {NOW} - to_seconds((event_id % 900)::INT) END AS started_at FROM events),
 leased AS (SELECT id, CASE WHEN id % 9 > 0 THEN 'l' || (id % 7) END AS lease_id, 'u' || id AS url, ['ingesting', 'succeeded', 'ingesting', 'dead_letter'][id % 4 + 1] AS status FROM range(480) r(id))"""


@query(f"""WITH {ITEMS}, n AS (SELECT *, row_number() OVER (PARTITION BY lease_id, job_id ORDER BY staged_at, report_id) AS nth FROM items)
 SELECT report_id, CASE WHEN h.lease_id IS NULL OR h.lease_id <> n.lease_id THEN 'unknown_lease' WHEN h.url <> n.url THEN 'wrong_url' WHEN nth > 1 THEN 'repeated' ELSE 'staged' END AS verdict FROM n LEFT JOIN leased h ON h.id = n.job_id""")
def stage_reports(spark, d):
    return hk.stage(items(spark, d), leased(spark)).select("report_id", "verdict")


@query(f"WITH {ITEMS} SELECT report_id FROM items WHERE status = 'pending' ORDER BY staged_at, lease_id, job_id LIMIT 100")
def pending_items(spark, d):
    return hk.pending_items(items(spark, d), 100).select("report_id")


@query(f"""WITH {ITEMS}, s AS (SELECT i.*, h.status AS job_status, coalesce(i.status = 'processing' AND started_at < {NOW} - to_seconds(600) AND h.status IS NOT NULL, false) AS stuck FROM items i LEFT JOIN leased h ON h.id = job_id)
 SELECT report_id, CASE WHEN stuck AND job_status = 'ingesting' THEN 'pending' WHEN stuck THEN 'failed' ELSE status END AS status,
 CASE WHEN stuck AND job_status <> 'ingesting' THEN 'projection stalled after crawl job left ingesting (job status: ' || job_status || ')' END AS error_message FROM s""")
def recover_items(spark, d):
    return hk.recover_items(items(spark, d), leased(spark), t.now(), 600).select("report_id", "status", "error_message")


@query(f"WITH {ITEMS} SELECT lease_id, count(*)::BIGINT AS results, count(*) FILTER (WHERE status IN ('pending', 'processing'))::BIGINT AS pending FROM items GROUP BY 1")
def lease_counts(spark, d):
    return items(spark, d).groupBy("lease_id").agg(F.count("*").alias("results"), F.count_if(F.col("status").isin("pending", "processing")).alias("pending"))


# ---- blacklists and rules

LISTED = ("example1.com", "h7.example2.com", "H9.example0.com")
IN_LIST = "(host = 'example1.com' OR host LIKE '%.example1.com' OR host = 'h7.example2.com' OR host LIKE '%.h7.example2.com' OR host = 'h9.example0.com' OR host LIKE '%.h9.example0.com')"


def listed(spark):
    return spark.range(1).select(F.explode(F.array(*map(F.lit, LISTED))).alias("domain")).select(F.lower("domain").alias("domain"))


@query(f"WITH {JOBS} SELECT id FROM full_jobs WHERE {IN_LIST}")
def blacklisted_jobs(spark, d):
    return hk.below(jobs(spark, d), "host", listed(spark)).select("id")


@query(f"""WITH {JOBS}, {t.ORIGINS}, l AS (SELECT * FROM full_jobs WHERE status IN ('claimed', 'ingesting') OR NOT {IN_LIST})
 SELECT 'job' AS kind, id FROM l UNION ALL SELECT 'origin', origin_key FROM origins WHERE EXISTS (SELECT 1 FROM l WHERE l.owner = origins.owner AND l.origin_key = origins.origin_key)""")
def blacklist_cleanup(spark, d):
    docs = jobs(spark, d).select("id", "host")
    _, left, origins = hk.blacklist_cleanup(docs, jobs(spark, d), t.origins(spark, d), listed(spark))
    return left.select(F.lit("job").alias("kind"), "id").unionByName(origins.select(F.lit("origin").alias("kind"), F.col("origin_key").alias("id")))


def rules(spark, d):
    i = F.col("p_partkey")
    return t.read(spark, d, "part").select(
        i.alias("id"), (i % 9).alias("owner"), F.concat(F.lit("https://s"), i, F.lit(".example.com/")).alias("seed_url"), (i % 4 > 0).alias("enabled"), (i % 300 + 1).alias("interval_minutes"), (i % 14).alias("max_depth"),
        F.when(i % 6 > 0, t.now() - F.make_dt_interval(mins=i % 400)).alias("last_enqueued_at"),
    )


RULES = f"""rules AS (SELECT p_partkey AS id, p_partkey % 9 AS owner, 'https://s' || p_partkey || '.example.com/' AS seed_url, p_partkey % 4 > 0 AS enabled, p_partkey % 300 + 1 AS interval_minutes, p_partkey % 14 AS max_depth,
 CASE WHEN p_partkey % 6 > 0 THEN {NOW} - to_minutes((p_partkey % 400)::INT) END AS last_enqueued_at FROM part),
 due AS (SELECT * FROM rules WHERE enabled AND (last_enqueued_at IS NULL OR date_diff('second', last_enqueued_at, {NOW}) >= 60 * interval_minutes))"""


@query(f"WITH {RULES} SELECT owner, id AS rule_id, seed_url AS url, 0 AS depth, least(max_depth, 10)::BIGINT AS max_depth, true AS revisit FROM due")
def expand_rules(spark, d):
    return hk.expand_due(rules(spark, d), t.now())[0].withColumn("max_depth", F.col("max_depth").cast("long"))


@query(f"WITH {RULES} SELECT r.id, {sql_stamp(f'CASE WHEN due.id IS NOT NULL THEN {NOW} ELSE r.last_enqueued_at END')} AS last_enqueued_at FROM rules r LEFT JOIN due ON due.id = r.id")
def stamp_rules(spark, d):
    return hk.expand_due(rules(spark, d), t.now())[1].select("id", stamp("last_enqueued_at").alias("last_enqueued_at"))


@query(f"""WITH {RULES} SELECT id, CASE WHEN id % 2 = 0 AND id % 5 > 0 THEN least(greatest(id * 7 - 100, 1), 10080) ELSE interval_minutes END::BIGINT AS interval_minutes, CASE WHEN id % 2 = 0 THEN least(greatest(id % 20, 0), 10) ELSE max_depth END::BIGINT AS max_depth,
 CASE WHEN id % 2 = 0 AND id % 3 = 0 THEN false ELSE enabled END AS enabled FROM rules""")
def patch_rules(spark, d):
    i = F.col("id")
    changes = rules(spark, d).where(i % 2 == 0).select("id", F.when(i % 5 > 0, i * 7 - 100).alias("interval_minutes"), (i % 20).alias("max_depth"), F.when(i % 3 == 0, F.lit(False)).alias("enabled"))
    out = hk.patch(rules(spark, d), changes, "id", {"interval_minutes": (1, 10_080), "max_depth": (0, 10)})
    return out.select("id", F.col("interval_minutes").cast("long").alias("interval_minutes"), F.col("max_depth").cast("long").alias("max_depth"), "enabled")


# ---- workers, users and keys


@query("""SELECT s_suppkey AS id, CASE WHEN s_suppkey % 5 - 1 > 0 THEN s_suppkey % 5 - 1 WHEN s_suppkey % 3 = 0 THEN 24 ELSE 16 END::BIGINT AS jobs, coalesce(TIMESTAMP '2024-01-31 00:00:00' - to_seconds((s_suppkey % 200)::INT) >= TIMESTAMP '2024-01-31 00:00:00' - to_seconds(90), false) AND s_suppkey % 8 > 0 AS online FROM supplier""")
def worker_runtime(spark, d):
    i = F.col("s_suppkey")
    config = F.when(i % 3 == 0, F.lit(" 24 ")).when(i % 3 == 1, F.lit("-4")).otherwise(F.lit("many"))
    seen = F.when(i % 8 > 0, t.now() - F.make_dt_interval(secs=i % 200))
    own = i % 5 - 1
    return t.read(spark, d, "supplier").select(i.alias("id"), F.coalesce(F.when(own > 0, own), clean.positive(config, 16)).cast("long").alias("jobs"), hk.online(seen, t.now(), 90).alias("online"))


@query("""WITH j AS (SELECT l_suppkey AS id, count(*) AS reported, count(*) FILTER (WHERE l_linestatus = 'O') AS in_flight FROM lineitem GROUP BY 1)
 SELECT count(*)::BIGINT AS workers, count(*) FILTER (WHERE s_suppkey % 8 > 0 AND s_suppkey % 200 <= 90)::BIGINT AS online, coalesce(sum(reported), 0)::BIGINT AS reported, coalesce(sum(in_flight), 0)::BIGINT AS in_flight FROM supplier LEFT JOIN j ON id = s_suppkey""")
def worker_totals(spark, d):
    n = t.read(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count("*").alias("reported"), F.count_if(F.col("l_linestatus") == "O").alias("in_flight"))
    i = F.col("s_suppkey")
    seen = F.when(i % 8 > 0, t.now() - F.make_dt_interval(secs=i % 200))
    w = t.read(spark, d, "supplier").join(n, "s_suppkey", "left").withColumn("online", hk.online(seen, t.now(), 90))
    return w.agg(F.count("*").alias("workers"), F.count_if("online").alias("online"), F.coalesce(F.sum("reported"), F.lit(0)).alias("reported"), F.coalesce(F.sum("in_flight"), F.lit(0)).alias("in_flight"))


@query("""SELECT n_name AS owner, count(*)::BIGINT AS keys, count(*) FILTER (WHERE c_custkey % 4 > 0)::BIGINT AS active, min(left('fvk_' || md5(c_custkey::VARCHAR), 8) || '...' || right(md5(c_custkey::VARCHAR), 4)) AS first_preview FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1""".replace("fvk_", "key_"))
def key_owners(spark, d):
    token = F.concat(F.lit("key_"), F.md5(F.col("c_custkey").cast("string").cast("binary")))
    keys = t.read(spark, d, "customer").select(F.col("c_nationkey").alias("n_nationkey"), (F.col("c_custkey") % 4 > 0).alias("active"), clean.token_preview(token).alias("preview"))
    return keys.join(t.read(spark, d, "nation"), "n_nationkey").groupBy(F.col("n_name").alias("owner")).agg(F.count("*").alias("keys"), F.count_if("active").alias("active"), F.min("preview").alias("first_preview"))


@query("""SELECT n_nationkey AS user_id, EXISTS (SELECT 1 FROM customer WHERE c_nationkey = n_nationkey AND c_custkey % 4 > 0 AND c_acctbal > 9900) AS key_found FROM nation""")
def key_flags(spark, d):
    keys = t.read(spark, d, "customer").where("c_custkey % 4 > 0 AND c_acctbal > 9900").select(F.col("c_nationkey").alias("user_id"), F.lit(True).alias("found")).distinct()
    return t.read(spark, d, "nation").select(F.col("n_nationkey").alias("user_id")).join(keys, "user_id", "left").select("user_id", F.coalesce("found", F.lit(False)).alias("key_found"))


@query("""WITH u AS (SELECT c_nationkey AS user_id, count(*) AS used FROM customer GROUP BY 1) SELECT count(*)::BIGINT AS users, sum(used)::BIGINT AS used_today, (count(*) * 100)::BIGINT AS limits FROM nation JOIN u ON user_id = n_nationkey""")
def user_totals(spark, d):
    used = t.read(spark, d, "customer").groupBy(F.col("c_nationkey").alias("user_id")).agg(F.count("*").alias("used"))
    users = t.read(spark, d, "nation").select(F.col("n_nationkey").alias("user_id")).join(used.select("user_id"), "user_id", "left_semi")
    return hk.accounts_with_usage(users, used).agg(F.count("*").alias("users"), F.sum("used").alias("used_today"), (F.count("*") * 100).alias("limits"))


@query("""SELECT key, value, id FROM (SELECT 'p' || p_partkey AS key, p_name AS value, 0 AS id FROM part WHERE p_partkey % 10 = 3 UNION ALL SELECT 'bundle', '{}', 1) ORDER BY key""")
def config_scan(spark, d):
    rows = t.read(spark, d, "part").where("p_partkey % 10 = 3").select(F.concat(F.lit("p"), "p_partkey").alias("key"), F.col("p_name").alias("value"), F.lit(0).alias("id"))
    default = spark.range(1).select(F.lit("bundle").alias("key"), F.lit("{}").alias("value"), F.lit(1).alias("id"))
    return rows.unionByName(default.join(rows, "key", "left_anti")).orderBy("key")


# ---- one domain, and what is handed in for it


@query(f"""WITH {JOBS} SELECT count(*) FILTER (WHERE status IN ('queued', 'claimed', 'ingesting'))::BIGINT AS pending_jobs, count(*) FILTER (WHERE status = 'succeeded' AND accepted_document_id IS NOT NULL)::BIGINT AS successful_jobs,
 count(*) FILTER (WHERE status = 'succeeded' AND accepted_document_id IS NULL)::BIGINT AS filtered_jobs, count(*) FILTER (WHERE status IN ('failed', 'dead_letter'))::BIGINT AS failed_jobs, count(*) FILTER (WHERE status = 'blocked')::BIGINT AS blocked_jobs,
 {sql_stamp('max(coalesce(finished_at, discovered_at))')} AS last_crawled_at FROM full_jobs WHERE host = 'example1.com' OR host LIKE '%.example1.com'""")
def domain_job_summary(spark, d):
    mine = jobs(spark, d).where(urls.within(F.col("host"), "example1.com"))
    return hk.job_summary(mine).withColumn("last_crawled_at", stamp("last_crawled_at"))


@query("""WITH x AS (SELECT CASE doc_id % 7 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'application/pdf' WHEN 3 THEN 'text/plain' ELSE 'text/html' END AS type FROM documents WHERE doc_id % 3 > 0)
 SELECT coalesce(nullif(type, ''), 'unknown') AS label, count(*)::BIGINT AS n FROM x GROUP BY type ORDER BY n DESC, nullif(type, '') ASC NULLS LAST LIMIT 4""")
def facet_type(spark, d):
    i = F.col("doc_id")
    kind = F.when(i % 7 == 0, F.lit(None)).when(i % 7 == 1, "").when(i % 7 == 2, "application/pdf").when(i % 7 == 3, "text/plain").otherwise("text/html")
    return hk.facet(t.read(spark, d, "documents").select(kind.alias("type"), F.when(i % 3 == 0, i).alias("duplicate_of")), "type", 4)


@query(f"""WITH {t.DOCS}, m AS (SELECT *, first_value(id) OVER (PARTITION BY content_hash ORDER BY fetched_at, id) AS f FROM docs WHERE lower(title) LIKE '%on%')
 SELECT id, (SELECT count(*) FROM m)::BIGINT AS total, CASE WHEN 30 + least(20, (SELECT count(*) FROM m) - 30) < (SELECT count(*) FROM m) THEN 30 + least(20, (SELECT count(*) FROM m) - 30) END::BIGINT AS next_offset
 FROM m ORDER BY f <> id, fetched_at DESC, id LIMIT 20 OFFSET 30""")
def documents_page(spark, d):
    from ..operators import documents as dx

    m = dx.mark_duplicates(t.docs(spark, d).where(F.lower("title").like("%on%")))
    return hk.page(m, [F.col("duplicate_of").isNotNull(), F.col("fetched_at").desc(), F.col("id")], 20, 30).select("id", "total", "next_offset")


FOUND = """found AS (SELECT l_suppkey % 6 AS owner, l_orderkey * 10 + l_linenumber AS position, 'https://h' || (l_partkey % 40) || '.example.com/' || l_partkey AS url, CASE WHEN l_partkey % 40 = 7 THEN 'h7.other.org' ELSE 'h' || (l_partkey % 40) || '.example.com' END AS host, 150::BIGINT AS max_pages FROM lineitem WHERE l_quantity > 40),
 known AS (SELECT DISTINCT owner, url FROM found WHERE position % 9 = 0)"""


@query(f"""WITH {FOUND}, own AS (SELECT * FROM found WHERE host = 'example.com' OR host LIKE '%.example.com'), f AS (SELECT owner, url, min(position) AS position FROM own GROUP BY 1, 2),
 n AS (SELECT owner, url, row_number() OVER (PARTITION BY owner ORDER BY position, url) <= 150 - owner * 5 AS ok FROM f WHERE NOT EXISTS (SELECT 1 FROM known k WHERE k.owner = f.owner AND k.url = f.url))
 SELECT position, CASE WHEN NOT (host = 'example.com' OR host LIKE '%.example.com') THEN 'foreign' WHEN n.ok THEN 'accepted' WHEN k.url IS NOT NULL THEN 'known' ELSE 'over_budget' END AS verdict
 FROM found LEFT JOIN n ON n.owner = found.owner AND n.url = found.url LEFT JOIN known k ON k.owner = found.owner AND k.url = found.url""")
def submit_urls(spark, d):
    p = F.col("l_partkey")
    found = t.read(spark, d, "lineitem").where("l_quantity > 40").select(
        (F.col("l_suppkey") % 6).alias("owner"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("position"), F.concat(F.lit("https://h"), p % 40, F.lit(".example.com/"), p).alias("url"),
        F.when(p % 40 == 7, "h7.other.org").otherwise(F.concat(F.lit("h"), p % 40, F.lit(".example.com"))).alias("host"), F.lit(150).cast("long").alias("max_pages"),
    )
    known = found.where("position % 9 = 0").select("owner", "url").distinct()
    used = found.select("owner", (F.col("owner") * 5).alias("used")).distinct()
    return hk.submit(found, "example.com", known, used).select("position", "verdict")


@query("""SELECT l_orderkey AS source, l_partkey AS target, max(seen)::BIGINT AS discovered_at FROM (SELECT l_orderkey, l_partkey, l_linenumber AS seen FROM lineitem UNION ALL SELECT l_orderkey, l_partkey + 1, l_linenumber + 3 FROM lineitem UNION ALL SELECT l_orderkey, l_partkey, 2 FROM lineitem WHERE l_orderkey % 2 = 0) GROUP BY 1, 2""")
def upsert_edges(spark, d):
    li = t.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("source"), F.col("l_partkey").cast("long").alias("target"), F.col("l_linenumber").cast("long").alias("at"))
    old = li.where("source % 2 = 0").select("source", "target", F.lit(2).cast("long").alias("discovered_at"))
    return hk.upsert_edges(old, li.select("source", F.array("target", F.col("target") + 1).alias("targets"), F.array("at", F.col("at") + 3).alias("seen")))


@query("""WITH f AS (SELECT l_suppkey AS seed, l_partkey AS url, min(l_orderkey * 10 + l_linenumber) AS position FROM lineitem GROUP BY 1, 2), c AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY position) AS nth FROM f)
 SELECT url, arg_min(seed, (seed, position)) AS seed, arg_min(position, (seed, position)) AS position FROM c WHERE nth <= 25 GROUP BY url""")
def seed_discovery(spark, d):
    found = t.read(spark, d, "lineitem").select(F.col("l_suppkey").alias("seed"), F.col("l_partkey").alias("url"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("position"))
    return hk.seeds(found, 25)


@query(f"""WITH {t.DOCS} SELECT j.o_orderkey AS id, 'e' || e.id AS etag FROM orders j LEFT JOIN (SELECT host || id % 200 AS url, arg_max(id, fetched_at) AS id FROM docs WHERE id % 120 = id GROUP BY 1) e ON e.url = 'src1.example.com' || j.o_orderkey""")
def conditional_requests(spark, d):
    i = F.col("id")
    stored = t.docs(spark, d).where("id % 120 = id").select(F.concat("host", i % 200).alias("canonical_url"), F.concat(F.lit("e"), i).alias("etag"), F.lit("").alias("last_modified"), "fetched_at")
    work = t.read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("src1.example.com"), "o_orderkey").alias("url"))
    return hk.with_conditions(work, stored).select("id", "etag")


# ---- clean-ups


@query("""SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 'crawler-' || left(md5(c_custkey::VARCHAR), 8) ELSE left(c_name, 120) END AS name, CASE WHEN c_custkey % 4 > 0 THEN 'v' || (c_custkey % 9) || '.0-rc' END AS tag,
 CASE c_custkey % 3 WHEN 0 THEN 'pending' WHEN 1 THEN 'failed' ELSE 'idle' END AS update_status, CASE WHEN c_custkey % 5 > 0 THEN 'user_' || c_custkey END AS username,
 CASE WHEN c_custkey % 250 + 350 IN (401, 403) THEN 'blocked' WHEN c_custkey % 250 + 350 BETWEEN 500 AND 599 THEN 'http_5xx' ELSE 'http_' || (c_custkey % 250 + 350) END AS failure FROM customer""")
def clean_names(spark, d):
    i, c = F.col("c_custkey"), t.read(spark, d, "customer")
    return c.select(
        i.alias("id"), clean.crawler_name(F.md5(i.cast("string").cast("binary")), F.when(i % 3 == 0, F.lit("  ")).otherwise(F.concat(F.lit(" "), "c_name", F.lit(" ")))).alias("name"),
        clean.release_tag(F.when(i % 4 == 0, F.lit("v 1/2")).otherwise(F.concat(F.lit(" vV"), i % 9, F.lit(".0-rc ")))).alias("tag"),
        clean.update_status(F.when(i % 3 == 0, F.lit(" pending ")).when(i % 3 == 1, F.lit("failed")).otherwise(F.lit("lost"))).alias("update_status"),
        clean.username(F.when(i % 5 == 0, F.lit("Ü b")).otherwise(F.concat(F.lit(" USER_"), i, F.lit(" ")))).alias("username"), clean.http_failure_kind(i % 250 + 350).alias("failure"),
    )


@query("""SELECT n_nationkey AS id, list_sort(['a.example.com', lower(n_name[1]) || '.example.org']) AS domains, ['a.example.com', 'x.a.example.com'] AS kept, ['b.com', 'c d'] AS csv FROM nation""")
def domain_lists(spark, d):
    first = F.upper(F.left("n_name", F.lit(1)))
    text = F.concat(F.lit(" a.example.com;https://"), first, F.lit(".Example.org/x\n,a.example.com\t"))
    hosts = F.array(F.lit("a.example.com"), F.lit("ba.example.com"), F.lit("x.a.example.com"))
    return t.read(spark, d, "nation").select(F.col("n_nationkey").alias("id"), clean.domain_list(text).alias("domains"), clean.allowed_hosts(hosts, F.array(F.lit("a.example.com"))).alias("kept"), clean.csv_domains(F.lit(" B.com ,, c D")).alias("csv"))


@query("""SELECT r_regionkey AS id, CASE r_regionkey WHEN 0 THEN 7 WHEN 1 THEN NULL WHEN 2 THEN NULL WHEN 3 THEN 30 END::BIGINT AS after, CASE r_regionkey WHEN 0 THEN 7 WHEN 1 THEN 2 WHEN 2 THEN 4 WHEN 3 THEN 30 ELSE 16 END::BIGINT AS wait FROM region""")
def retry_delays(spark, d):
    i = F.col("r_regionkey")
    after = clean.retry_after(F.when(i == 0, F.lit(" 7 ")).when(i == 1, F.lit("-3")).when(i == 2, F.lit("Wed, 21 Oct 2015")).when(i == 3, F.lit("30")))
    return t.read(spark, d, "region").select(i.alias("id"), after.alias("after"), clean.retry_delay(i, after).alias("wait"))
