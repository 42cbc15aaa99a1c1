"""The engine's tables as projections of the driver's tables, in Spark and as SQL for DuckDB."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.index import SearchIndex
from ..operators.manifest import shared_dir

#: Every query takes the present as an argument; this is the one the registered queries use.
NOW_TEXT = "2024-01-31 00:00:00"


def now() -> Column:
    return F.expr(f"timestamp_ntz'{NOW_TEXT}'")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def days(n: Column) -> Column:
    return F.make_dt_interval(n.cast("int"))


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, text = read(spark, sf_dir, "documents"), F.col("text")
    host = F.concat("source", F.lit(".example.com"))
    url = F.concat(F.lit("https://"), host, F.lit("/"), F.col("lang"), F.lit("/"), F.col("doc_id"))
    return d.select(
        F.col("doc_id").alias("id"), F.substring_index(text, "\n", 1).alias("title"), F.left(text, F.lit(220)).alias("snippet"), text.alias("body"), F.col("lang").alias("language"),
        host.alias("host"), url.alias("canonical_url"), F.concat(host, F.lit("/"), F.col("lang"), F.lit("/"), F.col("doc_id")).alias("display_url"),
        (now() - days(F.col("doc_id") % 120)).alias("fetched_at"), F.sha2(text.cast("binary"), 256).alias("content_hash"), F.lit("clearnet").alias("network"), F.when(F.col("doc_id") % 5 > 0, F.lit(0.3) + (F.col("doc_id") % 9) / F.lit(10.0)).alias("site_authority"),
    )


DOCS = f"""docs AS (SELECT doc_id AS id, split_part(text, chr(10), 1) AS title, left(text, 220) AS snippet, text AS body, lang AS language, source || '.example.com' AS host,
 'https://' || source || '.example.com/' || lang || '/' || doc_id AS canonical_url, source || '.example.com/' || lang || '/' || doc_id AS display_url,
 TIMESTAMP '{NOW_TEXT}' - to_days((doc_id % 120)::INT) AS fetched_at, sha256(text) AS content_hash, CASE WHEN doc_id % 5 > 0 THEN 0.3::DOUBLE + (doc_id % 9) / 10.0::DOUBLE END AS site_authority FROM documents)"""


#: Indexes of this application, by kind, folder and what the files were when they were read.
INDEXES: dict[tuple, SearchIndex] = {}


def kept_index(spark: SparkSession, sf_dir: str, kind: str, make) -> SearchIndex:
    """An index that is made when the files are new and read again by later searches."""
    state = []
    for name in ("documents", "labels"):
        files = read(spark, sf_dir, name).select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
        state.append(files.agg(F.bit_xor(F.xxhash64("file_path", "file_size", "file_modification_time"))).first()[0])
    key = (spark.sparkContext.applicationId, kind, sf_dir, *state)
    if key not in INDEXES:
        found = SearchIndex(spark, f"{shared_dir(spark)}/index-{uuid.uuid4().hex}", buckets=16)
        make(found)
        INDEXES[key] = found
    return INDEXES[key]


def index(spark: SparkSession, sf_dir: str) -> SearchIndex:
    """The index of docs()."""
    return kept_index(spark, sf_dir, "plain", lambda x: x.rebuild(docs(spark, sf_dir)))


def updated_index(spark: SparkSession, sf_dir: str) -> SearchIndex:
    """The same after documents labelled toxic were deleted, and those of low quality indexed anew with host and language as their
    title."""
    labels = read(spark, sf_dir, "labels").where("doc_id IS NOT NULL")
    toxic = labels.where("toxic = 1").select(F.col("doc_id").alias("id")).distinct()
    poor = labels.where("quality = 0").select(F.col("doc_id").alias("id")).distinct().join(toxic, "id", "left_anti")

    def make(x: SearchIndex) -> None:
        x.rebuild(docs(spark, sf_dir))
        x.delete(toxic)
        x.add(docs(spark, sf_dir).join(poor, "id", "left_semi").withColumn("title", F.concat("host", F.lit(" "), "language")))

    return kept_index(spark, sf_dir, "updated", make)


UPDATED = """docs AS (SELECT * REPLACE (CASE WHEN id IN (SELECT doc_id FROM labels WHERE quality = 0) THEN host || ' ' || language ELSE title END AS title) FROM old
 WHERE id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1 AND doc_id IS NOT NULL))"""


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "succeeded").when(F.col("o_orderstatus") == "O", "queued").otherwise("claimed")
    return o.select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("origin_key"), (F.col("o_custkey") % 25).alias("owner"), status.alias("status"), (80 - 10 * F.left("o_orderpriority", F.lit(1)).cast("int")).cast("long").alias("priority"),
        F.col("o_orderdate").alias("discovered_at"), F.when(F.col("o_orderkey") % 7 == 0, now() + days(F.col("o_orderkey") % 3 - 1)).alias("next_retry_at"), (F.col("o_orderkey") % 5 == 0).alias("requires_js"),
        (F.col("o_orderkey") % 3).alias("same_origin_concurrency"), (F.col("o_orderkey") % 4).alias("attempt_count"), F.lit(3).cast("long").alias("max_attempts"),
        F.when(status == "claimed", now() - F.make_dt_interval(secs=F.col("o_orderkey") % 600)).alias("claimed_at"),
    )


JOBS = f"""jobs AS (SELECT o_orderkey AS id, o_custkey AS origin_key, o_custkey % 25 AS owner, CASE o_orderstatus WHEN 'F' THEN 'succeeded' WHEN 'O' THEN 'queued' ELSE 'claimed' END AS status,
 (80 - 10 * left(o_orderpriority, 1)::INT)::BIGINT AS priority, o_orderdate AS discovered_at, CASE WHEN o_orderkey % 7 = 0 THEN TIMESTAMP '{NOW_TEXT}' + to_days((o_orderkey % 3 - 1)::INT) END AS next_retry_at,
 o_orderkey % 5 = 0 AS requires_js, o_orderkey % 3 AS same_origin_concurrency, o_orderkey % 4 AS attempt_count, 3::BIGINT AS max_attempts,
 CASE WHEN o_orderstatus NOT IN ('F', 'O') THEN TIMESTAMP '{NOW_TEXT}' - to_seconds((o_orderkey % 600)::INT) END AS claimed_at FROM orders)"""


def origins(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer")
    return c.select(
        F.col("c_custkey").alias("origin_key"), (F.col("c_custkey") % 25).alias("owner"), (now() + F.make_dt_interval(secs=F.floor("c_acctbal") - 2000)).alias("next_allowed_at"),
        (F.col("c_custkey") % 4).alias("in_flight_count"), (F.col("c_custkey") % 6).alias("consecutive_failures"),
    )


ORIGINS = f"""origins AS (SELECT c_custkey AS origin_key, c_custkey % 25 AS owner, TIMESTAMP '{NOW_TEXT}' + to_seconds((floor(c_acctbal) - 2000)::INT) AS next_allowed_at,
 c_custkey % 4 AS in_flight_count, c_custkey % 6 AS consecutive_failures FROM customer)"""


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fetch reports from the events: the status code cycles through what servers answer."""
    e = read(spark, sf_dir, "events")
    codes = F.array(*map(F.lit, STATUSES))
    i = F.col("event_id")
    return e.select(
        i.alias("job_id"), (F.col("user_id") % 200).alias("origin_key"), F.concat(F.lit("d"), F.col("user_id") % 40, F.lit(".example.com")).alias("domain"), F.col("ts").alias("fetched_at"),
        F.get(codes, (i % len(STATUSES)).cast("int")).alias("status_code"),
        F.when(i % 11 == 0, "network_error").when(i % 13 == 0, "robots").when(i % 17 == 0, "page_noindex").when(i % 19 == 0, "requires_js_render").alias("error_kind"),
        F.when(i % 5 > 0, i % 23 > 0).alias("llm_should_index"), (i % 29 > 0).alias("indexable"), F.when(i % 31 == 0, F.lit(True)).alias("retryable"), (i % 4).alias("attempt_count"), F.lit(3).cast("long").alias("max_attempts"),
        F.when(i % 3 > 0, i % 10).alias("crawl_delay"), F.when(i % 6 == 0, i % 90).alias("retry_after"),
    )


STATUSES = (200, 200, 304, 404, 200, 403, 429, 500, 200, 599, 410, 418, 301, 408, 200)
REPORTS = f"""reports AS (SELECT event_id AS job_id, user_id % 200 AS origin_key, 'd' || (user_id % 40) || '.example.com' AS domain, ts AS fetched_at, {list(STATUSES)}[event_id % {len(STATUSES)} + 1] AS status_code,
 CASE WHEN event_id % 11 = 0 THEN 'network_error' WHEN event_id % 13 = 0 THEN 'robots' WHEN event_id % 17 = 0 THEN 'page_noindex' WHEN event_id % 19 = 0 THEN 'requires_js_render' END AS error_kind,
 CASE WHEN event_id % 5 > 0 THEN event_id % 23 > 0 END AS llm_should_index, event_id % 29 > 0 AS indexable, CASE WHEN event_id % 31 = 0 THEN true END AS retryable, event_id % 4 AS attempt_count, 3 AS max_attempts,
 CASE WHEN event_id % 3 > 0 THEN event_id % 10 END AS crawl_delay, CASE WHEN event_id % 6 = 0 THEN event_id % 90 END AS retry_after FROM events)"""


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("source"), F.col("l_partkey").alias("target"))
