"""The crawl frontier set-wise: claims, enqueueing, staleness, recrawls, origins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import status as st


def claim(jobs: DataFrame, origins: DataFrame, now: Column, n: int, with_js: bool = False) -> DataFrame:
    """The jobs to hand out next: queued, ready, of a ready origin, within the origin's concurrency less what it has in flight;
    by readiness of the origin, priority and age."""
    active = jobs.where(F.col("status").isin("claimed", "ingesting")).groupBy("owner", "origin_key").agg(F.count("*").alias("active"))
    ready = jobs.where((F.col("status") == "queued") & (F.col("next_retry_at").isNull() | (F.col("next_retry_at") <= now)) & (F.lit(with_js) | ~F.col("requires_js")))
    ready = ready.join(origins.where(F.col("next_allowed_at") <= now), ["owner", "origin_key"]).join(active, ["owner", "origin_key"], "left")
    rank = F.row_number().over(Window.partitionBy("owner", "origin_key").orderBy(F.col("priority").desc(), "discovered_at", "id"))
    fair = ready.withColumn("rank", rank).where(F.coalesce("active", F.lit(0)) + F.col("rank") <= F.greatest("same_origin_concurrency", F.lit(1)))
    return fair.orderBy("next_allowed_at", F.col("priority").desc(), "discovered_at", "id").limit(max(1, min(100, n)))


def enqueue(found: DataFrame, known: DataFrame, used: DataFrame) -> DataFrame:
    """New addresses (owner, position, url, budget) not known to the owner, each once, in order, as far as the budget goes.
    `used` has (owner, used): what the budget had already spent."""
    first = found.groupBy("owner", "url").agg(F.min("position").alias("position"), F.max("max_pages").alias("max_pages"))
    new = first.join(known, ["owner", "url"], "left_anti").join(used, "owner", "left")
    order = F.row_number().over(Window.partitionBy("owner").orderBy("position", "url"))
    return new.withColumn("nth", order).where(F.col("nth") <= F.col("max_pages") - F.coalesce("used", F.lit(0)))


def requeue_stale(jobs: DataFrame, now: Column, timeout_s: int, status: str, reason: str) -> DataFrame:
    """Jobs stuck in `status` go back to the queue in 30 s, or to the dead letters once their attempts are used up."""
    stale = (F.col("status") == status) & (F.col("claimed_at") < now - F.make_dt_interval(secs=F.lit(timeout_s)))
    spent = F.greatest("attempt_count", F.lit(1)) >= F.greatest("max_attempts", F.lit(1))
    return jobs.select(
        "id", F.when(stale, F.when(spent, "dead_letter").otherwise("queued")).otherwise(F.col("status")).alias("status"),
        F.when(stale & spent, None).when(stale, now + F.make_dt_interval(secs=F.lit(30))).otherwise(F.col("next_retry_at")).alias("next_retry_at"), F.when(stale & spent, reason).alias("failure_kind"),
    )


def due_rules(rules: DataFrame, now: Column) -> DataFrame:
    """Enabled rules never run, or not for their interval of minutes."""
    minutes = F.timestamp_diff("MICROSECOND", F.col("last_enqueued_at"), now) / 60e6
    return rules.where(F.col("enabled") & (F.col("last_enqueued_at").isNull() | (minutes >= F.col("interval_minutes"))))


def recrawl_candidates(docs: DataFrame, stats: DataFrame, now: Column, n: int = 100) -> DataFrame:
    """The oldest documents past their domain's change interval of 24 to 720 hours (168 if unknown)."""
    hours = F.rint(F.least(F.greatest(F.coalesce("avg_change_frequency_hours", F.lit(168.0)), F.lit(24.0)), F.lit(720.0))).cast("int")
    old = docs.join(stats, F.col("host") == F.col("domain"), "left").where(F.col("fetched_at") < now - F.make_dt_interval(hours=hours))
    return old.orderBy("fetched_at", "id").limit(n)


def change_frequency(checks: DataFrame) -> DataFrame:
    """Per domain the hours between changes after each check: changes over checks times 168, null at the first."""
    run = Window.partitionBy("domain").orderBy("checked_at", "id").rowsBetween(Window.unboundedPreceding, 0)
    n = F.count("*").over(run)
    return checks.select("*", F.when(n > 1, F.sum(F.col("changed").cast("long")).over(run) / n * 168.0).alias("hours"))


def domain_health(events: DataFrame) -> DataFrame:
    """Per domain the state after all events: failures since the last success, and the level they mean."""
    last_ok = events.where("ok").groupBy("domain").agg(F.max(F.struct("at", "id")).alias("last"))
    joined = events.join(last_ok, "domain", "left")
    since = F.col("last").isNull() | (F.struct("at", "id") > F.col("last"))
    out = joined.groupBy("domain").agg(F.count_if("ok").alias("pages"), F.count_if(~F.col("ok")).alias("failed"), F.count_if(~F.col("ok") & since).alias("streak"))
    return out.withColumn("health", F.when(F.col("streak") >= 10, "unhealthy").when(F.col("streak") >= 5, "degraded").otherwise("healthy"))


def update_origins(origins: DataFrame, reports: DataFrame) -> DataFrame:
    """Each origin after a batch of reports: in flight less one each, failures in a row, and when it may be asked again."""
    wait = st.origin_wait_seconds(F.col("status_code"), F.col("error_kind"), F.col("crawl_delay"), F.col("retry_after"))
    bad = F.col("status_code").isin(429) | F.col("status_code").between(500, 599) | (F.coalesce("error_kind", F.lit("")) == "network_error")
    ready = F.col("fetched_at") + F.make_dt_interval(secs=wait)
    batch = reports.groupBy("origin_key").agg(
        F.count("*").alias("done"), F.max(ready).alias("ready_at"), F.max(F.when(~bad, F.struct("fetched_at", "job_id"))).alias("last_ok")
    )
    marked = reports.withColumn("bad", bad).join(batch, "origin_key")
    streak = marked.where(F.col("bad") & (F.col("last_ok").isNull() | (F.struct("fetched_at", "job_id") > F.col("last_ok")))).groupBy("origin_key").agg(F.count("*").alias("streak"))
    out = origins.join(batch, "origin_key", "left").join(streak, "origin_key", "left")
    return out.select(
        "origin_key", F.greatest("next_allowed_at", F.coalesce("ready_at", "next_allowed_at")).alias("next_allowed_at"),
        F.greatest(F.lit(0), F.col("in_flight_count") - F.coalesce("done", F.lit(0))).alias("in_flight_count"),
        (F.when(F.col("last_ok").isNotNull(), 0).otherwise(F.col("consecutive_failures")) + F.coalesce("streak", F.lit(0))).alias("consecutive_failures"),
    )


def trim_events(events: DataFrame, keep: int = 400) -> DataFrame:
    """The last events of each owner."""
    order = Window.partitionBy("owner").orderBy(F.col("created_at").desc(), F.col("id").desc())
    return events.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= keep).drop("nth")


def inlinks(edges: DataFrame) -> DataFrame:
    return edges.groupBy("target").agg(F.countDistinct("source").alias("inlinks"))


def quota_verdicts(requests: DataFrame, limit: int) -> DataFrame:
    """Requests by user and day in order; the first `limit` that ask something are served. Empty queries aren't counted."""
    asked = F.trim(F.coalesce("q", F.lit(""))) != ""
    nth = F.count_if(asked).over(Window.partitionBy("user_id", F.to_date("ts")).orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, 0))
    return requests.select("*", F.when(~asked, "rejected").when(nth <= limit, "served").otherwise("exceeded").alias("verdict"))


def rate_verdicts(requests: DataFrame, limit: int = 120, window_s: int = 60) -> DataFrame:
    """Tumbling windows: requests beyond `limit` of one ip in one window are refused."""
    window = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / window_s)
    nth = F.row_number().over(Window.partitionBy("ip", window).orderBy("ts", "id"))
    return requests.select("*", window.alias("window"), F.when(nth <= limit, True).otherwise(False).alias("allowed"))
