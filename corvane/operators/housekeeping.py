"""What keeps the frontier in order: released and recovered jobs, staged items, blacklists, due rules, reports, paging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import frontier as fr


def release(jobs: DataFrame, which: Column, now: Column, reason: str, message: Column, wait_s: int = 30) -> DataFrame:
    """The jobs, those in `which` given back: to the queue after a wait, or to the dead letters once their attempts are used up
    (one attempt at least counts). All other rows and values stay. `released` marks them."""
    which = F.coalesce(which, F.lit(False))
    dead = which & (F.greatest("max_attempts", F.lit(1)) <= F.greatest("attempt_count", F.lit(1)))
    new = {
        "status": F.when(dead, "dead_letter").when(which, "queued").otherwise(F.col("status")),
        "next_retry_at": F.when(dead, None).when(which, now + F.make_dt_interval(secs=F.lit(wait_s))).otherwise(F.col("next_retry_at")),
        "failure_kind": F.when(dead, reason).otherwise(F.col("failure_kind")),
        "failure_message": F.when(dead, message).otherwise(F.col("failure_message")),
        "claimed_at": F.when(~which, F.col("claimed_at")),
        "finished_at": F.when(dead, now).when(~which, F.col("finished_at")),
    }
    return jobs.select("*", which.alias("released")).withColumns(new)


def give_back(origins: DataFrame, released: DataFrame, now: Column, wait_s: int = 30) -> DataFrame:
    """The origins with as many fewer jobs in flight as were released, and not to be asked before the wait is over."""
    n = released.where("released").groupBy("owner", "origin_key").agg(F.count("*").alias("n"))
    out = origins.join(n, ["owner", "origin_key"], "left")
    ready = F.greatest("next_allowed_at", now + F.make_dt_interval(secs=F.lit(wait_s)))
    return out.select(
        "owner", "origin_key", F.greatest(F.col("in_flight_count") - F.coalesce("n", F.lit(0)), F.lit(0)).alias("in_flight_count"),
        F.when(F.col("n").isNotNull(), ready).otherwise(F.col("next_allowed_at")).alias("next_allowed_at"),
    )


def take(claimed: DataFrame, jobs: DataFrame, origins: DataFrame, now: Column, lease: str) -> tuple[DataFrame, DataFrame]:
    """Jobs and origins after a claim: claimed jobs carry the lease and one more attempt, their origins more in flight."""
    mine = claimed.select("owner", "id", F.lit(True).alias("_mine"))
    out = jobs.join(mine, ["owner", "id"], "left").withColumn("_mine", F.coalesce("_mine", F.lit(False)))
    out = out.withColumns({
        "status": F.when(F.col("_mine"), "claimed").otherwise(F.col("status")), "claimed_at": F.when(F.col("_mine"), now).otherwise(F.col("claimed_at")),
        "attempt_count": F.col("attempt_count") + F.col("_mine").cast("int"), "lease_id": F.when(F.col("_mine"), lease),
    }).drop("_mine")
    n = claimed.groupBy("owner", "origin_key").agg(F.count("*").alias("n"))
    held = origins.join(n, ["owner", "origin_key"], "left").withColumn("in_flight_count", F.col("in_flight_count") + F.coalesce("n", F.lit(0))).drop("n")
    return out, held


def stage(reports: DataFrame, jobs: DataFrame) -> DataFrame:
    """Reports checked against the leases: `staged` for the first report of a job under its lease with the address that was handed
    out; else `unknown_lease`, `wrong_url` or `repeated`, in this order."""
    held = jobs.select(F.col("lease_id").alias("_lease"), F.col("id").alias("job_id"), F.col("url").alias("_url"))
    first = F.row_number().over(Window.partitionBy("lease_id", "job_id").orderBy("staged_at", "report_id"))
    out = reports.withColumn("_nth", first).join(held, "job_id", "left")
    fits = F.col("_lease").eqNullSafe(F.col("lease_id")) & F.col("_lease").isNotNull()
    verdict = F.when(~fits, "unknown_lease").when(F.col("url") != F.col("_url"), "wrong_url").when(F.col("_nth") > 1, "repeated").otherwise("staged")
    return out.withColumn("verdict", verdict).drop("_nth", "_lease", "_url")


def pending_items(items: DataFrame, n: int) -> DataFrame:
    """The oldest pending items, 1 to 256 of them."""
    return items.where("status = 'pending'").orderBy("staged_at", "lease_id", "job_id").limit(max(1, min(256, n)))


def recover_items(items: DataFrame, jobs: DataFrame, now: Column, timeout_s: int) -> DataFrame:
    """Items stuck in processing: pending again while their job is being ingested, else failed with a message."""
    joined = items.join(jobs.select(F.col("id").alias("job_id"), F.col("status").alias("job_status")), "job_id", "left")
    stuck = (F.col("status") == "processing") & (F.col("started_at") < now - F.make_dt_interval(secs=F.lit(timeout_s))) & F.col("job_status").isNotNull()
    again = stuck & (F.col("job_status") == "ingesting")
    message = F.format_string("projection stalled after crawl job left ingesting (job status: %s)", "job_status")
    return joined.withColumns({
        "status": F.when(again, "pending").when(stuck, "failed").otherwise(F.col("status")),
        "error_message": F.when(stuck & ~again, message),
        "started_at": F.when(~again, F.col("started_at")), "finished_at": F.when(stuck & ~again, now),
    }).drop("job_status")


def suffixes(host: Column) -> Column:
    """A host and every domain above it."""
    parts = F.split(F.lower(host), r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def below(rows: DataFrame, host: str, domains: DataFrame, how: str = "left_semi") -> DataFrame:
    """The rows whose host is one of the domains or below one (or, with left_anti, the others): an equality join on suffixes, so that
    neither side has to be small. `domains` has a column `domain`; the rows need an `id`."""
    ids = rows.where(F.col(host).isNotNull()).select("id", F.explode(suffixes(F.col(host))).alias("domain")).join(domains.select("domain").distinct(), "domain", "left_semi")
    return rows.join(ids.select("id").distinct(), "id", how)


def blacklist_cleanup(docs: DataFrame, jobs: DataFrame, origins: DataFrame, domains: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents of other domains, jobs of other domains or in flight, and origins that still have a job."""
    held = jobs.where(F.col("status").isin("claimed", "ingesting"))
    left = below(jobs.where(~F.col("status").isin("claimed", "ingesting")), "host", domains, "left_anti").unionByName(held)
    return below(docs, "host", domains, "left_anti"), left, origins.join(left, ["owner", "origin_key"], "left_semi")


def expand_due(rules: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(addresses to enqueue, rules): each due rule's seed, to be visited again, and the rules with the time stamped."""
    due = fr.due_rules(rules, now)
    seeds = due.select("owner", F.col("id").alias("rule_id"), F.col("seed_url").alias("url"), F.lit(0).alias("depth"), F.least(F.col("max_depth"), F.lit(10)).alias("max_depth"), F.lit(True).alias("revisit"))
    stamped = rules.join(due.select("id", F.lit(True).alias("_due")), "id", "left")
    return seeds, stamped.withColumn("last_enqueued_at", F.when(F.col("_due"), now).otherwise(F.col("last_enqueued_at"))).drop("_due")


def patch(rows: DataFrame, changes: DataFrame, key: str, clamps: dict[str, tuple[int, int]]) -> DataFrame:
    """The rows with what a change gives (a null leaves the old value), numbers held within their bounds."""
    names = [c for c in changes.columns if c != key]
    new = changes.select(key, *[F.col(c).alias(f"_{c}") for c in names])

    def value(c):
        given = F.col(f"_{c}") if c not in clamps else F.when(F.col(f"_{c}").isNotNull(), F.least(F.greatest(F.col(f"_{c}"), F.lit(clamps[c][0])), F.lit(clamps[c][1])))
        return F.coalesce(given, F.col(c)).alias(c)

    return rows.join(new, key, "left").select(*[value(c) if c in names else F.col(c) for c in rows.columns])


def online(last_seen: Column, now: Column, timeout_s: int) -> Column:
    return F.coalesce(last_seen >= now - F.make_dt_interval(secs=F.lit(timeout_s)), F.lit(False))


def job_summary(jobs: DataFrame) -> DataFrame:
    """One row: pending, successful, filtered, failed and blocked jobs, and the last time any was worked on."""
    s, kept = F.col("status"), F.col("accepted_document_id").isNotNull()
    return jobs.agg(
        F.count_if(s.isin("queued", "claimed", "ingesting")).alias("pending_jobs"), F.count_if((s == "succeeded") & kept).alias("successful_jobs"), F.count_if((s == "succeeded") & ~kept).alias("filtered_jobs"),
        F.count_if(s.isin("failed", "dead_letter")).alias("failed_jobs"), F.count_if(s == "blocked").alias("blocked_jobs"), F.max(F.coalesce("finished_at", "discovered_at")).alias("last_crawled_at"),
    )


def facet(docs: DataFrame, column: str, k: int = 5) -> DataFrame:
    """The k most frequent values of canonical documents; blank and missing ones are counted apart and both named unknown."""
    n = docs.where("duplicate_of is null").groupBy(column).agg(F.count("*").alias("n"))
    label = F.nullif(F.col(column), F.lit(""))
    return n.orderBy(F.col("n").desc(), label.asc_nulls_last()).limit(k).select(F.coalesce(label, F.lit("unknown")).alias("label"), "n")


def page(rows: DataFrame, order: list[Column], limit: int, offset: int, most: int = 50) -> DataFrame:
    """One page of the rows; every row also has the total and the offset of the next page, null on the last."""
    limit = max(1, min(most, limit))
    total = rows.agg(F.count("*").alias("total")).withColumn("_k", F.lit(1))  # one row
    out = rows.orderBy(*order).offset(max(0, offset)).limit(limit).withColumn("_k", F.lit(1)).join(F.broadcast(total), "_k").drop("_k")
    after = offset + F.least(F.lit(limit), F.col("total") - offset)
    return out.withColumn("next_offset", F.when(after < F.col("total"), after).cast("bigint"))


def submit(found: DataFrame, domain: str, known: DataFrame, used: DataFrame) -> DataFrame:
    """Addresses (owner, position, url, host, max_pages) handed in for a domain: `accepted`, `known`, `over_budget` or `foreign`."""
    from ..functions import urls

    own = F.coalesce(urls.within(F.col("host"), domain), F.lit(False))
    new = fr.enqueue(found.where(own).select("owner", "position", "url", "max_pages"), known, used).select("owner", "url", F.lit(True).alias("_new"))
    seen = known.select("owner", "url", F.lit(True).alias("_known")).distinct()
    out = found.join(new, ["owner", "url"], "left").join(seen, ["owner", "url"], "left")
    return out.withColumn("verdict", F.when(~own, "foreign").when(F.col("_new"), "accepted").when(F.col("_known"), "known").otherwise("over_budget")).drop("_new", "_known")


def upsert_edges(old: DataFrame, sources: DataFrame) -> DataFrame:
    """Links (source, target, discovered_at), one for each pair with the last time it was seen. `sources` has the arrays `targets`
    and `seen`, taken pairwise."""
    pairs = sources.select("source", F.explode(F.arrays_zip("targets", "seen")).alias("x")).select("source", F.col("x.targets").alias("target"), F.col("x.seen").alias("discovered_at"))
    return old.unionByName(pairs).where("target is not null").groupBy("source", "target").agg(F.max("discovered_at").alias("discovered_at"))


def seeds(found: DataFrame, per_seed: int) -> DataFrame:
    """Addresses (seed, position, url): the first `per_seed` different ones of each seed, then each address once, where the first seed
    names it. A row each."""
    first = found.groupBy("seed", "url").agg(F.min("position").alias("position"))
    nth = F.row_number().over(Window.partitionBy("seed").orderBy("position"))
    capped = first.withColumn("nth", nth).where(F.col("nth") <= per_seed)
    return capped.groupBy("url").agg(F.min(F.struct("seed", "position")).alias("x")).select("url", "x.seed", "x.position")


def with_conditions(jobs: DataFrame, docs: DataFrame) -> DataFrame:
    """The jobs with the etag and date that the stored document of their address had, for a conditional request."""
    last = docs.groupBy(F.col("canonical_url").alias("url")).agg(F.max_by(F.struct("etag", "last_modified"), "fetched_at").alias("x"))
    return jobs.join(last, "url", "left").select(*jobs.columns, "x.etag", "x.last_modified")


def accounts_with_usage(accounts: DataFrame, usage: DataFrame) -> DataFrame:
    """Accounts with what they used; an account without usage is an error, not a zero."""
    joined = accounts.join(usage, "user_id", "left")
    missing = F.assert_true(F.col("used").isNotNull(), F.lit("an account has no usage row"))
    return joined.where(missing.isNull())
