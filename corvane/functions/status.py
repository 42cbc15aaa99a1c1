"""Fetch status, retry and priority rules as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def failure_kind(status: Column) -> Column:
    return (
        F.when(status == 599, "network_error").when(status.isin(401, 403), "blocked").when(status == 408, "timeout")
        .when(status.between(500, 599), "http_5xx").otherwise(F.concat(F.lit("http_"), status.cast("string")))
    )


def is_retryable(status: Column) -> Column:
    return status.isin(408, 425, 429, 599) | (status >= 500)


def is_blocked(status: Column, kind: Column) -> Column:
    return status.isin(401, 403) | kind.isin("robots", "blocked", "robots_blocked")


def backoff_seconds(attempt: Column) -> Column:
    return F.when(attempt <= 1, 30).when(attempt == 2, 120).otherwise(300)


def origin_wait_seconds(status: Column, kind: Column, crawl_delay: Column, retry_after: Column) -> Column:
    """How long an origin rests after a report: its delay, what the server asks, and more after trouble."""
    ra = F.coalesce(retry_after, F.lit(0))
    extra = F.when(status == 429, F.greatest(ra, F.lit(30))).when(status >= 500, F.greatest(ra, F.lit(60))).when(kind == "network_error", 45).when(kind == "robots", 300).otherwise(0)
    return F.greatest(F.coalesce(crawl_delay, F.lit(1)), F.lit(1), ra, extra)


def depth_priority(depth: Column) -> Column:
    return F.when(depth <= 0, 80).otherwise(50 + (10 - F.least(depth, F.lit(10))) * 3)


def site_authority(inlinks: Column) -> Column:
    return 0.5 + 0.2 * F.log10(F.greatest(inlinks, F.lit(0)) + 1)


def llm_decision(index: Column, discover: Column) -> Column:
    return F.when(index & discover, "indexed").when(index & ~discover, "index_only").when(~index & discover, "discover_only").when(~index & ~discover, "filtered")


def outcome(r: Column | None = None) -> Column:
    """One of filtered, succeeded, unindexable, gone, blocked, requires_js, retry, dead_letter, failed, from the report columns
    status_code, error_kind, llm_should_index, indexable, retryable, attempt_count and max_attempts. The first rule decides."""
    status, kind = F.col("status_code"), F.col("error_kind")
    ok = status.between(200, 299)
    named = F.coalesce(kind, failure_kind(status))
    retry = F.coalesce(F.col("retryable"), is_retryable(status))
    filtered = kind.isin("blacklisted_domain", "site_profile_filtered", "page_noindex") | (kind.isNull() & ~F.coalesce(F.col("llm_should_index"), F.lit(True)))
    again = F.greatest(F.col("attempt_count"), F.lit(1)) < F.greatest(F.col("max_attempts"), F.lit(1))
    return (
        F.when((status == 304) | (ok & filtered), "filtered")
        .when(ok & kind.isNull() & F.col("indexable"), "succeeded").when(ok & kind.isNull(), "unindexable")
        .when(status.isin(404, 410), "gone").when(is_blocked(status, named), "blocked").when(kind == "requires_js_render", "requires_js")
        .when(retry & again, "retry").when(retry, "dead_letter").otherwise("failed")
    )
