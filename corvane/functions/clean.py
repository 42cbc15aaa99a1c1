"""Clean-ups of names, tags, lists and header values as Columns. Null stands for what is refused."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import urls

#: States of a worker's update, and the characters that part a list of domains.
UPDATE_STATES = ("pending", "downloading", "restarting", "failed")
LIST_MARKS = "[,\n\r\t; ]"


def http_failure_kind(status: Column) -> Column:
    """A worker's own name for a failed answer, without the exceptions that the scheduler makes for 408 and 599."""
    known = F.when(status.isin(401, 403), "blocked").when(status == 404, "http_404").when(status == 429, "http_429").when(status.between(500, 599), "http_5xx")
    return known.otherwise(F.concat(F.lit("http_"), status.cast("string")))


def runtime_value(c: Column, most: int) -> Column:
    return F.left(F.nullif(F.trim(c), F.lit("")), F.lit(most))


def crawler_name(crawler_id: Column, name: Column) -> Column:
    return F.coalesce(runtime_value(name, 120), F.concat(F.lit("crawler-"), F.left(crawler_id, F.lit(8))))


def release_tag(c: Column) -> Column:
    bare = F.regexp_replace(F.trim(c), "^[vV]+", "")
    return F.when(bare.rlike("^[A-Za-z0-9.-]+$"), F.concat(F.lit("v"), bare))


def update_status(c: Column) -> Column:
    return F.when(F.trim(c).isin(*UPDATE_STATES), F.trim(c)).otherwise("idle")


def rule_name(c: Column) -> Column:
    return F.when(F.octet_length(F.trim(c)) >= 2, F.trim(c))


def username(c: Column) -> Column:
    name = F.lower(F.trim(c))
    return F.when(name.rlike("^[a-z0-9_-]{3,}$"), name)


def token_preview(c: Column) -> Column:
    return F.concat(F.left(c, F.lit(8)), F.lit("..."), F.right(c, F.lit(4)))


def csv_domains(c: Column) -> Column:
    """Parts between commas, trimmed, in lower case, without blank ones."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda x: F.lower(F.trim(x))), lambda x: x != "")


def domain_list(c: Column) -> Column:
    """The hosts of a list of addresses or domains, each once and sorted; what names no host is left out."""
    parts = F.filter(F.split(F.coalesce(c, F.lit("")), LIST_MARKS), lambda x: F.trim(x) != "")
    return F.array_sort(F.array_distinct(F.filter(F.transform(parts, urls.domain_input), lambda x: x.isNotNull())))


def allowed_hosts(hosts: Column, domains: Column) -> Column:
    """The hosts that are one of the domains or below one; none of them if there are no domains."""
    return F.filter(hosts, lambda h: F.exists(domains, lambda d: (h == d) | h.endswith(F.concat(F.lit("."), d))))


def retry_after(c: Column) -> Column:
    """Whole seconds; dates and signs other than a plus are not understood."""
    return F.when(F.trim(c).rlike(r"^\+?[0-9]+$"), F.trim(c).try_cast("bigint"))


def retry_delay(attempt: Column, after: Column) -> Column:
    """Seconds before another try: 2, 4, 8 ... or what the server asks for, if that is longer."""
    return F.greatest(F.coalesce(after, F.lit(0)), F.pow(F.lit(2), attempt).cast("bigint"))


def positive(c: Column, default: int) -> Column:
    """A whole number above 0, else the default."""
    n = F.when(F.trim(c).rlike(r"^\+?[0-9]+$"), F.trim(c).try_cast("bigint"))
    return F.coalesce(F.when(n > 0, n), F.lit(default).cast("bigint"))
