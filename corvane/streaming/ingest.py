"""Streaming projection of crawl reports, and stream versions of the tumbling counters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import status as st
from ..functions import text as tx
from ..operators.documents import Snapshots, mark_duplicates

REPORT = (
    "lease_id string, job_id string, url string, final_url string, status_code int, fetched_at timestamp_ntz, title string, body string, error_kind string, "
    "llm_should_index boolean, retryable boolean, attempt_count int, max_attempts int"
)


def classified(reports: DataFrame) -> DataFrame:
    """Each report once, with its outcome."""
    once = reports.dropDuplicates(["lease_id", "job_id"])
    has_text = (F.trim(F.coalesce("title", F.lit(""))) != "") & (F.trim(F.coalesce("body", F.lit(""))) != "")
    return once.withColumn("indexable", has_text & ~F.coalesce(tx.is_spam(F.col("body")), F.lit(True))).withColumn("outcome", st.outcome())


def latest(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The last row of each key, by an aggregation."""
    best = F.max_by(F.struct(*rows.columns), F.struct(*order))
    return rows.groupBy(F.col(key).alias("_key")).agg(best.alias("x")).select("x.*")


def project(batch: DataFrame, documents: Snapshots, jobs: Snapshots, quarantine: str | None = None, batch_id: int = 0) -> None:
    """Apply one micro-batch. A batch that comes again changes nothing: rows are keyed by what they are about, and an older report
    never replaces a newer one. Reports that can't be applied (unreadable, or without job, lease, time or address) are written to
    `quarantine`, a folder for each batch, and hold nothing else up."""
    spark = batch.sparkSession
    whole = F.col("lease_id").isNotNull() & F.col("job_id").isNotNull() & F.col("fetched_at").isNotNull() & F.col("final_url").isNotNull()
    if "_corrupt_record" in batch.columns:
        whole &= F.col("_corrupt_record").isNull()
    batch = batch.persist()
    try:
        if quarantine and not (bad := batch.where(~whole)).isEmpty():
            bad.write.mode("overwrite").parquet(f"{quarantine}/batch={batch_id}")
        c = classified(batch.where(whole))
        state = c.select("job_id", "lease_id", "outcome", "fetched_at")
        known = jobs.read().unionByName(state) if jobs.version() else state
        jobs.write(latest(known, "job_id", "fetched_at", "lease_id"))
        seen = c.where(F.col("outcome").isin("succeeded", "gone")).select(
            F.sha2("final_url", 256).alias("id"), F.col("final_url").alias("canonical_url"), "title", "body", "fetched_at", F.sha2("body", 256).alias("content_hash"), (F.col("outcome") == "gone").alias("gone")
        )
        # when a document went is kept beside the documents and written first, so that no older report brings it back
        graves = Snapshots(spark, f"{documents.root}-gone")
        dead = c.where("outcome = 'gone'").select(F.sha2("final_url", 256).alias("id"), "fetched_at")
        dead = latest(graves.read().unionByName(dead) if graves.version() else dead, "id", "fetched_at")
        graves.write(dead)
        seen = seen.where("not gone").drop("gone")
        if documents.version():
            seen = documents.read().drop("duplicate_of").unionByName(seen)
        last = latest(seen, "id", "fetched_at", "content_hash").join(graves.read().withColumnRenamed("fetched_at", "_gone"), "id", "left")
        documents.write(mark_duplicates(last.where("_gone IS NULL OR fetched_at > _gone").drop("_gone")))
    finally:
        batch.unpersist()


def start_projector(spark: SparkSession, source: str, documents: Snapshots, jobs: Snapshots, checkpoint: str, files: int = 64, available_now: bool = True, quarantine: str | None = None):
    """Read staged report files as a stream; each micro-batch goes through project()."""
    reports = spark.readStream.schema(f"{REPORT}, _corrupt_record string").option("maxFilesPerTrigger", files).json(source)
    writer = reports.writeStream.foreachBatch(lambda df, n: project(df, documents, jobs, quarantine, n)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="2 seconds")).start()


def rate_windows(requests: DataFrame, limit: int = 120) -> DataFrame:
    """Requests of an ip in each minute and whether they pass the limit; the watermark only bounds the state."""
    counts = requests.withWatermark("ts", "2 minutes").groupBy(F.window("ts", "60 seconds"), "ip").count()
    return counts.select(F.col("window.start").alias("start"), "ip", "count", (F.col("count") > limit).alias("over"))


def daily_usage(requests: DataFrame) -> DataFrame:
    return requests.withWatermark("ts", "1 day").groupBy(F.window("ts", "1 day"), "user_id").count().select(F.col("window.start").alias("day"), "user_id", F.col("count").alias("used"))
