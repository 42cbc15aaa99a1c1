"""An offline crawl as files: seeds, a frontier of JSON lines, a manifest beside stored pages, and an index of documents."""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import urls
from . import web

FRONTIER = "url string, source string, discovered_at string"
MANIFEST = "url string, fetched_at string, content_type string, storage_path string"
DOCUMENT = (
    "id string, title string, url string, display_url string, snippet string, body string, language string, last_crawled_at string, suggest_terms array<string>, "
    "site_authority double, content_type string, word_count bigint"
)


def read_seeds(spark: SparkSession, path: str) -> DataFrame:
    """(n, name, url, sitemap) of a configuration with a list `seeds`, in JSON, or in YAML where a YAML library is at hand."""
    raw = "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())  # a configuration, written by hand
    try:
        found = json.loads(raw)
    except ValueError:
        import yaml

        found = yaml.safe_load(raw)
    rows = [(i, s["name"], s["url"], s.get("sitemap")) for i, s in enumerate(found["seeds"])]
    return spark.createDataFrame(rows, "n int, name string, url string, sitemap string")


def discover(seeds: DataFrame, pages: DataFrame, sitemaps: DataFrame, per_seed: int) -> DataFrame:
    """Addresses (url, source) in order: of each seed itself, then what its sitemap names and what its page links to, `per_seed` of
    either at most; an address counts where it is first seen. pages: (url, html), sitemaps: (url, raw)."""
    links = seeds.join(pages, "url").select("n", "name", F.lit(2).alias("kind"), F.posexplode(F.slice(web.parse_html("url", "html")["links"], 1, per_seed)).alias("i", "url"))
    entries = seeds.select("n", "name", F.col("sitemap").alias("at")).join(sitemaps.withColumnRenamed("url", "at"), "at")
    named = F.slice(F.transform(web.sitemap_entries("raw"), lambda e: e["loc"]), 1, per_seed)
    mapped = entries.select("n", "name", F.lit(1).alias("kind"), F.posexplode(named).alias("i", "url"))
    own = seeds.select("n", "name", F.lit(0).alias("kind"), F.lit(0).alias("i"), "url")
    every = own.unionByName(mapped).unionByName(links)
    first = every.groupBy("url").agg(F.min(F.struct("n", "kind", "i", "name")).alias("x"))
    return first.orderBy("x.n", "x.kind", "x.i").select("url", F.col("x.name").alias("source"))


def write_frontier(entries: DataFrame, path: str) -> None:
    entries.write.mode("overwrite").json(path)


def read_frontier(spark: SparkSession, path: str, limit: int) -> DataFrame:
    """The first entries of the files, in the order of file and line."""
    at = spark.read.text(path).select("value", F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    rows = at.orderBy("file", "block", "line").limit(limit)
    return rows.select(F.from_json("value", FRONTIER).alias("x")).select("x.*")


def read_pages(spark: SparkSession, root: str) -> DataFrame:
    """The manifest's rows with the stored HTML; a row whose file is missing has none."""
    manifest = spark.read.schema(MANIFEST).json(f"{root}/manifest.jsonl")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.html").load(root)
    stored = files.select(F.substring_index("path", "/", -1).alias("file"), F.col("content").cast("string").alias("html"))
    return manifest.withColumn("file", F.substring_index("storage_path", "/", -1)).join(stored, "file", "left").drop("file")


def build_index(pages: DataFrame) -> DataFrame:
    """DOCUMENT of every page (url, fetched_at, content_type, html) with visible text."""
    p = pages.withColumn("p", web.parse_html("url", F.coalesce("html", F.lit("")))).where("p.body <> ''")
    title = F.coalesce(F.nullif(F.trim("p.title"), F.lit("")), F.col("url"))
    return p.select(
        F.sha2("url", 256).alias("id"), title.alias("title"), "url", urls.display(F.col("url")).alias("display_url"), F.left("p.snippet", F.lit(220)).alias("snippet"), F.left("p.body", F.lit(4000)).alias("body"),
        F.coalesce(web.detect_language("p.body"), F.lit("unknown")).alias("language"), F.col("fetched_at").cast("string").alias("last_crawled_at"), tx.derive_terms(title, F.col("p.body")).alias("suggest_terms"),
        F.lit(0.5).alias("site_authority"), "content_type", tx.word_count(F.col("p.body")).cast("bigint").alias("word_count"),
    )


def write_index(documents: DataFrame, path: str) -> None:
    documents.write.mode("overwrite").json(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """Documents of JSON lines or of one JSON array; without a file no rows."""
    try:
        return spark.read.schema(DOCUMENT).option("multiLine", path.endswith(".json")).json(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], DOCUMENT)
