"""A set of keyed tables that change together: buckets of Parquet files, named by one manifest."""

from __future__ import annotations

import uuid
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .manifest import Manifest


#: Sizes up to which Spark sends a whole side of a join through the driver: it takes a file's compressed columns for the size of the rows.
BROADCAST = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")


@contextmanager
def merged_joins(spark: SparkSession):
    """Inside, both sides of every join are shuffled, so that what the driver gets doesn't grow with the tables. A batch has some 90
    joins, each of which could be broadcast otherwise. It holds for what runs inside, not for what is only planned there."""
    before = {k: spark.conf.get(k, None) for k in BROADCAST}
    try:
        for k in BROADCAST:
            spark.conf.set(k, "-1")
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@dataclass(frozen=True)
class Table:
    """columns as DDL; key: the columns that tell rows apart, by which they lie in buckets. A table without a key is only added to."""

    columns: str
    key: tuple[str, ...] = ()


@dataclass(frozen=True)
class Change:
    """Rows that replace those of the same key (or are added, where there is no key), and keys whose rows go."""

    rows: DataFrame | None = None
    gone: DataFrame | None = None


class Tables:
    """Tables below a folder that all executors share. A commit reads and writes the buckets that its changes touch, of every table,
    and then names them all in one manifest: a reader sees all of it or nothing, and a writer that dies leaves files that no manifest
    names. One writer at a time; a second one gets an error and changes nothing."""

    def __init__(self, spark: SparkSession, root: str, tables: dict[str, Table], buckets: int = 16):
        self.spark, self.root, self.tables = spark, root.rstrip("/"), tables
        self.manifest = Manifest(spark, root)
        self.buckets = self.manifest.read().get("buckets", buckets)

    def note(self) -> dict:
        """What the last commit noted beside the tables."""
        return self.manifest.read().get("note", {})

    def bucket(self, name: str) -> Column:
        key = self.tables[name].key
        return F.pmod(F.xxhash64(*key), F.lit(self.buckets)).cast("int") if key else F.lit(0)

    def touched(self, name: str, keys: DataFrame) -> list[int]:
        with merged_joins(self.spark):
            return sorted(r[0] for r in keys.select(self.bucket(name)).distinct().collect())  # as many as there are buckets at most

    def read(self, name: str, near: DataFrame | None = None, at: list[int] | None = None) -> DataFrame:
        """The rows of a table; with `near`, those of the buckets in which its keys would lie; with `at`, of some buckets."""
        held = self.manifest.read().get("tables", {}).get(name, {})
        wanted = set(self.touched(name, near)) if near is not None and held else at
        paths = [f"{self.root}/{name}/{f}/bucket={b}" for b, folders in held.items() if wanted is None or int(b) in wanted for f in folders]
        return self.spark.read.schema(self.tables[name].columns).parquet(*paths) if paths else self.spark.createDataFrame([], self.tables[name].columns)

    def stage(self, rows: DataFrame) -> DataFrame:
        """Rows written once for all that is made from them; gone after the next commit."""
        path = f"{self.root}/staging/{uuid.uuid4().hex}"
        with merged_joins(self.spark):
            rows.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def commit(self, changes: dict[str, Change], note: dict | None = None) -> int:
        """Make all changes at once. Keys of a change's rows must be unique; a key that is also gone stays with its new row."""
        with merged_joins(self.spark):
            return self._commit(changes, note)

    def _commit(self, changes: dict[str, Change], note: dict | None) -> int:
        after = self.manifest.number()
        said = self.manifest.read(after)
        tables = {n: dict(b) for n, b in said.get("tables", {}).items()}
        with ThreadPoolExecutor(4) as pool:  # the tables' jobs are small and independent
            for name, held in zip(changes, pool.map(lambda x: self._write(*x), changes.items())):
                was = tables.setdefault(name, {})
                was.update(held if self.tables[name].key else {b: [*was.get(b, []), *f] for b, f in held.items()})
        number = self.manifest.commit({"tables": tables, "note": said.get("note", {}) | (note or {}), "buckets": self.buckets}, after)
        self.manifest.forget()
        self._sweep()
        return number

    def _write(self, name: str, change: Change) -> dict[str, list[str]]:
        """Write the buckets that a change touches; which folder holds each now."""
        key, folder, columns = list(self.tables[name].key), uuid.uuid4().hex, self.tables[name].columns
        rows = change.rows if change.rows is not None else self.spark.createDataFrame([], columns)
        rows = rows.select(*[f.name for f in self.spark.createDataFrame([], columns).schema])
        touched = []
        if key:
            keys = rows.select(*key)
            keys = (keys if change.gone is None else keys.unionByName(change.gone.select(*key))).distinct()
            touched = self.touched(name, keys)
            rows = self.read(name, at=touched).join(keys, key, "left_anti").unionByName(rows)
        out = rows.withColumn("bucket", self.bucket(name))
        (out.repartition("bucket") if key else out).write.partitionBy("bucket").option("compression", "zstd").parquet(f"{self.root}/{name}/{folder}")
        made = {f.removeprefix("bucket=") for f in self.manifest.folders(f"{self.root}/{name}/{folder}") if f.startswith("bucket=")}
        return {str(b): [folder] if str(b) in made else [] for b in touched} if key else {b: [folder] for b in made}

    def _sweep(self) -> None:
        """Drop what neither of the last two manifests names. Nothing but a writer that failed, or staging, leaves such folders."""
        kept = [self.manifest.read(n)["tables"] for n in self.manifest.numbers()]
        for name in self.tables:
            wanted = {f for tables in kept for folders in tables.get(name, {}).values() for f in folders}
            for folder in self.manifest.folders(f"{self.root}/{name}"):
                if folder not in wanted:
                    self.manifest.drop(f"{self.root}/{name}/{folder}")
        self.manifest.drop(f"{self.root}/staging")


def ranked(tables: Tables, rows: DataFrame, group: list[str], order: list[Column], name: str = "nth") -> DataFrame:
    """Rows with their number within a group, from 1, without sorting a group in one task: rows are range-sorted by group and order, and
    each part's number in it is added to what the parts before it hold of the group (a row a group and part)."""
    from pyspark.sql import Window

    keys = [F.col(g) for g in group]
    parts = tables.stage(rows.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()))
    sizes = parts.groupBy(*group, "_part").agg(F.count("*").alias("_n"))
    ahead = F.coalesce(F.sum("_n").over(Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.row_number().over(Window.partitionBy(*group, "_part").orderBy(*order))
    counted = parts.withColumn("_in", inside).join(sizes.withColumn("_ahead", ahead).drop("_n"), [*group, "_part"])
    return counted.withColumn(name, (F.col("_in") + F.col("_ahead")).cast("long")).drop("_in", "_ahead", "_part")
