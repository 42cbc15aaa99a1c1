"""Helpers that every operator of this subpackage shares."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of characters that are not ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Documents are worked on in slices of about this many bytes, whatever Arrow batch they come in.
SLICE_BYTES = 1 << 20
#: Shuffle files go as soon as a table is written, which then holds what they led to.
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Folders made where spark.checkpoint.dir is unset, by application.
OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a folder of our own, which only a
    local master can share; a cluster must name one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        if app not in OWN:
            OWN[app] = "file://" + tempfile.mkdtemp(prefix="corvane-")
        found = OWN[app]
    return found.rstrip("/")


@contextmanager
def setting(spark: SparkSession, key: str, value: str):
    """A setting of the session that holds inside the block only."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


class Scratch:
    """Tables written to the shared folder, which cut lineage and outlive lost executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.n = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", 0

    def path(self, name: str) -> str:
        self.n += 1
        return f"{self.root}/{self.n:03d}-{name}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        with setting(self.spark, CLEAN, "true"):
            df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._corvane_path = path
        return out

    def free(self, *tables: DataFrame) -> None:
        """Delete tables that nothing reads any more."""
        for t in tables:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(t._corvane_path)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


#: Rows of an Arrow batch at most. Texts may be long, and a batch lies in memory on both sides of the pipe.
BATCH_ROWS = 1000


def id_crc(doc_id: Column) -> Column:
    """crc32 of doc_id as text; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def small_batches(spark: SparkSession) -> None:
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > BATCH_ROWS:
        spark.conf.set(key, BATCH_ROWS)


def doc_columns(docs: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that extra ones can't clash with what an operator adds."""
    small_batches(docs.sparkSession)
    return docs.select(*[F.col(f"`{n}`") for n in names])


def bounded_sample(docs: DataFrame, share: Column | float, most: int, seed: int) -> list:
    """Rows chosen by a hash of doc_id and text, about `share` of them, `most` at most, those of the least hash, so
    that the order of the files decides nothing. Rows that repeat an id but not its text, null
    ids among them, fall on either side like others; rows that repeat both are chosen together, and `most` bounds them."""
    hashed = F.xxhash64("doc_id", "text", F.lit(seed))
    share = F.lit(int(1e6 * min(1.0, share))) if isinstance(share, (int, float)) else share
    return docs.where(F.pmod(hashed, F.lit(1_000_000)) < share).orderBy(hashed, "doc_id").limit(most).collect()


def cuts(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """(first, end) of runs of rows that hold about `most` bytes, at least a row each."""
    first, held = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if held and held + n > most:
            yield first, i
            first, held = i, 0
        held += n
    if first < len(sizes):
        yield first, len(sizes)


def _filled(batch: pa.RecordBatch, text: str) -> pa.Array:
    column = batch.column(batch.schema.get_field_index(text))
    return column.fill_null("") if column.null_count else column


def slices(batch: pa.RecordBatch, text: str = "text", most: int = SLICE_BYTES) -> Iterator[tuple[int, int, list[str]]]:
    """(first row, end row, texts) of slices of about `most` bytes, at least a row each; null texts come as ''."""
    column = _filled(batch, text)
    for i, j in cuts(pc.binary_length(column).to_numpy(zero_copy_only=False), most):
        yield i, j, column.slice(i, j - i).to_pylist()


def byte_slices(batch: pa.RecordBatch, text: str = "text", most: int = SLICE_BYTES // 4) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, ends) of such slices: the texts' UTF-8 one after the other, and where each ends, after a 0."""
    column = _filled(batch, text)
    _, offsets, data = column.buffers()
    wide = pa.types.is_large_string(column.type)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    for i, j in cuts(np.diff(at), most):
        yield i, j, raw[at[i] : at[j]], at[i : j + 1] - at[i]
