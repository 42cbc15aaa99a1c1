"""Token ids in Parquet: a dictionary-coded list column beside delta-coded metadata, in small row groups with page indexes.

A table of this format is a folder with `data` (rows in ascending doc_id order over the files: part, doc_id, local_start,
n_tokens, ids) and `parts` (for each part the ids before it, and its numbers of documents and ids).
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import bpe
from .common import doc_columns, slices

DATA = "part int, doc_id bigint, local_start bigint, n_tokens bigint, ids array<int>"
ARROW = pa.schema([("part", pa.int32()), ("doc_id", pa.int64()), ("local_start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32()))])
#: Writer settings. Version 2 codes integers without a dictionary as deltas; column and offset indexes come with every page.
LAYOUT = {
    "compression": "zstd",
    "parquet.writer.version": "v2",
    "parquet.block.size": str(16 << 20),
    "parquet.page.size": str(64 << 10),
    "parquet.page.row.count.limit": "512",
    "parquet.enable.dictionary": "false",
    "parquet.enable.dictionary#ids.list.element": "true",
}


def write_token_files(docs: DataFrame, path: str, end_id: int = 2, tokenizer: tuple[str, str, str] | None = None) -> None:
    """Encode every document, append end_id, and write the table in ascending doc_id order (nulls first; equal ids
    by a hash of the text, then by the text).

    One range shuffle of the texts puts them in order, rows of one id too, so that none of them fill a task; each task then
    encodes its range as a stream and keeps a running start. Null text: empty. Empty table: a table without rows. Other columns are ignored.
    """
    args = tokenizer or bpe.default_paths()
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        encoder, part, start = bpe.encoder(*args), TaskContext.get().partitionId(), 0
        for b in batches:
            ids = b.column(0)
            for i, j, texts in slices(b):
                raw = [r + end for r in encoder.encode_many(texts)]
                n = np.array([len(r) // 4 for r in raw], np.int64)
                ends = np.cumsum(n)
                values = pa.array(np.frombuffer(b"".join(raw), "<i4"))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), values)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), part, np.int32)), ids.slice(i, j - i), pa.array(start + ends - n), pa.array(n), lists], schema=ARROW)
                start += int(ends[-1])

    keyed = doc_columns(docs, "doc_id", "text").withColumn("print", F.xxhash64("text"))
    ordered = keyed.repartitionByRange("doc_id", "print").sortWithinPartitions("doc_id", "print", "text").select("doc_id", "text")
    ordered.mapInArrow(run, DATA).write.options(**LAYOUT).parquet(f"{path}/data")
    spark = docs.sparkSession
    parts = spark.read.schema(DATA).parquet(f"{path}/data").groupBy("part").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_ids"))
    before = F.sum("n_ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))  # a row for each file
    parts.withColumn("ids_before", F.coalesce(before, F.lit(0))).coalesce(1).write.parquet(f"{path}/parts")


def read_token_files(spark: SparkSession, path: str, ids: bool = True) -> DataFrame:
    """doc_id, start, n_tokens and, if asked for, ids. Without ids only the metadata pages are read."""
    data = spark.read.schema(DATA).parquet(f"{path}/data")
    parts = spark.read.schema("part int, n_docs bigint, n_ids bigint, ids_before bigint").parquet(f"{path}/parts")
    joined = data.join(F.broadcast(parts.select("part", "ids_before")), "part")  # as many rows as there are files
    return joined.select("doc_id", (F.col("ids_before") + F.col("local_start")).alias("start"), "n_tokens", *["ids"] * ids)


def with_crc(tokens: DataFrame) -> DataFrame:
    """Replace ids by ids_crc32, the unsigned crc32 of the ids as little-endian unsigned 32-bit integers."""

    def run(batches):
        for b in batches:
            lists = b.column(3)
            ends, values = lists.offsets.to_numpy(), lists.values.to_numpy()
            crc = [zlib.crc32(values[i:j].tobytes()) for i, j in zip(ends[:-1].tolist(), ends[1:].tolist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return tokens.mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
