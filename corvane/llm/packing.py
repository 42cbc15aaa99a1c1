"""Sum-of-squares packing of token sequences into windows of fixed capacity."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from . import bpe
from .common import doc_columns, slices

SCHEMA = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


class SumOfSquares:
    """Online packer. count[h] is the number of open windows filled to level h; an item goes to the level where the
    sum of squared counts over all levels is least afterwards (the fullest such level on ties)."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.count = np.zeros(capacity + 1, np.int64)
        self.open: dict[int, list[list]] = {}

    def level(self, size: int) -> int:
        """The level at which an item of 0 < size < capacity is placed; 0 opens a window."""
        c, top = self.count, self.capacity - size
        cost = 2 * (c[size : self.capacity] - c[:top]) + 2  # from level h < top to h + size
        cost[c[:top] == 0] = np.iinfo(np.int64).max
        cost[0] = 2 * c[size] + 1
        best = top - 1 - int(np.argmin(cost[::-1]))
        return top if c[top] and 1 - 2 * c[top] <= cost[best] else best

    def place(self, size: int, piece) -> list | None:
        """Put a piece in; returns a window's pieces once it is full."""
        h = self.level(size)
        window = []
        if h:
            window = self.open[h].pop()
            self.count[h] -= 1
        window.append((h, size, piece))
        if h + size == self.capacity:
            return window
        self.open.setdefault(h + size, []).append(window)
        self.count[h + size] += 1
        return None

    def close(self) -> list[list]:
        """The windows still open, emptied into each other by cutting, so that one at most stays partly filled."""
        left = [w for h in sorted(self.open) for w in self.open[h]]  # emptiest first
        done, i, j = [], 0, len(left) - 1
        while i < j:
            window = left[j]
            fill = window[-1][0] + window[-1][1]
            while fill < self.capacity and i < j:
                at, size, (doc, first) = left[i].pop()
                take = min(size, self.capacity - fill)
                window.append((fill, take, (doc, first + size - take)))
                fill += take
                if take < size:
                    left[i].append((at, size - take, (doc, first)))
                if not left[i]:
                    i += 1
            done.append(window)
            j -= 1
        if i == j:
            done.append(left[i])
        return done


def pack_stream(docs: Iterator[tuple[int | None, bytes]], capacity: int, first_sequence: int) -> Iterator[tuple]:
    """Rows of SCHEMA for (doc_id, ids as 4-byte integers). Whole windows are cut off a long document first; what is left is packed."""
    packer, sequence = SumOfSquares(capacity), first_sequence

    def rows(window):
        for offset, size, (doc, first) in window:
            doc_id, raw = doc
            yield doc_id, first, size, zlib.crc32(raw[4 * first : 4 * (first + size)]), len(raw) // 4, sequence, offset

    for doc in docs:
        n, first = len(doc[1]) // 4, 0
        while n - first >= capacity:
            yield from rows([(0, capacity, (doc, first))])
            sequence, first = sequence + 1, first + capacity
        if n > first and (full := packer.place(n - first, (doc, first))):
            yield from rows(full)
            sequence += 1
    for window in packer.close():
        yield from rows(window)
        sequence += 1


def pack(docs: DataFrame, capacity: int = 2048, end_id: int = 1, tokenizer: tuple[str, str, str] | None = None) -> DataFrame:
    """Pack every document's ids (then end_id) into windows of `capacity` ids; a row for each piece.

    Windows are packed where the documents lie, one packer to a partition, so nothing is shuffled; a partition leaves one
    window at most partly filled. A packer holds the open windows only: few per level, by the rule it packs by.
    Null or empty text: end_id alone. Null and repeated doc_ids: packed like others, each row on its own. Empty table: no
    rows. Other columns are ignored. sequence_id is unique, and grouped by partition.
    """
    args = tokenizer or bpe.default_paths()
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        encoder = bpe.encoder(*args)

        def ids():
            for b in batches:
                doc_ids = b.column(0).to_pylist()
                for i, j, texts in slices(b):
                    for doc_id, raw in zip(doc_ids[i:j], encoder.encode_many(texts)):
                        yield doc_id, raw + end

        out: list[tuple] = []
        for row in pack_stream(ids(), capacity, TaskContext.get().partitionId() << 32):
            out.append(row)
            if len(out) == 8192:
                yield as_batch(out)
                out = []
        if out:
            yield as_batch(out)

    return doc_columns(docs, "doc_id", "text").mapInArrow(run, SCHEMA)


def as_batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=names)
