"""A persisted, positional full-text index: segments of Parquet tables that a manifest lists.

What is looked up by a word lies in folders by bucket, a hash of the word, and is sorted by it inside; a search names the buckets
and words it needs, so the partition filter and the row groups' statistics leave the rest unread.

    postings    bucket(term)     term, field, id, tf, dl, positions (of the short fields; the body's aren't looked at)
    counts      bucket(term)     term, field, n: documents with the term that the segment adds, less those it takes away
    neighbours  bucket(variant)  variant, term: what is left of a term's first letters when up to two are deleted
    documents                    the stored documents, as they came
    deleted                      ids that earlier segments no longer count for

An insertion or deletion writes a segment of its own and the next manifest; a document's row counts if no later segment deletes
it. Document numbers and field lengths are sums in the manifest, and counts add up, so both are exact without a look at the
documents. An insertion shuffles no postings: each task writes those of its documents into their buckets. Compaction makes one
segment of all, a share of the buckets at a time, in a few files for each; it is what keeps the number of files down.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from .manifest import Manifest

FIELDS = ("title", "snippet", "body", "display_url")
#: Fields whose positions are kept, as phrases are looked for in them.
POSITIONAL = ("title", "snippet", "display_url")
#: Letters of a term in which deletions are tried, and how many of them.
PREFIX, DELETIONS = 5, 2
#: Words whose postings a task sorts at a time.
CHUNK = 2_000_000
#: Bytes that a task may hold of each bucket's file.
ROW_GROUP = 1 << 24

#: Jobs in which compaction rewrites the buckets of postings, one after the other.
PASSES = 4
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def bucket(c: Column, buckets: int) -> Column:
    return F.pmod(F.crc32(c.cast("string").cast("binary")), F.lit(buckets)).cast("int")


def bucket_of(value: str, buckets: int) -> int:
    return zlib.crc32(value.encode()) % buckets


def variants(term: str, edits: int) -> set[str]:
    """A term's first letters with up to `edits` of them deleted. Two terms within `edits` edits (a swap of neighbours is one) have
    such a variant in common: what both keep, cut where the shorter of the two prefixes ends."""
    out = last = {term[:PREFIX]}
    for _ in range(edits):
        last = {t[:i] + t[i + 1 :] for t in last for i in range(len(t))}
        out = out | last
    return out


def with_variants(words: DataFrame, column: str) -> DataFrame:
    """(column, variant) of each word, with as many deletions as a query word that could lie near may need: none for one letter, one
    for two or three. (As nested array functions it takes ten times as long.)"""

    def run(batches):
        for b in batches:
            of, out = [], []
            for w in b.column(0).to_pylist():
                found = variants(w, DELETIONS if len(w) >= 4 else 1 if len(w) >= 2 else 0)
                of += [w] * len(found)
                out += found
            yield pa.RecordBatch.from_arrays([pa.array(of, pa.string()), pa.array(out, pa.string())], names=[column, "variant"])

    return words.select(column).where(F.col(column).isNotNull()).mapInArrow(run, f"{column} string, variant string")


def near_terms(vocabulary: DataFrame, words: DataFrame) -> DataFrame:
    """(query_term, term): pairs with a variant in common, a superset of those within the edits that the query word allows. Both
    sides meet by equality. vocabulary: term; words: query_term."""
    return with_variants(vocabulary, "term").join(with_variants(words, "query_term"), "variant").select("query_term", "term").distinct()


def occurrences(docs: DataFrame, fields: Iterable[str] = FIELDS, buckets: int = 0) -> DataFrame:
    """(term, field, id, tf, dl, positions) without a shuffle: Spark finds the words, and the postings of up to CHUNK of them at a time are
    made by one sort of numbers that stand for word, field and document. With `buckets`, also the word's bucket, by which and the word
    the postings of a chunk are sorted."""
    fields, kind = tuple(fields), docs.schema["id"].dataType.simpleString()

    def run(batches):
        held, size = [], 0
        for b in batches:
            held.append(b)
            size += sum(len(b.column(k).flatten()) for k in range(1, len(fields) + 1))
            if size >= CHUNK:
                yield from chunk_postings(held, fields, buckets)
                held, size = [], 0
        if size:
            yield from chunk_postings(held, fields, buckets)

    out = f"term string, field string, id {kind}, tf long, dl long, positions array<int>" + (", bucket int" if buckets else "")
    return docs.select("id", *[tx.tokens(F.col(f)).alias(f) for f in fields]).mapInArrow(run, out)


def in_order(words: list[str], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of distinct words by bucket and bytes, and their buckets."""
    keys = [w.encode() for w in words]
    at = np.array([zlib.crc32(k) % buckets for k in keys] if buckets else [0] * len(keys), dtype=np.int64)
    return np.array(sorted(range(len(keys)), key=lambda i: (at[i], keys[i])), dtype=np.int64), at


def chunk_postings(held: list[pa.RecordBatch], fields: tuple[str, ...], buckets: int) -> Iterable[pa.RecordBatch]:
    """The postings of some documents, each with a list of words for every field."""
    docs = pa.Table.from_batches(held).combine_chunks()
    n, columns = docs.num_rows, [docs.column(k + 1).chunk(0) for k in range(len(fields))]
    sizes = np.concatenate([pc.fill_null(pc.list_value_length(c), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in columns])  # of field 0's documents, field 1's, ...
    coded = pa.concat_arrays([c.flatten() for c in columns]).dictionary_encode()
    words, codes = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    order, at = in_order(words.to_pylist(), buckets)
    rank = np.empty_like(order)
    rank[order] = np.arange(len(order))
    place = np.repeat(np.arange(len(sizes)), sizes)
    key = rank[codes] * len(sizes) + place
    by = np.argsort(key, kind="stable")  # positions stay in order
    key = key[by]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    tf, of = np.diff(np.r_[first, len(key)]), key[first] % len(sizes)
    word, field = order[key[first] // len(sizes)], of // n
    kept = np.isin(np.arange(len(fields)), [k for k, f in enumerate(fields) if f in POSITIONAL])
    position = (np.arange(len(place)) - np.repeat(np.cumsum(sizes) - sizes, sizes))[by]
    ends = np.r_[0, np.cumsum(np.where(kept[field], tf, 0))].astype(np.int32)
    positions = pa.ListArray.from_arrays(pa.array(ends), pa.array(position[np.repeat(kept[field], tf)].astype(np.int32)), mask=pa.array(~kept[field]))
    out = [words.take(pa.array(word)), pa.array(fields, pa.string()).take(pa.array(field)), docs.column(0).chunk(0).take(pa.array(of % n)), pa.array(tf.astype(np.int64)), pa.array(sizes[of]), positions]
    names = ["term", "field", "id", "tf", "dl", "positions"]
    if buckets:
        out, names = [*out, pa.array(at[word].astype(np.int32))], [*names, "bucket"]
    return pa.Table.from_arrays(out, names=names).to_batches(max_chunksize=65536)


def neighbour_rows(words: DataFrame, buckets: int) -> DataFrame:
    """(variant, term, bucket) of distinct words, sorted by bucket and variant in chunks. Words with the same first letters share their
    variants, which are made once."""

    def rows(terms):
        begun, prefixes, of = {}, [], []
        for t in terms:
            k = (t[:PREFIX], DELETIONS if len(t) >= 4 else 1 if len(t) >= 2 else 0)
            if k not in begun:
                begun[k] = len(prefixes)
                prefixes.append(list(variants(*k)))
            of.append(begun[k])
        flat = pa.array([v for p in prefixes for v in p], pa.string()).dictionary_encode()
        order, at = in_order(flat.dictionary.to_pylist(), buckets)
        rank = np.empty_like(order)
        rank[order] = np.arange(len(order))
        size = np.array([len(p) for p in prefixes], dtype=np.int64)
        start, of = np.cumsum(size) - size, np.array(of, dtype=np.int64)
        n = size[of]
        term = np.repeat(np.arange(len(of)), n)
        code = rank[flat.indices.to_numpy(zero_copy_only=False)[np.arange(len(term)) - np.repeat(np.cumsum(n) - n - start[of], n)]]
        by = np.argsort(code, kind="stable")
        variant = order[code[by]]
        out = [flat.dictionary.take(pa.array(variant)), pa.array(terms, pa.string()).take(pa.array(term[by])), pa.array(at[variant].astype(np.int32))]
        return pa.Table.from_arrays(out, names=["variant", "term", "bucket"]).to_batches(max_chunksize=65536)

    def run(batches):
        held = []
        for b in batches:
            held += b.column(0).to_pylist()
            if len(held) >= CHUNK // 16:
                yield from rows(held)
                held = []
        if held:
            yield from rows(held)

    return words.select("term").where("term IS NOT NULL").mapInArrow(run, "variant string, term string, bucket int")


class SearchIndex:
    """An index below a folder that all executors share. buckets: folders of each table; salts: parts that a bucket is written in, so
    that one very frequent term doesn't fall to one task. One writer at a time: a second one gets an error and changes nothing."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64, salts: int = 8):
        self.spark, self.root, self.salts = spark, root.rstrip("/"), salts
        self.manifest = Manifest(spark, root)
        self._number, self._tables = -1, {}
        said = self._said()
        self.buckets = said.get("buckets", buckets)

    # ---- reading

    def _said(self) -> dict:
        if self._number != (number := self.manifest.number()):
            self._number, self._content, self._tables = number, self.manifest.read(number), {}
        return self._content

    def segments(self) -> list[str]:
        return self._said().get("segments", [])

    def stats(self) -> dict[str, tuple[int, float]]:
        """How many documents have words in a field, and how many on average."""
        return {f: (n, total / n) for f, (n, total) in self._said().get("fields", {}).items() if n}

    def count(self) -> int:
        return self._said().get("documents", 0)

    def _schema(self, table: str) -> str:
        kind = self._said()["id"]
        return {
            "postings": f"term string, field string, id {kind}, tf long, dl long, positions array<int>, segment string, bucket int",
            "counts": "term string, field string, n long, segment string, bucket int", "neighbours": "variant string, term string, segment string, bucket int",
            "deleted": f"id {kind}, segment string", "documents": f"{self._said()['documents_schema']}, segment string",
        }[table]

    def table(self, name: str) -> DataFrame:
        """All rows of a table's segments, dead ones too. Its files are listed once for each version."""
        said = self._said()
        if not said:
            raise ValueError(f"no index at {self.root}")
        if name not in self._tables:
            has = said[{"deleted": "deleting", "documents": "filled", "postings": "filled"}.get(name, "segments")]
            reader = self.spark.read.schema(self._schema(name)).option("basePath", f"{self.root}/{name}")
            self._tables[name] = reader.parquet(*[f"{self.root}/{name}/segment={s}" for s in has]) if has else self.spark.createDataFrame([], self._schema(name))
        return self._tables[name]

    def _live(self, rows: DataFrame) -> DataFrame:
        if not self._said().get("deleting"):
            return rows
        dead = self.table("deleted").groupBy("id").agg(F.max("segment").alias("until"))
        return rows.join(dead, "id", "left").where("until IS NULL OR segment >= until").drop("until")

    def documents(self) -> DataFrame:
        return self._live(self.table("documents")).drop("segment")

    def of_terms(self, table: str, terms: Iterable[str], column: str = "term") -> DataFrame:
        """Rows of some terms (or variants), read from their buckets alone."""
        terms = sorted(set(terms))
        return self.table(table).where(F.col("bucket").isin(sorted({bucket_of(t, self.buckets) for t in terms})) & F.col(column).isin(terms))

    def postings(self, terms: Iterable[str]) -> DataFrame:
        """(term, field, id, tf, dl, positions) of the terms."""
        return self._live(self.of_terms("postings", terms)).drop("segment", "bucket")

    def of_queries(self, queries: DataFrame) -> DataFrame:
        """The queries' columns with the postings of their `term`: any number of them in one pass over the buckets they name."""
        wanted = queries.withColumn("bucket", bucket(F.col("term"), self.buckets))
        return self._live(self.table("postings").join(wanted, ["bucket", "term"])).drop("segment", "bucket")

    def frequencies(self, counts: DataFrame | None = None) -> DataFrame:
        """(field, term, df) of live documents."""
        return (self.table("counts") if counts is None else counts).groupBy("field", "term").agg(F.sum("n").alias("df")).where("df > 0")

    # ---- writing

    def rebuild(self, docs: DataFrame) -> int:
        """Make the index one of these documents alone (id, the four fields, and whatever else is to be stored)."""
        return self._commit(docs, None, fresh=True)

    def add(self, docs: DataFrame) -> int:
        """Insert documents; those whose id is there already replace them. Ids must be unique; null ids aren't allowed."""
        return self.rebuild(docs) if not self.segments() else self._commit(docs, docs.select("id"))

    def delete(self, ids: DataFrame) -> int:
        """Delete documents by id; unknown ids change nothing."""
        return self._commit(None, ids.select("id")) if self.segments() else 0

    def compact(self) -> int:
        """One segment of all live rows: each bucket of postings and documents is read and written once, nothing is tokenised anew."""
        if not self.segments():
            return 0
        after, said, name = self.manifest.number(), self._said(), self._name()
        self.documents().write.option("compression", "zstd").parquet(f"{self.root}/documents/segment={name}")
        for part in range(PASSES):  # so that what is shuffled at a time is a share of the postings
            some = self._live(self.table("postings").where(F.col("bucket").isin(*range(part, self.buckets, PASSES)))).drop("segment")
            self._write("postings", name, some, "term", "field", "id", mode="append")
        counts = self.frequencies().select("term", "field", F.col("df").alias("n"), bucket(F.col("term"), self.buckets).alias("bucket"))
        self._write("counts", name, counts, "term")
        living = self.table("counts").groupBy("term").agg(F.sum("n").alias("n")).where("n > 0")
        self._write_neighbours(name, living)
        return self._flip(said | {"segments": [name], "filled": [name], "deleting": []}, after)

    def _width(self) -> int:
        """Partitions of a write. A number keeps Spark from joining small ones, whose rows are few but dear."""
        return int(self.spark.conf.get("spark.sql.shuffle.partitions"))

    def _name(self) -> str:
        return f"s{self.manifest.number() + 1:08d}-{uuid.uuid4().hex}"  # names sort in the order of writing

    def _write(self, table: str, name: str, rows: DataFrame, *order: str, mode: str = "error") -> DataFrame:
        """Rows with a bucket, spread over buckets and salts and sorted inside. Shuffle files go once the table is written."""
        path = f"{self.root}/{table}/segment={name}"
        salt = F.pmod(F.xxhash64(*[c for c in ("id", "term") if c in rows.columns]), F.lit(self.salts)) if "id" in rows.columns else F.lit(0)
        before = self.spark.conf.get(CLEAN, "false")
        self.spark.conf.set(CLEAN, "true")
        try:
            rows.repartition(self._width(), "bucket", salt).sortWithinPartitions("bucket", *order).write.mode(mode).partitionBy("bucket").option("compression", "zstd").parquet(path)
        finally:
            self.spark.conf.set(CLEAN, before)
        return self.spark.read.schema(rows.schema).parquet(path)

    def _write_neighbours(self, name: str, terms: DataFrame) -> None:
        rows = neighbour_rows(terms.select("term").repartition(self._width(), "term").distinct(), self.buckets)
        self._write_sorted("neighbours", name, rows)  # only the words are shuffled

    def _write_sorted(self, table: str, name: str, rows: DataFrame) -> str:
        """Rows that come sorted from their tasks: each task keeps a file of every bucket open, so nothing is sorted or spilled."""
        path = f"{self.root}/{table}/segment={name}"
        set_to = {"spark.sql.maxConcurrentOutputFileWriters": str(self.buckets + 1), "spark.sql.execution.arrow.maxRecordsPerBatch": "1000" if table == "postings" else "10000"}
        before = {k: self.spark.conf.get(k) for k in set_to}
        try:
            for k, v in set_to.items():
                self.spark.conf.set(k, v)
            rows.write.partitionBy("bucket").option("compression", "zstd").option("parquet.block.size", ROW_GROUP).parquet(path)
        finally:
            for k, v in before.items():
                self.spark.conf.set(k, v)
        return path

    def _commit(self, docs: DataFrame | None, replaced: DataFrame | None, fresh: bool = False) -> int:
        after, name = self.manifest.number(), self._name()
        said = {"segments": [], "filled": [], "deleting": [], "fields": {f: [0, 0] for f in FIELDS}, "documents": 0, "buckets": self.buckets} if fresh else self._said()
        said = said | {"fields": {f: list(x) for f, x in said["fields"].items()}}
        counts, signed = [], []
        if docs is not None:
            if fresh:
                said |= {"id": docs.schema["id"].dataType.simpleString(), "documents_schema": ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)}
            docs.write.option("compression", "zstd").parquet(f"{self.root}/documents/segment={name}")
            new = self.spark.read.schema(docs.schema).parquet(f"{self.root}/documents/segment={name}")
            if not new.groupBy("id").count().where("id IS NULL OR count > 1").isEmpty():
                raise ValueError("ids of documents to index must be unique and not null")
            posts = occurrences(new, buckets=self.buckets)
            posts = self.spark.read.schema(posts.schema).parquet(self._write_sorted("postings", name, posts))
            counts.append(posts.groupBy("bucket", "term", "field").agg(F.count("*").alias("n")))
            signed.append((1, new.count(), posts))
            said |= {"filled": [*said["filled"], name]}
        if replaced is not None:
            ids = replaced.distinct()
            ids.write.parquet(f"{self.root}/deleted/segment={name}")
            ids = self.spark.read.schema(ids.schema).parquet(f"{self.root}/deleted/segment={name}")
            gone = self.documents().join(ids, "id", "left_semi")
            words = occurrences(gone)
            lost = words.groupBy("term", "field").agg((-F.count("*")).alias("n"))
            counts.append(lost.select(bucket(F.col("term"), self.buckets).alias("bucket"), "term", "field", "n"))
            signed.append((-1, gone.count(), words))
            said |= {"deleting": [*said["deleting"], name]}
        both = counts[0] if len(counts) == 1 else counts[0].unionByName(counts[1]).groupBy("bucket", "term", "field").agg(F.sum("n").alias("n"))
        written = self._write("counts", name, both.select("term", "field", "n", "bucket"), "term")
        self._write_neighbours(name, written.where("n > 0"))
        for sign, n, posts in signed:
            said["documents"] += sign * n
            # a field's words share its length, so their parts of it add up to one for each document (rounded: sums of doubles)
            for r in posts.groupBy("field").agg(F.round(F.sum(F.col("tf") / F.col("dl"))).cast("long").alias("n"), F.sum("tf").alias("s")).collect():  # a row a field
                said["fields"][r["field"]] = [said["fields"][r["field"]][0] + sign * r["n"], said["fields"][r["field"]][1] + sign * r["s"]]
        return self._flip(said | {"segments": [*said["segments"], name]}, after)

    def _flip(self, said: dict, after: int) -> int:
        number = self.manifest.commit(said, after)
        self.manifest.forget()
        wanted = {s for n in self.manifest.numbers() for s in self.manifest.read(n)["segments"]}
        for table in ("documents", "postings", "counts", "neighbours", "deleted"):
            for folder in self.manifest.folders(f"{self.root}/{table}"):
                if folder.removeprefix("segment=") not in wanted:
                    self.manifest.drop(f"{self.root}/{table}/{folder}")
        return number
