"""Media columns stored as content-defined chunks, each chunk's bytes once.

A gear hash rolls over the media: h = 2 h + G[byte] modulo 2^32, so the last 32 bytes decide it. A chunk ends where the top
bits of h are zero, after `least` bytes at the earliest and `most` at the latest; as least >= 32, a chunk's end hangs on nothing
before the chunk, and an insertion moves only the cuts around it. A medium is its ordered list of chunk digests and sizes.

Storing takes three passes of the media, none of which moves what occurs once:

1. digests are counted; those found more than once set bits in a map of fixed size;
2. each medium is written with its list; chunks outside the map stand in the row itself (one compressed piece), as no other row
   holds them;
3. the bytes of chunks in the map are gathered by digest and written once. A wrong bit costs a chunk its place in the row, no more.

Reading joins the lists of distinct media with the chunk table by digest, puts the pieces in order and verifies the digests of
the whole. Copies of a medium meet in its digest, so they are rebuilt once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard as zs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, byte_slices, doc_columns

#: One number for each byte, from the bytes' own digests.
GEAR = np.array([int.from_bytes(hashlib.blake2b(bytes([b]), digest_size=4).digest(), "little") for b in range(256)], np.uint32)
#: Bytes that decide a hash, and bytes of a chunk's digest.
REACH, DIGEST = 32, 16
#: Bits of one part of the map, as bitmap_construct_agg makes them.
PART = 32768


@dataclass(frozen=True)
class Params:
    """A chunk's bytes: at least `least`, about 2^bits more, at most `most`. The map has 2^map_bits bits (16 MB)."""

    least: int = 256
    bits: int = 10
    most: int = 8192
    map_bits: int = 27

    def __post_init__(self):
        if not REACH <= self.least <= self.most or self.map_bits < 15:
            raise ValueError("32 <= least <= most, map_bits >= 15")


def gear(data: np.ndarray) -> np.ndarray:
    """The hash after each byte: windows of 1, 2, 4, ... 32 bytes are put together from halves."""
    h, n = GEAR[data], 1
    while n < REACH:
        h[n:] += h[:-n] << np.uint32(n)  # the right side is a new array, so each step reads the halves of the one before
        n *= 2
    return h


def ends(hashes: np.ndarray, start: int, end: int, p: Params, marks: np.ndarray | None = None) -> list[int]:
    """Where the chunks of the medium in [start, end) end. hashes: of the bytes it lies in; marks: all places that may end a chunk."""
    if marks is None:
        marks = np.flatnonzero(hashes >> np.uint32(32 - p.bits) == 0) + 1
    own = marks[np.searchsorted(marks, start) : np.searchsorted(marks, end, "right")].tolist()
    out, at, i = [], start, 0
    while at < end:
        while i < len(own) and own[i] < at + p.least:
            i += 1
        at = min(own[i] if i < len(own) else end, at + p.most, end)
        out.append(at)
    return out


def chunks(batch: pa.RecordBatch, p: Params, column: str = "media") -> Iterator[tuple[int, bytes, list[bytes]]]:
    """(row, medium, its chunks) of every row; null is empty. An empty medium has no chunk."""
    for first, _, data, at in byte_slices(batch, column):
        hashes = gear(data)
        marks = np.flatnonzero(hashes >> np.uint32(32 - p.bits) == 0) + 1
        raw = data.tobytes()
        for i, (a, b) in enumerate(zip(at.tolist(), at[1:].tolist())):
            stops = ends(hashes, a, b, p, marks)
            yield first + i, raw[a:b], [raw[x:y] for x, y in zip([a, *stops], stops)]


def digest(chunk: bytes) -> bytes:
    return hashlib.blake2b(chunk, digest_size=DIGEST).digest()


def number(d: bytes) -> int:
    """A digest's first eight bytes as a signed number."""
    return int.from_bytes(d[:8], "little", signed=True)


def shared_bits(media: DataFrame, p: Params) -> np.ndarray:
    """The map: bits of the digests that occur more than once. Only numbers are shuffled, and 2^map_bits bits come to the driver."""

    def run(batches):
        for b in batches:
            found = [number(digest(c)) for _, _, cs in chunks(b, p) for c in cs]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64())], names=["number"])

    twice = media.mapInArrow(run, "number long").groupBy("number").agg(F.count("*").alias("n")).where("n > 1")
    bit = F.col("number").bitwiseAND((1 << p.map_bits) - 1)
    parts = twice.groupBy(F.shiftright(bit, 15).alias("part")).agg(F.bitmap_construct_agg(bit.bitwiseAND(PART - 1)).alias("bits"))
    out = np.zeros((1 << p.map_bits) // 8, np.uint8)
    for r in parts.toLocalIterator():
        out[r["part"] * PART // 8 : (r["part"] + 1) * PART // 8] = np.frombuffer(r["bits"], np.uint8)
    return out


class Store:
    """Media in chunks in the shared folder: `lists` (key columns, media_digest, media_bytes, sizes, digests, borrowed, own) and
    `bytes` (digest, data)."""

    def __init__(self, lists: DataFrame, data: DataFrame, keys: list[str]):
        self.lists, self.data, self.keys = lists, data, keys

    def manifest(self) -> DataFrame:
        """The key columns, media_digest and media_bytes of every row that was stored."""
        return self.lists.select(*[F.col(f"`{k}`") for k in self.keys], "media_digest", "media_bytes")

    def media(self) -> DataFrame:
        """media_digest and media of every distinct medium, rebuilt from its chunks and verified. A missing chunk or a medium that
        isn't what was stored is an error."""
        cols = ["media_digest", "sizes", "borrowed", "own"]
        whole = self.lists.where(F.size("borrowed") == 0).select(*cols, F.array().cast("array<binary>").alias("lent"))
        parts = self.lists.where(F.size("borrowed") > 0)
        # a row with bytes of its own has no copy, so only rows without any are to be made distinct
        wanted = parts.select("media_digest", "borrowed", "digests", "sizes").dropDuplicates(["media_digest"])
        refs = wanted.select("media_digest", F.explode("borrowed").alias("at"), "digests").select("media_digest", "at", F.get("digests", F.col("at")).alias("digest"))
        lent = refs.join(self.data, "digest").groupBy("media_digest").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "data"))), lambda x: x["data"]).alias("lent"))
        own = parts.where("own is not null").select("media_digest", "own")
        some = wanted.select("media_digest", "sizes", "borrowed").join(lent, "media_digest", "left").join(own, "media_digest", "left").select(*cols, "lent")
        # an empty medium has no chunk; its copies are as many rows
        empty = F.size("sizes") == 0
        return whole.where(~empty).unionByName(some).unionByName(whole.where(empty).dropDuplicates(["media_digest"])).mapInArrow(rebuild, "media_digest binary, media binary")


def rebuild(batches):
    """Chunk lists to media, those of about 4 MB at a time."""
    unpack = zs.ZstdDecompressor()
    for b in batches:
        ids, out, held = [], [], 0
        for r in range(b.num_rows):
            key, sizes, borrowed, own, lent = (c[r].as_py() for c in b.columns)
            rest, at, lent = unpack.decompress(own) if own else b"", 0, dict(zip(borrowed, lent or []))
            pieces = []
            for i, n in enumerate(sizes):
                if i in lent:
                    pieces.append(lent[i])
                else:
                    pieces.append(rest[at : at + n])
                    at += n
            medium = b"".join(pieces)
            if len(lent) != len(borrowed) or at != len(rest) or hashlib.sha256(medium).digest() != key:
                raise ValueError(f"medium {key.hex()} can't be rebuilt from its chunks")
            ids.append(key)
            out.append(medium)
            held += len(medium)
            if held > 1 << 22:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary()), pa.array(out, pa.binary())], names=["media_digest", "media"])
                ids, out, held = [], [], 0
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary()), pa.array(out, pa.binary())], names=["media_digest", "media"])


LISTS = "media_digest binary, media_bytes long, sizes array<int>, digests array<binary>, borrowed array<int>, own binary"


def store(df: DataFrame, media: str = "media", keys: tuple[str, ...] = ("doc_id",), params: Params = Params()) -> Store:
    """Store the media column. Null media are empty, empty ones have no chunk; repeated rows and null keys are rows like others, and
    copies of a medium share its chunks. An empty table gives an empty store. Other columns are ignored."""
    p, spark = params, df.sparkSession
    rows = doc_columns(df, *keys, media).withColumnRenamed(media, "media")
    only = rows.select("media")
    held = spark.sparkContext.broadcast(shared_bits(only, p))

    def in_map(d: bytes) -> bool:
        bit = number(d) & ((1 << p.map_bits) - 1)
        return bool(held.value[bit >> 3] >> (bit & 7) & 1)

    def lists(batches):
        pack = zs.ZstdCompressor(level=6)
        for b in batches:
            cols: list[list] = [[] for _ in range(6)]
            for _, medium, cs in chunks(b, p):
                names = [digest(c) for c in cs]
                lent = [i for i, d in enumerate(names) if in_map(d)]
                kept = set(lent)
                own = b"".join(c for i, c in enumerate(cs) if i not in kept)
                for col, x in zip(cols, (hashlib.sha256(medium).digest(), len(medium), [len(c) for c in cs], names, lent, pack.compress(own) if own else None)):
                    col.append(x)
            kinds = (pa.binary(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.binary()), pa.list_(pa.int32()), pa.binary())
            made = [pa.array(x, k) for x, k in zip(cols, kinds)]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keys)], *made], names=[*keys, "media_digest", "media_bytes", "sizes", "digests", "borrowed", "own"])

    def lent_bytes(batches):
        seen = set()  # of this task's rows
        for b in batches:
            names, data = [], []
            for _, _, cs in chunks(b, p):
                for c in cs:
                    d = digest(c)
                    if in_map(d) and d not in seen:
                        seen.add(d)
                        names.append(d)
                        data.append(c)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(data, pa.binary())], names=["digest", "data"])

    scratch = Scratch(spark, "media")
    kept = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)
    made = scratch.write(rows.mapInArrow(lists, f"{kept}, {LISTS}"), "lists")
    data = scratch.write(only.mapInArrow(lent_bytes, "digest binary, data binary").dropDuplicates(["digest"]), "bytes")
    return Store(made, data, list(keys))


# ---- texts as sound

HEADER = 44
UNIT = 192


def four(n: Column) -> Column:
    """A whole number below 2^32 as four bytes, the lowest first."""
    digits = F.lpad(F.hex(n.cast("long")), 8, "0")
    return F.unhex(F.concat(*[F.substring(digits, i, 2) for i in (7, 5, 3, 1)]))


def wav(payload: Column) -> Column:
    """A wave file of one channel of 8-bit samples, 8000 a second, of a binary column."""
    n = F.octet_length(payload)
    fixed = F.unhex(F.lit((b"WAVEfmt " + bytes([16, 0, 0, 0, 1, 0, 1, 0, 0x40, 0x1F, 0, 0, 0x40, 0x1F, 0, 0, 1, 0, 8, 0]) + b"data").hex()))
    return F.concat(F.lit(b"RIFF"), four(n + HEADER - 8), fixed, four(n), payload)


def padded(text: Column) -> Column:
    """A text's bytes with spaces behind, up to a positive multiple of UNIT."""
    text = F.coalesce(text, F.lit(""))
    n = F.octet_length(text)
    return F.concat(text, F.repeat(F.lit(" "), F.when(n == 0, UNIT).otherwise(F.pmod(-n, F.lit(UNIT))).cast("int"))).cast("binary")


def sound(media: bytes) -> str:
    """Of a wave file's samples: their sum, their sum of squares, how often they pass from below 96 to 96 or more, and a histogram of
    eight classes, counts joined by commas."""
    x = np.frombuffer(media, np.uint8)[HEADER:].astype(np.int64)
    high = x >= 96
    return f"{x.sum()}:{(x * x).sum()}:{int((high[1:] & ~high[:-1]).sum())}:{','.join(map(str, np.bincount(x >> 5, minlength=8).tolist()))}"


def text_media(docs: DataFrame, params: Params = Params()) -> DataFrame:
    """Texts stored as wave files in chunks, and what their stored bytes say when read back: doc_id, n_bytes, payload_bytes,
    payload_sha256, tail_crc32, media_bytes, media_sha256, feature, n_chunks.

    Null text is empty, and an empty text is 192 spaces. Null and repeated doc_ids keep their rows; equal texts have equal values.
    An empty table gives no rows. Other columns are ignored.
    """
    rows = doc_columns(docs, "doc_id", "text").select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), wav(padded(F.col("text"))).alias("media"))
    stored = store(rows, keys=("doc_id", "n_bytes"), params=params)
    payload = F.expr(f"substring(media, {HEADER + 1})")
    feature = F.pandas_udf(lambda media: media.map(sound), "string")
    read = stored.media().select(
        "media_digest", F.octet_length(payload).cast("long").alias("payload_bytes"), F.sha2(payload, 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(media, -16)")).alias("tail_crc32"), F.sha2("media", 256).alias("media_sha256"), feature("media").alias("feature"),
    )
    listed = stored.lists.select("doc_id", "n_bytes", "media_digest", "media_bytes", F.size("sizes").cast("long").alias("n_chunks"))
    return listed.join(read, "media_digest").select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_chunks")
