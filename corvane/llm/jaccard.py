"""N-gram Jaccard self-join by multiple-global-order filtering, giving components of linked documents.

Under any global order of tokens, two sets with a Jaccard similarity of t or more share a token among the first
n - ceil(t n) + 1 of each, and only a bounded number of common tokens can lie behind. An order here puts tokens that are frequent
in the corpus last (a sketch over all documents tells them) and hashes decide between the others, so each hash gives a
different order with the same property.

1. One pass over the texts describes each document: a digest of its set and its prefixes under all orders. Documents with equal
   sets are one record from here on.
2. Postings of the first order's prefixes meet by token. Records are first compared with the most typical record of one of
   their tokens only (a star, so a large group of near copies gives as many pairs as members) and joined into components.
3. Then pairs of records of different components meet by token; records of one component need no comparison, their link is
   known. A token counts for a pair only if it stands early enough in both prefixes to be among the first few (SHARED at most)
   that two linked sets share, and a pair needs that many of them, so records that hold one passage beside much text of their
   own, or one rare shingle by chance, make none. A pair goes on if the tokens it met in, and all that lies behind the last of
   them, allow the similarity.
4. Pairs must pass the same bound under each further order, for which only the prefixes move. What is left after all orders is
   verified on the whole sets. Either time a record's part goes to each pair it is in, the centre of many pairs once for every
   SPAN of them, so that no task holds all pairs of a record.

No pair of different components that could link is left out, so the components are those of all links (up to collisions of
64-bit hashes of shingles and 128-bit digests of sets).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard as zs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, byte_slices, doc_columns
from .components import components
from .shingles import mix, shingle_sets

SEEDS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
#: Pairs of one record that meet in one place.
SPAN = 256
#: Tokens that a pair must share at the beginning of both prefixes, where these are long enough to hold so many.
SHARED = 2
#: Bits of the map that keeps rows which a join would drop from being shuffled: 4 MB, however many keys there are.
MAP_BITS = 1 << 25


@dataclass(frozen=True)
class Params:
    words: int = 5
    percent: int = 80
    #: Slots of the frequency sketch, as a power of two; one byte each is broadcast.
    sketch_bits: int = 22


def need(n, percent: int):
    """The least overlap with a linked set that a set of n tokens has."""
    return -(-percent * n // 100)


def prefixes(tokens: np.ndarray, ends: np.ndarray, frequent: np.ndarray, seed: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n - need + 1 keys of each set, in order, and where each prefix ends. A token's key in the order of `seed` is its
    class of frequency, then 56 bits of a hash."""
    shift = np.uint64(64 - (len(frequent).bit_length() - 1))
    key = (frequent[tokens >> shift].astype(np.uint64) << np.uint64(56)) | (mix(tokens ^ np.uint64(seed)) >> np.uint64(8))
    n = np.diff(ends)
    size = np.where(n > 0, n - need(n, percent) + 1, 0)
    for a, b, p in zip(ends[:-1].tolist(), ends[1:].tolist(), size.tolist()):
        part = key[a:b]
        if p < b - a:
            part.partition(p - 1)
        part[:p].sort()
    keep = np.arange(len(key)) - np.repeat(ends[:-1], n) < np.repeat(size, n)
    return key[keep], np.concatenate([[0], np.cumsum(size)])


def enough(shared: int, n: int, m: int, percent: int) -> bool:
    """Whether sets of n and m tokens that share so many prefix tokens (or seem to) can be linked: the set whose prefix ends first in the
    order has all further common tokens behind its prefix."""
    behind = max(need(n, percent), need(m, percent)) - 1
    return (shared + behind) * (100 + percent) >= percent * (n + m)


def frequency_classes(docs: DataFrame, params: Params) -> np.ndarray:
    """For each slot of hash space a class of frequency, from the shingles of all documents: 0 unless a slot holds more than rare
    shingles would put there by chance (the median and 5 standard deviations of a Poisson law), then one more for every
    doubling of the excess. Tasks count into slots; the counts are added up in two rounds, so that no task reads them all."""
    bits, blocks = params.sketch_bits, 64
    width = (1 << bits) // blocks
    schema, names = "block int, salt int, counts binary", ["block", "salt", "counts"]

    def row(block, salt, part):
        kind = np.uint8 if part.max() < 1 << 8 else np.uint16 if part.max() < 1 << 16 else np.uint64
        raw = np.dtype(kind).char.encode() + zs.compress(part.astype(kind).tobytes(), 1)
        return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([salt], pa.int32()), pa.array([raw], pa.binary())], names=names)

    def counts(raw: bytes) -> np.ndarray:
        return np.frombuffer(zs.decompress(raw[1:]), raw[:1].decode()).astype(np.uint64)

    def count(batches):
        total = np.zeros(1 << bits, np.uint32)
        for b in batches:
            for _, _, data, ends in byte_slices(b):
                np.add.at(total, shingle_sets(data, ends, params.words)[0] >> np.uint64(64 - bits), np.uint32(1))
        salt = TaskContext.get().partitionId() % 16
        for block in range(blocks):
            if (part := total[block * width : (block + 1) * width]).any():
                yield row(block, salt, part)

    def add(batches):
        held: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            for block, salt, raw in zip(*[c.to_pylist() for c in b.columns]):
                held[block, salt] = held.get((block, salt), np.uint64(0)) + counts(raw)
        for (block, salt), part in held.items():
            yield row(block, salt, part)

    parts = doc_columns(docs, "text").mapInArrow(count, schema).repartition(F.col("block"), F.col("salt")).mapInArrow(add, schema)
    parts = parts.withColumn("salt", F.lit(0)).repartition(F.col("block")).mapInArrow(add, schema)
    total = np.zeros(1 << bits, np.float32)
    for block, _, raw in parts.toLocalIterator():  # 64 rows of fixed size
        total[block * width : (block + 1) * width] = counts(bytes(raw))
    usual = np.median(total)
    total -= usual
    total /= 5 * np.sqrt(usual + 1)
    np.maximum(total, 0.5, out=total)
    return (np.log2(total, out=total) + 1).astype(np.uint8)


#: row tells the rows of the table apart, print tells texts apart; rec_a and rec_b are a digest of the set, n its size, hot its mean
#: class; p1 is the prefix in the first order, further its prefixes in the others (the low 16 bits of each key).
DESCRIBED = "row bigint, doc_id bigint, print bigint, rec_a bigint, rec_b bigint, n bigint, hot bigint, p1 array<bigint>, further array<binary>"


def described(docs: DataFrame, frequent, params: Params) -> DataFrame:
    """DESCRIBED of every document."""

    def run(batches):
        row = TaskContext.get().partitionId() << 33
        table, shift = frequent.value, np.uint64(64 - params.sketch_bits)
        for b in batches:
            for i, j, data, at in byte_slices(b):
                tokens, ends = shingle_sets(data, at, params.words)
                bounds, k = list(zip(ends[:-1].tolist(), ends[1:].tolist())), j - i
                rec = digests(tokens, bounds)
                sums = np.concatenate([[0], np.cumsum(table[tokens >> shift], dtype=np.int64)])
                n = np.diff(ends)
                hot = 16 * (sums[ends[1:]] - sums[ends[:-1]]) // np.maximum(n, 1)
                first, *others = (prefixes(tokens, ends, table, s, params.percent) for s in SEEDS)
                low = [(keys.astype(np.uint16), e.tolist()) for keys, e in others]
                further = [keys[e[x] : e[x + 1]].tobytes() for x in range(k) for keys, e in low]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.arange(row, row + k)), b.column(0).slice(i, k), b.column(1).slice(i, k), pa.array(rec[:, 0]), pa.array(rec[:, 1]), pa.array(n), pa.array(hot),
                        pa.ListArray.from_arrays(pa.array(first[1].astype(np.int32)), pa.array(first[0].view(np.int64))),
                        pa.ListArray.from_arrays(pa.array(np.arange(0, len(further) + 1, len(SEEDS) - 1, dtype=np.int32)), pa.array(further, pa.binary())),
                    ],
                    names=[c.split()[0] for c in DESCRIBED.split(", ")],
                )
                row += k

    return printed(docs).mapInArrow(run, DESCRIBED)


def printed(docs: DataFrame) -> DataFrame:
    return doc_columns(docs, "doc_id", "text").select("doc_id", F.xxhash64("text").alias("print"), "text")


def digests(tokens: np.ndarray, bounds: list[tuple[int, int]]) -> np.ndarray:
    raw = b"".join([xxhash.xxh3_128_digest(tokens[x:y].data) for x, y in bounds])
    return np.frombuffer(raw, np.int64).reshape(-1, 2)


#: Where a record's part goes: to the pairs of `home` that have this salt, as home itself (side 0) or as the other one (side 1).
KEYS = ("home", "salt", "side", "rid")


def meeting(pairs: DataFrame) -> DataFrame:
    """KEYS of every record in the pairs (home, salt, rid)."""
    own = pairs.select("home", "salt").distinct().select("home", "salt", F.lit(0).alias("side"), F.col("home").alias("rid"))
    return pairs.select("home", "salt", F.lit(1).alias("side"), "rid").unionByName(own)


def compared(parts: DataFrame, read: Callable, test: Callable) -> DataFrame:
    """The pairs (home, salt, rid) for which test(home's part, the other's part) holds. parts: KEYS and what `read` makes parts of,
    a batch at a time. The rows of a meeting come together, home's first, and stream by; only home's part is held."""

    def run(batches):
        at = own = None
        for b in batches:
            home, salt, side, rid = (b.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            keep = []
            for i, (h, s, first, part) in enumerate(zip(home.tolist(), salt.tolist(), (side == 0).tolist(), read(b))):
                if first:
                    at, own = (h, s), part
                elif part and own and (h, s) == at and test(own, part):
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (home, salt, rid)], names=["home", "salt", "rid"])

    dealt = parts.repartition("home", "salt").sortWithinPartitions("home", "salt", "side")
    return dealt.mapInArrow(run, "home bigint, salt bigint, rid bigint")


def sifted(rows: DataFrame, key: Column, wanted: DataFrame, wanted_key: Column) -> tuple[DataFrame, DataFrame]:
    """Rows whose key (a long) some wanted row may have, and rows whose key none has. A bit for each hash of a wanted key tells
    them, in a table of MAP_BITS bits however many keys there are; with very many keys few rows are told apart."""
    page = 1 << 15
    spot = lambda c: F.pmod(F.xxhash64(c), F.lit(MAP_BITS))
    pages = wanted.select(spot(wanted_key).alias("spot")).groupBy(F.floor(F.col("spot") / page).alias("page")).agg(F.bitmap_construct_agg(F.col("spot") % page).alias("bits"))
    at = F.col("spot") % page
    byte = F.conv(F.hex(F.substring("bits", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(F.getbit(byte, (at % 8).cast("int")), F.lit(0)) == 1
    marked = rows.withColumn("spot", spot(key)).withColumn("page", F.floor(F.col("spot") / page)).join(F.broadcast(pages), "page", "left").withColumn("hit", hit)
    return marked.where("hit").select(*rows.columns), marked.where("not hit").select(*rows.columns)


def linked(pairs: DataFrame, docs: DataFrame, base: DataFrame, params: Params, scratch: Scratch) -> DataFrame:
    """The pairs (a, b) that pass the further orders and are similar enough."""
    percent = params.percent

    def prefixes_of(b):
        raw = [b.column(f"f{i}") for i in range(len(SEEDS) - 1)]
        for i, n in enumerate(b.column("n").to_pylist()):
            yield n, *[np.frombuffer(c[i].as_buffer(), np.uint16) for c in raw]

    def passes(x, y):
        return all(enough(common(p, q), x[0], y[0], percent) for p, q in zip(x[1:], y[1:]))

    def sets_of(b):
        rec = np.stack([b.column(c).to_numpy() for c in ("rec_a", "rec_b")], 1)
        for i, j, data, at in byte_slices(b):
            tokens, ends = shingle_sets(data, at, params.words)
            bounds = list(zip(ends[:-1].tolist(), ends[1:].tolist()))
            right = (digests(tokens, bounds) == rec[i:j]).all(1).tolist()  # another text with this hash is passed over
            yield from ((tokens[x:y].copy(),) if ok else None for (x, y), ok in zip(bounds, right))

    def similar(x, y):
        both = common(x[0], y[0])
        return 100 * both >= percent * (len(x[0]) + len(y[0]) - both)

    pairs = scratch.write(pairs.select("a", "b"), "pairs")
    ways = pairs.groupBy("b").agg(F.ceil(F.count("*") / SPAN).alias("ways"))
    met = pairs.join(ways, "b").select(F.col("b").alias("home"), F.pmod(F.xxhash64("a"), "ways").alias("salt"), F.col("a").alias("rid"))
    keys = scratch.write(meeting(met), "keys")
    narrow = base.select(F.col("row").alias("rid"), "n", *[F.col("further")[i].alias(f"f{i}") for i in range(len(SEEDS) - 1)])
    narrow = keys.join(sifted(narrow, F.col("rid"), keys, F.col("rid"))[0], "rid").select(*KEYS, "n", *[f"f{i}" for i in range(len(SEEDS) - 1)])
    left = scratch.write(compared(narrow, prefixes_of, passes), "left")
    texts = meeting(left).join(base.select(F.col("row").alias("rid"), "doc_id", "print", "rec_a", "rec_b"), "rid")
    texts = scratch.write(texts.withColumnRenamed("doc_id", "id").withColumnRenamed("print", "mark"), "wanted")
    both = lambda x, y: F.xxhash64(x, y)
    found = sifted(printed(docs), both("doc_id", "print"), texts, both("id", "mark"))[0]
    whole = found.join(texts, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("print") == F.col("mark"))).select(*KEYS, "rec_a", "rec_b", "text")
    links = compared(whole, sets_of, similar).select(F.col("rid").alias("a"), F.col("home").alias("b")).distinct()  # a repeated row is a repeated set
    links = scratch.write(links, "links")
    scratch.free(pairs, keys, left, texts)
    return links


def common(x: np.ndarray, y: np.ndarray) -> int:
    both = np.concatenate([x, y])
    both.sort()
    return int((both[1:] == both[:-1]).sum())


def placed(docs: DataFrame, params: Params, scratch: Scratch) -> DataFrame:
    """row, doc_id, print, n and comp of every document; documents with the same comp are linked over any number of others. An
    empty set has its own row as comp."""
    spark = docs.sparkSession
    frequent = spark.sparkContext.broadcast(frequency_classes(docs, params))
    base = scratch.write(described(docs, frequent, params), "documents")
    frequent.unpersist()
    recs = scratch.write(base.where("n > 0").groupBy("rec_a", "rec_b").agg(F.min("row").alias("rid")), "records")

    # postings of the tokens that more than one record has; hot and rid in one number, so that its maximum is a typical record
    same = (F.col("rec_a") == F.col("a")) & (F.col("rec_b") == F.col("b"))
    chosen = recs.select(F.col("rec_a").alias("a"), F.col("rec_b").alias("b"), "rid")
    copies = scratch.write(base.where("n > 0").select("row", "rec_a", "rec_b").join(chosen, same).where("row <> rid").select(F.col("row").alias("copy")), "copies")
    maybe, posts = sifted(base.where("n > 0").select("row", "n", "hot", "p1"), F.col("row"), copies, F.col("copy"))
    posts = posts.unionByName(maybe.join(copies, F.col("row") == F.col("copy"), "left_anti"))
    posts = posts.select(F.posexplode("p1").alias("i", "token"), F.col("row").alias("rid"), "n", (F.shiftleft(F.least("hot", F.lit(255)), 54) + F.col("row")).alias("typical"))
    shared = posts.groupBy("token").agg(F.count("*").alias("k"), F.max("typical").alias("high"), F.max_by("n", "typical").alias("centre_n")).where("k > 1")
    shared = shared.select("token", F.col("high").bitwiseAND((1 << 54) - 1).alias("centre"), "centre_n")
    lean = posts.select("token", "rid", (F.shiftleft(F.col("n"), 31) + F.col("i")).alias("at"))  # two numbers in one column: this is the widest shuffle
    posts = lean.join(shared, "token").select("token", F.col("at").bitwiseAND((1 << 31) - 1).alias("i"), "rid", F.shiftright("at", 31).alias("n"), "centre", "centre_n")
    posts = scratch.write(posts, "postings")
    fits = lambda n, m: F.least(n, m) * 100 >= F.greatest(n, m) * params.percent
    reach = lambda overlap, total: overlap * (100 + params.percent) >= total * params.percent

    def shared_first(n, m):
        """How many common tokens linked sets of n and m tokens have in their first n - r + that many and m - r + that many, where r
        is the overlap they need: what lies behind holds r less that many at most."""
        least = F.ceil((n + m) * params.percent / (100 + params.percent)) - F.ceil(F.greatest(n, m) * params.percent / 100) + 1
        return F.greatest(F.lit(1), F.least(F.lit(SHARED), least))

    star = posts.where("rid <> centre").where(fits(F.col("n"), F.col("centre_n"))).groupBy("rid", "centre").agg(F.count("*").alias("c"), F.first(shared_first(F.col("n"), F.col("centre_n"))).alias("first"))
    star = star.where("c >= first").groupBy("rid").agg(F.max_by("centre", "c").alias("b")).select(F.col("rid").alias("a"), "b")
    first = linked(star, docs, base, params, scratch)
    member = components(first, scratch)

    comp: Column = F.coalesce("component", "rid")
    open_posts = posts.select("token", "i", "rid", "n").join(member, F.col("rid") == F.col("node"), "left").select("token", "i", "rid", "n", comp.alias("comp"))
    open_posts = scratch.write(open_posts, "placed")
    scratch.free(posts, copies, member)
    held = open_posts.groupBy("token", "comp").agg(F.count("*").alias("c")).groupBy("token").agg(F.count("*").alias("k"), F.max_by("comp", "c").alias("major")).where("k > 1").drop("k")
    held = scratch.write(open_posts.join(held, "token"), "open")
    scratch.free(open_posts)
    minor = held.where("comp <> major").select("token", F.col("rid").alias("x"), F.col("n").alias("xn"), (F.col("n") - F.col("i")).alias("x_left"), F.col("comp").alias("x_comp"))
    every = held.select("token", F.col("rid").alias("y"), F.col("n").alias("yn"), (F.col("n") - F.col("i")).alias("y_left"), F.col("comp").alias("y_comp"), "major")
    behind, total = F.least("x_left", "y_left"), F.col("xn") + F.col("yn")  # tokens from this one on, of the set with fewer
    meet = minor.join(every, "token").where("x_comp <> y_comp and (y_comp = major or x < y)").where(fits(F.col("xn"), F.col("yn")))
    first_few = shared_first(F.col("xn"), F.col("yn"))
    meet = meet.where(reach(behind + first_few - 1, total))
    pairs = meet.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.count("*").alias("c"), F.min(behind).alias("behind"), F.first(total).alias("total"), F.first(first_few).alias("first"))
    second = linked(pairs.where("c >= first").where(reach(F.col("c") + F.col("behind") - 1, F.col("total"))), docs, base, params, scratch)
    scratch.free(held)

    whole = components(first.unionByName(second), scratch)
    names = recs.join(whole, F.col("rid") == F.col("node"), "left").select(F.col("rec_a").alias("a"), F.col("rec_b").alias("b"), comp.alias("comp"))
    out = base.select("row", "doc_id", "print", "n", "rec_a", "rec_b").join(names, (F.col("rec_a") == F.col("a")) & (F.col("rec_b") == F.col("b")) & (F.col("n") > 0), "left")
    out = scratch.write(out.select("row", "doc_id", "print", "n", F.coalesce("comp", "row").alias("comp")), "classes")
    scratch.free(base, recs, first, second, whole)
    return out


def near_duplicates(docs: DataFrame, params: Params = Params()) -> DataFrame:
    """doc_id, n_shingles and component_id (least doc_id that links reach) of every document.

    Null text, empty text or no words: an empty set, linked with nothing. Fewer words than a shingle: the whole sequence is the
    one shingle. Equal texts are linked. Null doc_ids take part, but a component's id is its least non-null one. Rows with one
    doc_id keep a row each. Empty table: no rows. Other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "jaccard")
    rows = placed(docs, params, scratch)
    least = rows.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    out = scratch.write(rows.join(least, "comp").select("doc_id", F.col("n").alias("n_shingles"), "component_id"), "result")
    scratch.free(rows)
    return out


def keep_one(docs: DataFrame, params: Params = Params()) -> DataFrame:
    """The documents, all columns, one of each group of linked ones: that with the least doc_id (null last), then the least hash
    of its text. Rows that repeat both its doc_id and its text become one. Texts without a word are linked with nothing, so all
    of these stay, as do all columns. Rows under one doc_id are judged each by its own text. Empty table: no rows."""
    scratch = Scratch(docs.sparkSession, "keep")
    rows = placed(docs, params, scratch).where("n > 0")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "print", "row")
    best = rows.groupBy("comp").agg(F.min(order).alias("best"))
    rest = rows.join(best, "comp").where("row <> best.row")
    same = F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("print") == F.col("best.print"))
    rest = scratch.write(rest.select(F.col("doc_id").alias("id"), "print", same.alias("again")).distinct(), "gone").alias("gone")
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole")  # so that no names clash
    marked = docs.select(F.struct("doc_id", F.xxhash64("text").alias("print")).alias("mark"), whole)
    key = F.col("mark.doc_id").eqNullSafe(F.col("gone.id")) & (F.col("mark.print") == F.col("gone.print"))
    maybe, kept = sifted(marked, F.xxhash64("mark.doc_id", "mark.print"), rest, F.xxhash64("id", "print"))
    kept = kept.unionByName(maybe.join(rest.where("not gone.again"), key, "left_anti"))
    again = rest.where("gone.again")
    if not again.isEmpty():
        kept = kept.join(again, key, "left_anti").unionByName(kept.join(again, key, "left_semi").dropDuplicates(["mark"]))
    return kept.select("whole.*")
