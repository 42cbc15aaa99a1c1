"""Document fingerprints by consistent weighted sampling, with built-in functions only.

A document is a bag of weighted terms: its lower-cased words, each weighing its count times the square of its length (in
code points, 63 at most), so that the short words of a language count little. For sample k and a term of weight S, with r and c
drawn from Gamma(2, 1) and b from [0, 1) by hashes of the term and k:

    t = floor(ln S / r + b),   ln a = ln c - r (t - b) - r

and the sample is the (term, t) of least a. Two documents agree on a sample with a probability equal to the generalised
Jaccard similarity of their bags: the sum of the smaller weights over the sum of the larger ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SAMPLES = 32
SPACES = r"[\x20\x09-\x0D]+"


#: Samples computed from one row. Rows are multiplied by SAMPLES / TOGETHER: few enough samples for code that the JVM compiles.
TOGETHER = 4


def uniform(x: Column, shift: int, bits: int) -> Column:
    return (F.shiftrightunsigned(x, shift).bitwiseAND((1 << bits) - 1) + 0.5) * 2.0**-bits


def signatures(rows: DataFrame, keys: list[str], text: str = "text", samples: int = SAMPLES) -> DataFrame:
    """keys and `signature` (array of longs) of every row that has a word. `keys` must tell rows apart. If the rows are
    partitioned by some of the keys, nothing is shuffled.

    A candidate is one long, ln a in the high 32 bits and a hash of (term, t) in the low ones, so that a sample is a plain
    minimum. The steps stand in projections of their own, lest a draw be computed more than once.
    """
    words = rows.select(*keys, F.explode(F.split(F.lower(F.col(text)), SPACES)).alias("word")).where("word <> ''")
    terms = words.select(*keys, F.xxhash64("word").alias("term"), F.least(F.length("word"), F.lit(63)).alias("len"))
    bags = terms.groupBy(*keys, "term", "len").agg(F.count("*").alias("n"))
    js = range(TOGETHER)
    step = bags.select(*keys, "term", F.ln(F.col("n") * F.col("len") * F.col("len")).alias("w"), F.explode(F.lit(list(range(samples // TOGETHER)))).alias("set"))
    step = step.select(*keys, "term", "w", "set", *[F.xxhash64("term", "set", F.lit(j)).alias(f"g{j}") for j in js], *[F.xxhash64("term", "set", F.lit(j + TOGETHER)).alias(f"h{j}") for j in js])
    step = step.select(
        *keys, "term", "w", "set",
        *[(-F.ln(uniform(F.col(f"g{j}"), 0, 21) * uniform(F.col(f"g{j}"), 21, 21))).alias(f"r{j}") for j in js],
        *[uniform(F.col(f"g{j}"), 42, 22).alias(f"b{j}") for j in js],
        *[F.ln(-F.ln(uniform(F.col(f"h{j}"), 0, 32) * uniform(F.col(f"h{j}"), 32, 32))).alias(f"c{j}") for j in js],
    )
    step = step.select("*", *[F.floor(F.col("w") / F.col(f"r{j}") + F.col(f"b{j}")).alias(f"t{j}") for j in js])

    def candidate(j: int) -> Column:
        r, b, c, t = (F.col(f"{x}{j}") for x in "rbct")
        high = ((c - r * (t - b) - r + 64) * float(1 << 24)).cast("long")
        return F.shiftleft(high, 32).bitwiseOR(F.col("term").bitwiseXOR(F.shiftleft(t, 9)).bitwiseXOR(t).bitwiseAND(0xFFFFFFFF))

    mins = step.groupBy(*keys, "set").agg(*[F.min(candidate(j)).alias(f"s{j}") for j in js])
    sets = mins.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("set", *[f"s{j}" for j in js]))).alias("sets"))
    return sets.select(*keys, F.flatten(F.transform("sets", lambda x: F.array(*[x[f"s{j}"] for j in js]))).alias("signature"))


def likeness(a: Column, b: Column) -> Column:
    """Share of samples on which two signatures agree; without words: 1.0 to each other, 0.0 to others."""
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x)) / F.size(a)
    return F.when(a.isNull() & b.isNull(), 1.0).when(a.isNull() | b.isNull(), 0.0).otherwise(same)


def fingerprint(signature: Column) -> Column:
    """Eight hex digits a sample; '' without words."""
    digits = F.transform(signature, lambda x: F.lpad(F.lower(F.hex(x.bitwiseAND(0xFFFFFFFF))), 8, "0"))
    return F.coalesce(F.array_join(digits, ""), F.lit(""))


def blocks(docs: DataFrame, rows_per_block: int = 500, most_blocks: int = 20_000, segments: int = 64) -> Column:
    """A block number that never falls as doc_id grows, with about rows_per_block rows in each, and most_blocks of them at
    most: equal widths inside segments between quantiles of doc_id. Null ids get the lowest block."""
    shares = F.array(*[F.lit(i / segments) for i in range(segments + 1)])
    row = docs.agg(F.count("doc_id"), F.percentile_approx("doc_id", shares, F.lit(10_000)), F.min("doc_id"), F.max("doc_id")).first()
    doc_id = F.col("doc_id")
    if not row[0]:
        return F.lit(-1).cast("long")
    bounds = sorted({row[2], *row[1], row[3] + 1})
    per = max(1, min(row[0] // rows_per_block, most_blocks) // max(1, len(bounds) - 1))

    def inside(i: int) -> Column:
        lo, hi = bounds[i], bounds[i + 1]
        share = (doc_id - lo) * (float(per) / float(hi - lo))
        return F.least(F.floor(share), F.lit(per - 1)) + F.lit(i * per).cast("long")

    def find(lo: int, hi: int) -> Column:
        if hi - lo == 1:
            return inside(lo)
        mid = (lo + hi) // 2
        return F.when(doc_id < bounds[mid], find(lo, mid)).otherwise(find(mid, hi))

    return F.when(doc_id.isNull(), F.lit(-1).cast("long")).otherwise(find(0, len(bounds) - 1))


def with_next(docs: DataFrame) -> DataFrame:
    """block, ghost, rn, doc_id, text and next_text of every document, in descending doc_id order (null last, equal ids by text),
    the first following the last. The texts are shuffled once: each block gets the first document of the block below
    as a ghost row, so that every row finds its neighbour in its own block."""
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("block", blocks(docs))
    firsts = docs.groupBy("block").agg(F.max("doc_id").alias("first_id"))
    down = Window.orderBy(F.col("block").desc())  # a row for each block, at most 20,000
    above = F.coalesce(F.lag("block").over(down), F.min("block").over(Window.partitionBy()))
    placed = docs.join(F.broadcast(firsts.withColumn("above", above)), "block")
    own, ghost = (F.struct(F.col(c).alias("block"), F.lit(g).alias("ghost")) for c, g in (("block", False), ("above", True)))
    homes = F.when(F.col("doc_id").eqNullSafe(F.col("first_id")), F.array(own, ghost)).otherwise(F.array(own))
    placed = placed.select("doc_id", "text", F.explode(homes).alias("home")).select(F.coalesce("home.block", F.lit(-1).cast("long")).alias("block"), "home.ghost", "doc_id", "text")
    order = Window.partitionBy("block").orderBy("ghost", F.col("doc_id").desc_nulls_last(), "text")
    return placed.select("*", F.row_number().over(order).alias("rn"), F.lead("text").over(order).alias("next_text"))


def fingerprint_edits(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next of every document, where the
    edited text has its last half replaced by the beginning of the next document's text.

    Null text: empty. Texts without a word have the fingerprint ''. Null doc_ids come last, repeated ones in order of
    their texts, each with a row of its own. One document: it is its own neighbour. Empty table: no rows. Other columns
    are ignored.
    """
    rows = with_next(docs.select("doc_id", "text"))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.left("text", n - half), F.left("next_text", half))
    rows = rows.withColumn("edited", F.when(~F.col("ghost"), edited))
    sides = F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("text").alias("text")), F.struct(F.lit(1).alias("side"), F.col("edited").alias("text"))))
    texts = rows.select("block", "rn", sides.alias("x")).select("block", "rn", "x.side", "x.text")
    found = signatures(texts, ["block", "rn", "side"], samples=samples)
    pairs = found.groupBy("block", "rn").agg(*[F.max(F.when(F.col("side") == s, F.col("signature"))).alias(name) for s, name in ((0, "own"), (1, "cut"))])
    attributes = rows.select("block", "rn", "ghost", "doc_id", n.cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"))
    joined = attributes.join(pairs, ["block", "rn"], "left").withColumn("after", F.lead("own").over(Window.partitionBy("block").orderBy("rn")))
    return joined.where(~F.col("ghost")).select(
        "doc_id", "n_chars", "edited_sha256",
        fingerprint(F.col("own")).alias("fingerprint"), fingerprint(F.col("cut")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("cut")).alias("near_edited"), likeness(F.col("own"), F.col("after")).alias("near_next"),
    )
