"""Mixing sources to target weights along a curriculum, with built-in functions only.

Every source has a weight schedule over training time u in [0, 1], here a straight line whose mean is the source's target.
Its integral is the source's cumulative token demand; inverting the demand at the place where a document begins in its
source's stream gives the document's training position, and sorting by position interleaves the sources as scheduled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD

#: Hash buckets of a source. A source's stream is a chain of buckets, so no source is ordered in one task.
BUCKETS_HEX = 3
#: Weights of the sources by code point, and slopes of their schedules; both repeat. A slope of -0.5 means that the weight
#: falls from 1.5 to 0.5 times its mean.
WEIGHTS = (1, 2, 3)
SLOPES = (-0.5, 0.0, 0.5)
MOST_REPEATS = 3


def sized(docs: DataFrame, *keep: str) -> DataFrame:
    """doc_id, source and further columns, with the size in words, the source's key and the place in its stream."""
    cols = dict.fromkeys(["doc_id", "source", *keep])
    order = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    return docs.select(
        *[F.col(f"`{c}`").alias(f"in_{c}") for c in cols],
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("t")).alias("key"),  # null sorts after every source
        order.alias("place"),
        F.substring(order, 1, BUCKETS_HEX).alias("bucket"),
    )


def targets(sources: DataFrame) -> DataFrame:
    """key, source_size, target and slope of every source, of (key, source_size). The table has a row a source.

    Water-filling: a source gets its weight's share of the level at which all shares together use up the total, but 3 times
    its own size at most. In order of size to weight, the capped sources are a prefix.
    """
    every, by_key = Window.partitionBy(), Window.orderBy("key")
    n = F.row_number().over(by_key) - 1
    w = F.element_at(F.array(*map(F.lit, WEIGHTS)), (n % len(WEIGHTS) + 1).cast("int"))
    slope = F.element_at(F.array(*map(F.lit, SLOPES)), (n % len(SLOPES) + 1).cast("int"))
    src = sources.select("key", "source_size", w.alias("w"), slope.alias("slope"), (F.lit(MOST_REPEATS) * F.col("source_size")).alias("cap"))
    before = Window.orderBy(F.col("cap") / F.col("w"), "key").rowsBetween(Window.unboundedPreceding, -1)
    src = src.select(
        "*",
        (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0))).alias("left"),
        (F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0))).alias("w_left"),
    )
    src = src.withColumn("level", F.col("left") / F.col("w_left")).withColumn("capped", F.col("cap") <= F.col("level") * F.col("w"))
    level = F.min(F.when(~F.col("capped"), F.struct(-F.col("w_left"), "level"))).over(every)["level"]
    return src.select("key", "source_size", "slope", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(level * F.col("w")).alias("target"))


def position(offset: Column, target: Column, slope: Column) -> Column:
    """The u at which a demand of target * (u + slope * (u * u - u)) has grown to offset."""
    y = F.try_divide(offset, target)
    return 2 * y / ((1 - slope) + F.sqrt((1 - slope) * (1 - slope) + 4 * slope * y))


def mix(docs: DataFrame, *keep: str, whole: bool = False, words: DataFrame | None = None) -> DataFrame:
    """A row for each document: doc_id, source, the `keep` columns, size, source_size, target, taken, and placements, an
    array of (position, words): the places in training at which the document, or its first words, are read.

    A source's documents follow each other in hash order and again from the start, 3 times at most, until the target is
    reached; the last one is cut there. With `whole`, it is read whole if the target covers half of it at least, else not.
    Null text or no words: size 0, never taken. Null source: a source of its own, the last. Repeated rows are documents each.
    Empty table: no rows. Extra columns are ignored. Reruns agree, as the order hangs on doc_id and size alone.
    """
    narrow = words if words is not None else sized(docs)
    rows = sized(docs, *keep) if keep or words is None else words
    buckets = narrow.groupBy("key", "bucket").agg(F.sum("size").alias("n"))
    chain = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    chained = buckets.select("key", "bucket", F.coalesce(F.sum("n").over(chain), F.lit(0)).alias("ahead"), F.sum("n").over(Window.partitionBy("key")).alias("source_size"))
    goals = targets(buckets.groupBy("key").agg(F.sum("n").alias("source_size"))).select("key", "slope", "target")
    goals = chained.join(goals, "key")
    inside = Window.partitionBy("key", "bucket").orderBy("place", "in_doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    out = rows.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(goals, ["key", "bucket"])
    goal = F.floor(F.col("target") + 0.5)

    def one(p: Column) -> Column:
        offset = F.col("ahead") + F.col("inside") + p * F.col("source_size")
        left = F.greatest(F.lit(0), F.least(F.col("size"), goal - offset))
        if whole:
            left = F.when(2 * left >= F.col("size"), F.col("size")).otherwise(F.lit(0))
        return F.struct(position(offset, F.col("target"), F.col("slope")).alias("position"), left.cast("long").alias("words"))

    places = F.filter(F.transform(F.array(*[F.lit(p).cast("long") for p in range(MOST_REPEATS)]), one), lambda x: x["words"] > 0)
    out = out.withColumn("placements", places)
    names = list(dict.fromkeys(["doc_id", "source", *keep]))
    return out.select(
        *[F.col(f"in_{c}").alias(c) for c in names],
        "size", "source_size", "target",
        F.aggregate("placements", F.lit(0).cast("long"), lambda a, x: a + x["words"]).alias("taken"),
        "placements",
    )


def in_training_order(mixed: DataFrame, *columns: str) -> DataFrame:
    """A row for each placement, range-sorted by position."""
    rows = mixed.select(*columns, F.explode("placements").alias("at"))
    return rows.repartitionByRange("at.position", "doc_id").sortWithinPartitions("at.position", "doc_id")


def by_first_position(mixed: DataFrame) -> DataFrame:
    """A row for each document, range-sorted by its first position, those never read last; placements as two arrays."""
    rows = mixed.withColumn("positions", F.col("placements.position")).withColumn("words", F.col("placements.words"))
    order = [F.try_element_at("positions", F.lit(1)).asc_nulls_last(), F.col("doc_id").asc()]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order)
