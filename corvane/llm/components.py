"""Connected components of an edge table, without collecting nodes or edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import Scratch


def components(edges: DataFrame, scratch: Scratch, most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of edges (a, b); component is the least node that links reach.

    Alternating stars: every node hands its larger neighbours to its least neighbour, then its smaller ones. Each half is an
    aggregation with a map-side minimum and a join back, so a node with very many edges is never gathered in one task.
    Each round is written to the shared folder, and the loop ends when a round changes nothing. Edges with a null end are
    ignored; loops and repeated edges do no harm. Empty table: no rows.
    """
    pairs = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("a is not null and b is not null")

    def written(df, name):
        """The table, and a number that tells whether it is another one than that of the round before."""
        seen = Observation()
        df = df.observe(seen, F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("x"))
        table = scratch.write(df, name)
        return table, seen.get

    now, before = written(pairs.where("u <> v").distinct(), "edges")
    first, loops = now, pairs.where("u = v").select(F.col("u").alias("node"))
    for _ in range(most_rounds):
        if not before["n"]:
            break
        both = now.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.u", "e.v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = scratch.write(large, "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        small, after = written(small.select("e.u", "e.v").where("u <> v").distinct(), "small")
        scratch.free(*[t for t in (now, large) if t is not first])
        now = small
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    nodes = first.select(F.explode(F.array("u", "v")).alias("node")).unionByName(loops).distinct()
    out = nodes.join(now.groupBy("u").agg(F.min("v").alias("v")), F.col("node") == F.col("u"), "left").select("node", F.coalesce("v", "node").alias("component"))
    out = scratch.write(out, "components")
    scratch.free(first, *[now] * (now is not first))
    return out
