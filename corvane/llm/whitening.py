"""Whitening of embeddings: covariance by column aggregates, one for each pair of dimensions in the upper triangle.

Vectors are taken on a grid, so that counts, sums and distances are whole numbers. The distinct vectors are written once and read
three times: for their number and sums, for the centred products of every pair of dimensions (generated SQL expressions in a
single aggregation), and for a check of the whitened values. Only these sums reach the driver, where LAPACK decomposes the
covariance. The triangle is folded into dims + 1 expressions over dims / 2 groups, as one column for each of dims * (dims + 1) / 2
pairs makes more code than the JVM compiles (51,282 vectors of 64 dimensions: 12 to 20 s flat, 2 s folded).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: A component whose variance is a smaller share of the trace than this has none.
NO_VARIANCE = 1e-12


@dataclass(frozen=True)
class Whitening:
    """n distinct vectors with the sums `sums` of each dimension; `axes` (a row a component, by falling variance) and `variances`."""

    n: int
    sums: list[int]
    covariance: np.ndarray
    axes: np.ndarray
    variances: np.ndarray

    @property
    def trace(self) -> float:
        return float(np.trace(self.covariance))

    def component(self, k: int, x: str = "x") -> Column:
        """The k-th whitened value of the vector column, null where the component has no variance."""
        if k >= len(self.variances) or self.variances[k] <= NO_VARIANCE * self.trace:
            return F.lit(None).cast("double")
        scale = 1 / np.sqrt(self.variances[k])
        terms = [f"({x}[{d}] - {s / self.n!r}D) * {float(a * scale)!r}D" for d, (s, a) in enumerate(zip(self.sums, self.axes[k]))]
        return F.expr(" + ".join(terms))

    def deviation(self, x: str = "x") -> Column:
        """Squared distance of n times the vector from the sums, exact; null if a long can't hold it."""
        terms = [f"try_cast({self.n} * CAST({x}[{d}] AS DECIMAL(19, 0)) - {s} AS DECIMAL(19, 0))" for d, s in enumerate(self.sums)]
        exact = f"aggregate(array({', '.join(terms)}), CAST(0 AS DECIMAL(38, 0)), (a, y) -> try_cast(try_add(a, try_multiply(y, y)) AS DECIMAL(38, 0)))"
        return F.expr(f"try_cast({exact} AS BIGINT)") if terms else F.lit(0).cast("long")


def on_grid(table: DataFrame, vector: str, *keep: str, scale: int = 256) -> DataFrame:
    """The kept columns and x, the vector in steps of 1 / scale as whole numbers. Rows whose vector is null or holds a null or
    non-finite entry are dropped. What a long can't hold becomes the nearest one."""
    v = F.col(f"`{vector}`")
    odd = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    steps = F.transform(v, lambda c: F.floor(c.cast("double") * float(scale)).cast("long"))
    return table.where(v.isNotNull() & ~odd).select(*[F.col(f"`{k}`") for k in keep], steps.alias("x"))


def widened(rows: DataFrame, dims: int) -> DataFrame:
    """Vectors of fewer dimensions get zeros behind."""
    return rows.withColumn("x", F.when(F.size("x") < dims, F.slice(F.concat("x", F.array_repeat(F.lit(0).cast("long"), dims)), 1, dims)).otherwise(F.col("x")))


def fit(distinct: DataFrame, dims: int) -> Whitening:
    """Statistics of the distinct vectors (column x) and their decomposition."""
    cols = [f"x[{d}]" for d in range(dims)]
    row = distinct.selectExpr("count(*) AS n", *[f"CAST(sum(CAST({c} AS DECIMAL(19, 0))) AS STRING) AS s{d}" for d, c in enumerate(cols)]).first()
    n, sums = row["n"], [int(row[f"s{d}"] or 0) for d in range(dims)]
    if not n or not dims:
        return Whitening(n, sums, np.zeros((dims, dims)), np.eye(dims), np.zeros(dims))
    centred = distinct.select(F.zip_with("x", F.lit([s / n for s in sums]), lambda x, m: x - m).alias("c"))
    # row i of the triangle and row dims - 1 - i hold dims + 1 pairs together: so many expressions, over half as many groups as rows
    spread = centred.select("c", F.explode(F.sequence(F.lit(0), F.lit((dims - 1) // 2))).alias("g"))
    products = [f"sum(get(c, if({k} < {dims} - g, g, {dims - 1} - g)) * get(c, if({k} < {dims} - g, g + {k}, {k - 1}))) AS p{k}" for k in range(dims + 1)]
    cov = np.zeros((dims, dims))
    for g, *found in spread.groupBy("g").agg(*map(F.expr, products)).collect():  # half as many rows as dimensions
        for k, total in enumerate(found):
            i, j = (g, g + k) if k < dims - g else (dims - 1 - g, k - 1)
            cov[i, j] = cov[j, i] = total / n
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(-values, kind="stable")
    axes = vectors.T[order]
    largest = np.abs(axes).argmax(axis=1)  # either sign would do; the largest entry is made positive
    return Whitening(n, sums, cov, axes * np.sign(axes[np.arange(dims), largest])[:, None], np.maximum(values[order], 0))


def whiten(table: DataFrame, vector: str = "embedding", key: str = "vec_id", components: int = 4, scale: int = 256) -> DataFrame:
    """A row for each vector and component: key, component (from 1), n, deviation, whitened, explained, identity_error.

    Vectors that are null or hold null or non-finite entries are dropped; all others, repeated ones and null keys too, have their
    rows, while repeated vectors count once in the statistics. There are as many components as dimensions at most. Vectors of fewer
    dimensions than the longest count as ending in zeros. A component without variance (one vector, say) has null whitened and
    explained 0, null if nothing varies, and doesn't enter identity_error, which is null without any. Empty table: no rows.
    Other columns are ignored.
    """
    # the dimensions decide the plan, a few dozen to a few hundred
    dims = on_grid(table, vector, scale=scale).agg(F.max(F.size("x"))).first()[0] or 0
    rows = widened(on_grid(table, vector, key, scale=scale), dims)
    distinct = Scratch(table.sparkSession, "whitening").write(rows.select("x").distinct(), "vectors")
    w = fit(distinct, dims)
    shown = range(min(components, dims))
    real = [k for k in shown if w.variances[k] > NO_VARIANCE * w.trace]
    error = None
    if real:
        values = distinct.select(*[w.component(k).alias(f"w{k}") for k in real])
        pairs = [(i, j) for i in real for j in real if i <= j]
        found = values.selectExpr(*[f"covar_pop(w{i}, w{j})" for i, j in pairs]).first()
        error = max(abs(c - (i == j)) for (i, j), c in zip(pairs, found))
    share = [w.variances[k] / w.trace if w.trace else None for k in shown]
    each = F.explode(F.array(*[F.struct(F.lit(k + 1).alias("component"), w.component(k).alias("whitened"), F.lit(share[k]).cast("double").alias("explained")) for k in shown]) if shown else F.expr("CAST(array() AS ARRAY<STRUCT<component: INT, whitened: DOUBLE, explained: DOUBLE>>)"))
    out = rows.select(F.col(f"`{key}`"), w.deviation().alias("deviation"), each.alias("c"))
    return out.select(F.col(f"`{key}`"), "c.component", F.lit(w.n).cast("long").alias("n"), "deviation", "c.whitened", "c.explained", F.lit(error).cast("double").alias("identity_error"))
