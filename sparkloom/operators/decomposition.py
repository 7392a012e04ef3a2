"""Tensor decompositions. Factors are tables (i, f ARRAY) of rank-length rows; only rank x rank matrices reach the driver."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import Rounds, cut
from ..tensor import SparseTensor
from .linear import BROADCAST_CELLS

#: Numbers of a starting factor that the driver draws.
DRIVER_CELLS = 1_000_000
#: Longest axis whose Gram matrix is gathered for an eigendecomposition.
GRAM_ROWS = 4096


def factor_table(spark: SparkSession, f: np.ndarray) -> DataFrame:
    return spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(f)], "i long, f array<double>")


def seeded_factor(spark: SparkSession, n: int, rank: int, seed: int = 0) -> DataFrame:
    """Starting values in [0, 1), equal for factors of equal size: those of a fresh seeded generator, or, beyond
    DRIVER_CELLS numbers, hashes of seed and place that the tasks draw."""
    if n * rank <= DRIVER_CELLS:
        return factor_table(spark, np.random.default_rng(seed).random((n, rank)))
    value = lambda r: F.shiftrightunsigned(F.xxhash64(F.lit(seed), "id", F.lit(r)), 11).cast("double") / float(1 << 53)
    return spark.range(n).select(F.col("id").alias("i"), F.array(*[value(r) for r in range(rank)]).alias("f"))


def joined_factors(x: DataFrame, factors: list[DataFrame], shape, skip: int) -> tuple[DataFrame, list[str]]:
    names = []
    for k, f in enumerate(factors):
        if k != skip:
            side = f.select(F.col("i").alias(f"i{k}"), F.col("f").alias(f"f{k}"))
            x = x.join(F.broadcast(side) if shape[k] <= BROADCAST_CELLS // 64 else side, f"i{k}")
            names.append(f"f{k}")
    return x, names


def mttkrp(x: SparseTensor, factors: list[DataFrame], mode: int, rank: int) -> DataFrame:
    """Rows (i, m ARRAY): the tensor times the Khatri-Rao product of all factors but one."""
    df, names = joined_factors(x.df, factors, x.shape, mode)
    terms = [reduce(lambda p, q: p * q, [F.col(n)[r] for n in names], F.col("v").cast("double")) for r in range(rank)]
    return df.groupBy(F.col(f"i{mode}").alias("i")).agg(F.array(*[F.sum(t) for t in terms]).alias("m"))


def gram(f: DataFrame, rank: int) -> np.ndarray:
    """F'F on the driver."""
    pairs = [(r, s) for r in range(rank) for s in range(r, rank)]
    row = f.agg(*[F.sum(F.col("f")[r] * F.col("f")[s]) for r, s in pairs]).first()
    out = np.zeros((rank, rank))
    for (r, s), v in zip(pairs, row, strict=True):
        out[r, s] = out[s, r] = v or 0.0
    return out


def times_small(row: Column, m: np.ndarray) -> Column:
    """A row array times a small matrix."""
    return F.array(*[reduce(lambda p, q: p + q, [row[s] * float(m[s, r]) for s in range(len(m))]) for r in range(m.shape[1])])


def cp_als(x: SparseTensor, rank: int, max_iter: int = 50, seed: int = 0) -> tuple[list[DataFrame], np.ndarray]:
    """Canonical decomposition of any order by alternating least squares: unit-norm factors and weights."""
    spark, order = x.spark, x.rank
    x = x.with_df(cut(x.df))
    factors = [seeded_factor(spark, n, rank, seed) for n in x.shape]
    grams, kept = [gram(f, rank) for f in factors], Rounds(2 * order)
    for _ in range(max_iter):
        for mode in range(order):
            g = reduce(np.multiply, [grams[k] for k in range(order) if k != mode])
            solved = mttkrp(x, factors, mode, rank).select("i", times_small(F.col("m"), np.linalg.pinv(g)).alias("f"))
            every = spark.range(x.shape[mode]).withColumnRenamed("id", "i").join(solved, "i", "left")
            factors[mode] = kept.cut(every.select("i", F.coalesce("f", F.array(*[F.lit(0.0)] * rank)).alias("f")))
            grams[mode] = gram(factors[mode], rank)
    norms = [np.sqrt(np.diag(g)) for g in grams]
    scaled = [f.select("i", F.array(*[F.col("f")[r] / float(max(n[r], 1e-10)) for r in range(rank)]).alias("f")) for f, n in zip(factors, norms, strict=True)]
    return scaled, reduce(np.multiply, norms)


def cp_error(x: SparseTensor, factors: list[DataFrame], weights: np.ndarray) -> float:
    """Relative reconstruction error, from inner products alone."""
    rank = len(weights)
    df, names = joined_factors(x.df, factors, x.shape, -1)
    model = reduce(lambda p, q: p + q, [reduce(lambda p, q: p * q, [F.col(n)[r] for n in names], F.lit(float(weights[r]))) for r in range(rank)])
    inner, norm_sq = (float(v or 0.0) for v in df.agg(F.sum(F.col("v") * model), F.sum(F.col("v") ** 2)).first())
    whole = float(weights @ reduce(np.multiply, [gram(f, rank) for f in factors]) @ weights)
    return math.sqrt(max(0.0, norm_sq - 2 * inner + whole) / norm_sq) if norm_sq else 0.0


def unfolding_gram(df: DataFrame, mode: str, rest: list[str], n: int) -> np.ndarray:
    """X_(mode) X_(mode)' on the driver; the axis must be short enough for that."""
    p, q = df.select(F.col(mode).alias("p"), *rest, F.col("v").alias("a")), df.select(F.col(mode).alias("q"), *rest, F.col("v").alias("b"))
    rows = p.join(q, rest).where("p <= q").groupBy("p", "q").agg(F.sum(F.col("a") * F.col("b")).alias("g")).toPandas()
    out = np.zeros((n, n))
    out[rows["p"], rows["q"]] = rows["g"]
    return out + np.triu(out, 1).T


def signed(u: np.ndarray) -> np.ndarray:
    """Columns with their largest entry positive."""
    return u * np.where(u[np.abs(u).argmax(0), np.arange(u.shape[1])] < 0, -1.0, 1.0)


def subspace(df: DataFrame, mode: str, rest: list[str], n: int, rank: int, rounds: int = 100, tol: float = 1e-9) -> np.ndarray:
    """Leading left singular vectors of an unfolding by subspace iteration: two joins a round, each cell used once in both.

    Only n x rank numbers are on the driver, and no fibre is joined with itself.
    """
    width = min(n, rank + 4)
    u = np.linalg.qr(np.random.default_rng(0).standard_normal((n, width)))[0]
    sums = lambda a: F.array(*[F.sum(F.col("v") * F.col(a)[r]) for r in range(width)])
    for _ in range(rounds):
        side = factor_table(df.sparkSession, u).toDF(mode, "u")
        side = F.broadcast(side) if n <= BROADCAST_CELLS // 64 else side
        seen = df.join(side, mode).groupBy(*rest).agg(sums("u").alias("w"))
        back = df.join(seen, rest).groupBy(mode).agg(sums("w").alias("y")).collect()
        y = np.zeros((n, width))
        for i, row in back:
            y[i] = row
        values, turn = np.linalg.eigh(u.T @ y)
        order = np.argsort(-values, kind="stable")
        ritz, image = u @ turn[:, order], y @ turn[:, order]
        gap = np.linalg.norm(image[:, :rank] - ritz[:, :rank] * values[order][:rank])
        if gap <= tol * max(abs(values).max(), 1e-300):
            break
        u = np.linalg.qr(y)[0]
    return signed(ritz[:, :rank])


def leading(df: DataFrame, mode: str, rest: list[str], n: int, rank: int) -> np.ndarray:
    """Leading left singular vectors of an unfolding: from its Gram matrix, or without that for a long axis."""
    return left_vectors(unfolding_gram(df, mode, rest, n), rank) if n <= GRAM_ROWS else subspace(df, mode, rest, n, rank)


def left_vectors(g: np.ndarray, rank: int) -> np.ndarray:
    """Leading left singular vectors from a Gram matrix, signs fixed by the largest entry."""
    values, vectors = np.linalg.eigh(g)
    u = vectors[:, np.argsort(-values, kind="stable")[:rank]]
    return signed(u)


def projected(x: SparseTensor, factors: list[np.ndarray], skip: int) -> DataFrame:
    """The tensor times every factor's transpose but one, by one join and aggregate per mode: columns i0.., v."""
    df, spark = x.df.select(*x.dims, F.col("v").cast("double").alias("v")), x.spark
    for k, f in enumerate(factors):
        if k != skip:
            side = F.broadcast(factor_table(spark, f).select(F.col("i").alias(f"i{k}"), F.posexplode("f").alias("r", "u")))
            keep = [d for d in x.dims if d != f"i{k}"]
            df = df.join(side, f"i{k}").groupBy(*keep, F.col("r").cast("long").alias(f"i{k}")).agg(F.sum(F.col("v") * F.col("u")).alias("v"))
    return df.select(*x.dims, "v")


def hosvd(x: SparseTensor, ranks: tuple[int, ...], max_iter: int = 50, tolerance: float = 1e-8) -> tuple[SparseTensor, list[np.ndarray]]:
    """Tucker decomposition of any order by higher-order orthogonal iteration: core and orthonormal factors."""
    x, kept = x.with_df(cut(x.df.withColumn("v", F.col("v").cast("double")))), Rounds()
    rest = lambda k: [d for d in x.dims if d != f"i{k}"]
    factors = [leading(x.df, f"i{k}", rest(k), n, ranks[k]) for k, n in enumerate(x.shape)]
    for _ in range(max_iter):
        before = list(factors)
        for k, n in enumerate(x.shape):
            factors[k] = leading(kept.cut(projected(x, factors, k)), f"i{k}", rest(k), n, ranks[k])
        if sum(np.linalg.norm(a - b) for a, b in zip(factors, before, strict=True)) < tolerance:
            break
    core = projected(x, factors, -1)
    return SparseTensor(core, tuple(ranks), 0.0), factors
