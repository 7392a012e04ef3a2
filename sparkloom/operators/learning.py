"""Graph convolution, nearest neighbours under random projection, and k-means."""

from __future__ import annotations

import functools
import itertools
import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.grid import grid
from ..storage import Rounds, cut, written
from ..tensor import SparseTensor, from_numpy
from . import linear

#: Numbers of the queries that are broadcast at once.
QUERY_CELLS = 4_000_000


def affine(x: SparseTensor, w: np.ndarray, b: np.ndarray) -> SparseTensor:
    """x @ w + b with every row present, so rows without entries get the bias."""
    w = np.asarray(w, float)
    spark, (n, h) = x.spark, (x.shape[0], w.shape[1])
    product = linear.matmul(x, from_numpy(spark, w))
    bias = F.broadcast(spark.createDataFrame([(j, float(v)) for j, v in enumerate(np.broadcast_to(np.asarray(b, float), (h,)))], "i1 long, b double"))
    cells = grid(spark, {"i0": n, "i1": h}).join(bias, "i1").join(product.df, ["i0", "i1"], "left")
    return SparseTensor(cells.select("i0", "i1", (F.coalesce("v", F.lit(0.0)) + F.col("b")).alias("v")), (n, h), 0.0)


def relu(x: SparseTensor) -> SparseTensor:
    return x.with_df(x.df.withColumn("v", F.greatest("v", F.lit(0.0))))


def gcn(a: SparseTensor, x: SparseTensor, w1: np.ndarray, b1: np.ndarray, w2: np.ndarray, b2: np.ndarray) -> SparseTensor:
    """Two layers: A relu(A X W1 + b1) W2 + b2. Rows of A gather their columns; A is taken as it is."""
    return affine(linear.matmul(a, relu(affine(linear.matmul(a, x), w1, b1))), w2, b2)


def small_product(x: DataFrame, y: DataFrame, shape: tuple[int, int]) -> np.ndarray:
    """X' Y of two tall tables (i0, i1, v), on the driver."""
    rows = x.toDF("i", "p", "a").join(y.toDF("i", "q", "b"), "i").groupBy("p", "q").agg(F.sum(F.col("a") * F.col("b")).alias("v")).toPandas()
    out = np.zeros(shape)
    out[rows["p"], rows["q"]] = rows["v"]
    return out


def column_sums(x: DataFrame, n: int) -> np.ndarray:
    rows = x.groupBy("i1").agg(F.sum("v").alias("v")).toPandas()
    out = np.zeros(n)
    out[rows["i1"]] = rows["v"]
    return out


def gcn_train(a: SparseTensor, x: SparseTensor, w1, b1, w2, b2, targets: SparseTensor, num_iterations: int = 10, learning_rate: float = 0.01):
    """Gradient descent on mean squared error; (loss before the last update, w1, b1, w2, b2). Weights live on the driver."""
    w1, b1, w2, b2 = (np.array(v, float) for v in (w1, b1, w2, b2))
    n, loss = a.shape[0], float("nan")
    at = linear.transpose(a)
    z1 = linear.matmul(a, x)
    z1 = z1.with_df(cut(z1.df))
    for _ in range(num_iterations):
        pre = affine(z1, w1, b1)
        pre = pre.with_df(cut(pre.df))
        z2 = linear.matmul(a, relu(pre))
        z2 = z2.with_df(cut(z2.df))
        y = affine(z2, w2, b2)
        gap = y.df.join(targets.df.withColumnRenamed("v", "t"), ["i0", "i1"], "left").select("i0", "i1", (F.col("v") - F.coalesce("t", F.lit(float(targets.fill)))).alias("v"))
        gap = cut(gap)
        loss = gap.agg(F.sum(F.col("v") ** 2)).first()[0] / n
        dy = SparseTensor(gap.select("i0", "i1", (F.col("v") * (2 / n)).alias("v")), y.shape, 0.0)
        dw2, db2 = small_product(z2.df, dy.df, w2.shape), column_sums(dy.df, len(b2))
        dh = linear.matmul(at, linear.matmul(dy, from_numpy(a.spark, w2.T)))
        dh = cut(dh.df.join(pre.df.where("v > 0").select("i0", "i1"), ["i0", "i1"], "left_semi"))
        dw1, db1 = small_product(z1.df, dh, w1.shape), column_sums(dh, len(b1))
        w1, b1, w2, b2 = w1 - learning_rate * dw1, b1 - learning_rate * db1, w2 - learning_rate * dw2, b2 - learning_rate * db2
    return loss, w1, b1, w2, b2


# --- random projection ----------------------------------------------------------


def uniform(*names: str, seed: int):
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *names), 11).cast("double") / float(1 << 53)


def sparse_signs(spark: SparkSession, n_features: int, n_samples: int, seed: int = 40, eps: float = 0.1) -> SparseTensor:
    """Very sparse random signs: density 1/sqrt(d), target dimension ceil(ln n / eps^2). Entries are hashes of their place."""
    t = math.ceil(math.log(n_samples) / eps**2)
    s = math.sqrt(n_features)
    scale, density = math.sqrt(s / t), 1 / s
    cells = grid(spark, {"i0": n_features, "i1": t}).withColumn("u", uniform("i0", "i1", seed=seed)).where(F.col("u") < density)
    return SparseTensor(cells.select("i0", "i1", F.when(F.col("u") < density / 2, -scale).otherwise(scale).alias("v")), (n_features, t), 0.0)


def signs(spark: SparkSession, d: int, t: int, seed: int = 0) -> SparseTensor:
    """Dense random signs of size 1/sqrt(t)."""
    value = 1 / math.sqrt(t)
    cells = grid(spark, {"i0": d, "i1": t})
    return SparseTensor(cells.select("i0", "i1", F.when(uniform("i0", "i1", seed=seed) < 0.5, value).otherwise(-value).alias("v")), (d, t), 0.0)


def nearest(data: SparseTensor, query: SparseTensor, projection: SparseTensor | None, k: int = 5) -> DataFrame:
    """(query, rank, neighbour, distance): the k nearest rows of ``data`` in the projected space, ties by index.

    Queries are broadcast as arrays, in blocks of at most QUERY_CELLS numbers; each bucket of the data
    keeps its own k best before the final ranking.
    """
    p, q = (linear.matmul(x, projection) if projection is not None else x for x in (data, query))
    rows = lambda t, name: t.dense().df.groupBy("i0").agg(F.transform(F.array_sort(F.collect_list(F.struct("i1", "v"))), lambda s: s["v"]).alias(name))
    near, far = written(rows(p, "d").withColumnRenamed("i0", "n"), "rows"), written(rows(q, "q").withColumnRenamed("i0", "m"), "queries")
    blocks = -(-q.shape[0] * q.shape[1] // QUERY_CELLS)
    gap = F.sqrt(F.aggregate(F.zip_with("d", "q", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x))
    inner = Window.partitionBy("i0", F.pmod(F.xxhash64("i1"), F.lit(64))).orderBy("v", "i1")
    found = []
    for block in range(max(1, blocks)):
        own = far if blocks <= 1 else far.where(F.pmod("m", F.lit(blocks)) == block)
        pairs = near.crossJoin(F.broadcast(own)).select(F.col("m").alias("i0"), F.col("n").alias("i1"), gap.alias("v"))
        best = pairs.withColumn("r", F.row_number().over(inner)).where(F.col("r") <= k)
        best = best.withColumn("rank", F.row_number().over(Window.partitionBy("i0").orderBy("v", "i1")) - 1).where(F.col("rank") < k)
        best = best.select(F.col("i0").alias("query"), "rank", F.col("i1").alias("neighbour"), F.col("v").alias("distance"))
        if blocks <= 1:
            return best
        found.append(written(best, "nearest"))
    return functools.reduce(DataFrame.union, found)


def k_means(a: SparseTensor, k: int, max_iter: int | None = 100) -> SparseTensor:
    """Lloyd's rounds from the first k rows, ``None``: until no row moves; ties go to the lowest cluster, an empty cluster keeps its place. The centres are one broadcast row."""
    spark, t, kept = a.spark, a.shape[1], Rounds()
    rows = cut(a.dense().df.groupBy("i0").agg(F.transform(F.array_sort(F.collect_list(F.struct("i1", F.col("v").cast("double").alias("v")))), lambda s: s["v"]).alias("p")))
    first = rows.where(F.col("i0") < k).orderBy("i0").collect()
    centres = np.array([r["p"] for r in first])
    labels = rows.select("i0", "p", F.lit(0).cast("long").alias("v"))
    for _ in itertools.count() if max_iter is None else range(max_iter):
        made = F.broadcast(spark.createDataFrame([(centres.tolist(),)], "centres array<array<double>>"))
        gaps = F.transform("centres", lambda c, j: F.struct(F.aggregate(F.zip_with("p", c, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x).alias("d"), j.cast("long").alias("j")))
        new = kept.cut(labels.crossJoin(made).select("i0", "p", F.col("v").alias("old"), F.array_min(gaps)["j"].alias("v")))
        moved = new.where("v <> old").isEmpty()
        means = new.select("v", F.posexplode("p").alias("d", "x")).groupBy("v", "d").agg(F.avg("x").alias("x")).toPandas()
        centres = centres.copy()
        centres[means["v"], means["d"]] = means["x"]
        labels = new.select("i0", "p", "v")
        if moved:
            break
    assert centres.shape == (k, t)
    return SparseTensor(labels.select("i0", "v"), (a.shape[0],), 0)


def projected_k_means(a: SparseTensor, k: int, eps: float, c: float = 1, max_iter: int = 100, seed: int = 0) -> SparseTensor:
    """k-means after projection to int(c * ceil(k / eps^2)) dimensions by random signs."""
    if not (c > 0 and 0 < eps < 1 / 3 and k > 0):
        raise ValueError("c and k must be positive and eps within (0, 1/3)")
    t = int(c * math.ceil(k / eps**2))
    return k_means(linear.matmul(a, signs(a.spark, a.shape[1], t, seed)), k, max_iter)


