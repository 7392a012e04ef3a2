"""Array primitives on sparse tensors: products, reductions, elementwise, indexing, sorting."""

from __future__ import annotations

import math
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..plans.einsum import BROADCAST_CELLS, REDUCTIONS, Lowering, einsum
from ..plans.grid import grid
from ..plans.parse import Access, Call, Literal, Program
from ..storage import cut
from ..tensor import SparseTensor, index_names

LETTERS = [f"x{k}" for k in range(16)]


def _run(expression, out, reduction=None, **tensors) -> SparseTensor:
    return Lowering(Program("out", tuple(out), reduction, expression), tensors).run()


# --- products -------------------------------------------------------------------


def matmul(a: SparseTensor, b: SparseTensor) -> SparseTensor:
    """``a @ b`` for matrices and vectors; the last two dimensions with equal batch dimensions before them."""
    if a.rank == 1 and b.rank == 1:
        return einsum("S[] += A[i] * B[i]", A=a, B=b)
    if b.rank == 1:
        return einsum("C[i] += A[i,k] * B[k]", A=a, B=b)
    if a.rank == 1:
        return einsum("C[j] += A[k] * B[k,j]", A=a, B=b)
    batch = LETTERS[: a.rank - 2]
    x, y = Access("A", (*batch, "i", "k")), Access("B", (*batch, "k", "j"))
    return _run(Call("*", (x, y)), (*batch, "i", "j"), "+", A=a, B=b)


def block_matmul(a: SparseTensor, b: SparseTensor, side: int = 512) -> SparseTensor:
    """``a @ b`` for matrices whose cells are mostly stored: cells are packed into square blocks and NumPy multiplies blocks.

    A task holds two blocks and the sum it works on, whatever the extents; the fill of both must be 0.
    """
    if a.fill or b.fill or a.shape[1] != b.shape[0]:
        raise ValueError("block_matmul needs fills of 0 and matching extents")
    x = packed(a, side).toDF("bi", "bk", "x")
    y = packed(b, side).toDF("bk", "bj", "y")
    pairs = x.join(y, "bk").repartition("bi", "bj").sortWithinPartitions("bi", "bj")
    df = pairs.select("bi", "bj", "x", "y").mapInArrow(partial(_multiply, side=side), "i0 long, i1 long, v double")
    return SparseTensor(df, (a.shape[0], b.shape[1]), 0.0)


def packed(t: SparseTensor, side: int) -> DataFrame:
    """(row block, column block, side x side doubles) of the stored cells."""
    cells = t.df.select(F.floor(F.col("i0") / side).alias("p"), F.floor(F.col("i1") / side).alias("q"), F.pmod("i0", F.lit(side)).alias("r"), F.pmod("i1", F.lit(side)).alias("c"), F.col("v").cast("double").alias("v"))

    def pack(key, rows: pd.DataFrame) -> pd.DataFrame:
        block = np.zeros((side, side))
        np.add.at(block, (rows["r"].to_numpy(), rows["c"].to_numpy()), rows["v"].to_numpy())
        return pd.DataFrame({"p": [key[0]], "q": [key[1]], "block": [block.tobytes()]})

    return cells.groupBy("p", "q").applyInPandas(pack, "p long, q long, block binary")


def _multiply(batches, side: int):
    """Products of block pairs in order of their place, summed while the place stays the same."""
    at, held = None, None

    def cells():
        i, j = np.nonzero(held)
        for k in range(0, len(i), 1 << 16):
            p, q = i[k : k + (1 << 16)], j[k : k + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(p + at[0] * side), pa.array(q + at[1] * side), pa.array(held[p, q])], ["i0", "i1", "v"])

    for batch in batches:
        for bi, bj, x, y in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if at != (bi, bj):
                if at is not None:
                    yield from cells()
                at, held = (bi, bj), np.zeros((side, side))
            held += np.frombuffer(x).reshape(side, side) @ np.frombuffer(y).reshape(side, side)
    if at is not None:
        yield from cells()


def vecdot(a: SparseTensor, b: SparseTensor) -> float:
    return einsum("S[] += A[i] * B[i]", A=a, B=b).item()


def norm(a: SparseTensor) -> float:
    """Euclidean (Frobenius) norm."""
    total = a.df.agg(F.sum(F.col("v").cast("double") ** 2)).first()[0] or 0.0
    if a.fill != 0:
        total += float(a.fill) ** 2 * (a.size - a.df.count())
    return math.sqrt(total)


def outer(a: SparseTensor, b: SparseTensor) -> SparseTensor:
    return einsum("C[i,j] = A[i] * B[j]", A=a, B=b)


def spmv(rows: DataFrame, x: DataFrame, n: int, transposed: bool = False) -> DataFrame:
    """(i, y) from matrix rows (i0, i1, v) and a vector (i, x) of n entries: broadcast while n is small, joined beyond."""
    out, inner = ("i1", "i0") if transposed else ("i0", "i1")
    side = x.select(F.col("i").alias(inner), F.col("x"))
    side = F.broadcast(side) if n <= BROADCAST_CELLS else side
    return rows.join(side, inner).groupBy(F.col(out).alias("i")).agg(F.sum(F.col("v") * F.col("x")).alias("y"))


def prepared(rows: DataFrame, n: int, transposed: bool = False) -> DataFrame:
    """Matrix rows (i0, i1, v) for many products with vectors of n entries.

    Beyond the size at which vectors are broadcast, the matrix is dealt by its inner index once and kept on the
    executors' disks, so a product shuffles vectors and partial sums, never the matrix. What a lost executor held
    is dealt again from the files.
    """
    rows = cut(rows)
    if n <= BROADCAST_CELLS:
        return rows
    many = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(many, "i0" if transposed else "i1").persist(StorageLevel.DISK_ONLY)


# --- elementwise ----------------------------------------------------------------


def elementwise(name: str, *operands) -> SparseTensor:
    """Any function of the einsum tables on tensors of one shape and Python scalars."""
    tensors = {f"t{k}": o for k, o in enumerate(operands) if isinstance(o, SparseTensor)}
    idx = tuple(LETTERS[: next(iter(tensors.values())).rank])
    args = tuple(Access(f"t{k}", idx) if isinstance(o, SparseTensor) else Literal(o) for k, o in enumerate(operands))
    return _run(Call(name, args), idx, **tensors)


def where(condition: SparseTensor, a, b) -> SparseTensor:
    """Cells of a where the condition holds, else of b (tensors of the same shape, or scalars)."""
    dims, df, fills = condition.dims, condition.df.withColumnRenamed("v", "__c"), []
    out = df
    for name, o in (("__a", a), ("__b", b)):
        if isinstance(o, SparseTensor):
            out = out.join(o.df.withColumnRenamed("v", name), dims, "full")
            fills.append(o.fill)
        else:
            out = out.withColumn(name, F.lit(o))
            fills.append(o)
    # rows that only one side stores still need the scalar
    chosen = F.when(F.coalesce("__c", F.lit(bool(condition.fill))), F.coalesce("__a", F.lit(fills[0]))).otherwise(F.coalesce("__b", F.lit(fills[1])))
    return SparseTensor(out.select(*dims, chosen.alias("v")), condition.shape, fills[0] if condition.fill else fills[1])


def astype(a: SparseTensor, kind: str) -> SparseTensor:
    name = {"bool": "boolean", "int": "bigint", "float": "double", "float32": "float"}[kind]
    value = S.truth(a.kind, F.col("v")) if kind == "bool" else F.col("v").cast(name)
    return SparseTensor(a.df.select(*a.dims, value.alias("v")), a.shape, {"bool": bool, "int": int}.get(kind, float)(a.fill))


# --- reductions -----------------------------------------------------------------


def reduce(a: SparseTensor, reduction: str, axis: int | tuple[int, ...] | None = None) -> SparseTensor:
    """Reduce over some axes (all by default); names as in the einsum tables."""
    if reduction not in REDUCTIONS:
        raise KeyError(reduction)
    axes = tuple(range(a.rank)) if axis is None else (axis,) if isinstance(axis, int) else tuple(axis)
    axes = tuple(x % a.rank for x in axes)
    idx = tuple(LETTERS[: a.rank])
    return _run(Access("A", idx), [i for k, i in enumerate(idx) if k not in axes], reduction, A=a)


def allclose(a: SparseTensor, b: SparseTensor, rtol: float = 1e-5, atol: float = 1e-8) -> bool:
    """Whether |a - b| <= atol + rtol |b| in every cell."""
    both = a.df.withColumnRenamed("v", "p").join(b.df.withColumnRenamed("v", "q"), a.dims, "full")
    p, q = F.coalesce("p", F.lit(a.fill)).cast("double"), F.coalesce("q", F.lit(b.fill)).cast("double")
    return not both.where(~((F.abs(p - q) <= atol + rtol * F.abs(q)) | (p == q))).take(1)


# --- indexing -------------------------------------------------------------------


def permute_dims(a: SparseTensor, axes: tuple[int, ...]) -> SparseTensor:
    names = index_names(a.rank)
    return SparseTensor(a.df.select(*[F.col(names[x]).alias(f"i{k}") for k, x in enumerate(axes)], "v"), tuple(a.shape[x] for x in axes), a.fill)


def transpose(a: SparseTensor) -> SparseTensor:
    return permute_dims(a, tuple(reversed(range(a.rank))))


def expand_dims(a: SparseTensor, axis: int) -> SparseTensor:
    axis %= a.rank + 1
    cols = [F.col(d) for d in a.dims]
    cols.insert(axis, F.lit(0).cast("bigint"))
    shape = (*a.shape[:axis], 1, *a.shape[axis:])
    return SparseTensor(a.df.select(*[c.alias(f"i{k}") for k, c in enumerate(cols)], "v"), shape, a.fill)


def reshape(a: SparseTensor, shape: tuple[int, ...]) -> SparseTensor:
    """Row-major; one extent may be -1."""
    shape = list(shape)
    if -1 in shape:
        shape[shape.index(-1)] = a.size // -math.prod(shape)
    if math.prod(shape) != a.size:
        raise ValueError(f"{a.shape} does not reshape to {tuple(shape)}")
    flat = F.lit(0).cast("bigint")
    for d, n in zip(a.dims, a.shape, strict=True):
        flat = flat * n + F.col(d)
    df, left, cols = a.df.withColumn("__flat", flat), a.size, []
    for n in shape:
        left //= max(n, 1)
        cols.append(F.expr(f"pmod(__flat div {max(left, 1)}, {max(n, 1)})"))
    return SparseTensor(df.select(*[c.alias(f"i{k}") for k, c in enumerate(cols)], "v"), tuple(shape), a.fill)


def slice_axis(a: SparseTensor, axis: int, start: int, stop: int) -> SparseTensor:
    """Indices start..stop-1 of an axis, counted from 0 again."""
    d, start, stop = f"i{axis}", max(start, 0), min(stop, a.shape[axis])
    df = a.df.where((F.col(d) >= start) & (F.col(d) < stop)).withColumn(d, F.col(d) - start)
    return SparseTensor(df, (*a.shape[:axis], max(stop - start, 0), *a.shape[axis + 1 :]), a.fill)


def pick(a: SparseTensor, axis: int, at: int) -> SparseTensor:
    """One index of an axis; the axis goes."""
    rest = [k for k in range(a.rank) if k != axis]
    df = a.df.where(F.col(f"i{axis}") == at).select(*[F.col(f"i{k}").alias(f"i{j}") for j, k in enumerate(rest)], "v")
    return SparseTensor(df, tuple(a.shape[k] for k in rest), a.fill)


def assign(a: SparseTensor, cells: SparseTensor) -> SparseTensor:
    """The stored cells of another tensor of this shape override those of ``a``."""
    return a.with_df(a.df.join(cells.df.select(*a.dims), a.dims, "left_anti").unionByName(cells.df))


def take(a: SparseTensor, at: SparseTensor, axis: int = 0) -> SparseTensor:
    """Gather along an axis by an index vector: ``take(f, f)`` is a pointer jump."""
    d = f"i{axis}"
    wanted = at.dense().df.select(F.col("i0").alias("__to"), F.col("v").alias(d)) if at.fill is not None else at.df
    df = a.df.join(wanted, d).withColumn(d, F.col("__to"))
    return SparseTensor(df.select(*a.dims, "v"), (*a.shape[:axis], at.shape[0], *a.shape[axis + 1 :]), a.fill)


def diagonal(a: SparseTensor) -> SparseTensor:
    return SparseTensor(a.df.where("i0 = i1").select("i0", "v"), (min(a.shape),), a.fill)


def roll(a: SparseTensor, shift: int, axis: int = 0) -> SparseTensor:
    d = f"i{axis}"
    return a.with_df(a.df.withColumn(d, F.pmod(F.col(d) + shift, F.lit(a.shape[axis]))))


# --- sorting --------------------------------------------------------------------


def ranked(a: SparseTensor, axis: int = -1, k: int | None = None, salt: int = 64) -> DataFrame:
    """Rows with their place (``rank`` from 0) along an axis by value, ties by index.

    With k, buckets of an axis give their own first k before the final ranking, so a long
    axis is not sorted in one task.
    """
    axis %= a.rank
    d, rest = f"i{axis}", [x for x in a.dims if x != f"i{axis}"]
    df = a.dense().df
    if k is not None:
        inner = Window.partitionBy(*rest, F.pmod(F.xxhash64(d), F.lit(salt))).orderBy("v", d)
        df = df.withColumn("__r", F.row_number().over(inner)).where(F.col("__r") <= k).drop("__r")
    df = df.withColumn("rank", F.row_number().over(Window.partitionBy(*rest).orderBy("v", d)) - 1)
    return df.where(F.col("rank") < k) if k is not None else df


def argsort(a: SparseTensor, axis: int = -1, k: int | None = None) -> SparseTensor:
    axis %= a.rank
    df = ranked(a, axis, k).withColumn("v", F.col(f"i{axis}")).withColumn(f"i{axis}", F.col("rank").cast("bigint"))
    return SparseTensor(df.select(*a.dims, "v"), (*a.shape[:axis], k or a.shape[axis], *a.shape[axis + 1 :]), 0)


def sort(a: SparseTensor, axis: int = -1, k: int | None = None) -> SparseTensor:
    axis %= a.rank
    df = ranked(a, axis, k).withColumn(f"i{axis}", F.col("rank").cast("bigint"))
    return SparseTensor(df.select(*a.dims, "v"), (*a.shape[:axis], k or a.shape[axis], *a.shape[axis + 1 :]), a.fill)


# --- constructors ---------------------------------------------------------------


def full(spark: SparkSession, shape, value) -> SparseTensor:
    """Nothing stored: the fill value says it all."""
    kind = {"bool": "boolean", "int": "bigint", "float": "double"}[S.kind_of_value(value)]
    names = index_names(len(shape))
    schema = ", ".join([*(f"{n} bigint" for n in names), f"v {kind}"])
    return SparseTensor(spark.createDataFrame([], schema), tuple(shape), value)


def zeros(spark: SparkSession, shape, kind: str = "float") -> SparseTensor:
    return full(spark, shape, {"bool": False, "int": 0, "float": 0.0}[kind])


def eye(spark: SparkSession, n: int) -> SparseTensor:
    return SparseTensor(spark.range(n).select(F.col("id").alias("i0"), F.col("id").alias("i1"), F.lit(1.0).alias("v")), (n, n), 0.0)


def arange(spark: SparkSession, start: int, stop: int | None = None, step: int = 1) -> SparseTensor:
    start, stop = (0, start) if stop is None else (start, stop)
    n = max(0, -(-(stop - start) // step))
    return SparseTensor(spark.range(n).select(F.col("id").alias("i0"), (F.col("id") * step + start).alias("v")), (n,), 0)


def rand(spark: SparkSession, shape, seed: int = 0) -> SparseTensor:
    """Uniform in [0, 1), a hash of seed and place: the same for any partitioning."""
    names = index_names(len(shape))
    cells = grid(spark, dict(zip(names, shape, strict=True)))
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *names), 11).cast("double")
    return SparseTensor(cells.select(*names, (bits / float(1 << 53)).alias("v")), tuple(shape), 0.0)


def block_diag(blocks: list[SparseTensor]) -> SparseTensor:
    out, rows, cols = None, 0, 0
    for b in blocks:
        moved = b.df.select((F.col("i0") + rows).alias("i0"), (F.col("i1") + cols).alias("i1"), "v")
        out = moved if out is None else out.unionByName(moved)
        rows, cols = rows + b.shape[0], cols + b.shape[1]
    return SparseTensor(out, (rows, cols), blocks[0].fill)


