"""Sparse tensors: a coordinate DataFrame with shape and fill value."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions.scalars import WIDE, literal

KINDS = {"boolean": "bool", "tinyint": "int", "smallint": "int", "int": "int", "bigint": "int", "float": "float", "double": "float", WIDE: "wide"}


def index_names(rank: int) -> list[str]:
    return [f"i{k}" for k in range(rank)]


@dataclass(frozen=True)
class SparseTensor:
    """Rows (i0, ..., v) for stored cells; every other cell inside ``shape`` holds ``fill``."""

    df: DataFrame
    shape: tuple[int, ...]
    fill: object = 0

    @property
    def rank(self) -> int:
        return len(self.shape)

    @property
    def dims(self) -> list[str]:
        return index_names(self.rank)

    @property
    def kind(self) -> str:
        return KINDS[self.df.schema["v"].dataType.simpleString()]

    @property
    def size(self) -> int:
        return math.prod(self.shape)

    @property
    def spark(self) -> SparkSession:
        return self.df.sparkSession

    def with_fill_value(self, fill) -> SparseTensor:
        """Another value for the cells that are not stored; stored cells stay."""
        return replace(self, fill=fill)

    def with_df(self, df: DataFrame) -> SparseTensor:
        return replace(self, df=df.select(*self.dims, "v"))

    def dense(self) -> SparseTensor:
        """All cells stored."""
        from .plans.grid import grid

        cells = grid(self.spark, dict(zip(self.dims, self.shape, strict=True)))
        joined = cells.join(self.df, self.dims, "left") if self.rank else self.df
        return self.with_df(joined.withColumn("v", F.coalesce("v", literal(self.fill).cast(self.df.schema["v"].dataType))))

    def pruned(self) -> SparseTensor:
        """Without stored cells that equal the fill value (NaN is kept)."""
        return self.with_df(self.df.where(F.col("v") != literal(self.fill)))

    def to_numpy(self) -> np.ndarray:
        """A dense array on the driver; for results known to be small."""
        dtype = {"bool": bool, "int": np.int64, "wide": object, "float": float}[self.kind]
        out = np.full(self.shape, self.fill, dtype if not (dtype is np.int64 and isinstance(self.fill, float)) else float)
        rows = self.df.toPandas()
        if self.kind == "wide":
            rows["v"] = rows["v"].map(int)
        if self.rank == 0:
            return np.array(rows["v"].iloc[0] if len(rows) else self.fill)
        out[tuple(rows[d].to_numpy() for d in self.dims)] = rows["v"].to_numpy()
        return out

    # --- operators, by the einsum tables; equality of whole tensors is ``equal`` ---

    def _with(self, name: str, other, reflected: bool = False) -> SparseTensor:
        from .operators.linear import elementwise

        return elementwise(name, other, self) if reflected else elementwise(name, self, other)

    def _alone(self, name: str) -> SparseTensor:
        from .operators.linear import elementwise

        return elementwise(name, self)

    def __matmul__(self, other: SparseTensor) -> SparseTensor:
        from .operators.linear import matmul

        return matmul(self, other)

    @property
    def T(self) -> SparseTensor:  # noqa: N802
        from .operators.linear import transpose

        return transpose(self)

    def item(self):
        """The value of a rank-0 tensor."""
        r = self.df.first()
        return self.fill if r is None else r["v"]


def _install() -> None:
    """Python's operators on tensors of one shape and scalars, with their reflected forms."""
    pairs = {"add": "+", "sub": "-", "mul": "*", "truediv": "/", "floordiv": "//", "mod": "%", "pow": "**", "and": "&", "or": "|", "xor": "^", "lshift": "<<", "rshift": ">>"}
    for method, name in pairs.items():
        setattr(SparseTensor, f"__{method}__", lambda self, other, name=name: self._with(name, other))
        setattr(SparseTensor, f"__r{method}__", lambda self, other, name=name: self._with(name, other, True))
    for method, name in {"lt": "<", "le": "<=", "gt": ">", "ge": ">="}.items():
        setattr(SparseTensor, f"__{method}__", lambda self, other, name=name: self._with(name, other))
    for method, name in {"neg": "-", "pos": "+", "abs": "abs", "invert": "~"}.items():
        setattr(SparseTensor, f"__{method}__", lambda self, name=name: self._alone(name))


_install()


def tensor(df: DataFrame, shape, fill=0, dup: str = "sum") -> SparseTensor:
    """From rows of index columns and a value column, in that order.

    dup: what to do with equal coordinates: "sum" them, "error", or "trust" that there are none.
    """
    shape = tuple(int(n) for n in shape)
    names = index_names(len(shape))
    own = df.toDF(*names, "v").select(*[F.col(n).cast("bigint").alias(n) for n in names], "v")
    if dup == "sum" and names:
        kind = KINDS[own.schema["v"].dataType.simpleString()]
        total = F.bool_or("v") if kind == "bool" else F.sum("v")
        own = own.groupBy(*names).agg(total.alias("v"))
    elif dup == "error" and names and own.groupBy(*names).count().where("count > 1").take(1):
        raise ValueError("equal coordinates")
    return SparseTensor(own, shape, fill)


def cells_of(spark: SparkSession, indices, values, schema: T.StructType) -> DataFrame:
    """Parallel arrays as rows, sent in columns."""
    wide = {T.BooleanType(): pa.bool_(), T.LongType(): pa.int64(), T.DoubleType(): pa.float64()}
    columns = [pa.array(np.asarray(c), wide[f.dataType]) for c, f in zip([*(np.asarray(i, np.int64) for i in indices), values], schema, strict=True)]
    return spark.createDataFrame(pa.Table.from_arrays(columns, schema.names), schema)


def from_numpy(spark: SparkSession, array, fill=0, keep_all: bool = False) -> SparseTensor:
    """From an array on the driver; cells equal to the fill value are left out unless ``keep_all``."""
    a = np.asarray(array)
    kind = {"b": (bool, T.BooleanType()), "i": (int, T.LongType()), "u": (int, T.LongType()), "f": (float, T.DoubleType())}[a.dtype.kind]
    schema = T.StructType([*(T.StructField(n, T.LongType(), False) for n in index_names(a.ndim)), T.StructField("v", kind[1], False)])
    if a.ndim == 0:
        return SparseTensor(spark.createDataFrame([(kind[0](a[()]),)], schema), (), fill)
    keep = np.ones(a.shape, bool) if keep_all else ~(a == fill)
    at = np.nonzero(keep)
    return SparseTensor(cells_of(spark, at, a[at], schema), a.shape, kind[0](fill) if kind[0] is not int or float(fill).is_integer() else fill)


def from_coo(spark: SparkSession, indices, values, shape, fill=0, dup: str = "sum") -> SparseTensor:
    """From parallel index arrays and values; dup="last" keeps the last of equal coordinates."""
    values = np.asarray(values)
    if dup == "last":
        held = {tuple(int(i) for i in c): v for *c, v in zip(*indices, values, strict=True)}
        indices, values, dup = [list(x) for x in zip(*held, strict=True)] or [[] for _ in shape], np.array(list(held.values()), values.dtype), "trust"
    kind = {"b": (bool, T.BooleanType()), "i": (int, T.LongType()), "u": (int, T.LongType()), "f": (float, T.DoubleType())}[values.dtype.kind]
    names = index_names(len(shape))
    schema = T.StructType([*(T.StructField(n, T.LongType(), False) for n in names), T.StructField("v", kind[1], False)])
    return tensor(cells_of(spark, indices, values, schema), shape, fill, dup)


def equal(a: SparseTensor, b: SparseTensor) -> bool:
    """Same shape and the same value in every cell, in whatever order and whichever cells are stored."""
    if a.shape != b.shape or (a.fill != b.fill and not (a.fill != a.fill and b.fill != b.fill)):
        return False
    x, y = a.pruned().df, b.pruned().df
    wide = "double" if "float" in (a.kind, b.kind) else WIDE if "wide" in (a.kind, b.kind) else "bigint"
    x, y = (d.withColumn("v", F.col("v").cast(wide)) for d in (x, y))
    return not x.exceptAll(y).take(1) and not y.exceptAll(x).take(1)
