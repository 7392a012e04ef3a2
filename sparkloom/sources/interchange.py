"""The interchange format: dictionaries of arrays, dense or coordinate."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from ..tensor import SparseTensor, from_coo, from_numpy


class Interchange:
    """``data`` has format ("dense" or "COO"), shape and values, and for COO indices_0, indices_1, ..."""

    def __init__(self, data: dict):
        self.data = data

    @classmethod
    def from_numpy(cls, array) -> Interchange:
        a = np.asarray(array)
        return cls({"format": "dense", "shape": a.shape, "values": a.reshape(-1)})

    @classmethod
    def from_coo(cls, indices, values, shape) -> Interchange:
        return cls({"format": "COO", **{f"indices_{k}": np.asarray(i) for k, i in enumerate(indices)}, "values": np.asarray(values), "shape": tuple(shape)})

    @property
    def indices(self) -> list[np.ndarray]:
        out = []
        while f"indices_{len(out)}" in self.data:
            out.append(self.data[f"indices_{len(out)}"])
        return out

    def to_coo(self) -> Interchange:
        """Coordinates of the cells that are not zero."""
        kind = self.data["format"]
        if kind == "COO":
            return self
        if kind != "dense":
            raise ValueError(f"unknown format {kind}")
        a = np.asarray(self.data["values"]).reshape(self.data["shape"])
        at = np.nonzero(a)
        return Interchange.from_coo(at, a[at], a.shape)

    def __eq__(self, other) -> bool:
        if not isinstance(other, Interchange) or self.data.keys() != other.data.keys():
            return False
        same = lambda a, b: np.array_equal(a, b) if isinstance(a, np.ndarray) or isinstance(b, np.ndarray) else a == b
        return all(same(v, other.data[k]) for k, v in self.data.items())

    __hash__ = None


def ingest(spark: SparkSession, x: Interchange, fill=0, dup: str = "sum") -> SparseTensor:
    if x.data["format"] == "dense":
        return from_numpy(spark, np.asarray(x.data["values"]).reshape(x.data["shape"]), fill)
    if x.data["format"] != "COO":
        raise ValueError(f"unknown format {x.data['format']}")
    return from_coo(spark, x.indices, x.data["values"], x.data["shape"], fill, dup)


def export(t: SparseTensor) -> Interchange:
    """On the driver; for results known to be small."""
    rows = t.df.orderBy(*t.dims).toPandas()
    return Interchange.from_coo([rows[d].to_numpy() for d in t.dims], rows["v"].to_numpy(), t.shape)


def read_parquet(spark: SparkSession, path: str, indices: list[str], value: str, shape, fill=0, dup: str = "sum") -> SparseTensor:
    """A tensor from columns of a Parquet table; only those columns are read."""
    from ..tensor import tensor

    return tensor(spark.read.parquet(path).select(*indices, value), shape, fill, dup)


def write_parquet(t: SparseTensor, path: str, mode: str = "errorifexists") -> DataFrame:
    t.df.write.mode(mode).parquet(path)
    return t.df
