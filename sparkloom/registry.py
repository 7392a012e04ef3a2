"""The registered queries and their SQL, by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tensor import SparseTensor

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its name, with the SQL that says the same if there is any."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rows(t: SparseTensor, digits: int | None = None) -> DataFrame:
    """Cells that are stored, rounded where floats are compared."""
    v = F.col("v") if digits is None else F.round(F.col("v").cast("double"), digits)
    return t.df.select(*t.dims, v.alias("v"))
