"""Matrix catalogs: JSON lists of {matrix_name, matrix_group, "<solver> convergence criteria", n, nnz}."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", "true").json(path)


def metric(catalog: DataFrame) -> str:
    return next(c for c in catalog.columns if c.endswith("convergence criteria"))


def append(catalog: DataFrame, entries: DataFrame) -> DataFrame:
    """Entries whose matrix is not listed yet are added; sorted by the metric, infinite and NaN values as the largest number."""
    both = catalog.unionByName(entries.join(catalog.select("matrix_name"), "matrix_name", "left_anti").dropDuplicates(["matrix_name"]), allowMissingColumns=True)
    name = f"`{metric(both)}`"
    value = F.col(name).cast("double")
    bounded = F.when(F.isnan(value) | (value == float("inf")), F.lit(1.7976931348623157e308)).otherwise(value)
    return both.withColumn(metric(both), bounded).orderBy(F.col(name), "matrix_name")


def write_catalog(catalog: DataFrame, path: str) -> None:
    catalog.write.mode("overwrite").json(path)


def listed(catalog: DataFrame, name: str) -> bool:
    return bool(catalog.where(F.col("matrix_name") == name).take(1))
