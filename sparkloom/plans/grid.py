"""Index grids from ``spark.range``: one range over the product, decomposed by div and mod."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def grid(spark: SparkSession, extents: dict[str, int]) -> DataFrame:
    """All index combinations; an empty dict gives one row without columns of use."""
    total = math.prod(extents.values())
    df, left = spark.range(total).withColumnRenamed("id", "__cell"), total
    for name, n in extents.items():
        left //= max(n, 1)
        df = df.withColumn(name, F.expr(f"pmod(__cell div {max(left, 1)}, {max(n, 1)})"))
    return df.select(*extents) if extents else df
