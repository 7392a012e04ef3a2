"""MatrixMarket text files, read in parallel by Spark's text reader."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tensor import SparseTensor


def read_matrix(spark: SparkSession, path: str) -> SparseTensor:
    """Coordinate or array format; real, integer or pattern fields; general, symmetric, skew-symmetric or hermitian storage."""
    lines = spark.read.text(path)
    banner = next(r[0] for r in lines.limit(1).collect()).lower().split()
    if not banner or banner[0] != "%%matrixmarket":
        raise ValueError(f"{path} is no MatrixMarket file")
    layout, kind, symmetry = banner[2:5]
    if kind == "complex":
        raise TypeError("complex matrices are not supported")
    body = lines.where(~F.col("value").startswith("%") & (F.trim("value") != ""))
    head = body.limit(1).collect()[0][0]
    sizes = [int(x) for x in head.split()]
    cells = F.split(F.trim("value"), r"\s+")
    if layout == "coordinate":
        entries = body.select(cells.alias("c")).where(F.size("c") == (2 if kind == "pattern" else 3))
        # the size line has three fields too; it is the one that repeats the known header text
        entries = entries.where(F.array_join("c", " ") != F.lit(" ".join(head.split()))) if kind != "pattern" else entries
        value = F.lit(1.0) if kind == "pattern" else F.col("c")[2].cast("double")
        df = entries.select((F.col("c")[0].cast("bigint") - 1).alias("i0"), (F.col("c")[1].cast("bigint") - 1).alias("i1"), value.alias("v"))
    else:
        rows, _ = sizes
        numbered = body.rdd.zipWithIndex().map(lambda x: (x[1], x[0][0])).toDF("k long, t string").where("k > 0")
        at = F.col("k") - 1
        df = numbered.select(F.pmod(at, F.lit(rows)).alias("i0"), F.floor(at / rows).alias("i1"), F.trim("t").cast("double").alias("v"))
    if symmetry in ("symmetric", "hermitian", "skew-symmetric"):
        sign = -1.0 if symmetry == "skew-symmetric" else 1.0
        df = df.union(df.where("i0 <> i1").select(F.col("i1").alias("i0"), F.col("i0").alias("i1"), (F.col("v") * sign).alias("v")))
    return SparseTensor(df, (sizes[0], sizes[1]), 0.0).pruned()


def text_lines(t: SparseTensor) -> DataFrame:
    """(k, value): the lines of a coordinate file; k puts the header first."""
    n = t.df.count()
    head = t.spark.createDataFrame([(0, "%%MatrixMarket matrix coordinate real general"), (1, f"{t.shape[0]} {t.shape[1]} {n}")], "k int, value string")
    rows = t.df.select(F.lit(2).alias("k"), F.concat_ws(" ", (F.col("i0") + 1).cast("string"), (F.col("i1") + 1).cast("string"), F.col("v").cast("double").cast("string")).alias("value"))
    return head.coalesce(1).union(rows)


def write_matrix(t: SparseTensor, path: str) -> None:
    """One coordinate file folder; Spark's parts in order make one MatrixMarket file."""
    text_lines(t).select("value").write.text(path)


def companions(spark: SparkSession, folder: str) -> DataFrame:
    """(stem, matrix, rhs): matrices ``X.mtx`` that have a right-hand side ``X_b.mtx`` anywhere below the folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.mtx").load(folder).select("path")
    named = files.select("path", F.regexp_extract("path", r"([^/]+)\.mtx$", 1).alias("name"))
    sides = named.where(F.col("name").endswith("_b")).select(F.regexp_replace("name", "_b$", "").alias("stem"), F.col("path").alias("rhs"))
    return named.withColumnsRenamed({"name": "stem", "path": "matrix"}).join(sides, "stem").select("stem", "matrix", "rhs")


def is_rhs(name: str) -> bool:
    return bool(re.search(r"_b\.mtx$", name))
