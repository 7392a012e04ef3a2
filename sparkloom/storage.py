"""Session set-up, and files in the shared folder: lineage cuts of loops and tables that grow by appending."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(master: str = "local[*]", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for one machine; on a cluster use the one you have, AQE on."""
    return (
        SparkSession.builder.master(master)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session, or the checkpoint folder in use.

    Where neither is set, a session on one machine (tests) gets a temporary folder. On a cluster that is an error,
    since executors would not see the driver's folder.
    """
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not base:
        if not re.match(r"local(\[|$)", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="sparkloom-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(base)
    return base.rstrip("/")


def fresh(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used."""
    return f"{folder(spark)}/{name}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def cut(df: DataFrame) -> DataFrame:
    """Materialise reliably: later rounds start from files that every executor can read."""
    folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, name: str) -> DataFrame:
    path = fresh(df.sparkSession, name)
    schema = df.schema
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


class Rounds:
    """Lineage cuts of a loop. The last ``keep`` stay, older ones are deleted, so a loop's disk does not grow with its rounds."""

    def __init__(self, keep: int = 2):
        self.keep, self.paths = keep, []

    def cut(self, df: DataFrame) -> DataFrame:
        spark = df.sparkSession
        path, schema = fresh(spark, "round"), df.schema
        df.write.parquet(path)
        self.paths.append(path)
        while len(self.paths) > self.keep:
            delete(spark, self.paths.pop(0))
        return spark.read.schema(schema).parquet(path)


class Appended:
    """A table that rounds append to: every row is written once, however many rounds follow."""

    def __init__(self, first: DataFrame, name: str):
        self.spark, self.path, self.schema = first.sparkSession, fresh(first.sparkSession, name), first.schema
        self.append(first)

    def append(self, df: DataFrame) -> DataFrame:
        """Adds rows of the table's columns; what was added alone comes back."""
        part = f"{self.path}/rows-{uuid.uuid4().hex}"
        df.select(*self.schema.names).write.parquet(part)
        return self.spark.read.schema(self.schema).parquet(part)

    def read(self) -> DataFrame:
        return self.spark.read.schema(self.schema).option("recursiveFileLookup", "true").parquet(self.path)
