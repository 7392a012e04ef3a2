"""Scratch storage, batch sizing and small Spark helpers shared by the operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import uuid
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import fresh as scratch
from ..storage import written

__all__ = ["scratch", "written"]

#: Rows and bytes of one Arrow batch, the same for all operators, since the session has one setting: long texts don't pile up in a worker.
BATCH_ROWS, BATCH_BYTES = 1500, "8m"
#: A table of at most so many rows (ids, keys, counts: some tens of bytes each) is broadcast; larger ones are joined.
BROADCAST_ROWS = 100_000


def small(table: DataFrame, width: int = 1) -> DataFrame:
    """A written table, to be broadcast if it has at most BROADCAST_ROWS short rows (counted); ``width``: how many short rows one is worth."""
    return F.broadcast(table) if table.count() * width <= BROADCAST_ROWS else table


ARROW = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string()}


def local(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    """A table of the driver's rows, with the types of ARROW. A list given to createDataFrame runs through Python workers of another
    kind on the executors, which stay there with a daemon of their own beside those of the operators; Arrow needs none."""
    kinds = [c.split() for c in schema.split(", ")]
    columns = [pa.array([r[k] for r in rows], ARROW[kind]) for k, (_, kind) in enumerate(kinds)]
    return spark.createDataFrame(pa.Table.from_arrays(columns, [name for name, _ in kinds]), schema)


def small_batches(spark: SparkSession) -> None:
    """Bound the rows and bytes that one Arrow batch carries, by the same numbers whichever operator runs."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def runs(batches, keys: list[str]) -> Iterator[pa.Table]:
    """Tables of neighbouring rows with equal keys (integers or text, none null), across batches; a run must fit in memory."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not len(batch):
            continue
        change = np.zeros(len(batch) - 1, bool)
        for k in keys:
            c = batch.column(k)
            change |= pc.not_equal(c.slice(1), c.slice(0, len(c) - 1)).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(change) + 1).tolist(), len(batch)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            part = batch.slice(a, b - a)
            if held and any(held[0].column(k)[0] != part.column(k)[0] for k in keys):
                yield pa.Table.from_batches(held)
                held = []
            held.append(part)
    if held:
        yield pa.Table.from_batches(held)


#: What a Python worker keeps between tasks: the cache of one operator at a time, so that those of a pipeline's stages don't add up.
_held: dict[str, object] = {}


def held(name: str, make):
    """The worker's cache of this name; those of other names are given up, and their memory goes back to the system."""
    if name not in _held:
        _held.clear()
        trim()
        _held[name] = make()
    return _held[name]


def trim() -> None:
    """Give freed memory back: a worker lives on after its task, and the next operator's memory comes on top of what it keeps."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def release(spark: SparkSession) -> None:
    """The same for executors: a collection in each of them, by a task for every core, after which the heap they don't use goes back.

    Without it their heap only grows, up to its limit, and the workers' memory comes on top.
    """
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.java_method(F.lit("java.lang.System"), F.lit("gc"))).collect()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null is the empty text."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def chunks(items: list, limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Index ranges of consecutive texts with about ``limit`` bytes or characters; a longer text stands alone."""
    start, held = 0, 0
    for i, x in enumerate(items):
        if held and held + len(x) > limit:
            yield start, i
            start, held = i, 0
        held += len(x) + 1
    if start < len(items):
        yield start, len(items)


# --- files in the shared folder -------------------------------------------------


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def is_local(path: str) -> bool:
    return urlparse(path).scheme in ("", "file")


def local_name(path: str) -> str:
    return urlparse(path).path if path.startswith("file:") else path


class SharedWriter:
    """A file that appears under its name only when complete, so a repeated task cannot leave half of one."""

    def __init__(self, path: str):
        self.path = path
        if is_local(path):
            self.name = local_name(path)
            os.makedirs(os.path.dirname(self.name), exist_ok=True)
            self.temporary = f"{self.name}.{uuid.uuid4().hex}.tmp"
            self.file = open(self.temporary, "wb")
        else:
            self.fs, self.name = _filesystem(path)
            self.temporary = f"{self.name}.{uuid.uuid4().hex}.tmp"
            self.fs.create_dir(os.path.dirname(self.name), recursive=True)
            self.file = self.fs.open_output_stream(self.temporary)
        self.position = 0

    def write(self, data: bytes) -> int:
        self.file.write(data)
        self.position += len(data)
        return len(data)

    def tell(self) -> int:
        return self.position

    def flush(self) -> None:
        self.file.flush()

    def commit(self) -> None:
        self.file.close()
        if is_local(self.path):
            os.replace(self.temporary, self.name)
        else:
            self.fs.move(self.temporary, self.name)


class SharedReader:
    """Range reads of a shared file."""

    def __init__(self, path: str):
        if is_local(path):
            self.file = open(local_name(path), "rb")
            self.size = os.fstat(self.file.fileno()).st_size
        else:
            filesystem, name = _filesystem(path)
            self.file = filesystem.open_input_file(name)
            self.size = self.file.size()

    def read(self, start: int, length: int) -> bytes:
        self.file.seek(start)
        return self.file.read(length)

    def close(self) -> None:
        self.file.close()

    def __enter__(self) -> SharedReader:
        return self

    def __exit__(self, *_) -> None:
        self.close()


def ascii_lower(column):
    """Lower-case A-Z only, as a Column."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fresh(df: DataFrame, prefix: str = "own") -> str:
    """A beginning for column names that no column of the table has, in any case of letters."""
    names = [c.lower() for c in df.columns]
    while any(n.startswith(prefix) for n in names):
        prefix += "_"
    return prefix
