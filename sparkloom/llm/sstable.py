"""Token-id shards as sorted string tables.

A shard is one file::

    block*  index  bloom  footer

* block: zstd frame over entries ``varint shared, varint unshared, varint value
  bytes, key tail, value``; a key repeats only what differs from the one before
  it, and a block starts afresh.
* index: per block its first key, place, size and number of entries.
* bloom: bits over all keys, probed by double hashing.
* footer: fixed size, with the places of index and bloom, counts and a checksum.

Keys are document ids as eight big-endian bytes with the sign bit flipped, so
bytes sort as numbers; the null id is the empty key and comes first. Values are
the ids of the document with the end id, little-endian, two bytes wide where all
ids of the entry allow it and four bytes otherwise (the first byte tells).

Nulls: a null text is an empty document (its end id alone). Repeated ids are kept,
ordered by text. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, tokens

MAGIC = b"SLSST001"
FOOTER = struct.Struct("<QQQQQQII8s")
ENTRY = struct.Struct("<QII")
SHARDS = "shard int, path string, n_docs long, n_tokens long, n_bytes long"
ROWS = "doc_id long, start long, n_tokens long, ids_crc32 long"


def key_of(doc_id: int | None) -> bytes:
    return b"" if doc_id is None else struct.pack(">Q", doc_id + (1 << 63))


def id_of(key: bytes) -> int | None:
    return struct.unpack(">Q", key)[0] - (1 << 63) if key else None


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def read_varint(data: bytes, at: int) -> tuple[int, int]:
    out = shift = 0
    while True:
        b = data[at]
        at += 1
        out |= (b & 127) << shift
        if b < 128:
            return out, at
        shift += 7


def pack_ids(ids: np.ndarray) -> bytes:
    narrow = not len(ids) or int(ids.max()) < 1 << 16
    return (b"\x02" if narrow else b"\x04") + ids.astype("<u2" if narrow else "<u4").tobytes()


def unpack_ids(value: bytes) -> np.ndarray:
    return np.frombuffer(value, "<u2" if value[0] == 2 else "<u4", offset=1).astype("<u4")


class Bloom:
    def __init__(self, bits: np.ndarray, probes: int):
        self.bits, self.probes = bits, probes

    @staticmethod
    def hashes(key: bytes) -> tuple[int, int]:
        h = xxhash.xxh3_128_intdigest(key)
        return h & (1 << 64) - 1, h >> 64 | 1

    @classmethod
    def build(cls, keys: list[tuple[int, int]], per_key: int = 10, probes: int = 7) -> Bloom:
        size = max(64, len(keys) * per_key + 7 & ~7)
        bits = np.zeros(size, bool)
        if keys:
            a, b = np.array(keys, np.uint64).T
            for i in range(probes):
                bits[(a + np.uint64(i) * b) % np.uint64(size)] = True
        return cls(bits, probes)

    def __contains__(self, key: bytes) -> bool:
        a, b = self.hashes(key)
        return all(self.bits[((a + i * b) & (1 << 64) - 1) % len(self.bits)] for i in range(self.probes))

    def dump(self) -> bytes:
        return struct.pack("<QI", len(self.bits), self.probes) + np.packbits(self.bits).tobytes()

    @classmethod
    def load(cls, data: bytes) -> Bloom:
        size, probes = struct.unpack_from("<QI", data)
        return cls(np.unpackbits(np.frombuffer(data, np.uint8, offset=12))[:size].astype(bool), probes)


class Writer:
    """Appends entries in ascending key order."""

    def __init__(self, path: str, block_bytes: int = 1 << 16):
        self.file, self.limit = common.SharedWriter(path), block_bytes
        self.block, self.count, self.first, self.last = bytearray(), 0, b"", b""
        self.index, self.keys = [], []
        self.n_docs = self.n_tokens = 0
        self.compress = zstandard.ZstdCompressor(level=1).compress

    def add(self, key: bytes, ids: np.ndarray) -> None:
        if self.count and key < self.last:
            raise ValueError("keys must ascend")
        if self.count:
            shared = 0
            while shared < min(len(key), len(self.last)) and key[shared] == self.last[shared]:
                shared += 1
        else:
            shared, self.first = 0, key
        value = pack_ids(ids)
        self.block += varint(shared) + varint(len(key) - shared) + varint(len(value)) + key[shared:] + value
        self.last, self.count = key, self.count + 1
        self.keys.append(Bloom.hashes(key))
        self.n_docs += 1
        self.n_tokens += len(ids)
        if len(self.block) >= self.limit:
            self.flush()

    def flush(self) -> None:
        if self.count:
            at = self.file.tell()
            n = self.file.write(self.compress(bytes(self.block)))
            self.index.append((self.first, at, n, self.count))
            self.block, self.count = bytearray(), 0

    def close(self) -> None:
        self.flush()
        index = b"".join(varint(len(k)) + k + ENTRY.pack(at, n, c) for k, at, n, c in self.index)
        bloom = Bloom.build(self.keys).dump()
        at = self.file.tell()
        self.file.write(index)
        self.file.write(bloom)
        self.file.write(FOOTER.pack(at, len(index), at + len(index), len(bloom), self.n_docs, self.n_tokens, zlib.crc32(index), zlib.crc32(bloom), MAGIC))
        self.file.commit()


class Table:
    """Reads a shard by ranges: footer, then index and Bloom filter, then single blocks."""

    def __init__(self, path: str):
        self.file = common.SharedReader(path)
        at, n, bloom_at, bloom_n, self.n_docs, self.n_tokens, check, bloom_check, magic = FOOTER.unpack(self.file.read(self.file.size - FOOTER.size, FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"{path}: not a shard")
        data = self.file.read(at, n)
        bloom = self.file.read(bloom_at, bloom_n)
        if zlib.crc32(data) != check or zlib.crc32(bloom) != bloom_check:
            raise ValueError(f"{path}: damaged index")
        self.first, self.blocks, at = [], [], 0
        while at < len(data):
            size, at = read_varint(data, at)
            self.first.append(data[at : at + size])
            self.blocks.append(ENTRY.unpack_from(data, at + size))
            at += size + ENTRY.size
        self.bloom = Bloom.load(bloom)

    def block(self, k: int) -> Iterator[tuple[bytes, np.ndarray]]:
        at, n, count = self.blocks[k]
        data, key, at = zstandard.ZstdDecompressor().decompress(self.file.read(at, n)), b"", 0
        for _ in range(count):
            shared, at = read_varint(data, at)
            tail, at = read_varint(data, at)
            size, at = read_varint(data, at)
            key = key[:shared] + data[at : at + tail]
            yield key, unpack_ids(data[at + tail : at + tail + size])
            at += tail + size

    def get(self, doc_id: int | None) -> np.ndarray | None:
        """Ids of a document (the first of repeated ids), or None."""
        key = key_of(doc_id)
        if key not in self.bloom:
            return None
        k = bisect_right(self.first, key) - 1
        while k > 0 and self.first[k] == key:  # a repeated id may start in the block before
            k -= 1
        for j in range(max(k, 0), len(self.blocks)):
            if self.first[j] > key:
                break
            for own, ids in self.block(j):
                if own == key:
                    return ids
        return None

    def close(self) -> None:
        self.file.close()


def _write(batches, folder: str, tokenizer: str, end_id: int):
    memo, shard, out = tokens.memo(tokenizer), TaskContext.get().partitionId(), None
    path = f"{folder}/shard-{shard:06d}.sst"
    end = np.array([end_id], "<u4")
    for batch in batches:
        docs = batch.column(0).to_pylist()
        raw = [t or "" for t in batch.column(1).to_pylist()]
        if docs and out is None:
            out = Writer(path)
        for a, b in common.chunks(raw, tokens.CHUNK):
            ids, at = memo.ids(raw[a:b])
            for k in range(b - a):
                out.add(key_of(docs[a + k]), np.concatenate([ids[at[k] : at[k + 1]], end]))
    if out is not None:
        out.close()
        yield pa.RecordBatch.from_pylist([{"shard": shard, "path": path, "n_docs": out.n_docs, "n_tokens": out.n_tokens, "n_bytes": out.file.position}], pa.schema([("shard", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("n_bytes", pa.int64())]))


def write_shards(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 1) -> DataFrame:
    """Write all documents in ascending id order; one row per shard, see SHARDS."""
    common.small_batches(docs.sparkSession)
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("content"), F.monotonically_increasing_id().alias("place"))
    # the place only splits rows that repeat id and text among shards; any order of those is the same
    ordered = rows.repartitionByRange("doc_id", "content", "place").sortWithinPartitions("doc_id", "content").select("doc_id", "text")
    return ordered.mapInArrow(partial(_write, folder=folder, tokenizer=tokenizer, end_id=end_id), SHARDS)


def _read(batches):
    for batch in batches:
        for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            shard = Table(path)
            for k in range(len(shard.blocks)):
                rows = []
                for key, ids in shard.block(k):
                    rows.append((id_of(key), base, len(ids), zlib.crc32(ids.tobytes())))
                    base += len(ids)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], ["doc_id", "start", "n_tokens", "ids_crc32"])
            shard.close()


def read_shards(shards: DataFrame) -> DataFrame:
    """Every document of the shards, read back from the files; see ROWS.

    The manifest (a row per shard of some megabytes) is summed on the driver.
    """
    spark = shards.sparkSession
    manifest, base = [], 0
    for r in sorted(shards.collect(), key=lambda r: r["shard"]):
        manifest.append((r["path"], base))
        base += r["n_tokens"]
    frame = spark.createDataFrame(manifest, "path string, base long")
    return frame.repartition(max(1, len(manifest))).mapInArrow(_read, ROWS)
