"""Web archives: WARC records in ZIP packages, read back by range.

Writing. Among records with equal payloads (of at least ``least`` bytes) the one with
the largest page id is a response and the others revisit it. Each task writes one
package: a stored member ``archive/data.warc.gz``, every record its own gzip member,
and a stored index with the place of each record.

Reading. The central directory (with ZIP64 records) gives the members' places, the
index the records' ranges; each record is read by itself, unpacked and parsed, and a response's
payload is checked against its digest.

Nulls: a null html is an empty payload; a null url leaves the target out; a null page id
stays null and never becomes the referred-to response while an equal payload has an id.
Rows that share payload and the largest id are all responses. An empty table gives no
rows. Other columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import uuid
import zlib
from functools import partial
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .zipio import ZipReader, ZipWriter

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PACKAGES = "path string, n_records long, n_bytes long"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
_PRINTABLE = "".join(chr(c) for c in range(33, 127))


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}')}>"


def head(lines: list[tuple[str, str]], first: str) -> bytes:
    return "\r\n".join([first, *(f"{k}: {v}" for k, v in lines), "", ""]).encode()


def build(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC/1.1 record, uncompressed."""
    digest = digest_of(payload)
    http = head([("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(payload)))], "HTTP/1.1 200 OK")
    body = http if revisit else http + payload
    lines = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id(page_id, digest)), ("WARC-Date", DATE), ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(body)))]
    if page_id is not None:
        lines.append(("X-Page-ID", str(page_id)))
    if url is not None:
        lines.append(("WARC-Target-URI", quote(url, safe=_PRINTABLE)))
    if revisit:
        lines += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to, digest)), ("X-Refers-To-Page-ID", str(refers_to))]
    return head(lines, "WARC/1.1") + body + b"\r\n\r\n"


def fields(block: bytes) -> tuple[str, dict[str, str], bytes]:
    """First line, headers (names lower-cased) and the rest of a header block."""
    top, _, rest = block.partition(b"\r\n\r\n")
    first, *lines = top.decode().split("\r\n")
    return first, {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}, rest


def parse(record: bytes) -> dict:
    first, warc, rest = fields(record)
    if not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    _, http, payload = fields(rest[: int(warc["content-length"])])
    kind, digest = warc["warc-type"], warc["warc-payload-digest"].removeprefix("sha1:")
    size = int(http["content-length"])
    if kind == "response" and (len(payload) != size or digest_of(payload) != digest):
        raise ValueError("payload does not match its digest")
    number = lambda k: int(warc[k]) if k in warc else None
    return {"page_id": number("x-page-id"), "payload_bytes": size, "payload_digest": digest, "record_type": kind, "refers_to": number("x-refers-to-page-id"), "url": warc.get("warc-target-uri"), "payload": payload if kind == "response" else None}


def _write(batches, folder: str):
    path, out, places = f"{folder}/part-{TaskContext.get().partitionId():06d}.wacz", None, []
    for batch in batches:
        if len(batch) and out is None:
            out = ZipWriter(path, zip64=True)
            out.open(DATA)
        for page_id, url, html, refers_to, revisit in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            packed = gzip.compress(build(page_id, url, (html or "").encode(), refers_to, revisit), 1, mtime=0)
            places.append((out.write(packed), len(packed), "revisit" if revisit else "response"))
    if out is not None:
        out.end_member()
        out.open(INDEX)
        for at, n, kind in places:
            out.write((json.dumps({"offset": at, "length": n, "type": kind}) + "\n").encode())
        out.end_member()
        out.close()
        yield pa.RecordBatch.from_pylist([{"path": path, "n_records": len(places), "n_bytes": out.file.position}], pa.schema([("path", pa.string()), ("n_records", pa.int64()), ("n_bytes", pa.int64())]))


def write_archives(pages: DataFrame, folder: str, least: int = 0) -> DataFrame:
    """Write all pages; one row per package, see PACKAGES."""
    common.small_batches(pages.sparkSession)
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"), F.sha1(html.cast("binary")).alias("digest"))
    shared = rows.where(F.octet_length("html") >= least).groupBy(F.col("digest").alias("d")).agg(F.max("page_id").alias("top"), F.count(F.lit(1)).alias("n")).where("n > 1 and top is not null")
    # only digests and ids are shuffled; pages stay where they are, unless very many digests are shared
    shared = common.small(common.written(shared.drop("n"), "shared"), 2)
    joined = rows.join(shared, F.col("digest") == F.col("d"), "left")
    revisit = F.col("top").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("top"))
    out = joined.select("page_id", "url", "html", F.when(revisit, F.col("top")).alias("refers_to"), F.coalesce(revisit, F.lit(False)).alias("revisit"))
    return out.mapInArrow(partial(_write, folder=folder), PACKAGES)


def records(path: str):
    """Records of a package, one range read each."""
    package = ZipReader(path)
    for line in package.read(INDEX).splitlines():
        at = json.loads(line)
        yield parse(zlib.decompress(package.read(DATA, at["offset"], at["length"]), 31))
    package.close()


def _read(batches):
    for batch in batches:
        for path in batch.column(0).to_pylist():
            rows: list[dict] = []
            for r in records(path):
                rows.append(r)
                if len(rows) == 512:
                    yield _batch(rows)
                    rows = []
            if rows:
                yield _batch(rows)


def _batch(rows: list[dict]) -> pa.RecordBatch:
    types = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64()}
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in types.items()], list(types))


def read_archives(packages: DataFrame) -> DataFrame:
    """Every record of the packages; see RECORDS."""
    paths = sorted(r["path"] for r in packages.select("path").collect())
    frame = packages.sparkSession.createDataFrame([(p,) for p in paths], "path string")
    return frame.repartition(max(1, len(paths))).mapInArrow(_read, RECORDS)
