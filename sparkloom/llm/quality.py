"""Quality rules: per-document measures and cross-document line frequency.

Every line is normalised (A-Z lower-cased, runs of white space made one space) and
hashed. For each host the distinct documents that hold a line are counted;
documents with equal texts are one, so plain copies do not turn their own
lines into boilerplate. A line of any length in more than ``docs_limit`` distinct
documents of its host is above the limit, whatever the host's size. It is
removed, and a document is rejected as depleted when what is left of it has fewer
than ``words_left`` words or a smaller share than ``share_left``.

Base rules (``base_failed``): fewer than 50 words, or over half of the words in
3-word windows that the text holds twice or more.

Nulls: a null text has no words and fails. A null host is a host of its own.
Repeated rows each get their own, equal, row. An empty table gives no rows. Other
columns are ignored.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .textcore import Chunk, table_of, windows

SYMBOLS = table_of(b"#*$%&|<>")
MEASURES = "row long, doc_id long, host string, content long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, lines array<long>, line_words array<int>"
DOCS, WORDS_LEFT, SHARE_LEFT = 20, 20, 0.3
#: Lines above the limit that are broadcast (some megabytes); beyond, documents are joined with their verdicts.
BROADCAST_LINES = 200_000


def normal(line: bytes) -> bytes:
    return b" ".join(line.lower().split())


def line_hash(line: bytes) -> int:
    h = xxhash.xxh3_64_intdigest(line)
    return h - (h >> 63 << 64)


def repeat_words(h: np.ndarray) -> int:
    """Words in 3-word windows that occur twice or more."""
    w = windows(h, 3)
    if len(w) < 2:
        return 0
    s = np.sort(w)
    twice = s[1:][s[1:] == s[:-1]]
    if not len(twice):
        return 0
    hit = twice[np.minimum(np.searchsorted(twice, w), len(twice) - 1)] == w
    covered = np.zeros(len(h), bool)
    for i in range(3):
        covered[i : i + len(hit)] |= hit
    return int(covered.sum())


def line_facts(text: bytes) -> tuple[int, dict[int, int]]:
    """Lines equal to an earlier one, and words by hash of the normalised lines."""
    seen, dup, out = set(), 0, {}
    for line in text.split(b"\n"):
        words = line.split()
        if not words:
            continue
        if line in seen:
            dup += 1
        seen.add(line)
        h = line_hash(b" ".join(words).lower())
        out[h] = out.get(h, 0) + len(words)
    return dup, out


def _measure(batches):
    common.held("quality", object)  # nothing is kept, but what an earlier operator kept goes
    row = TaskContext.get().partitionId() << 33
    for batch in batches:
        ids, hosts, items, contents = batch.column(0).to_pylist(), batch.column(1).to_pylist(), common.texts(batch.column(2)), batch.column(3).to_pylist()
        out: list[tuple] = []
        for a, b in common.chunks(items):
            chunk = Chunk(items[a:b])
            h = chunk.word_hashes()
            inside = np.zeros(len(chunk.buf) + 1, np.int8)
            inside[chunk.starts], inside[chunk.ends] = 1, -1
            letters = np.concatenate([[0], np.cumsum((np.cumsum(inside[:-1]) > 0) & ((chunk.buf & 0xC0) != 0x80))])
            symbols = np.concatenate([[0], np.cumsum(SYMBOLS[chunk.buf])])
            for d in range(b - a):
                i, j = chunk.begin[d], chunk.begin[d + 1]
                dup, lines = line_facts(items[a + d])
                own = h[chunk.first[d] : chunk.first[d + 1]]
                out.append((row, ids[a + d], hosts[a + d], contents[a + d], len(own), int(letters[j] - letters[i]), int(symbols[j] - symbols[i]), dup, repeat_words(own), list(lines), list(lines.values())))
                row += 1
        if out:
            types = (pa.int64(), pa.int64(), pa.string(), *[pa.int64()] * 6, pa.list_(pa.int64()), pa.list_(pa.int32()))
            names = [x.split()[0] for x in MEASURES.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*out, strict=True), types, strict=True)], names)


def measure(docs: DataFrame) -> DataFrame:
    """See MEASURES; written, since it is read more than once."""
    common.small_batches(docs.sparkSession)
    text = F.col("text").cast("string")
    base = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), text, F.xxhash64(text))
    return common.written(base.mapInArrow(_measure, MEASURES), "measures")


def line_rows(measured: DataFrame) -> DataFrame:
    return measured.select("row", "host", "content", F.explode(F.arrays_zip("lines", "line_words")).alias("x")).select("row", "host", "content", F.col("x.lines").alias("line"), F.col("x.line_words").alias("words"))


def above_limit(measured: DataFrame, docs_limit: int = DOCS) -> DataFrame:
    """(f_host, f_line) of the lines in too many distinct documents of their host."""
    held = line_rows(measured).select("host", "line", "content").distinct()
    found = held.groupBy("host", "line").agg(F.count(F.lit(1)).alias("docs")).where(F.col("docs") > docs_limit)
    return found.select(F.col("host").alias("f_host"), F.col("line").alias("f_line"))


def base_failed(n_words, n_repeat_words):
    return (n_words < 50) | (100 * n_repeat_words > 50 * n_words)


def depleted(n_words, gone, words_left: int, share_left: float):
    left = n_words - gone
    return (gone > 0) & ((left < words_left) | (left < n_words * share_left))


def judged(measured: DataFrame, limited: DataFrame, words_left: int, share_left: float) -> DataFrame:
    lines = line_rows(measured)
    hit = lines.join(limited, F.col("host").eqNullSafe(F.col("f_host")) & (F.col("line") == F.col("f_line")))
    removed = hit.groupBy(F.col("row").alias("r_row")).agg(F.sum("words").alias("words_removed"), F.collect_list("line").alias("removed"))
    out = measured.drop("lines", "line_words").join(removed, F.col("row") == F.col("r_row"), "left")
    gone = F.coalesce("words_removed", F.lit(0))
    failed = base_failed(F.col("n_words"), F.col("n_repeat_words"))
    return out.withColumns({"words_removed": gone, "base_failed": failed, "kept": ~failed & ~depleted(F.col("n_words"), gone, words_left, share_left)}).drop("r_row", "row")


def assess(docs: DataFrame, docs_limit: int = DOCS, words_left: int = WORDS_LEFT, share_left: float = SHARE_LEFT) -> DataFrame:
    """Measures, base_failed, words_removed, removed (hashes of the lines above the limit) and kept, a row per document."""
    measured = measure(docs)
    return judged(measured, above_limit(measured, docs_limit), words_left, share_left)


def strip(text: bytes, gone: set[int]) -> bytes:
    return b"\n".join(x for x in text.split(b"\n") if line_hash(normal(x)) not in gone)


def _clean(batches, sent, names: list[str], words_left: int, share_left: float):
    gone = sent.value
    at = {n: names.index(n) for n in ("text", "source", "n_chars") if n in names}
    for batch in batches:
        items, hosts = common.texts(batch.column(at["text"])), batch.column(at["source"]).to_pylist()
        keep, new, changed = np.zeros(len(items), bool), list(items), np.zeros(len(items), bool)
        for a, b in common.chunks(items):
            chunk = Chunk(items[a:b])
            h = chunk.word_hashes()
            for d in range(b - a):
                own = h[chunk.first[d] : chunk.first[d + 1]]
                if base_failed(len(own), repeat_words(own)):
                    continue
                lines = gone.get(hosts[a + d])
                facts = line_facts(items[a + d])[1] if lines else {}
                hit = lines.intersection(facts) if lines else set()
                if not depleted(len(own), sum(facts[x] for x in hit), words_left, share_left):
                    keep[a + d] = True
                    if hit:
                        new[a + d], changed[a + d] = strip(items[a + d], hit), True
        columns = list(batch.columns)
        if changed.any():
            text = [x.decode() for x in new]
            columns[at["text"]] = pa.array(text, pa.string()).cast(columns[at["text"]].type)
            if "n_chars" in at:
                old = columns[at["n_chars"]]
                columns[at["n_chars"]] = pa.array([len(t) if c else o for t, c, o in zip(text, changed, old.to_pylist(), strict=True)], old.type)
        yield pa.RecordBatch.from_arrays(columns, names).filter(pa.array(keep))


def clean(docs: DataFrame, docs_limit: int = DOCS, words_left: int = WORDS_LEFT, share_left: float = SHARE_LEFT) -> DataFrame:
    """The documents that pass, without the lines above the limit; all columns stay, ``n_chars`` follows the text.

    Up to BROADCAST_LINES lines above the limit are sent to the tasks, and one pass over
    the documents judges and cleans them without a join; more are joined.
    """
    measured = measure(docs)
    limited = common.written(above_limit(measured, docs_limit), "limited")
    if limited.count() <= BROADCAST_LINES:
        gone: dict = {}
        for r in limited.collect():
            gone.setdefault(r["f_host"], set()).add(r["f_line"])
        sent = docs.sparkSession.sparkContext.broadcast(gone)
        plain = docs.withColumns({"text": F.col("text").cast("string"), "source": F.col("source").cast("string")})
        return plain.mapInArrow(partial(_clean, sent=sent, names=plain.columns, words_left=words_left, share_left=share_left), plain.schema)
    x = common.fresh(docs, "judged_")
    verdict = judged(measured, limited, words_left, share_left).where("kept").select(F.col("doc_id").alias(f"{x}id"), F.col("content").alias(f"{x}content"), F.col("host").alias(f"{x}host"), F.col("removed").alias(f"{x}gone")).dropDuplicates([f"{x}id", f"{x}content", f"{x}host"])
    on = F.col("doc_id").cast("long").eqNullSafe(F.col(f"{x}id")) & F.col("source").eqNullSafe(F.col(f"{x}host")) & (F.xxhash64(F.col("text").cast("string")) == F.col(f"{x}content"))
    shorter = F.udf(lambda t, gone: None if t is None or not gone else strip(t.encode(), set(gone)).decode(), T.StringType(), useArrow=True)
    out, new = docs.join(verdict, on).withColumn(f"{x}text", shorter("text", f"{x}gone")), F.col(f"{x}text")
    changes = {"text": F.coalesce(new, F.col("text"))}
    if "n_chars" in docs.columns:
        changes["n_chars"] = F.when(new.isNotNull(), F.length(new)).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return out.withColumns(changes).select(*docs.columns)
