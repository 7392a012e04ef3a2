"""Best-fit packing with length patterns fitted by non-negative least squares.

1. Every text is tokenized; a document longer than the context is cut into
   context-sized pieces. Only lengths, never ids, leave the tokenizing tasks.
2. The histogram of piece lengths (at most ``context`` rows, whatever the corpus)
   goes to the driver. Lengths are gathered into ``grid`` bins; patterns of at
   most ``most`` bins that fill a sequence are enumerated, and non-negative least
   squares fits how often each repeats. The counts are rounded down.
3. Each pattern is filled with exact lengths (the last place gets the longest
   piece that still fits); what rounding left over goes, longest first, to the
   tightest gap. All steps move whole runs of equal lengths, so the plan has some
   thousands of rows for any number of documents.
4. Pieces of one length are numbered across the corpus (count by task, running
   sums by length), and a piece's number finds its sequence and place in the plan.

Nulls: a null text is an empty document and has its end id alone. Repeated rows
are packed as often as they occur. An empty table gives no rows. Other columns
are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common, tokens

CONTEXT = 4096
END_ID = 1
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, local_rank long"
PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def _cut(batches, path: str, context: int, end_id: int):
    memo, part = tokens.memo(path), TaskContext.get().partitionId()
    seen, end = [0] * (context + 1), np.array([end_id], "<u4").tobytes()
    for batch in batches:
        docs = batch.column(0).to_pylist()
        raw = [t or "" for t in batch.column(1).to_pylist()]
        out: list[tuple] = []
        for a, b in common.chunks(raw, tokens.CHUNK):
            ids, at = memo.ids(raw[a:b])
            data, at = memoryview(ids.astype("<u4", copy=False)).cast("B"), at.tolist()
            for k in range(b - a):
                first, size = at[k], at[k + 1] - at[k] + 1
                for piece, start in enumerate(range(0, size, context)):
                    length = min(context, size - start)
                    last = start + length == size  # the end id is not in the array
                    crc = zlib.crc32(data[4 * (first + start) : 4 * (first + start + length - last)])
                    out.append((docs[a + k], piece, start, length, zlib.crc32(end, crc) if last else crc, part, seen[length]))
                    seen[length] += 1
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32", "part", "local_rank"])


def pieces(docs: DataFrame, tokenizer: str, context: int = CONTEXT, end_id: int = END_ID) -> DataFrame:
    """Pieces of every document with their number within (task, length)."""
    common.small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(partial(_cut, path=tokenizer, context=context, end_id=end_id), PIECES)


# --- the plan, on the driver, from a histogram ------------------------------------


def patterns(bins: int, present: list[int], most: int) -> list[tuple[int, ...]]:
    """Multisets of at most ``most`` present bins that sum to ``bins``, largest first."""
    out: list[tuple[int, ...]] = []
    have = sorted(present, reverse=True)

    def grow(prefix: tuple[int, ...], left: int, top: int) -> None:
        if left == 0:
            out.append(prefix)
            return
        if len(prefix) == most:
            return
        for b in have:
            if b <= min(top, left) and b * (most - len(prefix)) >= left:
                grow((*prefix, b), left - b, b)

    grow((), bins, bins)
    return out


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Active-set non-negative least squares (Lawson and Hanson)."""
    x, passive = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    scale = 1e-9 * max(1.0, float(np.abs(a.T @ b).max(initial=0)))
    for _ in range(rounds):
        w = a.T @ (b - a @ x)
        w[passive] = -np.inf
        j = int(np.argmax(w)) if len(w) else -1
        if j < 0 or w[j] <= scale:
            break
        passive[j] = True
        while True:
            cols = np.flatnonzero(passive)
            z = np.linalg.lstsq(a[:, cols], b, rcond=None)[0]
            if (z > 0).all():
                x[:] = 0
                x[cols] = z
                break
            bad = z <= 0
            old = x[cols]
            step = np.min(old[bad] / np.maximum(old[bad] - z[bad], 1e-300))
            x[cols] = old + step * (z - old)
            passive[cols[(x[cols] <= 1e-12) & bad]] = False
            x[~passive] = 0
            if not passive.any():
                break
    return x


class Plan:
    """Runs of equal sequences: (lengths in order, number of sequences)."""

    def __init__(self, histogram: dict[int, int], context: int, grid: int, most: int, filler: int):
        self.context = context
        self.left = {n: c for n, c in histogram.items() if c > 0}
        self.have = sorted(self.left)
        self.runs: list[tuple[tuple[int, ...], int]] = []
        self.fit(grid, most, filler)
        self.residuals()

    def take(self, length: int, n: int) -> None:
        self.left[length] -= n
        if not self.left[length]:
            del self.left[length]
            self.have.pop(bisect_left(self.have, length))

    def longest(self, low: int, high: int) -> int | None:
        """The largest length in [low, high] that is left."""
        i = bisect_left(self.have, high + 1) - 1
        return self.have[i] if i >= 0 and self.have[i] >= low else None

    def fit(self, grid: int, most: int, filler: int) -> None:
        width = self.context // grid
        of = lambda n: max(1, round(n / width))
        counts: dict[int, int] = defaultdict(int)
        for n, c in self.left.items():
            if n >= filler:  # shorter pieces fill gaps
                counts[of(n)] += c
        shapes = patterns(grid, list(counts), most)
        if not shapes:
            return
        bins = sorted(counts)
        row = {b: i for i, b in enumerate(bins)}
        a = np.zeros((len(bins), len(shapes)))
        for j, shape in enumerate(shapes):
            for b in shape:
                a[row[b], j] += 1
        goal = np.array([counts[b] for b in bins], float)
        weight = 1 / np.sqrt(goal)  # relative misfit counts, so rare lengths are not ignored
        x = nnls(a * weight[:, None], goal * weight)
        for j in np.argsort(-x, kind="stable"):
            if (times := int(x[j] + 1e-9)) > 0:
                self.realise(shapes[j], times, width, filler)

    def realise(self, shape: tuple[int, ...], times: int, width: int, filler: int) -> None:
        """Fill a pattern with exact lengths, in runs as long as the counts allow."""
        while times > 0:
            room, chosen = self.context, []
            need: dict[int, int] = defaultdict(int)
            for k, b in enumerate(shape):
                high = min(room, (b + 1) * width if k + 1 == len(shape) else int((b + 0.5) * width))
                n = self.longest(max(filler, int((b - 1.5) * width)), high)
                while n is not None and need[n] >= self.left[n]:
                    n = self.longest(max(filler, int((b - 1.5) * width)), n - 1)
                if n is None:
                    break
                chosen.append(n)
                need[n] += 1
                room -= n
            if len(chosen) < len(shape):
                return
            run = min(times, *(self.left[n] // c for n, c in need.items() if c))
            for n, c in need.items():
                if c:
                    self.take(n, run * c)
            self.runs.append((tuple(chosen), run))
            times -= run

    def residuals(self) -> None:
        """Longest first into the tightest gap; a new sequence where none fits."""
        open_: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)
        gaps: list[int] = []

        def add(run: tuple[int, ...], n: int) -> None:
            gap = self.context - sum(run)
            if not open_[gap]:
                insort(gaps, gap)
            open_[gap].append((run, n))

        for run, n in self.runs:
            add(run, n)
        while self.have:
            length = self.have[-1]
            n = self.left[length]
            i = bisect_left(gaps, length)
            if i == len(gaps):
                each = self.context // length
                if n >= each:
                    add((length,) * each, n // each)
                    self.take(length, n // each * each)
                else:
                    add((length,) * n, 1)
                    self.take(length, n)
                continue
            gap = gaps[i]
            run, have = open_[gap].pop()
            if not open_[gap]:
                gaps.pop(i)
            m = min(have, n)
            if have > m:
                add(run, have - m)
            add((*run, length), m)
            self.take(length, m)
        self.runs = [x for gap in sorted(open_) for x in open_[gap]]

    def places(self) -> dict[int, np.ndarray]:
        """By length: rows (first rank, first sequence, place), ascending in rank."""
        at: dict[int, int] = defaultdict(int)
        out: dict[int, list] = defaultdict(list)
        sequence = 0
        for run, n in self.runs:
            offset = 0
            for length in run:
                out[length].append((at[length], sequence, offset))
                at[length] += n
                offset += length
            sequence += n
        return {k: np.array(v, np.int64) for k, v in out.items()}


def plan(histogram: dict[int, int], context: int = CONTEXT, grid: int = 64, most: int = 3, filler: int | None = None) -> Plan:
    return Plan(histogram, context, min(grid, context), most, max(1, context // 16) if filler is None else filler)


def _place(batches, sent):
    places = sent.value
    for batch in batches:
        length = batch.column("length").to_numpy()
        rank = batch.column("rank").to_numpy()
        sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
        order = np.argsort(length, kind="stable")
        edges = np.flatnonzero(np.diff(length[order])) + 1
        for rows in np.split(order, edges):
            if len(rows):
                own = places[int(length[rows[0]])]
                k = np.searchsorted(own[:, 0], rank[rows], "right") - 1
                sequence[rows] = own[k, 1] + rank[rows] - own[k, 0]
                offset[rows] = own[k, 2]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(sequence), pa.array(offset)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])


def pack(docs: DataFrame, tokenizer: str, context: int = CONTEXT, end_id: int = END_ID, grid: int = 64, most: int = 3) -> DataFrame:
    """Pack all documents (doc_id, text); one row per piece, see PACKED."""
    spark = docs.sparkSession
    cut = common.written(pieces(docs, tokenizer, context, end_id), "pieces")
    by_task = cut.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    by_task = common.written(by_task, "lengths")
    histogram = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    sent = spark.sparkContext.broadcast(plan(histogram, context, grid, most).places())
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = by_task.select(F.col("length").alias("b_length"), F.col("part").alias("b_part"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    base = common.small(common.written(base, "bases"))
    ranked = cut.join(base, (F.col("length") == F.col("b_length")) & (F.col("part") == F.col("b_part")))
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("local_rank")).alias("rank"))
    return ranked.mapInArrow(partial(_place, sent=sent), PACKED)
