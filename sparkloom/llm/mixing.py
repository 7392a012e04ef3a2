"""Mixing sources to target weights by pivotal dependent rounding.

Targets: sources in code point order, null last, take the weights in turn; the
budget is shared by weight and no source gets more than ``cap`` times its size;
what is cut off is shared again among the others. A document's expected copies
are target / size of its source. The whole part is certain; the fractions are
rounded together: two fractional documents of a source meet, and words move from one to
the other, in a direction drawn so that expectations hold, until one of them is
integral. The words a source gives therefore stay as they are through every meeting.

The meetings form a tree: documents of a source are dealt to buckets of bounded
size, each bucket leaves one fractional document at most, and the left-overs of
``fan_in`` buckets meet in the next level until one per source remains, which is
rounded to the nearer whole. Draws are hashes of ids, so reruns agree, and a hot
source is only more buckets.

Up to BROADCAST_SOURCES sources (counted) go to the driver, a row each; of more only sums do.

Nulls: a null text has size 0; a null source is a source of its own. Repeated rows are
counted first, then drawn each by itself, in runs of at most ``RUN`` rows a bucket. An empty table
gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .textcore import U64, mix

WEIGHTS, BUDGET, CAP = (5.0, 2.0, 1.0), 1.5, 2.0
BUCKET, FAN_IN, RUN = 1024, 64, 256
#: Targets are broadcast up to this many sources, joined beyond.
BROADCAST_SOURCES = 20_000
ROWS = "doc_id long, content long, source string, size long, source_size long, target double, bucket long, copies int, part double"
WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: list[int], weights: list[float], budget: float, cap: float) -> list[float]:
    """Shares of ``budget * sum(sizes)`` by weight, each at most cap * size."""
    total = budget * sum(sizes)
    out, capped = [0.0] * len(sizes), [False] * len(sizes)
    while True:
        rest = total - sum(cap * s for s, c in zip(sizes, capped, strict=True) if c)
        weight = sum(w for w, c in zip(weights, capped, strict=True) if not c)
        out = [cap * s if c else (rest * w / weight if weight else 0.0) for s, w, c in zip(sizes, weights, capped, strict=True)]
        over = [not c and t > cap * s for t, s, c in zip(out, sizes, capped, strict=True)]
        if not any(over):
            return out
        capped = [c or o for c, o in zip(capped, over, strict=True)]


def targets_in_tasks(stats: DataFrame, weights, budget: float, cap: float) -> DataFrame:
    """As ``targets`` for a table (source, source_size, n): adds target. Only the sums of each round reach the driver.

    A source is capped when the share of a unit of weight, which only grows from round to round, passes what it can take.
    """
    spark = stats.sparkSession
    ordered = common.written(stats.repartitionByRange(F.col("source").isNull(), "source").sortWithinPartitions(F.col("source").isNull(), "source").mapInArrow(_numbered, "source string, source_size long, n long, part int, place long"), "sources")
    counts = ordered.groupBy("part").count().orderBy("part").collect()
    before = np.cumsum([0, *(r["count"] for r in counts)]).tolist()
    bases = F.broadcast(common.local(spark, [(r["part"], b) for r, b in zip(counts, before, strict=False)], "part int, base long"))
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("base") + F.col("place")) % len(weights)).cast("int"))
    rated = common.written(ordered.join(bases, "part").select("source", "source_size", "n", weight.alias("weight")), "weights")
    total, share, most = budget * (rated.agg(F.sum("source_size")).first()[0] or 0), 0.0, F.col("source_size") * cap
    while True:
        capped = F.col("weight") * share > most
        taken, left = rated.agg(F.sum(F.when(capped, most)), F.sum(F.when(~capped, F.col("weight")))).first()
        new = (total - (taken or 0.0)) / left if left else share
        if not left or new <= share:
            break
        share = new
    return rated.select("source", "source_size", "n", F.least(F.col("weight") * share, most).alias("target"))


def _numbered(batches):
    part, place = TaskContext.get().partitionId(), 0
    for batch in batches:
        n = len(batch)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, part, np.int32)), pa.array(np.arange(place, place + n))], ["source", "source_size", "n", "part", "place"])
        place += n


def draws(ids: np.ndarray, level: int, seed: int) -> np.ndarray:
    x = mix(ids.astype(np.int64).view(U64) ^ U64((seed * 1_000_003 + level * 7_919 + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
    return (x >> U64(11)).astype(np.float64) / (1 << 53)


def pivot(sizes: list[int], parts: list[float], u: list[float]) -> int:
    """Round ``parts`` in place, keeping sum(size * part); the index of the one left fractional, or -1."""
    carry = -1
    for j in range(len(sizes)):
        if parts[j] in (0.0, 1.0):
            continue
        if carry < 0:
            carry = j
            continue
        i, w, v = carry, sizes[carry], sizes[j]
        a, b = parts[i], parts[j]
        up, down = min((1 - a) * w, b * v), min(a * w, (1 - b) * v)
        move = up if u[j] * (up + down) < down else -down
        if move > 0:
            parts[i], parts[j] = (1.0, b - up / v) if (1 - a) * w <= b * v else (a + up / w, 0.0)
        else:
            parts[i], parts[j] = (0.0, b + down / v) if a * w <= (1 - b) * v else (a - down / w, 1.0)
        for k in (i, j):
            if parts[k] < 1e-12 or parts[k] > 1 - 1e-12:
                parts[k] = float(round(parts[k]))
        carry = next((k for k in (i, j) if parts[k] not in (0.0, 1.0)), -1)
    return carry


def _meet(frame: pd.DataFrame, level: int, seed: int, last: bool) -> pd.DataFrame:
    """One bucket: largest documents first, so that what is left over tends to be small."""
    common.held("mixing", object)  # nothing is kept, but what an earlier operator kept goes
    frame = frame.sort_values(["size", "doc_id", "content"], ascending=[False, True, True], kind="stable", na_position="last")
    u = draws(frame["doc_id"].fillna(0).to_numpy(), level, seed)
    if level == 0:  # a document without words has nothing to transfer
        empty = frame["size"].to_numpy() == 0
        frame["part"] = np.where(empty, (u < frame["part"].to_numpy()).astype(float), frame["part"].to_numpy())
    parts = frame["part"].tolist()
    left = pivot(frame["size"].tolist(), parts, u.tolist())
    if last and left >= 0:
        parts[left] = 1.0 if parts[left] >= 0.5 else 0.0
    frame["part"] = parts
    return frame


def mix_sources(docs: DataFrame, weights=WEIGHTS, budget: float = BUDGET, cap: float = CAP, seed: int = 7) -> DataFrame:
    """Rows (doc_id, content, source, size, source_size, target, copies, taken), one per document."""
    spark = docs.sparkSession
    text = F.col("text").cast("string")
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("content"), F.col("source").cast("string").alias("source"), F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    sized = common.written(sized.groupBy("doc_id", "content", "source", "size").agg(F.count(F.lit(1)).alias("rows")), "sizes")
    stats = sized.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size"), F.sum("rows").alias("n"))
    stats = common.written(stats, "stats")
    if stats.count() <= BROADCAST_SOURCES:
        ordered = sorted(stats.collect(), key=lambda r: (r["source"] is None, r["source"] or ""))
        goal = targets([r["source_size"] for r in ordered], [weights[i % len(weights)] for i in range(len(ordered))], budget, cap)
        known = F.broadcast(common.local(spark, [(*r, t) for r, t in zip(ordered, goal, strict=True)], "source string, source_size long, n long, target double"))
    else:
        known = targets_in_tasks(stats, weights, budget, cap)
    known = known.select(F.col("source").alias("t_source"), "source_size", "target", F.ceil(F.col("n") / BUCKET).alias("buckets"))
    most = -(-(stats.agg(F.max("n")).first()[0] or 0) // BUCKET)
    expected = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(1.0))
    whole = F.floor(expected + F.lit(1e-12))
    part = F.greatest(expected - whole, F.lit(0.0))
    runs = sized.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("rows") - 1) / RUN))))
    inside = F.least(F.lit(RUN).cast("long"), F.col("rows") - F.col("run") * RUN)
    state = runs.join(known, F.col("source").eqNullSafe(F.col("t_source"))).select(
        "doc_id", "content", "source", "size", "source_size", "target",
        F.pmod(F.xxhash64(F.lit(seed), "doc_id", "content", "run"), F.col("buckets")).alias("bucket"), whole.cast("int").alias("copies"), F.when(part < 1e-12, 0.0).otherwise(part).alias("part"), inside.alias("inside"),
    ).withColumn("place", F.explode(F.sequence(F.lit(1).cast("long"), F.col("inside")))).drop("place", "inside")
    level, done = 0, []
    while True:
        met = state.groupBy("source", "bucket").applyInPandas(partial(_meet, level=level, seed=seed, last=most <= 1), ROWS)
        met = common.written(met, f"mixed{level}")
        integral = F.col("part").isin(0.0, 1.0)
        done.append(met.where(integral))
        if most <= 1:
            break
        state = met.where(~integral).withColumn("bucket", F.floor(F.col("bucket") / FAN_IN))
        most, level = -(-most // FAN_IN), level + 1
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    copies = F.col("copies") + F.col("part").cast("int")
    return out.select("doc_id", "content", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).cast("long").alias("taken"))


def mixture(docs: DataFrame, **how) -> DataFrame:
    """The documents, each as often as it is taken, with the columns of ``docs``."""
    x, keys = common.fresh(docs, "mix_"), ["doc_id", "content", "source"]
    taken = mix_sources(docs, **how).groupBy(*keys).agg(F.sum("copies").alias(f"{x}total"), F.count(F.lit(1)).alias(f"{x}rows"))
    taken = common.written(taken.withColumnsRenamed({k: x + k for k in keys}).where(F.col(f"{x}total") > 0), "taken")
    text = F.xxhash64(F.col("text").cast("string"))
    on = F.col("doc_id").cast("long").eqNullSafe(F.col(f"{x}doc_id")) & (text == F.col(f"{x}content")) & F.col("source").eqNullSafe(F.col(f"{x}source"))
    total, rows, times = F.col(f"{x}total"), F.col(f"{x}rows"), F.col(f"{x}times")

    def repeated(joined: DataFrame) -> DataFrame:
        return joined.where(times > 0).withColumn(f"{x}copy", F.explode(F.sequence(F.lit(1), times))).select(*docs.columns)

    out = repeated(docs.join(taken.where(rows == 1), on).withColumn(f"{x}times", total.cast("int")))
    many = taken.where(rows > 1)
    if not many.isEmpty():
        # equal rows share their total: the first of them get one more where it doesn't divide
        place = F.row_number().over(Window.partitionBy(*(x + k for k in keys)).orderBy(F.lit(0)))
        share = F.floor(total / rows) + (place <= total % rows).cast("long")
        out = out.union(repeated(docs.join(common.small(many), on).withColumn(f"{x}times", share.cast("int"))))
    return out
