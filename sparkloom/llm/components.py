"""Connected components of a link table, without gathering links on the driver.

Up to ONE_TASK links (a checked count, some tens of megabytes) are contracted with
union-find in a single task. Beyond, each task contracts its own links to a forest, and alternating
large-star and small-star rounds (Kiveris et al., 2014) then hook every node to
the smallest node it can reach. Both are grouped minima and joins on node ids, so
a node with very many links is combined map-side and its join can be split.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import Rounds
from . import common

ONE_TASK = 500_000


class UnionFind:
    def __init__(self):
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        root = x
        while (p := self.parent.get(root, root)) != root:
            root = p
        while (p := self.parent.get(x, x)) != root:
            self.parent[x] = root
            x = p
        return root

    def union(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)
            self.parent.setdefault(min(a, b), min(a, b))


def _contract(batches):
    forest = UnionFind()
    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            forest.union(a, b)
    pairs = [(x, r) for x in forest.parent if (r := forest.find(x)) != x]
    for k in range(0, len(pairs), 10_000):
        u, v = zip(*pairs[k : k + 10_000], strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(r)


def components(links: DataFrame, rounds: int = 200, one_task: int = ONE_TASK) -> DataFrame:
    """Rows (node, component) for every node of the links (a, b); component is its smallest node.

    Rows with a null end or equal ends are ignored; repeated links are harmless.
    """
    a, b = (F.col(c).cast("long") for c in links.columns[:2])
    edges = common.written(links.where(a.isNotNull() & b.isNotNull() & (a != b)).select(a.alias("a"), b.alias("b")), "links")
    if edges.count() <= one_task:
        edges = common.written(edges.coalesce(1).mapInArrow(_contract, "u long, v long"), "forest")
        return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select(F.col("v"), F.col("v")).distinct())
    kept = Rounds()
    edges = kept.cut(edges.mapInArrow(_contract, "u long, v long").distinct())
    state = _state(edges)
    for _ in range(rounds):
        if not state[0]:
            break
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m")).select("w", F.least("w", "m").alias("m"))
        large = both.join(least, F.col("u") == F.col("w")).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m"))
        own = large.join(low, F.col("u") == F.col("w"))
        small = own.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v")).union(own.select("u", F.col("m").alias("v"))).distinct()
        edges = kept.cut(small)
        if (now := _state(edges)) == state:
            break
        state = now
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select(F.col("v"), F.col("v")).distinct())
