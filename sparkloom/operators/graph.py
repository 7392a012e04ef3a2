"""Graph kernels: adjacency tensors in, vertex tables out. ``A[i,j]`` is an edge from i to j unless said otherwise."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import Appended, Rounds, cut
from ..tensor import SparseTensor
from .linear import BROADCAST_CELLS, prepared, spmv


def edges(a: SparseTensor) -> DataFrame:
    """(s, t, w) of the stored cells that differ from the fill value."""
    return a.pruned().df.select(F.col("i0").alias("s"), F.col("i1").alias("t"), F.col("v").alias("w"))


def small(df: DataFrame, n: int) -> DataFrame:
    return F.broadcast(df) if n <= BROADCAST_CELLS else df


def bfs_levels(a: SparseTensor, source: int) -> SparseTensor:
    """Level of every vertex: 1 for the source, 0 (the fill) for what it does not reach."""
    spark, e = a.spark, cut(edges(a).select("s", "t").distinct())
    frontier, level = spark.createDataFrame([(source, 1)], "i long, level long"), 1
    visited = Appended(frontier, "visited")
    while True:
        level += 1
        step = e.join(small(frontier.select("i"), a.shape[0]), e["s"] == F.col("i")).select(F.col("t").alias("i")).distinct()
        new = step.join(visited.read().select("i"), "i", "left_anti").withColumn("level", F.lit(level).cast("long"))
        frontier = visited.append(new)
        if frontier.isEmpty():
            break
    return SparseTensor(visited.read().select(F.col("i").alias("i0"), F.col("level").alias("v")), (a.shape[0],), 0)


def bellman_ford(a: SparseTensor, source: int) -> SparseTensor:
    """Distances from a source; absent edges are infinite (the tensor's fill), so are unreached vertices. At most n rounds."""
    spark, e, rounds = a.spark, cut(edges(a.with_fill_value(math.inf))), Rounds()
    state = spark.createDataFrame([(source, 0.0, True)], "i long, d double, moved boolean")
    for _ in range(a.shape[0]):
        # only what got nearer in the round before can bring others nearer
        relaxed = e.join(small(state.where("moved"), a.shape[0]), e["s"] == F.col("i")).select(F.col("t").alias("i"), (F.col("d") + F.col("w")).alias("d"), F.lit(None).cast("double").alias("old"))
        both = state.select("i", "d", F.col("d").alias("old")).union(relaxed).groupBy("i").agg(F.min("d").alias("d"), F.max("old").alias("old"))
        state = rounds.cut(both.select("i", "d", (F.col("old").isNull() | (F.col("d") < F.col("old"))).alias("moved")))
        if state.where("moved").isEmpty():
            break
    return SparseTensor(state.select(F.col("i").alias("i0"), F.col("d").alias("v")), (a.shape[0],), math.inf)


def min_plus_square(e: DataFrame) -> DataFrame:
    """Shortest two-hop lengths of (s, t, w)."""
    left, right = e.toDF("s", "k", "w1"), e.toDF("k", "t", "w2")
    return left.join(right, "k").groupBy("s", "t").agg(F.min(F.col("w1") + F.col("w2")).alias("w"))


def all_pairs(a: SparseTensor) -> SparseTensor:
    """Shortest path lengths between all pairs, by min-plus squaring until nothing changes."""
    n = a.shape[0]
    own = a.spark.range(n).select(F.col("id").alias("s"), F.col("id").alias("t"), F.lit(0.0).alias("w"))
    rounds = Rounds()
    d = rounds.cut(edges(a.with_fill_value(math.inf)).select("s", "t", F.col("w").cast("double")).union(own).groupBy("s", "t").agg(F.min("w").alias("w")))
    for _ in range(max(1, math.ceil(math.log2(max(n, 2))))):
        new = rounds.cut(min_plus_square(d))
        same = new.exceptAll(d).isEmpty()
        d = new
        if same:
            break
    return SparseTensor(d.toDF("i0", "i1", "v"), (n, n), math.inf)


def pagerank(a: SparseTensor, alpha: float = 0.85, max_iter: int = 100, tol: float = 1e-8) -> SparseTensor:
    """``A[i,j]`` is an edge from j to i here. Columns without weight give to all; the iterate before the last step is returned on convergence."""
    n, spark = a.shape[0], a.spark
    out = a.df.groupBy(F.col("i1").alias("j")).agg(F.sum(F.col("v").cast("double")).alias("out"))
    flow = a.df.join(small(out, n), F.col("i1") == F.col("j")).where("out <> 0")
    flow = prepared(flow.select("i0", "i1", (F.col("v") / F.col("out")).alias("v")), n)
    rounds = Rounds()
    gives = cut(out.where("out <> 0").select(F.col("j").alias("i"), F.lit(True).alias("gives")))
    rank = cut(spark.range(n).select(F.col("id").alias("i"), F.lit(1.0 / n).alias("x")).join(gives, "i", "left").fillna(False))
    lost = rank.where("not gives").agg(F.sum("x")).first()[0] or 0.0
    for _ in range(max_iter):
        got = spmv(flow, rank, n)
        base = (1 - alpha) / n + alpha * lost / n
        new = rounds.cut(rank.join(got, "i", "left").select("i", F.col("x").alias("old"), (F.coalesce("y", F.lit(0.0)) * alpha + base).alias("x"), "gives"))
        gap, lost = new.agg(F.sum((F.col("x") - F.col("old")) ** 2), F.sum(F.when(F.col("gives"), 0.0).otherwise(F.col("x")))).first()
        if math.sqrt(gap) < tol:
            break
        rank = new.select("i", "x", "gives")
    flow.unpersist()
    return SparseTensor(rank.select(F.col("i").alias("i0"), F.col("x").alias("v")), (n,), 0.0)


def betweenness(a: SparseTensor, batch: int = 1024) -> SparseTensor:
    """Unnormalised betweenness, endpoints excluded, keyed by (source, vertex) for ``batch`` sources at a time. Loops are ignored."""
    n, spark = a.shape[0], a.spark
    e = cut(edges(a).where("s <> t").select("s", "t", F.col("w").cast("double").alias("w")))
    totals = Appended(spark.createDataFrame([], "x long, v double"), "betweenness")
    for start in range(0, n, batch):
        totals.append(dependencies(e, spark.range(start, min(n, start + batch))))
    total = totals.read().groupBy("x").agg(F.sum("v").alias("v")).select(F.col("x").alias("i0"), "v")
    return SparseTensor(total, (n,), 0.0)


def dependencies(e: DataFrame, sources: DataFrame) -> DataFrame:
    """(x, v): what the shortest paths from the sources (id) pass through x. Levels outward, then back; each is written once."""
    first = sources.select(F.col("id").alias("o"), F.col("id").alias("x"), F.lit(0).alias("depth"), F.lit(1.0).alias("paths"))
    reached, levels = Appended(first, "reached"), [first]
    while True:
        front, depth = levels[-1], len(levels)
        step = front.join(e, front["x"] == e["s"]).groupBy("o", "t").agg(F.sum(F.col("paths") * F.col("w")).alias("paths")).withColumnRenamed("t", "x")
        new = reached.append(step.join(reached.read().select("o", "x"), ["o", "x"], "left_anti").withColumn("depth", F.lit(depth)))
        if new.isEmpty():
            break
        levels.append(new)
    gain = Appended(e.sparkSession.createDataFrame([], "o long, x long, delta double"), "gain")
    below = gain.read()
    for front, above in zip(levels[:1:-1], levels[-2:0:-1], strict=True):
        own = front.join(below, ["o", "x"], "left")
        share = own.select("o", F.col("x").alias("t"), ((1 + F.coalesce("delta", F.lit(0.0))) / F.greatest("paths", F.lit(1e-10))).alias("share"))
        up = share.join(e, "t").join(above.select("o", F.col("x").alias("s"), "paths"), ["o", "s"])
        below = gain.append(up.groupBy("o", F.col("s").alias("x")).agg(F.sum(F.col("share") * F.col("w") * F.col("paths")).alias("delta")))
    return gain.read().groupBy("x").agg(F.sum("delta").alias("v"))


def upward(a: SparseTensor) -> DataFrame:
    """Edges s < t of a symmetric matrix without loops."""
    return edges(a).where("s < t").select("s", "t", F.col("w").cast("double").alias("w"))


def triangles(a: SparseTensor) -> float:
    """Triangles of a symmetric 0/1 matrix; weights multiply through. Each is met once, as i < j < k."""
    e = upward(a)
    paths = e.toDF("i", "j", "p").join(e.toDF("j", "k", "q"), "j")
    closed = paths.join(e.toDF("i", "k", "r"), ["i", "k"])
    return closed.agg(F.sum(F.col("p") * F.col("q") * F.col("r"))).first()[0] or 0.0


def four_cliques(a: SparseTensor) -> float:
    """4-cliques of a symmetric 0/1 matrix, each met once."""
    e = upward(a)
    t = e.toDF("i", "j", "p").join(e.toDF("j", "k", "q"), "j").join(e.toDF("i", "k", "r"), ["i", "k"]).select("i", "j", "k", (F.col("p") * F.col("q") * F.col("r")).alias("w"))
    t = t.join(e.toDF("k", "l", "a"), "k").join(e.toDF("i", "l", "b"), ["i", "l"]).join(e.toDF("j", "l", "c"), ["j", "l"])
    return t.agg(F.sum(F.col("w") * F.col("a") * F.col("b") * F.col("c"))).first()[0] or 0.0


def components(a: SparseTensor) -> SparseTensor:
    """Smallest vertex of each vertex's component in a symmetric graph: hooking of trees, shortcuts and pointer jumps."""
    n, spark = a.shape[0], a.spark
    e, rounds = cut(edges(a).select("s", "t").distinct()), Rounds(4)
    state = rounds.cut(spark.range(n).select(F.col("id").alias("i"), F.col("id").alias("f"), F.col("id").alias("g")))
    while True:
        near = e.join(state.select(F.col("i").alias("t"), F.col("g").alias("tg")), "t").groupBy(F.col("s").alias("i")).agg(F.min("tg").alias("m"))
        own = state.join(near, "i", "left")
        hooked = own.where("m is not null").groupBy(F.col("f").alias("i")).agg(F.min("m").alias("h"))
        parents = own.join(hooked, "i", "left").select("i", F.least(F.coalesce("h", "g"), F.coalesce("m", "g"), "g").alias("f"), F.col("g").alias("old"))
        parents = rounds.cut(parents)
        grand = parents.select(F.col("i").alias("f"), F.col("f").alias("g"))
        new = rounds.cut(parents.join(grand, "f").select("i", "f", "g", "old"))
        if new.where("g <> old").isEmpty():
            break
        state = new.select("i", "f", "g")
    return SparseTensor(new.select(F.col("i").alias("i0"), F.col("f").alias("v")), (n,), 0)


def closure(a: SparseTensor) -> SparseTensor:
    """Reflexive transitive closure as a boolean matrix."""
    n = a.shape[0]
    own = a.spark.range(n).select(F.col("id").alias("s"), F.col("id").alias("t"))
    rounds = Rounds()
    r = rounds.cut(edges(a).select("s", "t").union(own).distinct())
    count = r.count()
    while True:
        r = rounds.cut(r.toDF("s", "k").join(r.toDF("k", "t"), "k").select("s", "t").distinct())
        if (now := r.count()) == count:
            break
        count = now
    return SparseTensor(r.select(F.col("s").alias("i0"), F.col("t").alias("i1"), F.lit(True).alias("v")), (n, n), False)


def mutual(a: SparseTensor) -> SparseTensor:
    """Pairs that reach each other: the relation of strong components."""
    c = closure(a)
    both = c.df.select("i0", "i1").intersect(c.df.select(F.col("i1").alias("i0"), F.col("i0").alias("i1")))
    return SparseTensor(both.withColumn("v", F.lit(True)), c.shape, False)


def strong_components(a: SparseTensor) -> SparseTensor:
    """Smallest vertex of each vertex's strong component."""
    m = mutual(a)
    return SparseTensor(m.df.groupBy("i0").agg(F.min("i1").alias("v")), (a.shape[0],), 0)


def transitive_reduction(a: SparseTensor, x: float = 1, max_iters: int = 10) -> SparseTensor:
    """Drop an edge where a two-hop path is no longer than the row's largest edge plus x; absent cells are infinite."""
    rounds = Rounds()
    r = rounds.cut(edges(a.with_fill_value(math.inf)).select("s", "t", F.col("w").cast("double")))
    count = r.count()
    for _ in range(max_iters):
        two = min_plus_square(r).withColumnRenamed("w", "n")
        top = r.groupBy("s").agg(F.max("w").alias("top"))
        gone = two.join(top, "s").where(F.col("top") + x >= F.col("n")).select("s", "t")
        r = rounds.cut(r.join(gone, ["s", "t"], "left_anti"))
        if (now := r.count()) == count:
            break
        count = now
    return SparseTensor(r.toDF("i0", "i1", "v"), a.shape, math.inf)


def normalised_columns(m: DataFrame, floor: float = 2.220446049250313e-16) -> DataFrame:
    sums = m.groupBy("i1").agg(F.sum("v").alias("total"))
    return m.join(sums, "i1").select("i0", "i1", (F.col("v") / F.greatest("total", F.lit(floor))).alias("v"))


def markov_clustering(a: SparseTensor, expansion: int = 2, inflation: float = 2, loop_value: float = 1, iterations: int = 100, pruning_threshold: float = 1e-5, pruning_frequency: int = 1, check_frequency: int = 1) -> SparseTensor:
    """The flow matrix of Markov clustering; clusters are the rows of attractors, see ``mcl_clusters``."""
    n = a.shape[0]
    loops = a.spark.range(n).select(F.col("id").alias("i0"), F.col("id").alias("i1"), F.lit(float(loop_value)).alias("v"))
    m = a.df.select("i0", "i1", F.col("v").cast("double")).union(loops).groupBy("i0", "i1").agg(F.sum("v").alias("v"))
    rounds = Rounds(4)
    m = rounds.cut(normalised_columns(m))
    for it in range(iterations):
        before, grown = m, m
        for _ in range(expansion - 1):
            grown = grown.toDF("i0", "k", "p").join(before.toDF("k", "i1", "q"), "k").groupBy("i0", "i1").agg(F.sum(F.col("p") * F.col("q")).alias("v"))
        m = normalised_columns(grown.select("i0", "i1", F.pow("v", F.lit(float(inflation))).alias("v")))
        if pruning_threshold > 0 and it % pruning_frequency == pruning_frequency - 1:
            m = rounds.cut(m)
            top = m.groupBy("i1").agg(F.max("v").alias("top"))
            m = m.join(top, "i1").where((F.col("v") >= pruning_threshold) | ((F.col("v") == F.col("top")) & (F.col("v") > 0))).select("i0", "i1", "v")
        m = rounds.cut(m)
        if it % check_frequency == check_frequency - 1:
            both = m.toDF("i0", "i1", "p").join(before.toDF("i0", "i1", "q"), ["i0", "i1"], "full").fillna(0.0)
            if both.where(F.abs(F.col("p") - F.col("q")) > 1e-8 + 1e-5 * F.abs("q")).isEmpty():
                break
    return SparseTensor(m, (n, n), 0.0)


def mcl_clusters(flow: SparseTensor) -> DataFrame:
    """(cluster, vertex): the distinct rows with entries, each row's columns being a cluster named by its smallest vertex."""
    rows = flow.pruned().df.groupBy("i0").agg(F.sort_array(F.collect_set("i1")).alias("members"))
    return rows.select("members").distinct().select(F.col("members")[0].alias("cluster"), F.explode("members").alias("vertex"))
