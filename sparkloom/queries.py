"""Registered queries: the operators applied to the star-schema tables, and SQL that says the same.

The graph of the graph queries is the trade graph: every nation points to the three
nations it buys most from, counted over all line items; weights are the ranks 1 to 3.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .operators import graph, learning, linear, simulation, solvers
from .plans.einsum import einsum
from .registry import ORACLES, QUERIES, load, query, rows
from .storage import cut
from .streaming.cells import windowed_cells
from .tensor import SparseTensor, from_numpy, tensor

NATIONS = 25
SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]

# --- tensors from tables --------------------------------------------------------


def supply(spark: SparkSession, sf_dir: str) -> SparseTensor:
    """Quantity by part and supplier."""
    shape = (load(spark, sf_dir, "part").count(), load(spark, sf_dir, "supplier").count())
    return tensor(load(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_quantity"), shape, 0.0)


def balances(spark: SparkSession, sf_dir: str) -> SparseTensor:
    """Customers' balance by nation and market segment, in whole units."""
    segment = F.array_position(F.array(*[F.lit(s) for s in SEGMENTS]), F.col("c_mktsegment")) - 1
    return tensor(load(spark, sf_dir, "customer").select("c_nationkey", segment, F.round("c_acctbal").cast("bigint")), (NATIONS, len(SEGMENTS)), 0)


def customers(spark: SparkSession, sf_dir: str) -> SparseTensor:
    """Customers by nation and market segment."""
    segment = F.array_position(F.array(*[F.lit(s) for s in SEGMENTS]), F.col("c_mktsegment")) - 1
    return tensor(load(spark, sf_dir, "customer").select("c_nationkey", segment, F.lit(1).cast("bigint")), (NATIONS, len(SEGMENTS)), 0)


def order_cube(spark: SparkSession, sf_dir: str) -> SparseTensor:
    """Orders by nation, segment and priority."""
    c, o = load(spark, sf_dir, "customer"), load(spark, sf_dir, "orders")
    segment = F.array_position(F.array(*[F.lit(s) for s in SEGMENTS]), F.col("c_mktsegment")) - 1
    priority = F.array_position(F.array(*[F.lit(p) for p in PRIORITIES]), F.col("o_orderpriority")) - 1
    joined = o.join(c, F.col("o_custkey") == F.col("c_custkey")).select("c_nationkey", segment, priority, F.lit(1).cast("bigint"))
    return tensor(joined, (NATIONS, len(SEGMENTS), len(PRIORITIES)), 0)


def trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(s, t, r): buying nation, selling nation, rank 1 to 3 by quantity."""
    l, o = load(spark, sf_dir, "lineitem"), load(spark, sf_dir, "orders")  # noqa: E741
    c, s = load(spark, sf_dir, "customer"), load(spark, sf_dir, "supplier")
    by_pair = (
        l.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
        .groupBy("o_custkey", "l_suppkey")
        .agg(F.sum("l_quantity").alias("q"))
        .join(c, F.col("o_custkey") == F.col("c_custkey"))
        .join(s, F.col("l_suppkey") == F.col("s_suppkey"))
        .groupBy(F.col("c_nationkey").cast("long").alias("s"), F.col("s_nationkey").cast("long").alias("t"))
        .agg(F.sum("q").alias("q"))
    )
    ranked = by_pair.where("s <> t").withColumn("r", F.row_number().over(Window.partitionBy("s").orderBy(F.desc("q"), "t")))
    return cut(ranked.where("r <= 3").select("s", "t", F.col("r").cast("long").alias("r")))


TRADE = """
trade AS (
    SELECT s, t, CAST(r AS BIGINT) AS r FROM (
        SELECT s, t, row_number() OVER (PARTITION BY s ORDER BY q DESC, t) AS r FROM (
            SELECT CAST(c_nationkey AS BIGINT) AS s, CAST(s_nationkey AS BIGINT) AS t, sum(l_quantity) AS q
            FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
            GROUP BY ALL
        ) WHERE s <> t
    ) WHERE r <= 3
), pairs AS (SELECT DISTINCT s, t FROM (SELECT s, t FROM trade UNION ALL SELECT t, s FROM trade))
"""
NODES = "nodes AS (SELECT CAST(range AS BIGINT) AS i FROM range(25))"
SEGMENT_CASE = "list_position(['" + "', '".join(SEGMENTS) + "'], c_mktsegment) - 1"
CELLS = "cells AS (SELECT n.range AS i0, s.range AS i1 FROM range(25) n, range(5) s)"
BALANCE = f"b AS (SELECT i0, i1, coalesce(v, 0) AS v FROM (SELECT * FROM cells) LEFT JOIN (SELECT c_nationkey AS i0, {SEGMENT_CASE} AS i1, CAST(sum(CAST(round(c_acctbal) AS BIGINT)) AS BIGINT) AS v FROM customer GROUP BY ALL) USING (i0, i1))"
COUNTS = f"c AS (SELECT i0, i1, coalesce(v, 0) AS v FROM (SELECT * FROM cells) LEFT JOIN (SELECT c_nationkey AS i0, {SEGMENT_CASE} AS i1, count(*) AS v FROM customer GROUP BY ALL) USING (i0, i1))"


def directed(spark: SparkSession, sf_dir: str, fill: float = 0.0) -> SparseTensor:
    return SparseTensor(trade(spark, sf_dir).select(F.col("s").alias("i0"), F.col("t").alias("i1"), F.col("r").cast("double").alias("v")), (NATIONS, NATIONS), fill)


def undirected(spark: SparkSession, sf_dir: str) -> SparseTensor:
    e = trade(spark, sf_dir)
    both = e.select("s", "t").union(e.select("t", "s")).distinct()
    return SparseTensor(cut(both.select(F.col("s").alias("i0"), F.col("t").alias("i1"), F.lit(1.0).alias("v"))), (NATIONS, NATIONS), 0.0)


# --- products and contractions --------------------------------------------------

SUPPLY = "a AS (SELECT l_partkey AS p, l_suppkey AS s, sum(l_quantity) AS q FROM lineitem GROUP BY ALL)"


@query(f"WITH {SUPPLY} SELECT x.s AS i0, y.s AS i1, sum(x.q * y.q) AS v FROM a x JOIN a y USING (p) GROUP BY ALL")
def gram_supplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(einsum("C[j,k] += A[i,j] * A[i,k]", A=supply(spark, sf_dir)))


@query(f"WITH {SUPPLY} SELECT p AS i0, round(sum(q * s_acctbal), 4) AS v FROM a JOIN supplier ON s = s_suppkey GROUP BY ALL")
def spmv_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = supply(spark, sf_dir)
    x = tensor(load(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal"), (a.shape[1],), 0.0)
    return rows(linear.matmul(a, x), 4)


@query(f"WITH {SUPPLY} SELECT s AS i0, round(sum(q * p_retailprice), 2) AS v FROM a JOIN part ON p = p_partkey GROUP BY ALL")
def spmv_transposed(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = supply(spark, sf_dir)
    x = tensor(load(spark, sf_dir, "part").select("p_partkey", "p_retailprice"), (a.shape[0],), 0.0)
    return rows(linear.matmul(linear.transpose(a), x), 2)


@query(
    f"""WITH {SUPPLY} SELECT 'norm' AS name, round(sqrt(sum(q * q)), 4) AS v FROM a
    UNION ALL SELECT 'vecdot', round(sum(s_acctbal * s_acctbal), 2) FROM supplier
    UNION ALL SELECT 'trace', sum(q) FROM a WHERE p = s"""
)
def scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = supply(spark, sf_dir)
    x = tensor(load(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal"), (a.shape[1],), 0.0)
    trace = linear.reduce(linear.diagonal(a), "sum").item()
    return spark.createDataFrame([("norm", round(linear.norm(a), 4)), ("vecdot", round(linear.vecdot(x, x), 2)), ("trace", float(trace))], "name string, v double")


CUBE = f"""x AS (SELECT CAST(c_nationkey AS BIGINT) AS i, {SEGMENT_CASE} AS j, list_position(['{"', '".join(PRIORITIES)}'], o_orderpriority) - 1 AS k, count(*) AS v
    FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL), r AS (SELECT CAST(range AS BIGINT) AS r FROM range(3))"""


def small_factor(spark: SparkSession, n: int, a: int) -> SparseTensor:
    """Entries (row * a + column + 1) mod 7, a stated small factor."""
    import numpy as np

    return from_numpy(spark, np.fromfunction(lambda i, r: (i * a + r + 1) % 7, (n, 3), dtype=int), keep_all=True)


@query(f"WITH {CUBE} SELECT i AS i0, r AS i1, CAST(sum(v * ((j * 2 + r + 1) % 7) * ((k * 3 + r + 1) % 7)) AS BIGINT) AS v FROM x, r GROUP BY ALL")
def mttkrp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(einsum("M[i,r] += X[i,j,k] * B[j,r] * C[k,r]", X=order_cube(spark, sf_dir), B=small_factor(spark, 5, 2), C=small_factor(spark, 5, 3)))


@query(
    f"""WITH {CUBE} SELECT CAST(p.r AS BIGINT) AS i0, CAST(q.r AS BIGINT) AS i1, CAST(s.r AS BIGINT) AS i2, CAST(sum(v * ((i * 4 + p.r + 1) % 7) * ((j * 2 + q.r + 1) % 7) * ((k * 3 + s.r + 1) % 7)) AS BIGINT) AS v
    FROM x, r p, r q, r s GROUP BY ALL"""
)
def tucker_core(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(einsum("G[p,q,r] += X[i,j,k] * A[i,p] * B[j,q] * C[k,r]", X=order_cube(spark, sf_dir), A=small_factor(spark, NATIONS, 4), B=small_factor(spark, 5, 2), C=small_factor(spark, 5, 3)))


@query(f"WITH {CELLS}, {BALANCE}, {COUNTS} SELECT i0, i1, b.v + c.v AS s, b.v - c.v AS d, b.v * c.v AS p, CASE WHEN c.v = 0 THEN NULL ELSE round(b.v / c.v, 6) END AS q FROM b JOIN c USING (i0, i1)")
def einsum_arithmetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, c = balances(spark, sf_dir), customers(spark, sf_dir)
    out = None
    for name, op in (("s", "+"), ("d", "-"), ("p", "*"), ("q", "/")):
        t = einsum(f"D[i,j] = B[i,j] {op} C[i,j]", B=b, C=c).dense().df.withColumnRenamed("v", name)
        out = t if out is None else out.join(t, ["i0", "i1"])
    finite = ~F.isnan("q") & (F.abs("q") != float("inf"))
    return out.withColumn("q", F.when(finite, F.round("q", 6)))


@query(
    f"""WITH {CELLS}, {BALANCE}, {COUNTS} SELECT i0, i1, b.v - 1000 * CAST(floor(b.v / 1000) AS BIGINT) AS m, CAST(floor(b.v / 1000) AS BIGINT) AS f, (c.v & 12) | 3 AS bits,
    xor(c.v, 5) AS x, c.v << 2 AS l, b.v >> 3 AS r, (b.v > 0 AND c.v > 3) OR NOT c.v <> 0 AS logic, 10 < c.v AND c.v <= 14 AS chain FROM b JOIN c USING (i0, i1)"""
)
def einsum_integers(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, c = balances(spark, sf_dir), customers(spark, sf_dir)
    programs = {"m": "B[i,j] % 1000", "f": "B[i,j] // 1000", "bits": "C[i,j] & 12 | 3", "x": "C[i,j] ^ 5", "l": "C[i,j] << 2", "r": "B[i,j] >> 3", "logic": "B[i,j] > 0 and C[i,j] > 3 or not C[i,j]", "chain": "10 < C[i,j] <= 14"}
    out = None
    for name, p in programs.items():
        t = einsum(f"D[i,j] = {p}", B=b, C=c).dense().df.withColumnRenamed("v", name)
        out = t if out is None else out.join(t, ["i0", "i1"])
    return out


UNARY = {
    "sqrt": "sqrt(v)", "exp": "exp(v / 100)", "log1p": "ln(1 + v)", "sin": "sin(v)", "cos": "cos(v)", "tanh": "(exp(2 * v / 100) - 1) / (exp(2 * v / 100) + 1)", "atan": "atan(v)", "asinh": "ln(v + sqrt(v * v + 1))",
}


@query(f"WITH {CELLS}, {COUNTS} SELECT i0, i1, {', '.join(f'round({e}, 9) AS {n}' for n, e in UNARY.items())} FROM c")
def einsum_unary(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, out = customers(spark, sf_dir), None
    for name in UNARY:
        arg = "C[i,j] / 100" if name in ("exp", "tanh") else "C[i,j]"
        t = einsum(f"D[i,j] = {name}({arg})", C=c).dense().df.select("i0", "i1", F.round("v", 9).alias(name))
        out = t if out is None else out.join(t, ["i0", "i1"])
    return out


@query(
    f"""WITH {CELLS}, {BALANCE} SELECT i0, CAST(sum(v) AS BIGINT) AS a_sum, min(v) AS a_min, max(v) AS a_max, round(avg(v), 6) AS a_mean, round(var_pop(v), 2) AS a_var, round(stddev_pop(v), 4) AS a_std,
    count(*) FILTER (WHERE v <> 0) AS a_nonzero, bool_and(v <> 0) AS a_all, bool_or(v < 0) AS a_any, arg_min(i1, (v, i1)) AS a_argmin, arg_max(i1, (v, -i1)) AS a_argmax FROM b GROUP BY i0"""
)
def einsum_reductions(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, out = balances(spark, sf_dir), None
    for name, op, e, digits in (("a_sum", "+", "B[i,j]", None), ("a_min", "min", "B[i,j]", None), ("a_max", "max", "B[i,j]", None), ("a_mean", "mean", "B[i,j]", 6), ("a_var", "var", "B[i,j]", 2), ("a_std", "std", "B[i,j]", 4), ("a_nonzero", "count_nonzero", "B[i,j]", None), ("a_all", "and", "B[i,j]", None), ("a_any", "or", "B[i,j] < 0", None), ("a_argmin", "argmin", "B[i,j]", None), ("a_argmax", "argmax", "B[i,j]", None)):
        t = einsum(f"R[i] {op}= {e}", B=b).dense().df
        t = t.select("i0", (F.col("v") if digits is None else F.round("v", digits)).alias(name))
        out = t if out is None else out.join(t, "i0")
    return out


@query(f"WITH {CELLS}, {BALANCE} SELECT i0, i1, v, row_number() OVER (PARTITION BY i0 ORDER BY v, i1) - 1 AS rank FROM b")
def argsort_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linear.ranked(balances(spark, sf_dir)).select("i0", "i1", "v", F.col("rank").cast("long").alias("rank"))


@query(f"WITH {CELLS}, {BALANCE} SELECT (i1 * 25 + i0) // 25 AS i0, ((i1 * 25 + i0) % 25 + 2) % 25 AS i1, v FROM b WHERE v <> 0")
def transpose_roll(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = linear.reshape(linear.reshape(linear.transpose(balances(spark, sf_dir)), (-1,)), (5, NATIONS))
    return rows(linear.roll(t, 2, axis=1).pruned())


# --- graphs ---------------------------------------------------------------------


@query(f"WITH RECURSIVE {TRADE}, walk AS (SELECT 0::BIGINT AS i, 1::BIGINT AS level UNION SELECT t, level + 1 FROM walk JOIN trade ON i = s WHERE level < 26) SELECT i AS i0, min(level) AS v FROM walk GROUP BY i")
def bfs_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(graph.bfs_levels(directed(spark, sf_dir), 0))


@query(f"WITH RECURSIVE {TRADE}, walk AS (SELECT 0::BIGINT AS i, 0::BIGINT AS d UNION SELECT t, d + r FROM walk JOIN trade ON i = s WHERE d < 76) SELECT i AS i0, CAST(min(d) AS DOUBLE) AS v FROM walk GROUP BY i")
def bellman_ford(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(graph.bellman_ford(directed(spark, sf_dir, math.inf), 0))


@query(f"WITH RECURSIVE {NODES}, {TRADE}, walk AS (SELECT i AS o, i, 0::BIGINT AS d FROM nodes UNION SELECT o, t, d + r FROM walk JOIN trade ON i = s WHERE d < 76) SELECT o AS i0, i AS i1, CAST(min(d) AS DOUBLE) AS v FROM walk GROUP BY ALL")
def all_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(graph.all_pairs(directed(spark, sf_dir, math.inf)))


CLOSURE = f"WITH RECURSIVE {NODES}, {TRADE}, reach AS (SELECT i AS s, i AS t FROM nodes UNION SELECT reach.s, trade.t FROM reach JOIN trade ON reach.t = trade.s)"


@query(f"{CLOSURE} SELECT s AS i0, t AS i1, true AS v FROM reach")
def closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(graph.closure(directed(spark, sf_dir)))


@query(f"{CLOSURE} SELECT a.s AS i0, min(a.t) AS v FROM reach a JOIN reach b ON a.s = b.t AND a.t = b.s GROUP BY a.s")
def strong_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(graph.strong_components(directed(spark, sf_dir)))


@query(f"WITH RECURSIVE {NODES}, {TRADE}, reach AS (SELECT i AS s, i AS t FROM nodes UNION SELECT reach.s, pairs.t FROM reach JOIN pairs ON reach.t = pairs.s) SELECT s AS i0, min(t) AS v FROM reach GROUP BY s")
def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(graph.components(undirected(spark, sf_dir)))


@query(
    f"""WITH {TRADE}, e AS (SELECT s, t FROM pairs WHERE s < t)
    SELECT 'triangles' AS name, CAST(count(*) AS DOUBLE) AS v FROM e a JOIN e b ON a.t = b.s JOIN e c ON c.s = a.s AND c.t = b.t
    UNION ALL SELECT 'four_cliques', CAST(count(*) AS DOUBLE) FROM e a JOIN e b ON a.t = b.s JOIN e c ON c.s = a.s AND c.t = b.t JOIN e d ON d.s = b.t JOIN e f ON f.s = a.s AND f.t = d.t JOIN e g ON g.s = b.s AND g.t = d.t"""
)
def cliques(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = undirected(spark, sf_dir)
    return spark.createDataFrame([("triangles", graph.triangles(a)), ("four_cliques", graph.four_cliques(a))], "name string, v double")


def _pagerank_sql(rounds: int) -> str:
    steps = [f"WITH {NODES}, {TRADE}, out AS (SELECT t AS j, sum(r) AS o FROM trade GROUP BY t), x0 AS MATERIALIZED (SELECT i, 1 / 25.0::DOUBLE AS x FROM nodes)"]
    for k in range(rounds):
        steps.append(f"x{k + 1} AS MATERIALIZED (SELECT n.i, 0.15::DOUBLE / 25 + 0.85::DOUBLE * (coalesce(y, 0) + (SELECT coalesce(sum(x), 0) FROM x{k} WHERE i NOT IN (SELECT j FROM out)) / 25) AS x FROM nodes n LEFT JOIN (SELECT s AS i, sum(r / o * x) AS y FROM trade JOIN out ON t = j JOIN x{k} ON x{k}.i = t GROUP BY s) USING (i))")
    return ", ".join(steps) + f" SELECT i AS i0, round(x, 9) AS v FROM x{rounds}"


@query(_pagerank_sql(6))
def pagerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(graph.pagerank(directed(spark, sf_dir), max_iter=6, tol=0.0), 9)


def _betweenness_sql(depth: int) -> str:
    parts = [f"WITH {NODES}, {TRADE}, g0 AS MATERIALIZED (SELECT i AS o, i AS x, 0 AS d, 1::DOUBLE AS p FROM nodes), all0 AS (SELECT * FROM g0)"]
    for k in range(1, depth):
        parts.append(f"g{k} AS MATERIALIZED (SELECT o, t AS x, {k} AS d, sum(p) AS p FROM g{k - 1} JOIN trade ON x = s WHERE NOT EXISTS (SELECT 1 FROM all{k - 1} a WHERE a.o = g{k - 1}.o AND a.x = trade.t) GROUP BY o, t), all{k} AS MATERIALIZED (SELECT * FROM all{k - 1} UNION ALL SELECT * FROM g{k})")
    last = f"all{depth - 1}"
    return ", ".join(parts) + f" SELECT b.x AS i0, round(sum(a.p * b.p / c.p), 6) AS v FROM (SELECT o, x, d, p FROM {last}) b JOIN {last} a ON a.o = b.x JOIN {last} c ON c.o = b.o AND c.x = a.x WHERE b.x <> b.o AND a.x <> b.x AND b.d + a.d = c.d GROUP BY b.x"


@query(_betweenness_sql(12))
def betweenness(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = directed(spark, sf_dir)
    return rows(graph.betweenness(e.with_df(e.df.withColumn("v", F.lit(1.0)))).pruned(), 6)


@query(
    f"""WITH {TRADE}, two AS (SELECT a.s, b.t, min(a.r + b.r) AS n FROM trade a JOIN trade b ON a.t = b.s GROUP BY ALL), top AS (SELECT s, max(r) AS top FROM trade GROUP BY s)
    SELECT s AS i0, t AS i1, CAST(r AS DOUBLE) AS v FROM trade WHERE NOT EXISTS (SELECT 1 FROM two JOIN top USING (s) WHERE two.s = trade.s AND two.t = trade.t AND top + 1 >= n)"""
)
def transitive_reduction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(graph.transitive_reduction(directed(spark, sf_dir, math.inf), 1, 1))


def _mcl_sql(rounds: int) -> str:
    norm = lambda src: f"SELECT i, j, v / sum(v) OVER (PARTITION BY j) AS v FROM ({src})"
    parts = [f"WITH {NODES}, {TRADE}, m0 AS MATERIALIZED ({norm('SELECT i, j, sum(v) AS v FROM (SELECT s AS i, t AS j, 1::DOUBLE AS v FROM pairs UNION ALL SELECT i, i, 1 FROM nodes) GROUP BY ALL')})"]
    for k in range(rounds):
        grown = f"SELECT a.i, b.j, power(sum(a.v * b.v), 2) AS v FROM m{k} a JOIN m{k} b ON a.j = b.i GROUP BY ALL"
        parts.append(f"n{k} AS MATERIALIZED ({norm(grown)}), m{k + 1} AS MATERIALIZED (SELECT i, j, v FROM (SELECT *, max(v) OVER (PARTITION BY j) AS top FROM n{k}) WHERE v >= 1e-5 OR (v = top AND v > 0))")
    return ", ".join(parts) + f" SELECT i AS i0, j AS i1, round(v, 8) AS v FROM m{rounds}"


@query(_mcl_sql(3))
def markov_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(graph.markov_clustering(undirected(spark, sf_dir), iterations=3), 8)


# --- solvers: A x for the x that solves A x = b gives b back --------------------

RHS = "SELECT CAST(n_nationkey AS BIGINT) AS i0, coalesce(v, 0) AS v FROM nation LEFT JOIN (SELECT s_nationkey AS n_nationkey, round(sum(s_acctbal) / 1000, 3) AS v FROM supplier GROUP BY ALL) USING (n_nationkey)"


def system(spark: SparkSession, sf_dir: str) -> tuple[SparseTensor, SparseTensor, SparseTensor]:
    """Laplacian of the undirected trade graph plus the identity, and suppliers' balances by nation."""
    e = undirected(spark, sf_dir).df
    degree = spark.range(NATIONS).withColumnRenamed("id", "i0").join(e.groupBy("i0").count(), "i0", "left").select("i0", F.col("i0").alias("i1"), (F.coalesce("count", F.lit(0)) + 1.0).alias("v"))
    a = SparseTensor(cut(degree.union(e.select("i0", "i1", -F.col("v")))), (NATIONS, NATIONS), 0.0)
    s = load(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").cast("long").alias("i0")).agg(F.round(F.sum("s_acctbal") / 1000, 3).alias("v"))
    return a, SparseTensor(cut(s), (NATIONS,), 0.0), linear.zeros(spark, (NATIONS,))


def checked(a: SparseTensor, x: SparseTensor) -> DataFrame:
    product = linear.matmul(a, x).dense().df
    return product.select("i0", (F.round("v", 3) + 0.0).alias("v"))


@query(RHS)
def solve_cg(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b, x = system(spark, sf_dir)
    return checked(a, solvers.conjugate_gradient(a, b, x, 1e-9))


@query(RHS)
def solve_diagonal_pcg(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b, x = system(spark, sf_dir)
    return checked(a, solvers.preconditioned_cg(a, b, x, solvers.diagonal_preconditioner(a), 1e-9))


@query(RHS)
def solve_block_pcg(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b, x = system(spark, sf_dir)
    return checked(a, solvers.preconditioned_cg(a, b, x, solvers.block_preconditioner(solvers.block_cholesky(a)), 1e-9))


@query(RHS)
def solve_jacobi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jacobi on the strongly dominant shift A + 6 I, whose solution is multiplied back."""
    a, b, x = system(spark, sf_dir)
    shifted = einsum("S[i,j] = A[i,j] + 6 * E[i,j]", A=a, E=linear.eye(spark, NATIONS))
    return checked(shifted, solvers.jacobi(shifted, b, x, 1e-7))


@query(RHS)
def solve_gmres(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b, x = system(spark, sf_dir)
    return checked(a, solvers.gmres(a, b, x, restart=25, tol=1e-9))


@query(RHS)
def solve_lsqr(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b, _ = system(spark, sf_dir)
    return checked(a, solvers.lsqr(a, b)[0])


# --- decompositions and learning ------------------------------------------------


GCN = f"""WITH {NODES}, {TRADE}, x AS (SELECT CAST(c_nationkey AS BIGINT) AS i, count(*) / 10.0::DOUBLE AS f0, sum(c_acctbal) / 100000.0::DOUBLE AS f1 FROM customer GROUP BY ALL),
h AS (SELECT n.i, greatest(coalesce(z0, 0) * 0.5 - coalesce(z1, 0) * 0.25 + 0.1, 0) AS h0, greatest(coalesce(z0, 0) * 0.1 + coalesce(z1, 0) * 0.3 - 0.2, 0) AS h1 FROM nodes n LEFT JOIN (SELECT s AS i, sum(r * f0) AS z0, sum(r * f1) AS z1 FROM trade JOIN x ON t = x.i GROUP BY s) USING (i))
SELECT n.i AS i0, round(coalesce(y, 0) + 0.5, 6) AS v FROM nodes n LEFT JOIN (SELECT s AS i, sum(r * (h0 + 2 * h1)) AS y FROM trade JOIN h ON t = h.i GROUP BY s) USING (i)"""


def features(spark: SparkSession, sf_dir: str) -> SparseTensor:
    c = load(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").cast("long").alias("i0")).agg((F.count(F.lit(1)) / 10.0).alias("a"), (F.sum("c_acctbal") / 100000.0).alias("b"))
    both = c.select("i0", F.explode(F.array(F.struct(F.lit(0).cast("long").alias("i1"), F.col("a").alias("v")), F.struct(F.lit(1).cast("long").alias("i1"), F.col("b").alias("v")))).alias("x"))
    return SparseTensor(cut(both.select("i0", "x.i1", "x.v")), (NATIONS, 2), 0.0)


@query(GCN)
def gcn_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    y = learning.gcn(directed(spark, sf_dir), features(spark, sf_dir), [[0.5, 0.1], [-0.25, 0.3]], [0.1, -0.2], [[1.0], [2.0]], [0.5])
    return y.df.select("i0", F.round("v", 6).alias("v"))


def embedding_tensor(df: DataFrame, n: int, d: int = 64) -> SparseTensor:
    cells = df.select(F.col("row").alias("i0"), F.posexplode("embedding").alias("p", "v")).select("i0", F.col("p").cast("long").alias("i1"), F.col("v").cast("double").alias("v"))
    return SparseTensor(cells, (n, d), 0.0)


@query(
    """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)
    SELECT q.vec_id AS query, rank, neighbour, distance FROM (
        SELECT q.vec_id, v.vec_id AS neighbour, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_distance(q.e, v.e), v.vec_id) - 1 AS rank, round(list_distance(q.e, v.e), 6) AS distance FROM v q, v WHERE q.vec_id % 50 = 0
    ) q WHERE rank < 5"""
)
def nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors of every vector whose id is divisible by 50."""
    e = load(spark, sf_dir, "embeddings")
    n = e.count()
    found = learning.nearest(embedding_tensor(e.withColumn("row", F.col("vec_id")), n), embedding_tensor(e.where("vec_id % 50 = 0").withColumn("row", (F.col("vec_id") / 50).cast("long")), -(-n // 50)), None, 5)
    return found.select((F.col("query") * 50).alias("query"), F.col("rank").cast("long").alias("rank"), "neighbour", F.round("distance", 6).alias("distance"))


def _k_means_sql(k: int, rounds: int) -> str:
    parts = [f"WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), c0 AS (SELECT vec_id AS j, e AS c FROM v WHERE vec_id < {k})"]
    for r in range(rounds):
        parts.append(f"l{r} AS MATERIALIZED (SELECT vec_id, e, arg_min(j, (d, j)) AS j FROM (SELECT vec_id, e, j, list_distance(e, c) AS d FROM v, c{r}) GROUP BY vec_id, e)")
        parts.append(f"c{r + 1} AS MATERIALIZED (SELECT j, list(x ORDER BY p) AS c FROM (SELECT j, p, avg(x) AS x FROM (SELECT j, unnest(e) AS x, generate_subscripts(e, 1) AS p FROM l{r}) GROUP BY j, p) GROUP BY j)")
    return ", ".join(parts) + f" SELECT vec_id AS i0, j AS v FROM l{rounds - 1}"


@query(_k_means_sql(4, 3))
def k_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "embeddings")
    return rows(learning.k_means(embedding_tensor(e.withColumn("row", F.col("vec_id")), e.count()), 4, 3))


# --- simulation -----------------------------------------------------------------


def _grid_sql(steps: int, next_: str) -> str:
    parts = ["WITH u0 AS (SELECT CAST(n_nationkey AS BIGINT) AS x, coalesce(u, 0) AS u FROM nation LEFT JOIN (SELECT c_nationkey AS n_nationkey, sum(c_acctbal) / 3141592.65::DOUBLE AS u FROM customer GROUP BY ALL) USING (n_nationkey))"]
    for k in range(steps):
        parts.append(f"u{k + 1} AS MATERIALIZED (SELECT m.x, {next_} AS u FROM u{k} m JOIN u{k} r ON r.x = (m.x + 1) % 25 JOIN u{k} l ON l.x = (m.x + 24) % 25)")
    return ", ".join(parts) + " " + " UNION ALL ".join(f"SELECT {k}::BIGINT AS i0, x AS i1, round(u, 9) AS v FROM u{k}" for k in range(steps + 1))


def initial(spark: SparkSession, sf_dir: str) -> SparseTensor:
    c = load(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").cast("long").alias("i0")).agg((F.sum("c_acctbal") / 3141592.65).alias("v"))
    return SparseTensor(cut(c), (NATIONS,), 0.0)


@query(_grid_sql(4, "0.5 * (r.u + l.u) - 0.25 * (0.5 * r.u * r.u - 0.5 * l.u * l.u)"))
def lax_friedrichs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(simulation.lax_friedrichs(initial(spark, sf_dir), 0.5, 1.0, simulation.burgers, 4), 9)


@query(_grid_sql(4, "0.5 * (r.u + l.u) - 0.45 * (r.u - l.u)"))
def lax_friedrichs_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = simulation.lax_friedrichs_matrix(spark, NATIONS, 1.0, 1.0, 0.9)
    return rows(simulation.lax_friedrichs_by_matrix(initial(spark, sf_dir), m, 4), 9)


PARTICLES = """WITH p AS (SELECT c_custkey AS pid, (c_acctbal + 1000) / 11000 AS x, (c_custkey * 7919 % 1000) / 1000.0::DOUBLE AS y, 0.5::DOUBLE AS vx, -0.25::DOUBLE AS vy FROM customer),
f AS (SELECT a.pid, sum((1 - 0.01 / sqrt(greatest(r2, 1e-8))) / greatest(r2, 1e-8) / 0.01 * dx) AS fx, sum((1 - 0.01 / sqrt(greatest(r2, 1e-8))) / greatest(r2, 1e-8) / 0.01 * dy) AS fy
    FROM (SELECT a.pid, b.x - a.x AS dx, b.y - a.y AS dy, (b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y) AS r2 FROM p a JOIN p b ON a.pid <> b.pid AND b.x BETWEEN a.x - 0.011 AND a.x + 0.011) a WHERE r2 <= 0.01 * 0.01 GROUP BY a.pid),
m AS (SELECT pid, x, y, vx + coalesce(fx, 0) * 0.0005 AS vx, vy + coalesce(fy, 0) * 0.0005 AS vy FROM p LEFT JOIN f USING (pid)), n AS (SELECT pid, x + vx * 0.0005 AS x, y + vy * 0.0005 AS y, vx, vy FROM m)
SELECT pid, round(CASE WHEN x > 1 THEN 2 - x ELSE abs(x) END, 6) AS x, round(CASE WHEN y > 1 THEN 2 - y ELSE abs(y) END, 6) AS y, round(CASE WHEN x < 0 OR x > 1 THEN -vx ELSE vx END, 3) AS vx, round(CASE WHEN y < 0 OR y > 1 THEN -vy ELSE vy END, 3) AS vy FROM n"""


@query(PARTICLES)
def particle_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = load(spark, sf_dir, "customer")
    p = c.select(F.col("c_custkey").alias("pid"), ((F.col("c_acctbal") + 1000) / 11000).alias("x"), ((F.col("c_custkey") * 7919 % 1000) / 1000.0).alias("y"), F.lit(0.5).alias("vx"), F.lit(-0.25).alias("vy"))
    out = simulation.particles(p, 1.0, 1)
    return out.select("pid", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), F.round("vx", 3).alias("vx"), F.round("vy", 3).alias("vy"))


@query("WITH RECURSIVE y AS (SELECT CAST(r_regionkey AS BIGINT) AS run, 0::BIGINT AS k, 0.0::DOUBLE AS y, r_regionkey FROM region UNION ALL SELECT run, k + 1, y + (5 - y) / (1 + r_regionkey) * 0.125, r_regionkey FROM y WHERE k < 7) SELECT run, k, k * 0.125::DOUBLE AS t, round(y, 9) AS y FROM y")
def euler(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An RC circuit for every region, with its own time constant."""
    r = load(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("run"), (F.col("r_regionkey") + 1.0).alias("r"), F.lit(1.0).alias("c"), F.lit(1.0).alias("t_end"), F.lit(0.125).alias("step"), F.array(F.lit(0.0)).alias("y0"))
    out = simulation.euler_scenarios(r, "rc")
    return out.select("run", "k", "t", F.round(F.col("y")[0], 9).alias("y"))


@query("SELECT time_bucket(INTERVAL 1 hour, ts) AS start, user_id AS i0, round(sum(value), 4) AS v FROM events GROUP BY ALL")
def windowed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The streaming operator over the whole table as one batch."""
    return windowed_cells(load(spark, sf_dir, "events"), ["user_id"], "value").withColumn("v", F.round("v", 4))


from . import market, surface  # noqa: E402, F401  (they register more)

__all__ = ["ORACLES", "QUERIES"]
