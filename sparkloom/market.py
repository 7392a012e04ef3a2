"""Graph and solver queries on graphs that grow with the tables, run to convergence.

The market: customers 0, 1, ... and, after them, suppliers. Line items of 48 pieces or more join a
customer and a supplier; an even part goes from the customer to the supplier, an odd one back, and
an edge weighs 1 to 5 by its lightest part. The partners: suppliers, each joined to the four
with which it most often serves one order.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .operators import graph, learning, linear, solvers
from .registry import load, query, rows
from .storage import cut
from .tensor import SparseTensor


def market(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int, int]:
    """Edges (s, t, w), and the numbers of customers and suppliers."""
    people, firms = load(spark, sf_dir, "customer").count(), load(spark, sf_dir, "supplier").count()
    l = load(spark, sf_dir, "lineitem").where("l_quantity >= 48").select("l_orderkey", "l_suppkey", "l_partkey")  # noqa: E741
    o = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    both = l.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    out, firm = F.col("l_partkey") % 2 == 0, F.col("l_suppkey") + people
    ends = both.select(F.when(out, F.col("o_custkey")).otherwise(firm).alias("s"), F.when(out, firm).otherwise(F.col("o_custkey")).alias("t"), (F.col("l_partkey") % 5 + 1).alias("w"))
    return cut(ends.groupBy("s", "t").agg(F.min("w").cast("double").alias("w"))), people, firms


MARKET = """size AS (SELECT (SELECT count(*) FROM customer) AS people, (SELECT count(*) FROM supplier) AS firms),
market AS MATERIALIZED (SELECT s, t, CAST(min(w) AS DOUBLE) AS w FROM (
    SELECT CASE WHEN l_partkey % 2 = 0 THEN o_custkey ELSE l_suppkey + people END AS s, CASE WHEN l_partkey % 2 = 0 THEN l_suppkey + people ELSE o_custkey END AS t, l_partkey % 5 + 1 AS w
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey, size WHERE l_quantity >= 48) GROUP BY ALL),
nodes AS MATERIALIZED (SELECT CAST(range AS BIGINT) AS i FROM range((SELECT people + firms FROM size))),
links AS MATERIALIZED (SELECT DISTINCT s, t FROM (SELECT s, t FROM market UNION ALL SELECT t, s FROM market))"""


def directed(spark: SparkSession, sf_dir: str, fill: float = 0.0) -> tuple[SparseTensor, int]:
    """The market, and the vertex of the first supplier."""
    e, people, firms = market(spark, sf_dir)
    return SparseTensor(e.toDF("i0", "i1", "v"), (people + firms,) * 2, fill), people


def undirected(spark: SparkSession, sf_dir: str) -> SparseTensor:
    e, people, firms = market(spark, sf_dir)
    both = e.select("s", "t").union(e.select("t", "s")).distinct()
    return SparseTensor(cut(both.select(F.col("s").alias("i0"), F.col("t").alias("i1"), F.lit(1.0).alias("v"))), (people + firms,) * 2, 0.0)


@query(f"WITH RECURSIVE {MARKET}, walk AS (SELECT people AS i, 1::BIGINT AS level FROM size UNION SELECT t, level + 1 FROM walk JOIN market ON i = s WHERE level < 40) SELECT i AS i0, min(level) AS v FROM walk GROUP BY i")
def market_bfs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(graph.bfs_levels(*directed(spark, sf_dir)))


@query(f"WITH RECURSIVE {MARKET}, walk AS (SELECT people AS i, 0::DOUBLE AS d FROM size UNION SELECT t, d + w FROM walk JOIN market ON i = s WHERE d < 80) SELECT i AS i0, min(d) AS v FROM walk GROUP BY i")
def market_bellman_ford(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(graph.bellman_ford(*directed(spark, sf_dir, math.inf)))


@query(f"WITH RECURSIVE {MARKET}, reach AS (SELECT i AS a, i AS b FROM nodes UNION SELECT reach.a, links.t FROM reach JOIN links ON reach.b = links.s) SELECT a AS i0, min(b) AS v FROM reach GROUP BY a")
def market_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(graph.components(undirected(spark, sf_dir)))


def _pagerank(rounds: int) -> str:
    """Rounds of the power iteration, rank as a table of its own each."""
    steps = [f"WITH {MARKET}, out AS MATERIALIZED (SELECT t AS j, sum(w) AS o FROM market GROUP BY t), n AS (SELECT count(*)::DOUBLE AS n FROM nodes), x0 AS MATERIALIZED (SELECT i, 1 / n AS x FROM nodes, n)"]
    for k in range(rounds):
        lost = f"(SELECT coalesce(sum(x), 0) FROM x{k} WHERE i NOT IN (SELECT j FROM out))"
        steps.append(f"x{k + 1} AS MATERIALIZED (SELECT a.i, 0.15::DOUBLE / n + 0.85::DOUBLE * (coalesce(y, 0) + {lost} / n) AS x FROM nodes a CROSS JOIN n LEFT JOIN (SELECT s AS i, sum(w / o * x) AS y FROM market JOIN out ON t = j JOIN x{k} ON x{k}.i = t GROUP BY s) b ON a.i = b.i)")
    return ", ".join(steps) + f" SELECT i AS i0, round(x, 6) AS v FROM x{rounds}"


@query(_pagerank(90))
def market_pagerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """To the default tolerance; the SQL takes more rounds than that needs."""
    return rows(graph.pagerank(directed(spark, sf_dir)[0]), 6)


def _reduction(rounds: int) -> str:
    steps = [f"WITH {MARKET}, r0 AS (SELECT * FROM market)"]
    for k in range(rounds):
        steps.append(f"r{k + 1} AS MATERIALIZED (SELECT * FROM r{k} WHERE NOT EXISTS (SELECT 1 FROM (SELECT a.s, b.t, min(a.w + b.w) AS n FROM r{k} a JOIN r{k} b ON a.t = b.s GROUP BY ALL) two JOIN (SELECT s, max(w) AS top FROM r{k} GROUP BY s) USING (s) WHERE two.s = r{k}.s AND two.t = r{k}.t AND top + 2 >= n))")
    return ", ".join(steps) + f" SELECT s AS i0, t AS i1, w AS v FROM r{rounds}"


def _spread() -> str:
    return MARKET.replace("market AS MATERIALIZED (", "sides AS MATERIALIZED (", 1).replace("FROM market UNION ALL SELECT t, s FROM market", "FROM sides UNION ALL SELECT t, s FROM sides")


@query(_reduction(10).replace(MARKET, _spread() + ", market AS MATERIALIZED (SELECT s, t, min(w) AS w FROM (SELECT * FROM sides UNION ALL SELECT a.s, b.t, a.w + b.w FROM sides a JOIN sides b ON a.t = b.s WHERE a.s <> b.t AND a.s % 3 = 0) GROUP BY ALL)"))
def market_reduction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The string-graph reduction of the market with shortcuts over two edges, until nothing goes (ten rounds at most)."""
    a, _ = directed(spark, sf_dir, math.inf)
    e = a.df.toDF("s", "t", "w")
    two = e.where("s % 3 = 0").toDF("s", "k", "w1").join(e.toDF("k", "t", "w2"), "k").where("s <> t").select("s", "t", (F.col("w1") + F.col("w2")).alias("w"))
    longer = e.union(two).groupBy("s", "t").agg(F.min("w").alias("w"))
    return rows(graph.transitive_reduction(SparseTensor(longer.toDF("i0", "i1", "v"), a.shape, math.inf), 2, 10))


# --- systems: A x for the x that solves A x = b gives b back -----------------------

RIGHT = f"WITH {MARKET} SELECT i AS i0, round(CASE WHEN i < people THEN c_acctbal ELSE s_acctbal END / 1000, 2) + 0.0 AS v FROM nodes CROSS JOIN size LEFT JOIN customer ON c_custkey = i LEFT JOIN supplier ON s_suppkey + people = i"


def system(spark: SparkSession, sf_dir: str, shift: float, times: float) -> tuple[SparseTensor, SparseTensor, SparseTensor]:
    """``times`` the degrees plus ``shift`` on the diagonal less the undirected market, and the balances of customers and suppliers."""
    a = undirected(spark, sf_dir)
    n, people = a.shape[0], load(spark, sf_dir, "customer").count()
    degree = spark.range(n).withColumnRenamed("id", "i0").join(a.df.groupBy("i0").count(), "i0", "left").select("i0", F.col("i0").alias("i1"), (F.coalesce("count", F.lit(0)) * times + shift).alias("v"))
    matrix = SparseTensor(cut(degree.union(a.df.select("i0", "i1", -F.col("v")))), a.shape, 0.0)
    c = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("i0"), F.round(F.col("c_acctbal") / 1000, 2).alias("v"))
    s = load(spark, sf_dir, "supplier").select((F.col("s_suppkey") + people).alias("i0"), F.round(F.col("s_acctbal") / 1000, 2).alias("v"))
    return matrix, SparseTensor(cut(c.union(s)), (n,), 0.0), linear.zeros(spark, (n,))


def given_back(a: SparseTensor, x: SparseTensor) -> DataFrame:
    return linear.matmul(a, x).dense().df.select("i0", (F.round("v", 2) + 0.0).alias("v"))


@query(RIGHT)
def market_cg(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b, x = system(spark, sf_dir, 1.0, 1.0)
    return given_back(a, solvers.preconditioned_cg(a, b, x, solvers.diagonal_preconditioner(a), 1e-7))


@query(RIGHT)
def market_jacobi(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b, x = system(spark, sf_dir, 1.0, 3.0)
    return given_back(a, solvers.jacobi(a, b, x, 1e-6))


@query(RIGHT)
def market_gmres(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b, x = system(spark, sf_dir, 1.0, 3.0)
    return given_back(a, solvers.gmres(a, b, x, tol=1e-6))


# --- partners ----------------------------------------------------------------------


def partners(spark: SparkSession, sf_dir: str) -> SparseTensor:
    firms = load(spark, sf_dir, "supplier").count()
    served = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey").distinct()
    pairs = served.toDF("o", "s").join(served.toDF("o", "t"), "o").where("s <> t").groupBy("s", "t").count()
    best = pairs.withColumn("r", F.row_number().over(Window.partitionBy("s").orderBy(F.desc("count"), "t"))).where("r <= 4").select("s", "t")
    both = best.union(best.select("t", "s")).distinct()
    return SparseTensor(cut(both.select(F.col("s").alias("i0"), F.col("t").alias("i1"), F.lit(1.0).alias("v"))), (firms, firms), 0.0)


PARTNERS = """best AS (SELECT s, t FROM (SELECT s, t, row_number() OVER (PARTITION BY s ORDER BY c DESC, t) AS r FROM (
    SELECT a.l_suppkey AS s, b.l_suppkey AS t, count(*) AS c FROM (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) a JOIN (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) b USING (l_orderkey) WHERE a.l_suppkey <> b.l_suppkey GROUP BY ALL
)) WHERE r <= 4), pairs AS MATERIALIZED (SELECT DISTINCT s, t FROM (SELECT s, t FROM best UNION ALL SELECT t, s FROM best))"""


@query(
    f"""WITH {PARTNERS}, e AS (SELECT s, t FROM pairs WHERE s < t)
    SELECT 'triangles' AS name, CAST(count(*) AS DOUBLE) AS v FROM e a JOIN e b ON a.t = b.s JOIN e c ON c.s = a.s AND c.t = b.t
    UNION ALL SELECT 'four_cliques', CAST(count(*) AS DOUBLE) FROM e a JOIN e b ON a.t = b.s JOIN e c ON c.s = a.s AND c.t = b.t JOIN e d ON d.s = b.t JOIN e f ON f.s = a.s AND f.t = d.t JOIN e g ON g.s = b.s AND g.t = d.t"""
)
def partner_cliques(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = partners(spark, sf_dir)
    return spark.createDataFrame([("triangles", float(graph.triangles(a))), ("four_cliques", float(graph.four_cliques(a)))], "name string, v double")


def _flow(rounds: int, threshold: float) -> str:
    norm = lambda src: f"SELECT i, j, v / sum(v) OVER (PARTITION BY j) AS v FROM ({src})"
    parts = [f"WITH {PARTNERS}, m0 AS MATERIALIZED ({norm('SELECT i, j, sum(v) AS v FROM (SELECT s AS i, t AS j, 1::DOUBLE AS v FROM pairs UNION ALL SELECT s_suppkey, s_suppkey, 1 FROM supplier) GROUP BY ALL')})"]
    for k in range(rounds):
        grown = f"SELECT a.i, b.j, power(sum(a.v * b.v), 2) AS v FROM m{k} a JOIN m{k} b ON a.j = b.i GROUP BY ALL"
        parts.append(f"n{k} AS MATERIALIZED ({norm(grown)}), m{k + 1} AS MATERIALIZED (SELECT i, j, v FROM (SELECT *, max(v) OVER (PARTITION BY j) AS top FROM n{k}) WHERE v >= {threshold} OR (v = top AND v > 0))")
    sets = f"SELECT DISTINCT members FROM (SELECT i, list(j ORDER BY j) AS members FROM m{rounds} WHERE v > 0 GROUP BY i)"
    return ", ".join(parts) + f" SELECT members[1] AS cluster, unnest(members) AS vertex FROM ({sets})"


@query(_flow(40, 0.001))
def partner_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markov clustering to convergence, and its clusters."""
    return graph.mcl_clusters(graph.markov_clustering(partners(spark, sf_dir), pruning_threshold=0.001))


MARKET_GCN = f"""WITH {MARKET}, x AS (SELECT i, (i % 7) / 7::DOUBLE AS f0, (i % 5) / 5::DOUBLE AS f1 FROM nodes),
h AS (SELECT n.i, greatest(coalesce(z0, 0) * 0.5 - coalesce(z1, 0) * 0.25 + 0.1, 0) AS h0, greatest(coalesce(z0, 0) * 0.1 + coalesce(z1, 0) * 0.3 - 0.2, 0) AS h1 FROM nodes n LEFT JOIN (SELECT s AS i, sum(w * f0) AS z0, sum(w * f1) AS z1 FROM market JOIN x ON t = x.i GROUP BY s) USING (i))
SELECT n.i AS i0, round(coalesce(y, 0) + 0.5, 6) AS v FROM nodes n LEFT JOIN (SELECT s AS i, sum(w * (h0 + 2 * h1)) AS y FROM market JOIN h ON t = h.i GROUP BY s) USING (i)"""


@query(MARKET_GCN)
def market_gcn(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, _ = directed(spark, sf_dir)
    n = a.shape[0]
    each = F.explode(F.array(*[F.struct(F.lit(j).cast("long").alias("i1"), (F.col("id") % m / float(m)).alias("v")) for j, m in enumerate((7, 5))]))
    x = SparseTensor(spark.range(n).select(F.col("id").alias("i0"), each.alias("x")).select("i0", "x.i1", "x.v"), (n, 2), 0.0)
    return rows(learning.gcn(a, x, [[0.5, 0.1], [-0.25, 0.3]], [0.1, -0.2], [[1.0], [2.0]], [0.5]), 6).select("i0", "v")
