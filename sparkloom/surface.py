"""Queries for what the other modules leave out: scalar functions, indexing, interchange, decompositions, projections."""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import queries as Q
from .framework import CheckerFramework, SparkFramework
from .operators import decomposition, learning, linear, simulation, solvers
from .plans.einsum import einsum
from .registry import load, query, rows
from .sources import catalog, matrix_market
from .sources.interchange import export, ingest
from .storage import cut, fresh
from .tensor import SparseTensor, equal, from_numpy

TABLES = f"WITH {Q.CELLS}, {Q.BALANCE}, {Q.COUNTS}"


def side_by_side(programs: dict[str, str], digits: int | None = None, **tensors: SparseTensor) -> DataFrame:
    """A column a program, over all cells."""
    out, keys = None, None
    for name, program in programs.items():
        v = F.col("v") if digits is None else F.round("v", digits) + 0.0
        t = einsum(program, **tensors).dense()
        dims = t.dims
        t = t.df.select(*dims, v.alias(name))
        out, keys = (t, dims) if out is None else (out.join(t, keys), keys)
    return out


# --- scalar functions ----------------------------------------------------------------


@query(
    f"""{TABLES} SELECT i0, i1, c.v = 12 AS eq, b.v <> c.v AS ne, c.v >= 12 AS ge, least(b.v, c.v * 1000) AS mn, greatest(b.v, c.v * 1000) AS mx, (c.v > 11) <> (b.v > 0) AS xo FROM b JOIN c USING (i0, i1)"""
)
def einsum_comparisons(spark: SparkSession, sf_dir: str) -> DataFrame:
    programs = {"eq": "C[i,j] == 12", "ne": "B[i,j] != C[i,j]", "ge": "C[i,j] >= 12", "mn": "min(B[i,j], C[i,j] * 1000)", "mx": "max(B[i,j], C[i,j] * 1000)", "xo": "logical_xor(C[i,j] > 11, B[i,j] > 0)"}
    return side_by_side({k: f"D[i,j] = {p}" for k, p in programs.items()}, B=Q.balances(spark, sf_dir), C=Q.customers(spark, sf_dir))


@query(
    f"""{TABLES}, w AS (SELECT i0, i1, b.v * 9007199254741 AS a, c.v % 9 AS e, c.v + 1 AS c FROM b JOIN c USING (i0, i1))
    SELECT i0, i1, (a - ((a % c) + c) % c) // c AS quotient, ((a % c) + c) % c AS rest, CAST(coalesce(list_reduce(list_transform(range(19), lambda x: e), lambda p, q: p * q), 1) AS BIGINT) AS power FROM w"""
)
def einsum_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Integer division, remainders and powers beyond the 53 bits of a double."""
    programs = {"quotient": "D[i,j] = (B[i,j] * 9007199254741) // (C[i,j] + 1)", "rest": "D[i,j] = (B[i,j] * 9007199254741) % (C[i,j] + 1)", "power": "D[i,j] = (C[i,j] % 9) ** 19"}
    return side_by_side(programs, B=Q.balances(spark, sf_dir), C=Q.customers(spark, sf_dir))


@query(
    f"""{TABLES}, t AS (SELECT i0, i1, v + 3001 AS t, CASE WHEN v % 2 = 1 THEN 1 + v / 16.0::DOUBLE ELSE 0 END AS s FROM c)
    SELECT i0, CAST(list_reduce(list(t), lambda p, q: p * q) AS BIGINT) AS exact, round(list_reduce(list(1 + s), lambda p, q: p * q), 6) AS floats FROM t GROUP BY i0"""
)
def einsum_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = Q.customers(spark, sf_dir)
    exact = side_by_side({"exact": "P[i] *= C[i,j] + 3001"}, C=c)
    return exact.join(side_by_side({"floats": "P[i] *= 1 + (C[i,j] % 2) * (1 + C[i,j] / 16)"}, 6, C=c), "i0")


FUNCTIONS = {
    "pos": ("+B[i,j]", "b.v"), "neg": ("-B[i,j]", "-b.v"), "abs": ("abs(B[i,j])", "abs(b.v)"), "inv": ("~C[i,j]", "-c.v - 1"),
    "log": ("log(C[i,j] + 1)", "ln(c.v + 1)"), "log10": ("log10(C[i,j] + 1)", "log10(c.v + 1)"), "log2": ("log2(C[i,j] + 1)", "ln(c.v + 1) / ln(2)"),
    "tan": ("tan(C[i,j] / 1000)", "tan(c.v / 1000)"), "sinh": ("sinh(C[i,j] / 1000)", "(exp(c.v / 1000) - exp(-c.v / 1000)) / 2"), "cosh": ("cosh(C[i,j] / 1000)", "(exp(c.v / 1000) + exp(-c.v / 1000)) / 2"),
    "asin": ("asin(C[i,j] / 10000)", "asin(c.v / 10000)"), "acos": ("acos(C[i,j] / 10000)", "acos(c.v / 10000)"), "acosh": ("acosh(C[i,j] + 1)", "ln(c.v + 1 + sqrt((c.v + 1) * (c.v + 1) - 1))"), "atanh": ("atanh(C[i,j] / 10000)", "ln((1 + c.v / 10000) / (1 - c.v / 10000)) / 2"),
    "logaddexp": ("logaddexp(C[i,j] / 100, 1)", "ln(exp(c.v / 100) + exp(1))"), "power": ("(C[i,j] / 10) ** 1.5", "power(c.v / 10, 1.5)"), "atan2": ("atan2(C[i,j], 5)", "atan2(c.v, 5)"),
}


@query(f"{TABLES} SELECT i0, i1, {', '.join(f'round({sql}, 9) + 0.0 AS {n}' for n, (_, sql) in FUNCTIONS.items())} FROM b JOIN c USING (i0, i1)")
def einsum_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return side_by_side({n: f"D[i,j] = {p}" for n, (p, _) in FUNCTIONS.items()}, 9, B=Q.balances(spark, sf_dir), C=Q.customers(spark, sf_dir))


# --- indexing --------------------------------------------------------------------------


def united(spark: SparkSession, parts: dict[str, SparseTensor]) -> DataFrame:
    """(name, i0, i1, v) of matrices and vectors (i1 is 0), stored cells that differ from the fill."""
    out = None
    for name, t in parts.items():
        t = t.pruned()
        second = F.col("i1") if t.rank > 1 else F.lit(0).cast("bigint")
        df = t.df.select(F.lit(name).alias("name"), "i0", second.alias("i1"), F.col("v").cast("double").alias("v"))
        out = df if out is None else out.union(df)
    return out


@query(
    f"""{TABLES}, d AS (SELECT i0, i1, b.v AS b, c.v AS c FROM b JOIN c USING (i0, i1))
    SELECT name, CAST(i0 AS BIGINT) AS i0, CAST(i1 AS BIGINT) AS i1, CAST(v AS DOUBLE) AS v FROM (
        SELECT 'where' AS name, i0, i1, CASE WHEN b > 50000 THEN b ELSE c END AS v FROM d
        UNION ALL SELECT 'least', i0, i1, least(b, c) FROM d UNION ALL SELECT 'greatest', i0, i1, greatest(b, c) FROM d
        UNION ALL SELECT 'slice', i0 - 3, i1, b FROM d WHERE i0 BETWEEN 3 AND 9 UNION ALL SELECT 'pick', i0, 0, b FROM d WHERE i1 = 2
        UNION ALL SELECT 'assign', i0, i1, CASE WHEN i0 < 4 AND i1 = 0 THEN 7 ELSE b END FROM d
        UNION ALL SELECT 'take', r.range, i1, b FROM d JOIN range(10) r ON i0 = r.range * 2 + 1
        UNION ALL SELECT 'bool', i0, i1, 1 FROM d WHERE b <> 0 UNION ALL SELECT 'expanded', i0, 0, sum(b) FROM d GROUP BY i0
        UNION ALL SELECT 'outer', x.i0, y.i0, x.b * y.b FROM d x, d y WHERE x.i1 = 1 AND y.i1 = 3
        UNION ALL SELECT 'flat', (i0 * 5 + i1) // 25, (i0 * 5 + i1) % 25, b FROM d
        UNION ALL SELECT 'blocks', i0, i1, b FROM d UNION ALL SELECT 'blocks', i0 + 25, i1 + 5, c FROM d
    ) WHERE v <> 0"""
)
def primitives(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, c = Q.balances(spark, sf_dir), Q.customers(spark, sf_dir)
    b, c = b.with_df(cut(b.df)), c.with_df(cut(c.df))
    column = SparseTensor(spark.range(4).select(F.col("id").alias("i0"), F.lit(0).cast("bigint").alias("i1"), F.lit(7).cast("bigint").alias("v")), b.shape, 0)
    one, three = linear.pick(b, 1, 1), linear.pick(b, 1, 3)
    parts = {
        "where": linear.where(linear.elementwise(">", b, 50000), b, c), "least": linear.elementwise("min", b, c), "greatest": linear.elementwise("max", b, c),
        "slice": linear.slice_axis(b, 0, 3, 10), "pick": linear.pick(b, 1, 2), "assign": linear.assign(b, column), "take": linear.take(b, linear.arange(spark, 1, 21, 2)),
        "bool": linear.astype(linear.astype(b, "bool"), "int"), "expanded": linear.expand_dims(linear.reduce(b, "sum", 1), 1), "outer": linear.outer(one, three),
        "flat": linear.reshape(b, (5, 25)), "blocks": linear.block_diag([b, c]),
    }
    return united(spark, parts)


@query(f"WITH {Q.CUBE} SELECT x.i AS i0, x.j AS i1, y.j AS i2, CAST(sum(x.v * y.v) AS BIGINT) AS v FROM x JOIN x y USING (i, k) GROUP BY ALL")
def batched_matmul(spark: SparkSession, sf_dir: str) -> DataFrame:
    cube = Q.order_cube(spark, sf_dir)
    return rows(linear.matmul(cube, linear.permute_dims(cube, (0, 2, 1))))


@query("SELECT name, v FROM (VALUES ('distinct', (SELECT count(DISTINCT (c_nationkey, c_mktsegment)) FROM customer)), ('equal', 1), ('reordered', 1), ('other', 0), ('random', 1), ('eye', 9), ('arange', 4 + 7 + 10)) t(name, v)")
def tensor_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equality of tensors, distinct cells, constructors; random numbers that do not depend on partitions."""
    c, r = Q.customers(spark, sf_dir), linear.rand(spark, (30, 4), 5)
    again = linear.rand(spark, (30, 4), 5)
    within = r.df.agg(F.min("v") >= 0, F.max("v") < 1, F.abs(F.avg("v") - 0.5) < 0.1).first()
    found = {
        "distinct": c.pruned().df.select("i0", "i1").distinct().count(), "equal": int(equal(c, c.dense())), "reordered": int(equal(c, c.with_df(c.df.orderBy(F.desc("i1"))))), "other": int(equal(c, linear.elementwise("+", c, 1))),
        "random": int(all(within) and equal(r, again.with_df(again.df.repartition(3)))), "eye": linear.eye(spark, 9).df.count(), "arange": int(linear.arange(spark, 4, 12, 3).df.agg(F.sum("v")).first()[0]),
    }
    return spark.createDataFrame([(k, int(v)) for k, v in found.items()], "name string, v int")


# --- interchange and files ---------------------------------------------------------------

SHARES = f"{TABLES} SELECT i0, i1, CAST(v AS DOUBLE) AS v FROM c WHERE v <> 0"


@query(SHARES)
def interchange(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Out of the engine and in again, dense and by coordinates, through both frameworks' lazy regions."""
    plain, checker = SparkFramework(spark), CheckerFramework(spark)
    out = plain.to_benchmark(plain.compute(plain.lazy(Q.customers(spark, sf_dir))))
    lazy = checker.lazy(checker.from_benchmark(out.to_coo()))
    same = checker.compute(checker.with_fill_value(checker.einsum("D[i,j] = A[i,j] + 0", A=lazy), 0))
    return rows(ingest(spark, export(same)).pruned()).select("i0", "i1", F.col("v").cast("double").alias("v"))


@query(SHARES)
def matrix_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written as MatrixMarket text with a right-hand side beside it, found by its companion, and read back."""
    folder = fresh(spark, "matrices")
    c = Q.customers(spark, sf_dir)
    lines = [r["value"] for r in matrix_market.text_lines(c).orderBy("k").collect()]
    for name in ("shares", "shares_b"):
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/pair/{name}.mtx")
        out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path, True)
        out.write(bytearray(("\n".join(lines) + "\n").encode()))
        out.close()
    found = matrix_market.companions(spark, f"{folder}/pair").first()
    return rows(matrix_market.read_matrix(spark, found["rhs" if found["stem"] != "shares" else "matrix"])).select("i0", "i1", "v")


@query(f"""{TABLES}, entries AS (SELECT 'nation' || i0 AS matrix_name, CAST(sum(v) AS DOUBLE) AS value FROM c WHERE v <> 0 GROUP BY i0) SELECT matrix_name, CASE WHEN matrix_name = 'nation3' THEN 1.5 ELSE value END AS value, row_number() OVER (ORDER BY CASE WHEN matrix_name = 'nation3' THEN 1.5 ELSE value END, matrix_name) - 1 AS place FROM entries""")
def matrix_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalog with one entry takes the others in, keeps its own, and is sorted by the metric."""
    from pyspark.sql import Window

    name = "cg convergence criteria"
    folder = fresh(spark, "catalog")
    catalog.write_catalog(spark.createDataFrame([("nation3", "g", 1.5, 25, 5)], f"matrix_name string, matrix_group string, `{name}` double, n int, nnz int"), f"{folder}/first")
    found = Q.customers(spark, sf_dir).pruned().df.groupBy("i0").agg(F.sum("v").cast("double").alias(name))
    entries = found.select(F.concat(F.lit("nation"), "i0").alias("matrix_name"), F.lit("g").alias("matrix_group"), F.col(f"`{name}`"), F.lit(25).alias("n"), F.lit(5).alias("nnz"))
    both = catalog.append(spark.read.json(f"{folder}/first"), entries)
    value = F.col(f"`{name}`")
    return both.select("matrix_name", value.alias("value"), (F.row_number().over(Window.orderBy(value, "matrix_name")) - 1).cast("long").alias("place"))


# --- decompositions ------------------------------------------------------------------------

AXES = {
    "i": ("c_nationkey", 25), "j": (Q.SEGMENT_CASE, 5), "k": ("list_position(['" + "', '".join(Q.PRIORITIES) + "'], o_orderpriority) - 1", 5), "l": ("year(o_orderdate) - 1995", 7), "m": ("list_position(['F', 'O', 'P'], o_orderstatus) - 1", 3),
}


def order_tensor(spark: SparkSession, sf_dir: str, order: int) -> SparseTensor:
    """Orders by nation, segment, priority, year and status, as many as the order has."""
    c, o = load(spark, sf_dir, "customer"), load(spark, sf_dir, "orders")
    at = lambda names, column: F.array_position(F.array(*[F.lit(x) for x in names]), F.col(column)) - 1
    axes = [F.col("c_nationkey"), at(Q.SEGMENTS, "c_mktsegment"), at(Q.PRIORITIES, "o_orderpriority"), F.year("o_orderdate") - 1995, at("FOP", "o_orderstatus")][:order]
    joined = o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(*[a.cast("bigint").alias(f"i{k}") for k, a in enumerate(axes)])
    counted = joined.groupBy(*joined.columns).agg(F.count(F.lit(1)).cast("double").alias("v"))
    return SparseTensor(cut(counted), tuple(n for _, n in list(AXES.values())[:order]), 0.0)


def _cp_sql(order: int, rounds: int) -> str:
    """Alternating least squares of rank 2, every factor of every round a table (x, a, b)."""
    names = list(AXES)[:order]
    cells = ", ".join(f"CAST({AXES[n][0]} AS BIGINT) AS {n}" for n in names)
    parts = [f"WITH x AS MATERIALIZED (SELECT {cells}, count(*)::DOUBLE AS v FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)"]
    for n in names:
        start = np.random.default_rng(0).random((AXES[n][1], 2)).tolist()
        parts.append(f"{n}0 AS (SELECT * FROM (VALUES {', '.join(f'({r}, {a!r}::DOUBLE, {b!r}::DOUBLE)' for r, (a, b) in enumerate(start))}) t(x, a, b))")
    now = {n: f"{n}0" for n in names}
    for r in range(rounds):
        for n in names:
            rest = [now[o] for o in names if o != n]
            new = f"{n}{r + 1}"
            product = lambda c: " * ".join(f"{t}.{c}" for t in rest)  # noqa: E731, B023
            joins = " ".join(f"JOIN {now[o]} ON {now[o]}.x = x.{o}" for o in names if o != n)
            gram = lambda c: " * ".join(f"(SELECT sum({c}) FROM {t})" for t in rest)  # noqa: E731, B023
            parts.append(f"g_{new} AS MATERIALIZED (SELECT {gram('a * a')} AS aa, {gram('a * b')} AS ab, {gram('b * b')} AS bb)")
            parts.append(f"m_{new} AS MATERIALIZED (SELECT x.{n} AS x, sum(x.v * {product('a')}) AS a, sum(x.v * {product('b')}) AS b FROM x {joins} GROUP BY x.{n})")
            parts.append(f"{new} AS MATERIALIZED (SELECT CAST(r.range AS BIGINT) AS x, coalesce((m.a * bb - m.b * ab) / (aa * bb - ab * ab), 0) AS a, coalesce((m.b * aa - m.a * ab) / (aa * bb - ab * ab), 0) AS b FROM range({AXES[n][1]}) r CROSS JOIN g_{new} LEFT JOIN m_{new} m ON m.x = r.range)")
            now[n] = new
    norm = lambda t, c: f"(SELECT greatest(sqrt(sum({c} * {c})), 1e-10) FROM {t})"
    out = [f"SELECT {k} AS mode, x AS i, {j}::BIGINT AS r, round({c} / {norm(now[n], c)}, 5) + 0.0 AS v FROM {now[n]}" for k, n in enumerate(names) for j, c in enumerate("ab")]
    weights = [f"SELECT -1, 0, {j}, round({' * '.join(norm(now[n], c) for n in names)}, 3)" for j, c in enumerate("ab")]
    return ", ".join(parts) + " " + " UNION ALL ".join(out + weights)


def cp_rows(spark: SparkSession, sf_dir: str, order: int, rounds: int) -> DataFrame:
    factors, weights = decomposition.cp_als(order_tensor(spark, sf_dir, order), 2, rounds)
    out = spark.createDataFrame([(-1, 0, r, round(float(w), 3)) for r, w in enumerate(weights)], "mode int, i long, r long, v double")
    for k, f in enumerate(factors):
        out = out.union(f.select(F.lit(k).alias("mode"), "i", F.posexplode("f").alias("r", "v")).select("mode", "i", F.col("r").cast("long"), F.round("v", 5) + 0.0))
    return out


@query(_cp_sql(3, 4))
def cp_als(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cp_rows(spark, sf_dir, 3, 4)


@query(_cp_sql(4, 3))
def cp_als_order_4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cp_rows(spark, sf_dir, 4, 3)


@query(_cp_sql(5, 3))
def cp_als_order_5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cp_rows(spark, sf_dir, 5, 3)


def _mttkrp_sql(order: int) -> str:
    names = list(AXES)[:order]
    cells = ", ".join(f"CAST({AXES[n][0]} AS BIGINT) AS {n}" for n in names)
    entry = " * ".join(f"(({n} * {k + 2} + r + 1) % 7)" for k, n in enumerate(names) if k)
    return f"WITH x AS (SELECT {cells}, count(*) AS v FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL), r AS (SELECT CAST(range AS BIGINT) AS r FROM range(3)) SELECT i AS i0, r AS i1, CAST(sum(v * {entry}) AS DOUBLE) AS v FROM x, r GROUP BY ALL"


def mttkrp_rows(spark: SparkSession, sf_dir: str, order: int) -> DataFrame:
    x = order_tensor(spark, sf_dir, order)
    factors = {n.upper(): Q.small_factor(spark, AXES[n][1], k + 2) for k, n in enumerate(list(AXES)[:order]) if k}
    access = " * ".join(f"{n.upper()}[{n},r]" for n in list(AXES)[1:order])
    return rows(einsum(f"M[i,r] += X[{','.join(list(AXES)[:order])}] * {access}", X=x, **factors)).select("i0", "i1", F.col("v").cast("double").alias("v"))


@query(_mttkrp_sql(4))
def mttkrp_order_4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mttkrp_rows(spark, sf_dir, 4)


@query(_mttkrp_sql(5))
def mttkrp_order_5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mttkrp_rows(spark, sf_dir, 5)


@query(f"WITH {Q.CUBE} SELECT i AS i0, j AS i1, k AS i2, CAST(v AS DOUBLE) AS v FROM x")
def hosvd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At full ranks the core times the factors is the tensor again."""
    x = Q.order_cube(spark, sf_dir)
    core, factors = decomposition.hosvd(x, x.shape, max_iter=3)
    a, b, c = (from_numpy(spark, f) for f in factors)
    again = einsum("X[i,j,k] += G[p,q,r] * A[i,p] * B[j,q] * C[k,r]", G=core, A=a, B=b, C=c)
    return rows(again, 6).where("abs(v) > 1e-6")


HOOI = f"""WITH RECURSIVE {Q.CUBE}, cells AS (SELECT list(struct_pack(i := i + 1, j := j + 1, k := k + 1, v := v::DOUBLE)) AS cells FROM x),
rounds AS (
    SELECT 0 AS n, list_transform(range(5), lambda t: 1::DOUBLE) AS b, list_transform(range(5), lambda t: 1::DOUBLE) AS c, 0::DOUBLE AS s
    UNION ALL SELECT n + 1, b, list_transform(w, lambda t: t / sqrt(list_sum(list_transform(w, lambda u: u * u)))), sqrt(list_sum(list_transform(w, lambda u: u * u))) FROM (
        SELECT n, b, list_transform(range(5), lambda t: list_sum(list_transform(list_filter(cells, lambda e: e.k = t + 1), lambda e: e.v * a[e.i] * b[e.j]))) AS w, cells, a FROM (
            SELECT n, cells, a, list_transform(w, lambda t: t / sqrt(list_sum(list_transform(w, lambda u: u * u)))) AS b FROM (
                SELECT n, cells, c, a, list_transform(range(5), lambda t: list_sum(list_transform(list_filter(cells, lambda e: e.j = t + 1), lambda e: e.v * a[e.i] * c[e.k]))) AS w FROM (
                    SELECT n, cells, b, c, list_transform(w, lambda t: t / sqrt(list_sum(list_transform(w, lambda u: u * u)))) AS a FROM (
                        SELECT n, cells, b, c, list_transform(range(25), lambda t: coalesce(list_sum(list_transform(list_filter(cells, lambda e: e.i = t + 1), lambda e: e.v * b[e.j] * c[e.k])), 0)) AS w FROM rounds, cells WHERE n < 25
                    )
                )
            )
        )
    )
) SELECT 0::BIGINT AS i0, 0::BIGINT AS i1, 0::BIGINT AS i2, round(s, 6) AS v FROM rounds WHERE n = 25"""


@query(HOOI)
def hosvd_rank_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best approximation of rank one, to convergence: its core is one number."""
    core, _ = decomposition.hosvd(Q.order_cube(spark, sf_dir), (1, 1, 1))
    return core.df.select("i0", "i1", "i2", F.abs(F.round("v", 6)).alias("v"))


# --- training, projections, clusters -----------------------------------------------------------


def _training_sql(rounds: int, rate: float) -> str:
    """Gradient descent spelled out: two inputs, two hidden units, one output, target 1 everywhere."""
    base = Q.GCN[: Q.GCN.index("h AS (")]
    parts = [base + "z AS MATERIALIZED (SELECT n.i, coalesce(z0, 0) AS z0, coalesce(z1, 0) AS z1 FROM nodes n LEFT JOIN (SELECT s AS i, sum(r * f0) AS z0, sum(r * f1) AS z1 FROM trade JOIN x ON t = x.i GROUP BY s) USING (i))"]
    parts.append("w0 AS (SELECT 0.5::DOUBLE AS p00, 0.1::DOUBLE AS p01, -0.25::DOUBLE AS p10, 0.3::DOUBLE AS p11, 0.1::DOUBLE AS c0, -0.2::DOUBLE AS c1, 1::DOUBLE AS q0, 1::DOUBLE AS q1, 0::DOUBLE AS d)")
    for k in range(rounds):
        parts.append(f"a{k} AS MATERIALIZED (SELECT i, z0, z1, z0 * p00 + z1 * p10 + c0 AS a0, z0 * p01 + z1 * p11 + c1 AS a1 FROM z, w{k})")
        parts.append(f"h{k} AS MATERIALIZED (SELECT n.i, coalesce(g0, 0) AS g0, coalesce(g1, 0) AS g1 FROM nodes n LEFT JOIN (SELECT s AS i, sum(r * greatest(a0, 0)) AS g0, sum(r * greatest(a1, 0)) AS g1 FROM trade JOIN a{k} ON t = a{k}.i GROUP BY s) USING (i))")
        parts.append(f"y{k} AS MATERIALIZED (SELECT i, g0, g1, g0 * q0 + g1 * q1 + d - 1 AS gap FROM h{k}, w{k})")
        parts.append(f"b{k} AS MATERIALIZED (SELECT t AS i, sum(r * gap * 2 / 25) AS e FROM trade JOIN y{k} ON s = y{k}.i GROUP BY t)")
        parts.append(
            f"""w{k + 1} AS MATERIALIZED (SELECT p00 - {rate} * s00 AS p00, p01 - {rate} * s01 AS p01, p10 - {rate} * s10 AS p10, p11 - {rate} * s11 AS p11, c0 - {rate} * t0 AS c0, c1 - {rate} * t1 AS c1, q0 - {rate} * u0 AS q0, q1 - {rate} * u1 AS q1, d - {rate} * ud AS d
            FROM w{k}, (SELECT sum(g0 * gap) * 2 / 25 AS u0, sum(g1 * gap) * 2 / 25 AS u1, sum(gap) * 2 / 25 AS ud FROM y{k}),
            (SELECT sum(CASE WHEN a0 > 0 THEN z0 * e * q0 ELSE 0 END) AS s00, sum(CASE WHEN a1 > 0 THEN z0 * e * q1 ELSE 0 END) AS s01, sum(CASE WHEN a0 > 0 THEN z1 * e * q0 ELSE 0 END) AS s10, sum(CASE WHEN a1 > 0 THEN z1 * e * q1 ELSE 0 END) AS s11,
                sum(CASE WHEN a0 > 0 THEN e * q0 ELSE 0 END) AS t0, sum(CASE WHEN a1 > 0 THEN e * q1 ELSE 0 END) AS t1 FROM a{k} JOIN b{k} USING (i), w{k}))"""
        )
    names = {"w1_00": "p00", "w1_01": "p01", "w1_10": "p10", "w1_11": "p11", "b1_0": "c0", "b1_1": "c1", "w2_0": "q0", "w2_1": "q1", "b2": "d"}
    out = [f"SELECT 'loss' AS name, round((SELECT sum(gap * gap) / 25 FROM y{rounds - 1}), 4) AS v"] + [f"SELECT '{n}', round({c}, 9) FROM w{rounds}" for n, c in names.items()]
    return ", ".join(parts) + " " + " UNION ALL ".join(out)


@query(_training_sql(10, 1e-5))
def gcn_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten updates, the default number: the loss before the last, and all weights."""
    target = linear.full(spark, (Q.NATIONS, 1), 1.0).dense()
    loss, w1, b1, w2, b2 = learning.gcn_train(Q.directed(spark, sf_dir), Q.features(spark, sf_dir), np.array([[0.5, 0.1], [-0.25, 0.3]]), np.array([0.1, -0.2]), np.ones((2, 1)), np.zeros(1), target, learning_rate=1e-5)
    found = [("loss", round(float(loss), 4))] + [(f"w1_{i}{j}", round(float(w1[i, j]), 9)) for i in (0, 1) for j in (0, 1)]
    found += [(f"b1_{j}", round(float(b1[j]), 9)) for j in (0, 1)] + [(f"w2_{i}", round(float(w2[i, 0]), 9)) for i in (0, 1)] + [("b2", round(float(b2[0]), 9))]
    return spark.createDataFrame(found, "name string, v double")


def place_hash(seed: int, i: int, j: int) -> float:
    """What ``learning.uniform`` draws for a place: chained 64-bit hashes of seed and indices, as a number in [0, 1)."""
    h = xxhash.xxh64_intdigest(seed.to_bytes(4, "little"), 42)
    for x in (i, j):
        h = xxhash.xxh64_intdigest(x.to_bytes(8, "little"), h)
    return (h >> 11) / (1 << 53)


def _signs_sql(d: int, t: int, seed: int, plus: float, minus: float) -> str:
    """s(i, j, s): the sign of every place whose hash is below ``plus`` (minus sign below ``minus``); others are 0."""
    cells = [(i, j, -1 if u < minus else 1) for i in range(d) for j in range(t) if (u := place_hash(seed, i, j)) < plus]
    return f"s AS (SELECT * FROM (VALUES {', '.join(f'({i},{j},{v})' for i, j, v in cells)}) t(i, j, s))"


#: A projection of 64 features by sparse signs: sqrt(64) = 8, so an eighth of the places are not 0.
NEAREST = f"""WITH {_signs_sql(64, 45, 40, 1 / 8, 1 / 16)}, n AS (SELECT count(*) AS n FROM embeddings), t AS (SELECT CAST(ceil(ln(n) / 0.25) AS BIGINT) AS t FROM n),
p AS MATERIALIZED (SELECT vec_id, j, sum(e * s) * sqrt(8.0::DOUBLE / t) AS v FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS e, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings) JOIN s USING (i), t WHERE j < t GROUP BY vec_id, j, t),
gaps AS (SELECT q.vec_id AS query, p.vec_id AS neighbour, sqrt(sum((q.v - p.v) * (q.v - p.v))) AS distance FROM p q JOIN p ON q.j = p.j WHERE q.vec_id % 50 = 0 GROUP BY ALL)
SELECT query, rank, neighbour, round(distance, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY distance, neighbour) - 1 AS rank FROM gaps) WHERE rank < 5"""


@query(NEAREST)
def projected_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "embeddings")
    n = e.count()
    p = learning.sparse_signs(spark, 64, n, eps=0.5)
    own = e.where("vec_id % 50 = 0").withColumn("row", (F.col("vec_id") / 50).cast("long"))
    found = learning.nearest(Q.embedding_tensor(e.withColumn("row", F.col("vec_id")), n), Q.embedding_tensor(own, -(-n // 50)), p, 5)
    return found.select((F.col("query") * 50).alias("query"), F.col("rank").cast("long").alias("rank"), "neighbour", F.round("distance", 6).alias("distance"))


def _clusters_sql(source: str, k: int, rounds: int) -> str:
    parts = [f"{source}, c0 AS (SELECT vec_id AS j, e AS c FROM v WHERE vec_id < {k})"]
    for r in range(rounds):
        parts.append(f"l{r} AS MATERIALIZED (SELECT vec_id, e, arg_min(j, (d, j)) AS j FROM (SELECT vec_id, e, j, list_distance(e, c) AS d FROM v, c{r}) GROUP BY vec_id, e)")
        parts.append(f"c{r + 1} AS MATERIALIZED (SELECT j, list(x ORDER BY p) AS c FROM (SELECT j, p, avg(x) AS x FROM (SELECT j, unnest(e) AS x, generate_subscripts(e, 1) AS p FROM l{r}) GROUP BY j, p) GROUP BY j)")
    return ", ".join(parts) + f" SELECT vec_id AS i0, j AS v FROM l{rounds - 1}"


@query(_clusters_sql("WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)", 4, 40))
def k_means_converged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """To the end, however many rounds that takes: 36 at scale factor 0.1, where the 40 of the SQL are enough, 94 with five times as many vectors."""
    e = load(spark, sf_dir, "embeddings")
    return rows(learning.k_means(Q.embedding_tensor(e.withColumn("row", F.col("vec_id")), e.count()), 4, None))


#: k = 4 and eps = 0.33 make 37 dimensions.
PROJECTED = f"WITH {_signs_sql(64, 37, 0, 1.0, 0.5).replace('s AS (SELECT * FROM', 's AS (SELECT i, j, -s AS s FROM', 1)}, v AS MATERIALIZED (SELECT vec_id, list(x ORDER BY j) AS e FROM (SELECT vec_id, j, sum(e * s) / sqrt(37.0::DOUBLE) AS x FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS e, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings) JOIN s USING (i) GROUP BY vec_id, j) GROUP BY vec_id)"


@query(_clusters_sql(PROJECTED, 4, 40))
def k_means_projected(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "embeddings")
    return rows(learning.projected_k_means(Q.embedding_tensor(e.withColumn("row", F.col("vec_id")), e.count()), 4, 0.33))


# --- how hard the system of the trade graph is --------------------------------------------------

DIFFICULTY = f"""WITH RECURSIVE {Q.NODES}, {Q.TRADE}, a AS MATERIALIZED (
    SELECT s AS i, t AS j, -1::DOUBLE AS v FROM pairs UNION ALL SELECT i, i, 1 + (SELECT count(*) FROM pairs WHERE s = i) FROM nodes
), m AS MATERIALIZED (SELECT list(r ORDER BY i) AS m FROM (SELECT n.i, list(coalesce(a.v, 0) ORDER BY k.i) AS r FROM nodes n CROSS JOIN nodes k LEFT JOIN a ON a.i = n.i AND a.j = k.i GROUP BY n.i)),
it AS (
    SELECT 0 AS n, list_transform(range(25), lambda t: 1 + sin(t * t)::DOUBLE) AS x, 0::DOUBLE AS top
    UNION ALL SELECT n + 1, list_transform(y, lambda t: t / sqrt(list_dot_product(y, y))), list_dot_product(x, y) / list_dot_product(x, x) FROM (SELECT n, x, list_transform(m, lambda r: list_dot_product(r, x)) AS y FROM it, m WHERE n < 900)
) SELECT 'cg' AS name, round(top, 2) AS v FROM it WHERE n = 900 UNION ALL SELECT 'lsqr', round(top, 2) FROM it WHERE n = 900"""


@query(DIFFICULTY)
def difficulty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Condition number and ratio of singular values: a graph's Laplacian plus one has 1 as smallest eigenvalue, so both are its largest."""
    a, _, _ = Q.system(spark, sf_dir)
    found = [("cg", round(solvers.condition_number(a), 2)), ("lsqr", round(solvers.singular_ratio(a), 2))]
    return spark.createDataFrame(found, "name string, v double")


DIAGONAL = f"""WITH RECURSIVE {Q.NODES}, {Q.TRADE}, deg AS (SELECT i, 1 + (SELECT count(*) FROM pairs WHERE s = i) AS d FROM nodes),
m AS MATERIALIZED (SELECT list(r ORDER BY i) AS m FROM (SELECT n.i, list(CASE WHEN n.i = k.i THEN 0 WHEN p.s IS NULL THEN 0 ELSE 1 / (sqrt(n.d) * sqrt(k.d)) END::DOUBLE ORDER BY k.i) AS r FROM deg n CROSS JOIN deg k LEFT JOIN pairs p ON p.s = n.i AND p.t = k.i GROUP BY n.i)),
up AS (
    SELECT 0 AS n, list_transform(range(25), lambda t: 1 + sin(t * t)::DOUBLE) AS x, 0::DOUBLE AS top
    UNION ALL SELECT n + 1, list_transform(y, lambda t: t / sqrt(list_dot_product(y, y))), list_dot_product(x, y) / list_dot_product(x, x) FROM (SELECT n, x, list_transform(list_zip(list_transform(m, lambda r: list_dot_product(r, x)), x), lambda t: t[1] + t[2]) AS y FROM up, m WHERE n < 900)
), down AS (
    SELECT 0 AS n, list_transform(range(25), lambda t: 1 + sin(t * t)::DOUBLE) AS x, 0::DOUBLE AS top
    UNION ALL SELECT n + 1, list_transform(y, lambda t: t / sqrt(list_dot_product(y, y))), list_dot_product(x, y) / list_dot_product(x, x) FROM (SELECT n, x, list_transform(list_zip(list_transform(m, lambda r: list_dot_product(r, x)), x), lambda t: t[2] - t[1]) AS y FROM down, m WHERE n < 900)
) SELECT 'diagonal_pcg' AS name, round(down.top / (2 - up.top), 2) AS v FROM up JOIN down USING (n) WHERE n = 900 UNION ALL SELECT 'jacobi', round(up.top - 1, 2) FROM up WHERE n = 900"""


@query(DIAGONAL)
def difficulty_scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the diagonal divided out: the condition number, and the spectral radius of Jacobi's iteration. Both follow from the extreme eigenvalues of D^-1/2 A D^-1/2."""
    a, _, _ = Q.system(spark, sf_dir)
    found = [("diagonal_pcg", round(solvers.condition_number(a, solvers.diagonal_preconditioner(a)), 2)), ("jacobi", round(solvers.jacobi_spectral_radius(a, tol=1e-6), 2))]
    return spark.createDataFrame(found, "name string, v double")


# --- simulation ---------------------------------------------------------------------------------

_FLUX = "{0}.u * {0}.u / ({0}.u * {0}.u + 0.25 * (1 - {0}.u) * (1 - {0}.u))"


@query(Q._grid_sql(4, f"0.5 * (r.u + l.u) - 0.25 * ({_FLUX.format('r')} - {_FLUX.format('l')})").replace(Q._grid_sql(0, "").split(" SELECT 0::BIGINT")[0], "WITH u0 AS (SELECT CAST(n_nationkey AS BIGINT) AS x, CASE WHEN n_nationkey % 5 = 0 THEN 1 ELSE 0 END::DOUBLE AS u FROM nation)", 1))
def lax_friedrichs_impulses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flux of two fluids in a porous medium, from a row of impulses as long as the table of nations."""
    u0 = simulation.impulses(spark, load(spark, sf_dir, "nation").count(), 0.2)
    return rows(simulation.lax_friedrichs(u0, 0.5, 1.0, simulation.buckley_leverett, 4), 9)


@query(
    """WITH RECURSIVE y AS (SELECT CAST(r_regionkey AS BIGINT) AS run, 0::BIGINT AS k, 0::DOUBLE AS p, 0::DOUBLE AS q, 1 + r_regionkey / 2.0::DOUBLE AS r FROM region
    UNION ALL SELECT run, k + 1, p + q * 0.0625, q + (5 - p - r * 0.5 * q) / (2 * 0.5) * 0.0625, r FROM y WHERE k < 31) SELECT run, k, k * 0.0625::DOUBLE AS t, round(p, 9) + 0.0 AS charge, round(q, 9) + 0.0 AS current FROM y"""
)
def euler_rlc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A coil, a capacitor and a resistor of another size for every region, switched on at once."""
    r = load(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("run"), (1 + F.col("r_regionkey") / 2).alias("r"), F.lit(2.0).alias("l"), F.lit(0.5).alias("c"), F.lit(2.0).alias("t_end"), F.lit(0.0625).alias("step"), F.array(F.lit(0.0), F.lit(0.0)).alias("y0"))
    y = simulation.euler_scenarios(r, "rlc")
    return y.select("run", "k", "t", (F.round(F.col("y")[0], 9) + 0.0).alias("charge"), (F.round(F.col("y")[1], 9) + 0.0).alias("current"))


@query(
    """WITH RECURSIVE y AS (SELECT CAST(n_nationkey AS BIGINT) AS run, 0::BIGINT AS k, 2 + n_nationkey / 10.0::DOUBLE AS prey, 1::DOUBLE AS hunters FROM nation
    UNION ALL SELECT run, k + 1, prey + (1.1 * prey - 0.4 * prey * hunters) * 0.03125, hunters + (0.1 * prey * hunters - 0.4 * hunters) * 0.03125 FROM y WHERE k < 63) SELECT run, k, round(prey, 8) AS prey, round(hunters, 8) AS hunters FROM y"""
)
def euler_predators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hunters and prey, from another number of prey for every nation."""
    r = load(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("run"), *[F.lit(v).alias(n) for n, v in (("a", 1.1), ("b", 0.4), ("c", 0.4), ("d", 0.1))], F.lit(2.0).alias("t_end"), F.lit(0.03125).alias("step"), F.array(2 + F.col("n_nationkey") / 10, F.lit(1.0)).alias("y0"))
    y = simulation.euler_scenarios(r, "lotka_volterra")
    return y.select("run", "k", F.round(F.col("y")[0], 8).alias("prey"), F.round(F.col("y")[1], 8).alias("hunters"))


@query(Q.RHS)
def framework_solve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A direct solve through the framework: the solution multiplied back."""
    a, b, _ = Q.system(spark, sf_dir)
    return Q.checked(a, SparkFramework(spark).solve(a, b))
