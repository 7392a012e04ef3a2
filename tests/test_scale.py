"""Paths that only sizes beyond a bound take, with the bounds lowered; and what storage promises."""

import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom import framework, storage
from sparkloom.operators import decomposition, graph, learning, linear, solvers
from sparkloom.plans.einsum import einsum
from sparkloom.sources import generators
from sparkloom.sources.interchange import ingest
from sparkloom.tensor import from_numpy


@pytest.fixture
def large(monkeypatch):
    """Every vector counts as too long to broadcast."""
    monkeypatch.setattr(linear, "BROADCAST_CELLS", 0)
    monkeypatch.setattr(graph, "BROADCAST_CELLS", 0)


def test_products_shuffle_vectors_only(spark, large):
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        rows = solvers.matrix(ingest(spark, generators.poisson(12)))
        x = storage.cut(spark.range(144).select(F.col("id").alias("i"), F.lit(1.0).alias("x")))
        plan = linear.spmv(rows, x, 144)._jdf.queryExecution().executedPlan().toString()
        side = plan[plan.index("InMemoryTableScan") :]
        assert plan.count("Exchange hashpartitioning(i0") == 1 and "InMemoryRelation" in side
        before = plan[: plan.index("InMemoryTableScan")].splitlines()[-1]
        assert "Exchange" not in before
        rows.unpersist()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_solvers_on_large_vectors(spark, large):
    a, b, x0 = (ingest(spark, x) for x in generators.system(generators.poisson(5, 0.5)))
    want = np.linalg.solve(a.to_numpy(), b.to_numpy())
    for solved in (solvers.conjugate_gradient(a, b, x0), solvers.gmres(a, b, x0, restart=7), solvers.lsqr(a, b)[0]):
        assert np.allclose(solved.to_numpy(), want, atol=1e-5)


def test_pagerank_on_large_vectors(spark, large):
    a = ingest(spark, generators.graph(30, 2, seed=3, symmetric=False))
    m = a.to_numpy()
    out = m.sum(0)
    m = np.where(out > 0, m / np.where(out > 0, out, 1), 1 / 30)
    x = np.full(30, 1 / 30)
    for _ in range(100):
        x = 0.85 * m @ x + 0.15 / 30
    assert np.allclose(graph.pagerank(a).to_numpy(), x, atol=1e-6)


def test_sources_in_batches(spark):
    a = ingest(spark, generators.graph(12, 1.5, seed=4))
    assert np.allclose(graph.betweenness(a, batch=5).dense().to_numpy(), graph.betweenness(a).dense().to_numpy())


def test_solve_without_the_driver(spark, monkeypatch):
    monkeypatch.setattr(framework, "DIRECT", 4)
    xp = framework.SparkFramework(spark)
    a, b, _ = (ingest(spark, x) for x in generators.system(generators.poisson(4)))
    assert np.allclose(xp.solve(a, b).to_numpy(), np.linalg.solve(a.to_numpy(), b.to_numpy()), atol=1e-6)
    with pytest.raises(ValueError):
        xp.solve(from_numpy(spark, np.ones((5, 6))), b)


def test_nearest_in_blocks(spark, monkeypatch):
    r = np.random.default_rng(0)
    data, query = from_numpy(spark, r.random((40, 3))), from_numpy(spark, r.random((7, 3)))
    want = sorted(map(tuple, learning.nearest(data, query, None, 3).collect()))
    monkeypatch.setattr(learning, "QUERY_CELLS", 6)
    assert sorted(map(tuple, learning.nearest(data, query, None, 3).collect())) == want and len(want) == 21


def test_factors_drawn_in_tasks(spark, monkeypatch):
    monkeypatch.setattr(decomposition, "DRIVER_CELLS", 0)
    a, b = (decomposition.seeded_factor(spark, 50, 3).orderBy("i").collect() for _ in range(2))
    values = np.array([r["f"] for r in a])
    assert a == b and values.shape == (50, 3) and 0 <= values.min() and values.max() < 1 and 0.3 < values.mean() < 0.7


def test_long_axes_without_gram_matrices(spark, monkeypatch):
    x = ingest(spark, generators.sparse_tensor((9, 6, 5), 0.4, seed=2))
    core, factors = decomposition.hosvd(x, (2, 2, 2), 3)
    monkeypatch.setattr(decomposition, "GRAM_ROWS", 0)
    other, again = decomposition.hosvd(x, (2, 2, 2), 3)
    assert all(np.allclose(p, q, atol=1e-5) for p, q in zip(factors, again, strict=True))
    assert np.allclose(core.to_numpy(), other.to_numpy(), atol=1e-5)


def test_exact_integers(spark):
    a, b = np.array([9007199254740993, -9007199254740993, 7, -7, 2**62]), np.array([1, 2, -2, 5, -3])
    x, y = from_numpy(spark, a), from_numpy(spark, b)
    assert (einsum("D[i] = A[i] // B[i]", A=x, B=y).to_numpy() == a // b).all() and (einsum("D[i] = A[i] % B[i]", A=x, B=y).to_numpy() == a % b).all()
    a, b = np.array([3, -3, 2, -2, 1, -1, 0, 0, 10, -1]), np.array([39, 39, 62, 62, 1000, 1001, 0, 7, 18, 1000])
    x, y = from_numpy(spark, a, keep_all=True), from_numpy(spark, b, keep_all=True)
    assert (einsum("D[i] = A[i] ** B[i]", A=x, B=y).to_numpy() == a**b).all()
    m = np.array([[94906267, 94906267, 1], [3, -5, 7], [0, 2**30, 2**30], [-1, -1, -1], [2, 2, 2]])
    assert (einsum("P[i] *= M[i,j]", M=from_numpy(spark, m)).to_numpy() == m.prod(1)).all()
    filled = np.where(np.isin(m, (0, 1)), 3, m)
    sparse = from_numpy(spark, m).df.where("v <> 1")
    assert (einsum("P[i] *= M[i,j]", M=from_numpy(spark, m).with_df(sparse).with_fill_value(3)).to_numpy() == filled.prod(1)).all()
    for program in ("D[i] = A[i] ** -1", "D[i] = A[i] ** 99"):
        with pytest.raises(Exception, match="(?i)negative integer powers|overflow"):
            einsum(program, A=x).to_numpy()


def test_rounds_delete_what_is_old(spark):
    rounds, df = storage.Rounds(2), spark.range(3)
    for _ in range(5):
        df = rounds.cut(df.select((F.col("id") + 1).alias("id")))
    assert sorted(r["id"] for r in df.collect()) == [5, 6, 7]
    assert len(rounds.paths) == 2 and all(os.path.isdir(p.removeprefix("file://")) for p in rounds.paths)


def test_no_temporary_folder_on_a_cluster(spark):
    class Cluster:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Cluster()

        class conf:
            @staticmethod
            def get(name, default):
                return default

    with pytest.raises(RuntimeError, match=r"spark\.checkpoint\.dir"):
        storage.folder(Session())


def test_integers_beyond_64_bits(spark):
    a, b = np.array([3390654, -3390654, 2**62, 0]), np.array([3, 5, 2**40, 7])
    x, y = from_numpy(spark, a), from_numpy(spark, b)
    for op, f in (("//", lambda p, q: p // q), ("%", lambda p, q: p % q)):
        got = einsum(f"D[i] = (A[i] * 9007199254741 - 1) {op} (B[i] + 1)", A=x, B=y)
        want = [f(int(p) * 9007199254741 - 1, int(q) + 1) for p, q in zip(a, b, strict=True)]
        if op == "//":  # one quotient has more than 64 bits
            with pytest.raises(Exception, match="(?i)overflow|out.of.range"):
                got.to_numpy()
            got, want = einsum("D[i] = (A[i] * 9007199254741 - 1) // (B[i] * 8 + 1)", A=x, B=y), [(int(p) * 9007199254741 - 1) // (int(q) * 8 + 1) for p, q in zip(a, b, strict=True)]
        assert got.kind == "int" and got.dense().to_numpy().tolist() == want


def test_products_beyond_64_bits(spark):
    m = [[10381, 10300, 10200, 10100, 10000], [3, 1, 1, 1, 1], [2**31, -(2**31), 2**31, 0, 5], [2**31, -(2**31), 2**31, 3, 5]]
    got = einsum("P[i] *= M[i,j]", M=from_numpy(spark, np.array(m)))
    assert got.kind == "wide" and got.to_numpy().tolist() == [math.prod(r) for r in m]
    assert einsum("P[i] *= M[i,j]", M=from_numpy(spark, np.array(m[1:3]))).kind == "int"
    stored = from_numpy(spark, np.array(m[:2]))
    filled = einsum("P[i] *= M[i,j]", M=stored.with_df(stored.df.where("i0 = 1")).with_fill_value(10007))
    assert filled.dense().to_numpy().tolist() == [10007**5, 3]
    with pytest.raises(Exception, match="(?i)overflow|out.of.range|precision"):
        einsum("P[i] *= M[i,j]", M=from_numpy(spark, np.full((2, 9), 2**31)))
