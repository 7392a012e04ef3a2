"""Interchange, primitives, sources, runner, streaming and entry points."""

import numpy as np
import pytest

from sparkloom.framework import SparkFramework
from sparkloom.operators import linear
from sparkloom.sources import catalog, matrix_market
from sparkloom.sources.interchange import Interchange, export, ingest
from sparkloom.tensor import equal, from_coo, from_numpy

M = np.arange(1, 7, dtype="float32").reshape(2, 3)


def test_interchange(spark):
    dense = Interchange.from_numpy(M)
    assert export(ingest(spark, dense)) == dense.to_coo()
    coo = Interchange.from_coo(([0, 1, 2], [0, 2, 1]), np.array([1.0, 2, 3]), (3, 3))
    assert export(ingest(spark, coo)) == coo
    with pytest.raises(ValueError):
        Interchange({"format": "other", "shape": (1,), "values": np.zeros(1)}).to_coo()
    twice = ([0, 0], [1, 1])
    assert from_coo(spark, twice, [1.0, 2.0], (2, 2)).to_numpy()[0, 1] == 3
    assert from_coo(spark, twice, [1.0, 2.0], (2, 2), dup="last").to_numpy()[0, 1] == 2
    with pytest.raises(ValueError):
        from_coo(spark, twice, [1.0, 2.0], (2, 2), dup="error")


def test_framework(spark):
    xp = SparkFramework(spark)
    a = xp.from_benchmark(Interchange.from_numpy(M))
    assert equal(xp.compute(xp.lazy(a)), a)
    assert np.allclose(xp.einsum("G[i,j] += A[i,k] * A[j,k]", A=a).to_numpy(), M @ M.T)
    assert xp.with_fill_value(a, 7).fill == 7
    assert np.allclose(xp.solve(from_numpy(spark, np.array([[2.0, 0], [0, 4]])), from_numpy(spark, np.array([2.0, 4]))).to_numpy(), [1, 1])


def test_checker_and_operators(spark):
    from sparkloom.framework import CheckerFramework, Lazy

    xp = CheckerFramework(spark)
    x = np.array([[1.0, 0, -2], [0, 3, 0]])
    a = xp.from_benchmark(Interchange.from_numpy(x))
    lazy = xp.lazy(a)
    made = abs(-lazy * 2 + a) / 4 - 1
    assert isinstance(made, Lazy) and isinstance(xp.einsum("S[] += A[i,j]", A=lazy), Lazy) and isinstance(xp.transpose(lazy), Lazy)
    for read in (float, bool, lambda t: t[0], xp.to_benchmark):
        with pytest.raises(TypeError):
            read(made)
    assert np.allclose(xp.compute(made).to_numpy(), abs(-x * 2 + x) / 4 - 1)
    assert np.allclose((2 - a).to_numpy(), 2 - x) and np.allclose((a @ a.T).to_numpy(), x @ x.T) and ((a > 0) & (a < 2)).to_numpy().sum() == 1


def test_generators(spark):
    from sparkloom.operators import solvers
    from sparkloom.sources import generators

    a, b, zero = (ingest(spark, s) for s in generators.system(generators.poisson(4)))
    x = solvers.conjugate_gradient(a, b, zero)
    assert np.allclose(a.to_numpy() @ x.to_numpy(), b.to_numpy(), atol=1e-5)
    assert generators.sparse_tensor((5, 5, 5), 0.1).data["shape"] == (5, 5, 5) and len(generators.gcn(10, 3, 2)) == 6
    assert np.linalg.matrix_rank(np.reshape(generators.factorizable_tensor((4, 4, 4), (2.0, 1.0)).data["values"], (4, 16))) == 2
    g = generators.graph(20, 2).data
    assert (g["indices_0"] != g["indices_1"]).all() and generators.rectangular(6, 3)[1].data["shape"] == (6,)


def test_primitives(spark):
    r = np.random.default_rng(0)
    a, b = np.round(r.random((3, 4)) * (r.random((3, 4)) < 0.6), 3), np.round(r.random((3, 4)), 3)
    ta, tb = from_numpy(spark, a), from_numpy(spark, b)
    assert np.allclose(linear.where(linear.elementwise(">", ta, 0.3), ta, tb).to_numpy(), np.where(a > 0.3, a, b))
    assert np.allclose(linear.where(linear.elementwise(">", ta, 0.3), ta, -1.0).to_numpy(), np.where(a > 0.3, a, -1))
    assert np.allclose(linear.reshape(ta, (2, -1)).to_numpy(), a.reshape(2, -1))
    assert np.allclose(linear.roll(ta, 1, 1).to_numpy(), np.roll(a, 1, 1))
    assert np.allclose(linear.slice_axis(ta, 1, 1, 3).to_numpy(), a[:, 1:3])
    assert np.allclose(linear.pick(ta, 0, 1).to_numpy(), a[1])
    assert np.allclose(linear.sort(ta).to_numpy(), np.sort(a)) and (linear.argsort(tb, k=2).to_numpy() == np.argsort(b)[:, :2]).all()
    assert np.allclose(linear.expand_dims(ta, 1).to_numpy(), a[:, None])
    assert np.allclose(linear.matmul(from_numpy(spark, r.random((2, 3, 4)).round(2)), from_numpy(spark, np.ones((2, 4, 5)))).to_numpy().shape, (2, 3, 5))
    assert linear.norm(ta) == pytest.approx(np.linalg.norm(a)) and linear.allclose(ta, ta) and not linear.allclose(ta, tb)
    f = from_numpy(spark, np.array([2, 0, 1]), fill=-1)
    assert list(linear.take(f, f).to_numpy()) == [1, 2, 0]
    assert np.allclose(linear.outer(f, f).to_numpy(), np.outer([2, 0, 1], [2, 0, 1]))
    cells = from_coo(spark, ([0], [0]), [9.0], (3, 4))
    assert linear.assign(ta, cells).to_numpy()[0, 0] == 9 and np.allclose(linear.reduce(ta, "max", 0).to_numpy(), a.max(0))
    assert np.allclose(linear.block_diag([from_numpy(spark, np.ones((1, 1))), from_numpy(spark, np.eye(2))]).to_numpy(), np.eye(3))
    assert list(linear.arange(spark, 1, 8, 3).to_numpy()) == [1, 4, 7] and 0 <= linear.rand(spark, (3,)).to_numpy().min()


def test_matrix_market(spark, tmp_path):
    (tmp_path / "m.mtx").write_text("%%MatrixMarket matrix coordinate real symmetric\n% note\n3 3 3\n1 1 2.0\n2 1 -1\n3 3 4\n")
    (tmp_path / "m_b.mtx").write_text("%%MatrixMarket matrix array real general\n3 1\n1\n0\n3\n")
    assert np.allclose(matrix_market.read_matrix(spark, f"{tmp_path}/m.mtx").to_numpy(), [[2, -1, 0], [-1, 0, 0], [0, 0, 4]])
    assert np.allclose(matrix_market.read_matrix(spark, f"{tmp_path}/m_b.mtx").to_numpy(), [[1], [0], [3]])
    assert [r["stem"] for r in matrix_market.companions(spark, str(tmp_path)).collect()] == ["m"]
    matrix_market.write_matrix(from_numpy(spark, np.eye(2)), f"{tmp_path}/out")


def test_catalog(spark, tmp_path):
    row = lambda n, v: (n, "g", v, 3, 9)
    schema = "matrix_name string, matrix_group string, `cg convergence criteria` double, n int, nnz int"
    old = spark.createDataFrame([row("a", 2.0)], schema)
    new = catalog.append(old, spark.createDataFrame([row("a", 1.0), row("b", 1.0), row("c", float("inf"))], schema))
    assert [r["matrix_name"] for r in new.collect()] == ["b", "a", "c"]
    catalog.write_catalog(new, f"{tmp_path}/c")
    assert catalog.listed(spark.read.json(f"{tmp_path}/c"), "b")


def test_runner(spark, tmp_path):
    from sparkloom import runner

    class Counting(SparkFramework):
        made = 0

        def from_benchmark(self, x):
            Counting.made += 1
            return super().from_benchmark(x)

    tiny = {"own": {"tiny": lambda: runner.generators.sparse_pair(8, 0.2)}, "matmul": {"mine": lambda: runner.generators.dense_pair(6)}}
    rows = runner.main(
        ["--framework", "spark", "mine", "--benchmark", "own", "matmul", "--data-generator", "tiny", "mine", "sparse_small", "--iterations", "1", "--results-folder", str(tmp_path)],
        spark, {"mine": Counting(spark)}, benchmarks={"own": runner.BENCHMARKS["matmul"]}, data_generators=tiny,
    )
    assert {r[:3] for r in rows} == {(f, b, g) for f in ("spark", "mine") for b, g in (("own", "tiny"), ("matmul", "mine"), ("matmul", "sparse_small"))}
    assert Counting.made == 6 and spark.read.csv(f"{tmp_path}/mine_matmul_mine", header=True).count() == 1
    assert set(runner.DATA_GENERATORS) == set(runner.BENCHMARKS) and sum(map(len, runner.DATA_GENERATORS.values())) > 60


@pytest.mark.parametrize("name", ["matmul", "cg", "preconditioned_cg", "block_preconditioned_cg", "jacobi", "gmres", "lsqr", "floyd_warshall", "hosvd", "gcn", "gcn_training", "ode"])
def test_kernels_run_on_their_smallest_data(spark, name):
    from sparkloom import runner

    data = next(iter(runner.DATA_GENERATORS[name].values()))()
    assert runner.BENCHMARKS[name](SparkFramework(spark), *data) is not None
    if name in ("matmul", "cg"):
        assert runner.main(["--framework", "checker"], spark, benchmark_names=[name], data_generator_names=[next(iter(runner.DATA_GENERATORS[name]))], iterations=1)


def test_block_matmul(spark):
    r = np.random.default_rng(0)
    x, y = r.random((23, 11)), r.random((11, 17))
    x[:8, :8] = 0
    assert np.allclose(linear.block_matmul(from_numpy(spark, x), from_numpy(spark, y), 4).to_numpy(), x @ y)
    with pytest.raises(ValueError):
        linear.block_matmul(from_numpy(spark, x), from_numpy(spark, x))


def test_streaming(spark, tmp_path):
    from pyspark.sql import functions as F

    from sparkloom.streaming.cells import accumulate, windowed_cells

    events = spark.createDataFrame([(f"2024-01-01 {h:02d}:{m:02d}:00", h % 2, 1.0) for h in range(6) for m in (0, 30)], "t string, u int, value double").select(F.to_timestamp("t").alias("ts"), "u", "value")
    events.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in")
    accumulate(windowed_cells(stream, ["u"], "value", late="1 hour"), f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    got = {(r["start"], r["i0"]): r["v"] for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    want = {(r["start"], r["i0"]): r["v"] for r in windowed_cells(events, ["u"], "value").collect()}
    assert got and all(want[k] == v for k, v in got.items())


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).columns == ["i0", "i1", "v"]
