"""Benchmark registry, timing loop and command line.

A run is every chosen framework x benchmark x data generator. Frameworks, benchmarks and generators of
one's own are merged into the registries; generators may also be added to a benchmark that is there already.
"""

from __future__ import annotations

import argparse
import time
from collections.abc import Callable
from functools import partial

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .framework import CheckerFramework, SparkFramework
from .operators import decomposition, graph, learning, linear, simulation, solvers
from .sources import generators
from .sources.interchange import Interchange
from .storage import session
from .tensor import SparseTensor

RESULT = "Framework string, Benchmark string, `Data Generator` string, Iteration int, ExecutionTime double"

#: name: what makes a framework for a session.
FRAMEWORKS: dict[str, Callable[[SparkSession], SparkFramework]] = {"spark": SparkFramework, "checker": CheckerFramework}


def _in(xp: SparkFramework, *data) -> tuple[SparseTensor, ...]:
    return tuple(xp.from_benchmark(x) for x in data)


def _matmul(xp: SparkFramework, a, b):
    """In lazily, out computed; two dense matrices are multiplied by blocks."""
    dense = a.data["format"] == b.data["format"] == "dense"
    return xp.compute((xp.block_matmul if dense else xp.matmul)(*xp.lazy(_in(xp, a, b))))


def _solve(solver: Callable, xp: SparkFramework, a, b, x):
    return solver(*_in(xp, a, b, x))


def _diagonal(xp: SparkFramework, a, b, x):
    m, b, x = _in(xp, a, b, x)
    return solvers.preconditioned_cg(m, b, x, solvers.diagonal_preconditioner(m))


def _blocks(xp: SparkFramework, a, b, x):
    m, b, x = _in(xp, a, b, x)
    return solvers.preconditioned_cg(m, b, x, solvers.block_preconditioner(solvers.block_cholesky(m)))


def _cp(xp: SparkFramework, x, rank: int, rounds: int):
    factors, weights = decomposition.cp_als(xp.from_benchmark(x), rank, rounds)
    return SparseTensor(factors[0].selectExpr("i as i0", "posexplode(f) as (r, v)").selectExpr("i0", "cast(r as bigint) as i1", "v"), (x.data["shape"][0], len(weights)), 0.0)


def _gcn(xp: SparkFramework, a, x, *weights):
    return learning.gcn(*_in(xp, a, x), *weights)


def _training(xp: SparkFramework, a, x, w1, b1, w2, b2):
    a, x = _in(xp, a, x)
    target = linear.full(xp.spark, (a.shape[0], w2.shape[1]), 1.0).dense()
    loss, *_ = learning.gcn_train(a, x, w1, b1, w2, b2, target, num_iterations=3, learning_rate=1e-4)
    return linear.full(xp.spark, (1,), float(loss)).dense()


def _ode(xp: SparkFramework, system: str, rows: list[tuple], schema: str):
    return xp.spark.createDataFrame(rows, schema).transform(partial(simulation.euler_scenarios, system=system))


def systems(sides: dict[str, int], shift: float) -> dict[str, Callable]:
    """Generators of five-point systems (A, b, 0) on square grids of the given sides."""
    return {name: partial(_system, side, shift) for name, side in sides.items()}


def _system(side: int, shift: float):
    return generators.system(generators.poisson(side, shift))


#: Side of the grid: 25 to 99,856 unknowns, 105 to 498,016 cells.
SIDES = {"grid_5": 5, "grid_10": 10, "grid_16": 16, "grid_32": 32, "grid_64": 64, "grid_100": 100, "grid_200": 200, "grid_316": 316}
#: Nodes of random graphs.
GRAPHS = {"graph_34": 34, "graph_100": 100, "graph_200": 200, "graph_400": 400}


def _rectangular(m: int, n: int):
    a, b = generators.rectangular(m, n)
    return a, b, Interchange.from_numpy(np.zeros(n))


def _graph(n: int, degree: float = 3):
    return (generators.graph(n, degree),)


def _tensor(shape: tuple[int, ...], rank: int, rounds: int):
    return generators.sparse_tensor(shape), rank, rounds


def _factorizable(shape: tuple[int, ...], rank: int, rounds: int):
    return generators.factorizable_tensor(shape, tuple(float(r + 1) for r in range(rank))), rank, rounds


_FLOYD = lambda xp, a: graph.all_pairs(xp.from_benchmark(a))

BENCHMARKS: dict[str, Callable] = {
    "matmul": _matmul,
    "cg": partial(_solve, solvers.conjugate_gradient),
    "preconditioned_cg": _diagonal,
    "block_preconditioned_cg": _blocks,
    "jacobi": partial(_solve, solvers.jacobi),
    "gmres": partial(_solve, solvers.gmres),
    "lsqr": lambda xp, a, b, x: solvers.lsqr(*_in(xp, a, b))[0],
    "floyd_warshall": _FLOYD,
    "mcl": lambda xp, a: graph.markov_clustering(xp.from_benchmark(a), iterations=20, pruning_threshold=1e-3),
    "cp_als": _cp,
    "hosvd": lambda xp, x, ranks: decomposition.hosvd(xp.from_benchmark(x), ranks, 5)[0],
    "gcn": _gcn,
    "gcn_training": _training,
    "ode": _ode,
}
_CIRCUIT = "run long, r double, c double, t_end double, step double, y0 array<double>"
DATA_GENERATORS: dict[str, dict[str, Callable]] = {
    "matmul": {"dense_small": partial(generators.dense_pair, 32), "dense_large": partial(generators.dense_pair, 4096), "sparse_small": partial(generators.sparse_pair, 32, 0.1), "sparse_large": partial(generators.sparse_pair, 4096, 0.01)},
    "cg": systems(SIDES, 0.1),
    "preconditioned_cg": systems(SIDES, 0.1),
    "block_preconditioned_cg": systems({k: v for k, v in SIDES.items() if v <= 64}, 0.1),
    "jacobi": systems(SIDES, 2.0),
    "gmres": systems(SIDES, 2.0),
    "lsqr": {f"rectangular_{m}": partial(_rectangular, m, m // 2) for m in (20, 50, 100, 200, 400, 800)},
    "floyd_warshall": {k: partial(_graph, v) for k, v in GRAPHS.items()},
    "mcl": {k: partial(_graph, v) for k, v in GRAPHS.items()},
    "cp_als": {f"{kind.__name__.strip('_')}_{len(shape)}": partial(kind, shape, rank, rounds) for shape, rank in (((20,) * 3, 3), ((20,) * 4, 4), ((10,) * 5, 4)) for kind, rounds in ((_tensor, 50), (_factorizable, 100))},
    "hosvd": {"dense_10": lambda: (generators.factorizable_tensor((10,) * 3, (3.0, 2.0, 1.0)), (3, 3, 3)), "sparse_20": lambda: (generators.sparse_tensor((20,) * 3), (3, 3, 3))},
    "gcn": {k: partial(generators.gcn, v, 8, 4) for k, v in GRAPHS.items()},
    "gcn_training": {k: partial(generators.gcn, v, 8, 4) for k, v in GRAPHS.items()},
    "ode": {f"rc_{n}": partial(lambda n: ("rc", [(k, 1.0 + k, 1.0, 1.0, 0.01, [0.0]) for k in range(n)], _CIRCUIT), n) for n in (1, 100)},
}


def timed(xp: SparkFramework, kernel: Callable, generator: Callable, iterations: int) -> list[float]:
    """Seconds of each iteration: new data every time, generation not counted, the whole result computed."""
    out = []
    for _ in range(iterations):
        data = generator()
        start = time.perf_counter()
        result = kernel(xp, *data)
        (result if isinstance(result, DataFrame) else result.df).write.format("noop").mode("overwrite").save()
        out.append(time.perf_counter() - start)
    return out


def save(spark: SparkSession, rows: list[tuple], folder: str) -> DataFrame:
    """One CSV folder per (framework, benchmark, generator)."""
    df = spark.createDataFrame(rows, RESULT)
    for f, b, g in sorted({r[:3] for r in rows}):
        part = [r for r in rows if r[:3] == (f, b, g)]
        spark.createDataFrame(part, RESULT).coalesce(1).write.mode("overwrite").csv(f"{folder}/{f}_{b}_{g}", header=True)
    return df


def chosen(given: list[str] | None, flag: list[str], known) -> list[str]:
    """Names asked for in code, else on the command line; "all" are those of the registry itself."""
    names = given if given is not None else list(known) if flag == ["all"] else flag
    return list(names)


def main(
    argv: list[str] | None = None,
    spark: SparkSession | None = None,
    frameworks: dict[str, Callable] | None = None,
    framework_names: list[str] | None = None,
    benchmarks: dict[str, Callable] | None = None,
    benchmark_names: list[str] | None = None,
    data_generators: dict[str, dict[str, Callable]] | None = None,
    data_generator_names: list[str] | None = None,
    iterations: int | None = None,
    results_folder: str | None = None,
) -> list[tuple]:
    """Frameworks (a framework, or what makes one for a session), benchmarks and data generators (by benchmark) are merged into the registries. What is named in code goes before the command line."""
    parser = argparse.ArgumentParser(description="Time kernels on generated data.")
    parser.add_argument("--framework", nargs="*", default=["spark"], help="frameworks to use, or all")
    parser.add_argument("--benchmark", nargs="*", default=["all"], help="benchmarks to run")
    parser.add_argument("--data-generator", nargs="*", default=["all"], help="data generators to use")
    parser.add_argument("--iterations", type=int, default=5)
    parser.add_argument("--results-folder", default=None, help="folder for the CSV results")
    args = parser.parse_args(argv)
    makers, kernels = FRAMEWORKS | (frameworks or {}), BENCHMARKS | (benchmarks or {})
    data = {b: DATA_GENERATORS.get(b, {}) | (data_generators or {}).get(b, {}) for b in {**kernels, **(data_generators or {})}}
    spark = spark or session()
    wanted = chosen(data_generator_names, args.data_generator, [g for made in data.values() for g in made])
    folder, rows = results_folder or args.results_folder, []
    for f in chosen(framework_names, args.framework, FRAMEWORKS):
        xp = makers[f](spark) if callable(makers[f]) else makers[f]
        for b in chosen(benchmark_names, args.benchmark, BENCHMARKS):
            for g in (g for g in data[b] if g in wanted):
                seconds = timed(xp, kernels[b], data[b][g], args.iterations if iterations is None else iterations)
                print(f"{f} {b} {g}: mean {sum(seconds) / max(len(seconds), 1):.3f} s")
                rows += [(f, b, g, i, s) for i, s in enumerate(seconds)]
    if folder and rows:
        save(spark, rows, folder)
    return rows


if __name__ == "__main__":
    main()
