import math

import numpy as np
import pytest

from sparkloom.operators import decomposition, learning, simulation, solvers
from sparkloom.tensor import from_numpy

R = np.random.default_rng(3)
Q = R.random((5, 5))
SPD = Q @ Q.T + 5 * np.eye(5)
WANT = np.array([1.0, 2, 3, 4, 5])


@pytest.fixture(scope="module")
def t(spark):
    return lambda a: from_numpy(spark, np.asarray(a, float))


def test_conjugate_gradients(t):
    a, b, zero = t(SPD), t(SPD @ WANT), t(np.zeros(5))
    for m in (None, solvers.diagonal_preconditioner(t(np.diag(SPD))), solvers.block_preconditioner(solvers.block_cholesky(a))):
        assert np.allclose(solvers.preconditioned_cg(a, b, zero, m).to_numpy(), WANT, atol=1e-5)


def test_jacobi(t):
    a = SPD + np.diag(SPD.sum(1))
    assert np.allclose(solvers.jacobi(t(a), t(a @ WANT), t(np.zeros(5)), 1e-8).to_numpy(), WANT, atol=1e-4)
    with pytest.raises(ValueError):
        solvers.jacobi(t([[0.0, 1], [1, 1]]), t([1.0, 1]), t([0.0, 0]))
    with pytest.raises(RuntimeError):
        solvers.jacobi(t(a), t(a @ WANT), t(np.zeros(5)), 1e-12, max_iters=2)


def test_gmres(t):
    a = Q + np.eye(5)
    assert np.allclose(solvers.gmres(t(a), t(a @ WANT), t(np.zeros(5)), restart=5).to_numpy(), WANT, atol=1e-5)


def test_lsqr(t):
    a = R.random((6, 4))
    x, code, _ = solvers.lsqr(t(a), t(a @ WANT[:4]))
    assert code == 1 and np.allclose(x.to_numpy(), WANT[:4], atol=1e-5)
    b = R.random(6)
    x, code, _ = solvers.lsqr(t(a), t(b))
    assert code == 2 and np.allclose(x.to_numpy(), np.linalg.lstsq(a, b, rcond=None)[0], atol=1e-5)


def test_difficulty(t):
    assert solvers.condition_number(t(SPD)) == pytest.approx(np.linalg.cond(SPD), rel=0.01)
    scaled = np.diag(np.diag(SPD) ** -0.5)
    assert solvers.condition_number(t(SPD), solvers.diagonal_preconditioner(t(np.diag(SPD)))) == pytest.approx(np.linalg.cond(scaled @ SPD @ scaled), rel=0.01)
    a = R.random((7, 4))
    assert solvers.singular_ratio(t(a)) == pytest.approx(np.linalg.cond(a), rel=0.01)
    j = SPD + np.diag(SPD.sum(1))
    values = np.linalg.eigvals(np.eye(5) - j / np.diag(j)[:, None]).real
    assert solvers.jacobi_spectral_radius(t(j), rounds=25) == pytest.approx(values[np.abs(values).argmax()], rel=0.05)


def test_decompositions(t):
    f = [R.random((n, 2)) for n in (5, 4, 3)]
    x = np.einsum("ir,jr,kr->ijk", *f)
    factors, weights = decomposition.cp_als(t(x), 2, max_iter=4)
    assert decomposition.cp_error(t(x), factors, weights) < 0.2
    core, u = decomposition.hosvd(t(x), (2, 2, 2), max_iter=1)
    assert np.allclose(np.einsum("pqr,ip,jq,kr->ijk", core.to_numpy(), *u), x, atol=1e-5)
    assert np.allclose(u[0].T @ u[0], np.eye(2))


def test_graph_convolution(t):
    a = np.array([[0, 1, 0], [1, 0, 1], [0, 1, 0.0]])
    x, w1, w2, b1, b2 = R.random((3, 2)), np.eye(2) - 0.3, np.ones((2, 1)), np.array([0.1, -0.2]), np.array([0.5])
    want = a @ np.maximum(a @ x @ w1 + b1, 0) @ w2 + b2
    assert np.allclose(learning.gcn(t(a), t(x), w1, b1, w2, b2).to_numpy(), want)
    goal = t([[1.0], [2], [3]])
    first, *_ = learning.gcn_train(t(a), t(x), w1, b1, w2, b2, goal, 1)
    later, *_ = learning.gcn_train(t(a), t(x), w1, b1, w2, b2, goal, 3)
    assert later < first == pytest.approx(((want - np.array([[1.0], [2], [3]])) ** 2).sum() / 3)


def test_neighbours_and_clusters(t):
    data, query = R.random((20, 10)), R.random((4, 10))
    found = learning.nearest(t(data), t(query), None, 3).toPandas().sort_values(["query", "rank"])
    order = np.argsort(np.linalg.norm(query[:, None] - data[None], axis=2), 1)[:, :3]
    assert (found["neighbour"].to_numpy().reshape(4, 3) == order).all()
    points = t([[0, 0], [5, 5], [9, 0], [0, 0.1], [5, 5.1], [9, 0.1]])
    assert list(learning.k_means(points, 3).to_numpy()) == [0, 1, 2, 0, 1, 2]
    with pytest.raises(ValueError):
        learning.projected_k_means(points, 3, 0.5)


def test_clusters_to_the_end(t):
    x = np.arange(300.0)[:, None]
    centres, old, rounds = x[:3].copy(), None, 0
    while old is None or (labels != old).any():
        old, labels = (None if old is None else labels), np.abs(x - centres.T).argmin(1)
        old = np.full(len(x), -1) if old is None else old
        centres, rounds = np.array([x[labels == j].mean(0) for j in range(3)]), rounds + 1
    assert rounds > 10 and (learning.k_means(t(x), 3, None).to_numpy() == labels).all()
    assert (learning.k_means(t(x), 3, 4).to_numpy() != labels).any()


def test_finite_differences(spark):
    u0 = simulation.impulses(spark, 20, 0.2)
    grid = simulation.lax_friedrichs(u0, 1, 1, simulation.advection(0.9), 3).to_numpy()
    assert np.allclose(grid, simulation.lax_friedrichs_by_matrix(u0, simulation.lax_friedrichs_matrix(spark, 20, 1, 1, 0.9), 3).to_numpy())
    assert np.allclose(grid.sum(1), grid[0].sum())


def test_particles(spark):
    n = 40
    x, y, vx, vy = (R.random(n) * 0.1 for _ in range(4))
    p = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(zip(x, y, vx, vy, strict=True))], "pid long, x double, y double, vx double, vy double")
    got = simulation.particles(p, 2.0, 2).orderBy("pid").toPandas()
    for _ in range(2):
        dx, dy = x - x[:, None], y - y[:, None]
        r2 = dx * dx + dy * dy
        r2 = np.maximum(np.where(r2 > 1e-4, np.inf, r2), 1e-8)
        c = (1 - 0.01 / np.sqrt(r2)) / r2 / 0.01
        vx, vy = vx + (c * dx).sum(1) * 0.0005, vy + (c * dy).sum(1) * 0.0005
        x, y = x + vx * 0.0005, y + vy * 0.0005
        vx, x = np.where((x < 0) | (x > 2), -vx, vx), np.where(x > 2, 4 - x, abs(x))
        vy, y = np.where((y < 0) | (y > 2), -vy, vy), np.where(y > 2, 4 - y, abs(y))
    assert np.allclose(got["x"], x) and np.allclose(got["vy"], vy)


def test_euler():
    t, y = simulation.forward_euler(simulation.rc(1000, 0.001), (0, 5), [0.0], 0.01)
    assert max(abs(v[0] - 5 * (1 - math.exp(-s))) for s, v in zip(t, y, strict=True)) < 0.05
    assert len(simulation.forward_euler(simulation.lotka_volterra(0.1, 0.02, 0.3, 0.01), (0, 1), [40, 9], 0.1)[1]) in (10, 11)
