"""Synthetic inputs for the kernels: what collections of matrices would supply, made from seeds."""

from __future__ import annotations

import numpy as np

from .interchange import Interchange


def dense_pair(n: int, seed: int = 0) -> tuple[Interchange, Interchange]:
    r = np.random.default_rng(seed)
    return tuple(Interchange.from_numpy(r.random((n, n)).astype("float32")) for _ in range(2))


def sparse_matrix(n: int, density: float, seed: int = 0) -> Interchange:
    r, k = np.random.default_rng(seed), int(n * n * density)
    at = np.unique(r.integers(0, n * n, k))
    return Interchange.from_coo((at // n, at % n), r.random(len(at)).astype("float32"), (n, n))


def sparse_pair(n: int, density: float, seed: int = 0) -> tuple[Interchange, Interchange]:
    return sparse_matrix(n, density, seed), sparse_matrix(n, density, seed + 1)


def poisson(side: int, shift: float = 0.0) -> Interchange:
    """Five-point Laplacian of a square grid: symmetric positive definite, worse conditioned the larger the grid."""
    n, i = side * side, np.arange(side * side)
    right, down = i[i % side < side - 1], i[i < n - side]
    rows = np.concatenate([i, right, right + 1, down, down + side])
    cols = np.concatenate([i, right + 1, right, down + side, down])
    values = np.concatenate([np.full(n, 4.0 + shift), np.full(2 * len(right) + 2 * len(down), -1.0)])
    return Interchange.from_coo((rows, cols), values, (n, n))


def system(a: Interchange, seed: int = 0) -> tuple[Interchange, Interchange, Interchange]:
    """(A, b, 0) with b = A x for a random x."""
    x = np.random.default_rng(seed).random(a.data["shape"][1])
    b = np.zeros(a.data["shape"][0])
    rows, cols = a.indices
    np.add.at(b, rows, a.data["values"] * x[cols])
    return a, Interchange.from_numpy(b), Interchange.from_numpy(np.zeros(len(x)))


def rectangular(m: int, n: int, density: float = 0.2, noise: float = 0.1, seed: int = 0) -> tuple[Interchange, Interchange]:
    """A least-squares problem with noise on its right-hand side."""
    r = np.random.default_rng(seed)
    a = np.where(r.random((m, n)) < density, r.standard_normal((m, n)), 0.0) + np.eye(m, n)
    return Interchange.from_numpy(a).to_coo(), Interchange.from_numpy(a @ r.random(n) + noise * r.standard_normal(m))


def graph(n: int, degree: float, seed: int = 0, symmetric: bool = True) -> Interchange:
    """A random graph without loops, 0/1 weights."""
    r = np.random.default_rng(seed)
    s, t = r.integers(0, n, (2, int(n * degree)))
    keep = s != t
    s, t = s[keep], t[keep]
    if symmetric:
        s, t = np.concatenate([s, t]), np.concatenate([t, s])
    at = np.unique(s * n + t)
    return Interchange.from_coo((at // n, at % n), np.ones(len(at)), (n, n))


def sparse_tensor(shape: tuple[int, ...], density: float = 0.01, seed: int = 0) -> Interchange:
    """Cells at random flat places, unravelled."""
    r, size = np.random.default_rng(seed), int(np.prod(shape))
    at = r.choice(size, max(1, int(size * density)), replace=False)
    return Interchange.from_coo(np.unravel_index(at, shape), r.random(len(at)).astype("float32"), shape)


def factorizable_tensor(shape: tuple[int, ...], weights: tuple[float, ...], seed: int = 0) -> Interchange:
    """A dense tensor of exactly known rank."""
    r, out = np.random.default_rng(seed), np.zeros(shape)
    for w in weights:
        part = np.array(w)
        for n in shape:
            part = np.multiply.outer(part, r.random(n))
        out += part
    return Interchange.from_numpy(out)


def gcn(n: int, features: int, hidden: int, outputs: int = 1, degree: float = 3, seed: int = 42) -> tuple:
    """(A, X, W1, b1, W2, b2) for a random graph."""
    r = np.random.default_rng(seed)
    return graph(n, degree, seed), Interchange.from_numpy(r.random((n, features))), r.standard_normal((features, hidden)) * 0.1, np.zeros(hidden), r.standard_normal((hidden, outputs)) * 0.1, np.zeros(outputs)
