"""Iterative solvers. State vectors share one table, so their dot products are single aggregates."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import Appended, Rounds, cut
from ..tensor import SparseTensor
from .linear import prepared, spmv


def vector(t: SparseTensor, name: str) -> DataFrame:
    """(i, name) for every index of a vector."""
    filled = t.spark.range(t.shape[0]).withColumnRenamed("id", "i").join(t.df.select(F.col("i0").alias("i"), "v"), "i", "left")
    return filled.select("i", F.coalesce(F.col("v").cast("double"), F.lit(float(t.fill))).alias(name))


def as_tensor(state: DataFrame, name: str, n: int) -> SparseTensor:
    return SparseTensor(state.select(F.col("i").alias("i0"), F.col(name).alias("v")), (n,), 0.0)


def matrix(a: SparseTensor, transposed: bool = False) -> DataFrame:
    """Rows for many products with a vector; ``unpersist`` them afterwards."""
    return prepared(a.df.select("i0", "i1", F.col("v").cast("double").alias("v")), a.shape[0 if transposed else 1], transposed)


def times(a: DataFrame, state: DataFrame, name: str, into: str, n: int, transposed: bool = False) -> DataFrame:
    """The state with ``into`` = A @ name."""
    y = spmv(a, state.select("i", F.col(name).alias("x")), n, transposed).withColumnRenamed("y", into)
    return state.drop(into).join(y, "i", "left").fillna(0.0, [into])


def total(state: DataFrame, *columns) -> list[float]:
    return [float(x or 0.0) for x in state.agg(*[F.sum(c) for c in columns]).first()]


def col(name: str):
    return F.col(name)


def conjugate_gradient(a: SparseTensor, b: SparseTensor, x0: SparseTensor, rel_tol: float = 1e-8, abs_tol: float = 1e-20, max_iters: int = 10_000) -> SparseTensor:
    """For symmetric positive definite matrices; the last iterate if it does not converge."""
    return preconditioned_cg(a, b, x0, None, rel_tol, abs_tol, max_iters)


Preconditioner = Callable[[DataFrame], DataFrame]


def diagonal_preconditioner(m: SparseTensor) -> Preconditioner:
    """z = r / m for a stored diagonal (a vector or a diagonal matrix)."""
    d = m.df.select(F.col("i0").alias("i"), F.col("v").cast("double").alias("m")) if m.rank == 1 else m.df.where("i0 = i1").select(F.col("i0").alias("i"), F.col("v").cast("double").alias("m"))
    d = cut(d)
    return lambda state: state.drop("z").join(d, "i", "left").select(*[c for c in state.columns if c != "z"], F.when(F.col("m").isNull(), 0.0).otherwise(col("r") / F.when(col("m") == 0, F.lit(None)).otherwise(col("m"))).alias("z"))


def block_size(n: int) -> int:
    return max(1, n // min(10, n))


def block_cholesky(a: SparseTensor) -> SparseTensor:
    """Lower Cholesky factors of the diagonal blocks of ``n // min(10, n)`` rows (the last may be shorter)."""
    n, size = a.shape[0], block_size(a.shape[0])
    own = a.df.select("i0", "i1", F.col("v").cast("double").alias("v"), F.floor(F.col("i0") / size).alias("block")).where(F.floor(F.col("i1") / size) == F.col("block"))

    def factor(key, rows: pd.DataFrame) -> pd.DataFrame:
        start = int(key[0]) * size
        m = np.zeros((min(size, n - start),) * 2)
        m[rows["i0"] - start, rows["i1"] - start] = rows["v"]
        low = np.linalg.cholesky(m)
        i, j = np.nonzero(low)
        return pd.DataFrame({"i0": i + start, "i1": j + start, "v": low[i, j]})

    return SparseTensor(own.groupBy("block").applyInPandas(factor, "i0 long, i1 long, v double"), a.shape, 0.0)


def block_preconditioner(factors: SparseTensor) -> Preconditioner:
    """z from L y = r, then L' z = y, block by block."""
    n, size = factors.shape[0], block_size(factors.shape[0])
    rows = cut(factors.df.select("i0", "i1", "v", F.floor(F.col("i0") / size).alias("block")))

    def solve(key, low: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
        start = int(key[0]) * size
        m = np.zeros((min(size, n - start),) * 2)
        m[low["i0"] - start, low["i1"] - start] = low["v"]
        r = np.zeros(len(m))
        r[state["i"] - start] = state["r"]
        z = np.linalg.solve(m.T, np.linalg.solve(m, r))
        return pd.DataFrame({"i": np.arange(start, start + len(z)), "z": z})

    def apply(state: DataFrame) -> DataFrame:
        sides = state.select("i", "r", F.floor(F.col("i") / size).alias("block"))
        z = rows.groupBy("block").cogroup(sides.groupBy("block")).applyInPandas(solve, "i long, z double")
        return state.drop("z").join(z, "i")

    return apply


def preconditioned_cg(a: SparseTensor, b: SparseTensor, x0: SparseTensor, precondition: Preconditioner | None, rel_tol: float = 1e-8, abs_tol: float = 1e-20, max_iters: int = 10_000, trace: list | None = None) -> SparseTensor:
    """trace: gets the step and the direction coefficient of every round."""
    n, rows, rounds = a.shape[0], matrix(a), Rounds(4)
    state = times(rows, vector(b, "b").join(vector(x0, "x"), "i"), "x", "q", n)
    state = state.withColumn("r", col("b") - col("q"))
    z = (lambda s: s.withColumn("z", col("r"))) if precondition is None else precondition
    state = rounds.cut(z(state).withColumn("p", col("z")))
    bb, rr, rz = total(state, col("b") ** 2, col("r") ** 2, col("r") * col("z"))
    limit = max(rel_tol**2 * bb, abs_tol**2)
    for _ in range(max_iters):
        if rr <= limit:
            break
        state = rounds.cut(times(rows, state, "p", "q", n))
        (pq,) = total(state, col("p") * col("q"))
        alpha = rz / pq
        state = state.withColumns({"x": col("x") + alpha * col("p"), "r": col("r") - alpha * col("q")})
        # without a preconditioner all that follows is a projection of the checkpoint
        state = z(state) if precondition is None else rounds.cut(z(state))
        rr, new = total(state, col("r") ** 2, col("r") * col("z"))
        if trace is not None:
            trace.append((alpha, new / rz))
        state, rz = state.withColumn("p", col("z") + (new / rz) * col("p")), new
    rows.unpersist()
    return as_tensor(state, "x", n)


def jacobi(a: SparseTensor, b: SparseTensor, x0: SparseTensor, rel_tol: float = 1e-6, abs_tol: float = 1e-20, max_iters: int = 1000) -> SparseTensor:
    """x + (b - A x) / diag(A); a missing or zero diagonal is an error, and so is running out of rounds."""
    n, rows, kept = a.shape[0], matrix(a), Rounds()
    d = rows.where("i0 = i1 and v <> 0").select(F.col("i0").alias("i"), F.col("v").alias("d"))
    if d.count() != n:
        raise ValueError("the diagonal has zeros")
    state = vector(b, "b").join(vector(x0, "x"), "i").join(d, "i")
    state = kept.cut(times(rows, state, "x", "q", n).withColumn("r", col("b") - col("q")))
    bb, rr = total(state, col("b") ** 2, col("r") ** 2)
    limit, rounds = max(rel_tol * math.sqrt(bb), abs_tol), 0
    while math.sqrt(rr) >= limit:
        if rounds == max_iters:
            raise RuntimeError("Jacobi did not converge")
        state = state.withColumn("x", col("x") + col("r") / col("d"))
        state = kept.cut(times(rows, state, "x", "q", n).withColumn("r", col("b") - col("q")))
        (rr,) = total(state, col("r") ** 2)
        rounds += 1
    rows.unpersist()
    return as_tensor(state, "x", n)


def gmres(a: SparseTensor, b: SparseTensor, x0: SparseTensor, restart: int = 50, tol: float = 1e-8, max_iter: int = 1000) -> SparseTensor:
    """Arnoldi vectors are rows (k, i, q) of a table that grows by one vector a step; the small least-squares problem is solved on the driver."""
    n, rows, rounds, kept = a.shape[0], matrix(a), 0, Rounds(3)
    state = cut(times(rows, vector(b, "b").join(vector(x0, "x"), "i"), "x", "q", n).withColumn("r", col("b") - col("q")))
    beta = first = math.sqrt(total(state, col("r") ** 2)[0])
    if first < tol:
        return as_tensor(state, "x", n)
    while rounds < max_iter:
        basis = Appended(state.select(F.lit(0).alias("k"), "i", (col("r") / beta).alias("q")), "basis")
        last = basis.read()
        h = np.zeros((restart + 1, restart))
        for k in range(restart):
            w = kept.cut(times(rows, last.select("i", "q"), "q", "w", n).select("i", "w"))
            every = basis.read().join(w, "i")
            for j, d in every.groupBy("k").agg(F.sum(col("q") * col("w"))).collect():
                h[j, k] = d
            weight = F.array(*[F.lit(float(d)) for d in h[: k + 1, k]])
            taken = basis.read().groupBy("i").agg(F.sum(col("q") * F.get(weight, col("k"))).alias("taken"))
            w = kept.cut(w.join(taken, "i", "left").select("i", (col("w") - F.coalesce("taken", F.lit(0.0))).alias("w")))
            h[k + 1, k] = math.sqrt(total(w, col("w") ** 2)[0])
            broke = h[k + 1, k] <= 1e-14 * first
            e1 = np.zeros(k + 2)
            e1[0] = beta
            c = np.linalg.lstsq(h[: k + 2, : k + 1], e1, rcond=None)[0]
            gap = float(np.linalg.norm(e1 - h[: k + 2, : k + 1] @ c))
            rounds += 1
            if gap / first < tol or broke or rounds >= max_iter or k + 1 == restart:
                break
            last = basis.append(w.select(F.lit(k + 1).alias("k"), "i", (col("w") / h[k + 1, k]).alias("q")))
        step = basis.read().groupBy("i").agg(F.sum(col("q") * F.get(F.array(*[F.lit(float(v)) for v in c]), col("k"))).alias("step"))
        moved = state.join(step, "i", "left").select("i", "b", (col("x") + F.coalesce("step", F.lit(0.0))).alias("x"))
        state = cut(times(rows, moved, "x", "q", n).withColumn("r", col("b") - col("q")))
        beta = math.sqrt(total(state, col("r") ** 2)[0])
        if beta / first < tol or beta == 0:
            break
    rows.unpersist()
    return as_tensor(state, "x", n)


def lsqr(a: SparseTensor, b: SparseTensor, atol: float = 1e-9, btol: float = 1e-9, conlim: float = 1e8, max_iters: int = 10_000, trace: list | None = None) -> tuple[SparseTensor, int, int]:
    """(x, exit, rounds) for rectangular systems; exit 1: small residual, 2: small gradient, 3: ill conditioned, 0: zero solution or out of rounds."""
    (m, n), rows = a.shape, matrix(a)
    turned, kept = matrix(a, True) if rows.is_cached else rows, Rounds(4)
    u = vector(b, "u")
    beta = b_norm = math.sqrt(total(u, col("u") ** 2)[0])
    empty = a.spark.range(n).select(F.col("id").alias("i"), F.lit(0.0).alias("x"))
    if beta == 0:
        return as_tensor(empty, "x", n), 0, 0
    u = kept.cut(u.withColumn("u", col("u") / beta))
    v = spmv(turned, u.select("i", F.col("u").alias("x")), m, True).withColumnRenamed("y", "v")
    right = kept.cut(empty.join(v, "i", "left").fillna(0.0, ["v"]))
    alpha = math.sqrt(total(right, col("v") ** 2)[0])
    if alpha == 0:
        return as_tensor(empty, "x", n), 0, 0
    right = right.withColumn("v", col("v") / alpha).withColumn("w", col("v"))
    if trace is not None:
        trace.append((beta, alpha))
    phi_bar, rho_bar, a_sq, x_sq, d_sq = beta, alpha, beta**2, 0.0, 0.0
    code = it = 0
    while it < max_iters and not code:
        it += 1
        av = spmv(rows, right.select("i", F.col("v").alias("x")), n).withColumnRenamed("y", "av")
        u = kept.cut(u.join(av, "i", "left").fillna(0.0, ["av"]).select("i", (col("av") - alpha * col("u")).alias("u")))
        beta = math.sqrt(total(u, col("u") ** 2)[0])
        u = u.withColumn("u", col("u") / (beta or 1.0))
        atu = spmv(turned, u.select("i", F.col("u").alias("x")), m, True).withColumnRenamed("y", "atu")
        right = kept.cut(right.join(atu, "i", "left").fillna(0.0, ["atu"]).withColumn("v", col("atu") - beta * col("v")).drop("atu"))
        new_alpha, w_sq = total(right, col("v") ** 2, col("w") ** 2)
        alpha = math.sqrt(new_alpha)
        if trace is not None:
            trace.append((beta, alpha))
        rho = math.hypot(rho_bar, beta)
        c, s = rho_bar / rho, beta / rho
        theta, rho_bar = s * alpha, -c * alpha
        phi, phi_bar = c * phi_bar, s * phi_bar
        step = phi / rho
        right = right.withColumn("x", col("x") + step * col("w")).withColumn("v", col("v") / (alpha or 1.0))
        right = right.withColumn("w", col("v") - (theta / rho) * col("w"))
        d_sq += w_sq / rho**2
        r_norm, ar_norm = abs(phi_bar), alpha * abs(phi_bar * c)
        a_sq += alpha**2 + beta**2
        x_sq += step**2
        a_norm, condition = math.sqrt(a_sq), math.sqrt(a_sq) * math.sqrt(d_sq)
        if condition and 1 / condition <= 1 / conlim:
            code = 3
        if r_norm == 0 or ar_norm / (a_norm * r_norm) <= atol:
            code = 2
        if r_norm / b_norm <= atol * a_norm * math.sqrt(x_sq) / b_norm + btol:
            code = 1
    x = cut(right.select("i", "x"))
    rows.unpersist()
    turned.unpersist()
    return as_tensor(x, "x", n), code, it


# --- how hard a system is -------------------------------------------------------


def power_iteration(apply: Callable[[DataFrame], DataFrame], state: DataFrame, rounds: int, tol: float) -> float:
    """Signed eigenvalue of largest magnitude; ``apply`` adds q = M x to a state (i, x)."""
    kept = Rounds()
    state, value = kept.cut(state), 0.0
    (xx,) = total(state, col("x") ** 2)
    state = state.withColumn("x", col("x") / math.sqrt(xx))
    for _ in range(rounds):
        state = kept.cut(apply(state))
        xq, qq = total(state, col("x") * col("q"), col("q") ** 2)
        if qq == 0:
            return 0.0
        done = abs(xq - value) <= tol * abs(xq)
        value = xq
        if done:
            break
        state = state.select("i", (col("q") / math.sqrt(qq)).alias("x"))
    return value


def seed_vector(spark, n: int) -> DataFrame:
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(11), "id"), 11).cast("double") / float(1 << 53)
    return spark.range(n).select(F.col("id").alias("i"), (bits + 0.5).alias("x"))


def jacobi_spectral_radius(a: SparseTensor, rounds: int = 200, tol: float = 1e-3) -> float:
    """Largest-magnitude eigenvalue of I - D^-1 A, signed."""
    n, rows = a.shape[0], matrix(a)
    d = cut(rows.where("i0 = i1").select(F.col("i0").alias("i"), F.col("v").alias("d")))
    step = lambda s: times(rows, s.select("i", "x"), "x", "ax", n).join(d, "i").withColumn("q", col("x") - col("ax") / col("d"))
    return power_iteration(step, seed_vector(a.spark, n), rounds, tol)


def seeded(spark, n: int) -> SparseTensor:
    return SparseTensor(seed_vector(spark, n).toDF("i0", "v"), (n,), 0.0)


def condition_number(a: SparseTensor, precondition: Preconditioner | None = None, rounds: int = 50) -> float:
    """Ratio of extreme eigenvalues of M^-1 A (of A without a preconditioner), for symmetric positive definite A.

    The coefficients of conjugate gradients are those of a Lanczos process; the extreme
    eigenvalues of its small tridiagonal matrix approach those sought.
    """
    n, steps = a.shape[0], []
    zero = SparseTensor(a.spark.createDataFrame([], "i0 long, v double"), (n,), 0.0)
    preconditioned_cg(a, seeded(a.spark, n), zero, precondition, 1e-10, max_iters=min(rounds, n), trace=steps)
    k = len(steps)
    t = np.zeros((k, k))
    for i, (alpha, beta) in enumerate(steps):
        t[i, i] = 1 / alpha + (steps[i - 1][1] / steps[i - 1][0] if i else 0.0)
        if i + 1 < k:
            t[i, i + 1] = t[i + 1, i] = math.sqrt(beta) / alpha
    values = np.linalg.eigvalsh(t)
    return float(values[-1] / values[0])


def singular_ratio(a: SparseTensor, rounds: int = 50) -> float:
    """Largest over smallest singular value, from the bidiagonal matrix that LSQR builds."""
    steps: list = []
    lsqr(a, seeded(a.spark, a.shape[0]), 1e-12, 1e-12, math.inf, min(rounds, *a.shape), steps)
    k = len(steps) - 1
    b = np.zeros((k + 1, k))
    for i in range(k):
        b[i, i], b[i + 1, i] = steps[i][1], steps[i + 1][0]
    values = np.linalg.svd(b, compute_uv=False)
    return float(values[0] / values[-1]) if values[-1] > 0 else math.inf
