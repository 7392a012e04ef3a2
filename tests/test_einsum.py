"""The einsum language against NumPy, on random sparse operands."""

import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from sparkloom.plans.einsum import einsum
from sparkloom.plans.parse import Access, Call, Literal, parse
from sparkloom.tensor import from_numpy

R = np.random.default_rng(42)


def sparse(*shape, kind=float):
    keep = R.random(shape) < 0.5
    if kind is bool:
        return keep
    if kind is int:
        return np.where(keep, R.integers(0, 8, shape), 0)
    return np.where(keep, np.round(R.random(shape) * 4 - 2, 3), 0.0)


A, B = sparse(3, 4), sparse(4, 5)
X, Y = sparse(3, 3), sparse(3, 3)
I, J = sparse(3, 3, kind=int), sparse(3, 3, kind=int)  # noqa: E741
P, Q = sparse(3, 3, kind=bool), sparse(3, 3, kind=bool)
G = np.where(sparse(4, 4, kind=bool), R.random((4, 4)), np.inf)
T4 = sparse(2, 3, 2, 3)
OPERANDS = {"A": A, "B": B, "X": X, "Y": Y, "I": I, "J": J, "P": P, "Q": Q, "G": G, "D": A, "v": B[:, 0], "T": T4}

CASES = [
    ("C[i,j] = X[i,j] + Y[j,i]", lambda: X + Y.T),
    ("C[i,j] += A[i,k] * B[k,j]", lambda: A @ B),
    ("C[i] += A[i,j]", lambda: A.sum(1)),
    ("C[i] max= A[i,j]", lambda: A.max(1)),
    ("C[i] min= A[i,j]", lambda: A.min(1)),
    ("C[i] *= A[i,j]", lambda: A.prod(1)),
    ("C[i] mean= A[i,j]", lambda: A.mean(1)),
    ("C[i] var= A[i,j]", lambda: A.var(1)),
    ("C[i] std= A[i,j]", lambda: A.std(1)),
    ("C[i] count_nonzero= A[i,j]", lambda: np.count_nonzero(A, 1)),
    ("C[i] argmin= A[i,j]", lambda: A.argmin(1)),
    ("C[i] argmax= A[i,j]", lambda: A.argmax(1)),
    ("C[i] and= P[i,j]", lambda: P.all(1)),
    ("C[i] or= P[i,j]", lambda: P.any(1)),
    ("C[i] |= I[i,j]", lambda: np.bitwise_or.reduce(I, 1)),
    ("C[i] &= I[i,j]", lambda: np.bitwise_and.reduce(I, 1)),
    ("C[i] ^= I[i,j]", lambda: np.bitwise_xor.reduce(I, 1)),
    ("C[i,j] = -X[i,j] ** 2", lambda: -(X**2)),
    ("C[i,j] = I[i,j] << 2 | J[i,j] & 3 ^ 1", lambda: I << 2 | J & 3 ^ 1),
    ("C[i,j] = I[i,j] % 3 - I[i,j] // 3", lambda: I % 3 - I // 3),
    ("C[i,j] = X[i,j] // 0.7 + X[i,j] % 0.7", lambda: X // 0.7 + X % 0.7),
    ("C[i,j] = P[i,j] and Q[i,j] or not P[i,j]", lambda: P & Q | ~P),
    ("C[i,j] or= P[i,k] & Q[k,j]", lambda: (P.astype(int) @ Q.astype(int)) > 0),
    ("N[i,j] min= G[i,k] + G[k,j]", lambda: (G[:, :, None] + G[None]).min(1)),
    ("S[] += X[i,j] * X[j,k] * X[k,i]", lambda: np.trace(X @ X @ X)),
    ("C[i,j,k] = A[i,k] - D[j,k]", lambda: A[:, None] - A[None]),
    ("C[j] += exp(A[i,j])", lambda: np.exp(A).sum(0)),
    ("C[i,j] = X[i,j] < Y[i,j] <= X[i,j] + 1", lambda: (X < Y) & (Y <= X + 1)),
    ("C[i,j] = max(X[i,j], Y[i,j]) / 2.0", lambda: np.maximum(X, Y) / 2),
    ("C[i,j] = X[i,j] / Y[i,j]", lambda: X / Y),
    ("C[r,s] += A[k,r] * A[k,s]", lambda: A.T @ A),
    ("C[s,r] += 2 * A[k,r] * A[k,s]", lambda: 2 * A.T @ A),
    ("C[i,j,k] += A[i,k] * A[j,k]", lambda: A[:, None] * A[None]),
    ("C[l,i,m] += T[i,j,k,l] * T[i,j,k,m]", lambda: np.einsum("ijkl,ijkm->lim", T4, T4)),
    ("n[r] += A[i,r] * A[i,r]", lambda: (A * A).sum(0)),
    ("C[i] += A[i,j] * 0.5 * v[j]", lambda: A @ B[:, 0] * 0.5),
    ("C[j,i] += A[i,j]", lambda: A.T),
    ("C[l,j,i,k] += T[i,j,k,l]", lambda: T4.transpose(3, 1, 0, 2)),
    ("C[k,i] += T[i,j,k,l]", lambda: T4.sum((1, 3)).T),
    ("C[i,j] = logaddexp(X[i,j], Y[i,j])", lambda: np.logaddexp(X, Y)),
    ("C[i,j] = log(abs(X[i,j])) + log1p(X[i,j])", lambda: np.log(abs(X)) + np.log1p(X)),
    ("C[i,j] = (X[i,j] == Y[i,j]) + 2 * (X[i,j] != 0)", lambda: (X == Y) + 2 * (X != 0)),
    ("C[i] min= X[i,j] * 0 + 3", lambda: np.full(3, 3.0)),
    ("C[i] *= X[i,j] + 1.5", lambda: (X + 1.5).prod(1)),
    ("C[i,j] = sqrt(abs(X[i,j])) * sin(Y[i,j]) - cosh(X[i,j])", lambda: np.sqrt(abs(X)) * np.sin(Y) - np.cosh(X)),
]


@pytest.mark.parametrize("program,want", CASES, ids=[c[0] for c in CASES])
def test_program(spark, program, want):
    import re

    names = set(re.findall(r"\b([A-Zv]\w*)\[", program.split("=", 1)[1]))
    operands = {n: from_numpy(spark, OPERANDS[n], np.inf if n == "G" else 0) for n in names}
    with np.errstate(all="ignore"):
        assert np.allclose(einsum(program, **operands).to_numpy(), want(), equal_nan=True)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.integers(0, 2**32 - 1), st.sampled_from([0.0, 1.0, -2.0, 0.5, math.inf]), st.sampled_from(["+", "*", "min", "max", "mean", "var", "count_nonzero"]))
def test_reductions_with_fill(spark, seed, fill, op):
    r = np.random.default_rng(seed)
    a = np.where(r.random((3, 4)) < 0.5, np.round(r.random((3, 4)), 2), fill)
    a[0] = fill
    f = {"+": np.sum, "*": np.prod, "min": np.min, "max": np.max, "mean": np.mean, "var": np.var, "count_nonzero": np.count_nonzero}[op]
    got = einsum(f"C[i] {op}= A[i,j]", A=from_numpy(spark, a, fill)).to_numpy()
    with np.errstate(all="ignore"):
        want = f(a, axis=1)
    if op == "var" and math.isinf(fill):
        got, want = got[np.isfinite(want)], want[np.isfinite(want)]
    assert np.allclose(got, want, equal_nan=True)


def test_parser():
    assert parse("C[i,] = -2 ** 2").expression == Call("-", (Call("**", (Literal(2), Literal(2))),))
    assert parse("S[] min= A1[i] < B_2[i] < 3e-2").indices == ()
    assert parse("C[i] = (-1-2j)").expression == Call("-", (Literal(-1), Literal(2j)))
    assert parse("C[i] = not A[i] and True").expression == Call("and", (Call("not", (Access("A", ("i",)),)), Literal(True)))
    for bad in ("C[i]", "C[i] = A[i", "C[i] = A[i] +", "1 = A[i]", "C[i] = A[i] $ 2"):
        with pytest.raises(SyntaxError):
            parse(bad)


def test_errors(spark):
    a = from_numpy(spark, A)
    for program in ("C[i] = A[i,j]", "C[z] += A[i,j]", "C[i] -= A[i,j]", "C[i] += A[i,i]", "C[i] += A[i,j] * B[j]", "C[] argmin= A[i,j]"):
        with pytest.raises((ValueError, TypeError)):
            einsum(program, A=a, B=from_numpy(spark, np.arange(1, 3.0)))
