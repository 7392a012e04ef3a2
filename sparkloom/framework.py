"""A backend in the array-framework sense: ingest, lazy regions, compute, einsum, conversion back."""

from __future__ import annotations

import numpy as np
from pyspark.sql import SparkSession

from .operators import linear, solvers
from .plans.einsum import einsum
from .sources.interchange import Interchange, export, ingest
from .storage import cut
from .tensor import SparseTensor, from_numpy

#: Unknowns of a system that the driver solves: its matrix has 32 MB.
DIRECT = 2048


class SparkFramework:
    """Tensors are lazy until ``compute`` materialises them; several at once are materialised one by one from files."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def from_benchmark(self, x: Interchange) -> SparseTensor:
        return ingest(self.spark, x)

    def to_benchmark(self, t: SparseTensor) -> Interchange:
        return export(t)

    def lazy(self, x):
        return x

    def compute(self, x):
        if isinstance(x, (tuple, list)):
            return type(x)(self.compute(t) for t in x)
        return x.with_df(cut(x.df)) if isinstance(x, SparseTensor) else x

    def einsum(self, program: str, **tensors: SparseTensor) -> SparseTensor:
        return einsum(program, **tensors)

    def with_fill_value(self, t: SparseTensor, value) -> SparseTensor:
        return t.with_fill_value(value)

    def solve(self, a: SparseTensor, b: SparseTensor) -> SparseTensor:
        """x with A x = b. Up to DIRECT unknowns are solved on the driver; more by GMRES in tasks, and a residual above 1e-8 of b is an error."""
        n = a.shape[0]
        if a.shape != (n, n):
            raise ValueError("the matrix is not square")
        if n <= DIRECT:
            return from_numpy(self.spark, np.linalg.solve(a.to_numpy(), b.to_numpy()))
        x = solvers.gmres(a, b, linear.zeros(self.spark, (n,)), tol=1e-11, max_iter=2000)
        gap = einsum("G[i] = P[i] - B[i]", P=linear.matmul(a, x), B=b)
        if linear.norm(gap) > 1e-8 * max(linear.norm(b), 1e-300):
            raise RuntimeError("the system was not solved")
        return x

    matmul = staticmethod(linear.matmul)
    block_matmul = staticmethod(linear.block_matmul)
    vecdot = staticmethod(linear.vecdot)
    norm = staticmethod(linear.norm)
    where = staticmethod(linear.where)
    transpose = staticmethod(linear.transpose)
    permute_dims = staticmethod(linear.permute_dims)
    reshape = staticmethod(linear.reshape)
    take = staticmethod(linear.take)
    roll = staticmethod(linear.roll)
    diagonal = staticmethod(linear.diagonal)
    argsort = staticmethod(linear.argsort)
    sort = staticmethod(linear.sort)
    expand_dims = staticmethod(linear.expand_dims)
    reduce = staticmethod(linear.reduce)
    elementwise = staticmethod(linear.elementwise)
    outer = staticmethod(linear.outer)


class Lazy:
    """A tensor inside a lazy region: it can enter operations, but not be read before ``compute``."""

    def __init__(self, value: SparseTensor):
        self.value = value

    def _refuse(self, *_):
        raise TypeError("compute a lazy tensor before reading it")

    __getitem__ = __setitem__ = __float__ = __int__ = __bool__ = __complex__ = __index__ = item = to_numpy = _refuse

    def __matmul__(self, other):
        return Lazy(self.value @ opened(other))


def opened(x):
    return x.value if isinstance(x, Lazy) else x


for _name in "add radd sub rsub mul rmul truediv rtruediv floordiv rfloordiv mod rmod pow rpow and rand or ror xor rxor lshift rlshift rshift rrshift lt le gt ge".split():
    setattr(Lazy, f"__{_name}__", lambda self, other, name=f"__{_name}__": Lazy(getattr(self.value, name)(opened(other))))
for _name in "neg pos abs invert".split():
    setattr(Lazy, f"__{_name}__", lambda self, name=f"__{_name}__": Lazy(getattr(self.value, name)()))


class CheckerFramework(SparkFramework):
    """The same backend with the discipline of lazy regions enforced: what is made of lazy tensors is lazy, and
    only ``compute`` makes it readable."""

    def lazy(self, x):
        if isinstance(x, (tuple, list)):
            return type(x)(self.lazy(t) for t in x)
        return Lazy(x) if isinstance(x, SparseTensor) else x

    def compute(self, x):
        if isinstance(x, (tuple, list)):
            return type(x)(self.compute(t) for t in x)
        return super().compute(opened(x))

    def to_benchmark(self, t) -> Interchange:
        if isinstance(t, Lazy):
            raise TypeError("compute a lazy tensor before converting it")
        return super().to_benchmark(t)

    def einsum(self, program: str, **tensors):
        out = einsum(program, **{k: opened(v) for k, v in tensors.items()})
        return Lazy(out) if any(isinstance(v, Lazy) for v in tensors.values()) else out

    def with_fill_value(self, t, value):
        out = opened(t).with_fill_value(value)
        return Lazy(out) if isinstance(t, Lazy) else out

    def __getattribute__(self, name: str):
        found = super().__getattribute__(name)
        if name in ("matmul", "block_matmul", "where", "transpose", "permute_dims", "reshape", "take", "roll", "diagonal", "argsort", "sort", "expand_dims", "reduce", "elementwise", "outer", "solve"):
            return lambda *a, **k: (Lazy if any(isinstance(x, Lazy) for x in a) else opened)(found(*map(opened, a), **k))
        return found
