"""Einsum programs as joins, projections and grouped aggregates.

Fill analysis decides per call whether a result lives where both operands are stored
(inner join), where one is (left join), where either is (full join), or everywhere (a grid).
Sums of products, and any other reduction that the product distributes over, are contracted
pairwise: indices that nothing else needs are aggregated before and after each join, so
no join carries an index longer than it must.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..storage import cut
from ..tensor import SparseTensor
from .grid import grid
from .parse import Access, Call, Literal, Program, parse

# The language's spellings of the reductions, spelling: array function.
REDUCTIONS = {
    "+": "sum", "add": "sum", "sum": "sum",
    "*": "prod", "mul": "prod", "prod": "prod",
    "and": "all", "all": "all",
    "or": "any", "any": "any",
    "min": "min",
    "max": "max",
    "argmin": "argmin",
    "argmax": "argmax",
    "mean": "mean",
    "std": "std",
    "var": "var",
    "count_nonzero": "count_nonzero",
    "&": "bit_and",
    "|": "bit_or",
    "^": "bit_xor",
}
#: (operation, value): f(value, x) is value for every finite x.
ANNIHILATORS = {"multiply": (0, 0.0, False), "logical_and": (0, 0.0, False), "bitwise_and": (0, False)}
#: reduction: operations that distribute over it, and the fill at which cells vanish.
SEMIRINGS = {("sum", "multiply"): 0, ("min", "add"): math.inf, ("max", "add"): -math.inf, ("any", "logical_and"): False, ("any", "bitwise_and"): False, ("any", "multiply"): False}
#: Operands of at most this many cells are small enough to broadcast.
BROADCAST_CELLS = 1_000_000


@dataclass
class Relation:
    """Rows over loop indices with a value ``v``; cells without a row hold ``fill``."""

    df: DataFrame
    indices: tuple[str, ...]
    fill: object
    kind: str
    full: bool = False


@dataclass
class Constant:
    value: object
    kind: str = field(init=False)

    def __post_init__(self):
        self.kind = S.kind_of_value(self.value)


def small(df: DataFrame, cells: int) -> DataFrame:
    return F.broadcast(df) if cells <= BROADCAST_CELLS else df


class Lowering:
    def __init__(self, program: Program, tensors: dict[str, SparseTensor]):
        self.program, self.tensors = program, tensors
        self.extents: dict[str, int] = {}
        self.spark = None
        self.collect(program.expression)
        missing = [i for i in program.indices if i not in self.extents]
        if missing:
            raise ValueError(f"output indices {missing} do not occur in the expression")
        if len(set(program.indices)) < len(program.indices):
            raise ValueError("an output index occurs twice")

    def collect(self, node) -> None:
        if isinstance(node, Access):
            t = self.tensors[node.name]
            self.spark = self.spark or t.spark
            if len(set(node.indices)) < len(node.indices):
                raise ValueError(f"{node.name} has an index twice")
            if len(node.indices) != t.rank:
                raise ValueError(f"{node.name} has {t.rank} dimensions")
            for i, n in zip(node.indices, t.shape, strict=True):
                if self.extents.setdefault(i, n) != n:
                    raise ValueError(f"index {i} runs over {self.extents[i]} and {n}")
        elif isinstance(node, Call):
            for a in node.args:
                self.collect(a)

    # --- scalar expressions ---

    def cells(self, indices) -> int:
        return math.prod(self.extents[i] for i in indices)

    def densify(self, r: Relation, indices: tuple[str, ...]) -> Relation:
        """Every cell over ``indices`` stored."""
        if r.full and set(r.indices) == set(indices):
            return r
        cells = grid(self.spark, {i: self.extents[i] for i in indices})
        if not indices:
            return r
        shared = [i for i in indices if i in r.indices]
        value = F.coalesce("v", S.literal(r.fill))
        if not shared:
            joined = cells.crossJoin(F.broadcast(r.df.select("v")))
        else:
            joined = cells.join(r.df, shared, "left")
        return Relation(joined.select(*indices, value.alias("v")), indices, r.fill, r.kind, True)

    def evaluate(self, node, wide: bool = False):
        """``wide``: integers that // or % takes, so sums and products in them may be longer than 64 bits."""
        if isinstance(node, Literal):
            if isinstance(node.value, complex):
                raise TypeError("Spark has no complex numbers; use two tensors for the parts")
            return Constant(node.value)
        if isinstance(node, Access):
            t = self.tensors[node.name]
            df = t.df.select(*[F.col(d).alias(i) for d, i in zip(t.dims, node.indices, strict=True)], "v")
            fill = t.fill
            kind = t.kind if t.kind == "float" or not isinstance(fill, float) or float(fill).is_integer() else "float"
            if kind == "int" and isinstance(fill, float):
                fill = int(fill)
            if kind == "bool":
                fill = bool(fill)
            if kind == "float":
                df, fill = df.withColumn("v", F.col("v").cast("double")), float(fill)
            return Relation(df, node.indices, fill, kind, t.rank == 0)
        name = S.UNARY_NAMES.get(node.op) if len(node.args) == 1 else S.BINARY_NAMES.get(node.op)
        args = [self.evaluate(a, name in S.NARROWING or wide and name in S.EXACT) for a in node.args]
        if len(args) == 1:
            return self.unary(S.UNARY_NAMES[node.op], args[0], wide)
        if len(args) != 2 or node.op not in S.BINARY_NAMES:
            raise TypeError(f"{node.op} of {len(args)} arguments")
        return self.binary(S.BINARY_NAMES[node.op], *args, wide)

    def unary(self, name: str, a, wide: bool = False):
        if isinstance(a, Constant):
            return Constant(S.on_values(name, a.value, wide=wide))
        column, kind = S.apply_unary(name, F.col("v"), a.kind, wide)
        return Relation(a.df.select(*a.indices, column.alias("v")), a.indices, S.on_values(name, a.fill, wide=wide), kind, a.full)

    def binary(self, name: str, a, b, wide: bool = False):
        if isinstance(a, Constant) and isinstance(b, Constant):
            return Constant(S.on_values(name, a.value, b.value, wide=wide))
        if isinstance(a, Constant) or isinstance(b, Constant):
            r = b if isinstance(a, Constant) else a
            left, right = (S.literal(a.value), F.col("v")) if isinstance(a, Constant) else (F.col("v"), S.literal(b.value))
            column, kind = S.apply_binary(name, left, a.kind, right, b.kind, wide)
            values = (a.value, b.fill) if isinstance(a, Constant) else (a.fill, b.value)
            return Relation(r.df.select(*r.indices, column.alias("v")), r.indices, S.on_values(name, *values, wide=wide), kind, r.full)
        indices = tuple(dict.fromkeys((*a.indices, *b.indices)))
        fill = S.on_values(name, a.fill, b.fill, wide=wide)
        zero_a, zero_b = self.annihilates(name, a.fill), self.annihilates(name, b.fill)
        same = set(a.indices) == set(b.indices)
        if zero_a and zero_b or (zero_a or a.full) and (zero_b or b.full) and same:
            return self.joined(name, a, b, indices, "inner", fill, False, wide)
        if zero_a and set(b.indices) <= set(a.indices) and b.indices:
            return self.joined(name, a, b, indices, "left", fill, False, wide)
        if zero_b and set(a.indices) <= set(b.indices) and a.indices:
            return self.joined(name, a, b, indices, "right", fill, False, wide)
        if same and a.indices and not (a.full and b.full):
            return self.joined(name, a, b, indices, "full", fill, a.full or b.full, wide)
        a, b = self.densify(a, a.indices), self.densify(b, b.indices)
        return self.joined(name, a, b, indices, "inner", fill, True, wide)

    @staticmethod
    def annihilates(name: str, fill) -> bool:
        if name == "add":
            return isinstance(fill, float) and math.isinf(fill)
        return name in ANNIHILATORS and any(fill == z for z in ANNIHILATORS[name])

    def joined(self, name, a: Relation, b: Relation, indices, how: str, fill, full: bool, wide: bool = False) -> Relation:
        x, y = a.df.withColumnRenamed("v", "__a"), b.df.withColumnRenamed("v", "__b")
        shared = [i for i in a.indices if i in b.indices]
        if how == "inner" and shared:
            ca, cb = self.cells(a.indices), self.cells(b.indices)
            x, y = (small(x, ca), y) if ca < cb else (x, small(y, cb))
        df = x.join(y, shared, how) if shared else x.crossJoin(small(y, self.cells(b.indices)))
        left, right = F.col("__a"), F.col("__b")
        if how in ("right", "full"):
            left = F.coalesce(left, S.literal(a.fill))
        if how in ("left", "full"):
            right = F.coalesce(right, S.literal(b.fill))
        column, kind = S.apply_binary(name, left, a.kind, right, b.kind, wide)
        return Relation(df.select(*indices, column.alias("v")), indices, fill, kind, full)

    # --- contraction ---

    def factors(self, node, op: str) -> list | None:
        """Operands of a chain of one operation, or None if an operand's fill does not vanish."""
        if isinstance(node, Call) and len(node.args) == 2 and S.BINARY_NAMES.get(node.op) == op:
            parts = [self.factors(a, op) for a in node.args]
            return None if None in parts else parts[0] + parts[1]
        return [node]

    def contract(self, op: str, reduction: str, zero) -> Relation | None:
        nodes = self.factors(self.program.expression, op)
        if nodes is None or len(nodes) < 2:
            return None
        scale, kept = [], {}
        for n in nodes:
            r = self.evaluate(n)
            if isinstance(r, Constant):
                scale.append(r)
                continue
            if not (r.fill == zero and type(r.fill) is not str) or not r.indices:
                return None
            kept.setdefault(n, []).append(r)
        if op != "multiply" and scale or not kept:
            return None
        operands: list[Relation] = []
        for same in kept.values():  # equal accesses need no join
            r = same[0]
            for _ in same[1:]:
                column, kind = S.apply_binary(op, F.col("v"), r.kind, F.col("w"), same[0].kind)
                wide = r.df if "w" in r.df.columns else r.df.withColumn("w", F.col("v"))
                r = Relation(wide.withColumn("v", column), r.indices, r.fill, kind)
            operands.append(Relation(r.df.select(*r.indices, "v"), r.indices, r.fill, r.kind))
        out = set(self.program.indices)
        twins = self.twins(list(kept), out)
        operands = [self.squeeze(r, [o for o in operands if o is not r], out, reduction) for r in operands]
        while len(operands) > 1:
            best = min(
                ((i, j) for i in range(len(operands)) for j in range(i + 1, len(operands))),
                key=lambda p: self.cost(operands[p[0]], operands[p[1]], [o for k, o in enumerate(operands) if k not in p], out),
            )
            a, b = operands[best[0]], operands[best[1]]
            rest = [o for k, o in enumerate(operands) if k not in best]
            pair = self.joined(op, a, b, tuple(dict.fromkeys((*a.indices, *b.indices))), "inner", zero, False)
            if twins:  # the other half of a symmetric result is a copy
                pair.df = pair.df.where(F.col(twins[0]) <= F.col(twins[1]))
            operands = [*rest, self.squeeze(pair, rest, out, reduction)]
        result = mirrored(operands[0], twins) if twins else operands[0]
        for c in scale:
            result = self.binary(op, result, c)
        return result

    @staticmethod
    def twins(nodes: list, out: set) -> tuple[str, str] | None:
        """The two output indices of a product of one tensor with itself that can be exchanged."""
        if len(nodes) != 2 or not all(isinstance(n, Access) for n in nodes) or nodes[0].name != nodes[1].name:
            return None
        apart = [(a, b) for a, b in zip(nodes[0].indices, nodes[1].indices, strict=True) if a != b]
        own = (*nodes[0].indices, *nodes[1].indices)
        if len(apart) != 1 or not set(apart[0]) <= out or any(own.count(i) != 1 for i in apart[0]):
            return None
        return apart[0]

    def cost(self, a: Relation, b: Relation, rest: list[Relation], out: set) -> tuple:
        shared = set(a.indices) & set(b.indices)
        needed = out.union(*(r.indices for r in rest)) if rest else out
        both = set(a.indices) | set(b.indices)
        return (not shared, self.cells(both & needed), self.cells(both))

    def squeeze(self, r: Relation, rest: list[Relation], out: set, reduction: str) -> Relation:
        """Aggregate the indices that neither the output nor another operand has."""
        needed = out.union(*(o.indices for o in rest)) if rest else out
        keep = tuple(i for i in r.indices if i in needed)
        if len(keep) == len(r.indices):
            return r
        if reduction == "sum":
            v, kind = F.sum(S.num(r.kind, F.col("v"))), "int" if r.kind == "bool" else r.kind
        elif reduction == "any":
            v, kind = F.bool_or(S.truth(r.kind, F.col("v"))), "bool"
        else:
            v, kind = nan_min(F.col("v"), r.kind) if reduction == "min" else F.max("v"), r.kind
        return Relation(r.df.groupBy(*keep).agg(v.alias("v")) if keep else r.df.agg(v.alias("v")).where("v is not null"), keep, r.fill, kind)

    # --- whole programs ---

    def run(self) -> SparseTensor:
        p = self.program
        loops = tuple(self.extents)
        reduced = tuple(i for i in loops if i not in p.indices)
        if p.reduction is None:
            if reduced:
                raise ValueError(f"= leaves indices {reduced} unreduced")
            r = self.evaluate(p.expression)
            return self.finish(self.spread(r, p.indices), r.fill if isinstance(r, Relation) else r.value)
        reduction = REDUCTIONS.get(p.reduction)
        if reduction is None:
            raise TypeError(f"{p.reduction}= is no reduction")
        for (red, op), zero in SEMIRINGS.items():
            if red == reduction and (r := self.contract(op, reduction, zero)) is not None and set(r.indices) == set(p.indices):
                if reduction == "any":
                    r = Relation(r.df.withColumn("v", S.truth(r.kind, F.col("v"))), r.indices, False, "bool")
                return self.finish(r, r.fill)
        r = self.spread(self.evaluate(p.expression), loops)
        return self.reduce(r, reduction, reduced)

    def spread(self, r, indices: tuple[str, ...]) -> Relation:
        if isinstance(r, Constant):
            df = grid(self.spark, {i: self.extents[i] for i in indices}).withColumn("v", S.literal(r.value))
            return Relation(df.select(*indices, "v"), indices, r.value, r.kind, True)
        return r if set(r.indices) == set(indices) else self.densify(r, indices)

    def finish(self, r: Relation, fill) -> SparseTensor:
        out = self.program.indices
        df = r.df.select(*[F.col(i).alias(f"i{k}") for k, i in enumerate(out)], "v")
        return SparseTensor(df, tuple(self.extents[i] for i in out), fill)

    def reduce(self, r: Relation, reduction: str, reduced: tuple[str, ...]) -> SparseTensor:
        out, n = self.program.indices, self.cells(reduced)
        if reduction in ("argmin", "argmax"):
            return self.arg(r, reduction, reduced)
        v, fill = F.col("v"), r.fill
        x = S.num(r.kind, v)
        count = F.count(F.lit(1)).alias("c")
        short = F.col("c") < n
        lack = F.lit(n) - F.col("c")
        number = fill if not isinstance(fill, bool) else int(fill)
        if reduction in ("sum", "mean"):
            aggs = [F.sum(x).alias("s")]
            total = F.when(short, F.col("s") + S.literal(number) * lack).otherwise(F.col("s")) if number != 0 else F.col("s")
            value = total if reduction == "sum" else total.cast("double") / n
            rest = number * n if reduction == "sum" else float(number)
            if number != number or (isinstance(number, float) and math.isinf(number)):
                rest = number
        elif reduction == "prod" and r.kind != "float":
            return self.integer_product(r, number, n)
        elif reduction == "prod":
            aggs = [F.product(x.cast("double")).alias("s")]
            value = F.when(short, F.col("s") * F.pow(F.lit(float(number)), lack.cast("double"))).otherwise(F.col("s"))
            rest = S.on_values("power", float(number), float(n))
        elif reduction in ("all", "any"):
            both = reduction == "all"
            aggs = [(F.bool_and if both else F.bool_or)(S.truth(r.kind, v)).alias("s")]
            value = F.when(short, (F.col("s") & F.lit(bool(fill))) if both else (F.col("s") | F.lit(bool(fill)))).otherwise(F.col("s"))
            rest = bool(fill)
        elif reduction in ("min", "max"):
            aggs = [(nan_min(v, r.kind) if reduction == "min" else F.max(v)).alias("s")]
            other = S.least(F.col("s"), S.literal(fill), r.kind == "float") if reduction == "min" else F.greatest(F.col("s"), S.literal(fill))
            value, rest = F.when(short, other).otherwise(F.col("s")), fill
        elif reduction in ("var", "std"):
            aggs = [F.avg(x).alias("m"), F.var_pop(x).alias("q")]
            c, k = F.col("c"), lack
            mean_gap = F.col("m") - F.lit(float(number))
            merged = (F.col("q") * c + mean_gap * mean_gap * c * k / n) / n
            var = F.when(short, merged).otherwise(F.col("q"))
            value, rest = (F.sqrt(var) if reduction == "std" else var), 0.0
        elif reduction == "count_nonzero":
            aggs = [F.count_if(S.truth(r.kind, v)).alias("s")]
            value = F.col("s") + (lack if fill != 0 else F.lit(0))
            rest = n if fill != 0 else 0
        else:
            f = {"bit_and": F.bit_and, "bit_or": F.bit_or, "bit_xor": F.bit_xor}[reduction]
            aggs = [f(x).alias("s")]
            name = "bitwise" + reduction[3:]
            value = F.col("s")
            if number or reduction == "bit_and":
                again = S.literal(number) if reduction != "bit_xor" else F.when(lack % 2 == 1, S.literal(number)).otherwise(F.lit(0))
                value = F.when(short, S.apply_binary(name, F.col("s"), "int", again, "int")[0]).otherwise(F.col("s"))
            rest = number if reduction != "bit_xor" or n % 2 else 0
        if out:
            df = r.df.groupBy(*out).agg(*aggs, count)
        else:
            df = r.df.agg(*aggs, count).where("c > 0")
        df = df.select(*out, value.alias("v"))
        return self.finish(Relation(df, out, rest, "float"), rest)

    def integer_product(self, r: Relation, number: int, n: int) -> SparseTensor:
        """Exact products. If all fit (one aggregate over the written result), they have 64 bits, else up to 38 digits; more is an overflow error.

        Equal magnitudes are counted first, so what is gathered of a group are its distinct magnitudes above 1, and a product with more
        than 32 of them does not fit in 38 digits.
        """
        out, one = self.program.indices, F.lit(1).cast(S.WIDE)
        x = S.num(r.kind, F.col("v")).cast(S.WIDE if r.kind == "wide" else "bigint")
        counted = r.df.groupBy(*out, F.abs(x).alias("size")).agg(F.count(F.lit(1)).alias("c"), F.count_if(x < 0).alias("below"))
        power = F.struct("size", F.col("c").alias("times"))
        aggs = [F.sum("c").alias("c"), F.sum("below").alias("below"), F.min("size").alias("least"), F.collect_list(F.when(F.col("size") > 1, power)).alias("powers")]
        grouped = counted.groupBy(*out).agg(*aggs) if out else counted.agg(*aggs).where("c > 0")
        lack = F.lit(n).cast("bigint") - F.col("c")
        filled = F.when(lack > 0, S.power(S.literal(number), lack, True, S.WIDE)).otherwise(one)
        size = F.aggregate("powers", one, lambda held, p: held * S.power(p["size"], p["times"], True, S.WIDE))
        sign = F.when(F.col("below") % 2 == 1, -one).otherwise(one)
        zero = (F.col("least") == 0) | ((lack > 0) & F.lit(number == 0))
        made = cut(grouped.select(*out, F.when(zero, F.lit(0).cast(S.WIDE)).otherwise(sign * size * filled).alias("v")))
        low, high, count = made.agg(F.min("v"), F.max("v"), F.count(F.lit(1))).first()
        lowest, highest, rest = int(low or 0), int(high or 0), 0
        if count < self.cells(out):  # the fill value of the result is that of some cell
            rest = number if abs(number) < 2 and (number >= 0 or n % 2) else abs(number) ** min(n, 127) * (-1 if number < 0 and n % 2 else 1)
            if len(str(abs(rest))) > 38:
                raise OverflowError("the product of cells that are not stored needs more than 38 digits")
        if all(v in S.INT64 for v in (lowest, highest, rest)):
            return self.finish(Relation(made.select(*out, F.col("v").cast("bigint").alias("v")), out, rest, "int"), rest)
        return self.finish(Relation(made, out, rest, "wide"), rest)

    def arg(self, r: Relation, reduction: str, reduced: tuple[str, ...]) -> SparseTensor:
        if len(reduced) != 1:
            raise ValueError(f"{reduction} reduces exactly one index")
        r = self.densify(r, tuple(self.extents))
        out, i = self.program.indices, reduced[0]
        if reduction == "argmin":
            best = F.min(F.struct(F.col("v"), F.col(i).alias("i")))["i"]
        else:
            best = -F.max(F.struct(F.col("v"), (-F.col(i)).alias("i")))["i"]
        df = r.df.groupBy(*out).agg(best.alias("v")) if out else r.df.agg(best.alias("v"))
        return self.finish(Relation(df, out, 0, "int"), 0)


def mirrored(r: Relation, twins: tuple[str, str]) -> Relation:
    """Cells with twins[0] < twins[1] once more with the two exchanged."""
    a, b = (F.col(t) for t in twins)
    once, twice = F.struct(a.alias("p"), b.alias("q")), F.struct(b.alias("p"), a.alias("q"))
    rest = [i for i in r.indices if i not in twins]
    df = r.df.select(*rest, "v", F.explode(F.when(a == b, F.array(once)).otherwise(F.array(once, twice))).alias("c"))
    return Relation(df.select(*rest, F.col("c.p").alias(twins[0]), F.col("c.q").alias(twins[1]), "v"), (*rest, *twins), r.fill, r.kind)


def nan_min(v: Column, kind: str) -> Column:
    return F.when(F.max(F.isnan(v)), S.nan()).otherwise(F.min(v)) if kind == "float" else F.min(v)


def einsum(text: str, **tensors: SparseTensor) -> SparseTensor:
    """Run one program over tensors, e.g. ``einsum("C[i,j] += A[i,k] * B[k,j]", A=a, B=b)``."""
    return Lowering(parse(text), tensors).run()
