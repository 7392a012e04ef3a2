"""NumPy-faithful scalar functions as Columns, with NumPy counterparts for fill values.

ANSI mode stays on: division, logarithms, comparisons with NaN and integer
rules are spelled out where Spark and NumPy differ.
"""

from __future__ import annotations

import math
import operator
from collections.abc import Callable
from decimal import Decimal

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


#: The kind "wide": integers of up to 38 digits. Operands of // and % are computed as such, and products that 64 bits don't hold.
WIDE = "decimal(38,0)"
INT64 = range(-(1 << 63), 1 << 63)


def literal(value) -> Column:
    wide = isinstance(value, int) and value not in INT64
    return F.lit(Decimal(value)).cast(WIDE) if wide else F.lit(value)


def nan() -> Column:
    return F.lit(float("nan"))


def inf() -> Column:
    return F.lit(float("inf"))


def num(kind: str, c: Column) -> Column:
    """Booleans as integers where arithmetic needs numbers."""
    return c.cast("bigint") if kind == "bool" else c


def truth(kind: str, c: Column) -> Column:
    return c if kind == "bool" else c != 0


def divide(a: Column, b: Column) -> Column:
    a, b = a.cast("double"), b.cast("double")
    by_zero = F.when(F.isnan(a) | (a == 0), nan()).when(a > 0, inf()).otherwise(-inf())
    return F.when(b == 0, by_zero).otherwise(a / F.when(b == 0, F.lit(1.0)).otherwise(b))


def floor_divide(a: Column, b: Column, integral: bool, wide: bool = False) -> Column:
    if integral:
        safe = F.when(b == 0, F.lit(1)).otherwise(b)
        rest = a % safe
        down = (rest != 0) & ((rest < 0) != (safe < 0))
        whole = ((a - rest) / safe).cast(WIDE) if wide else F.call_function("div", a, safe)
        return F.when(b == 0, F.lit(0).cast("bigint")).otherwise(F.when(down, whole - 1).otherwise(whole))
    quotient = divide(a, b)
    return F.when(F.isnan(quotient) | (F.abs(quotient) == inf()), quotient).otherwise(F.floor(F.when(F.isnan(quotient) | (F.abs(quotient) == inf()), F.lit(0.0)).otherwise(quotient)).cast("double"))


def remainder(a: Column, b: Column, integral: bool) -> Column:
    if integral:
        safe = F.when(b == 0, F.lit(1)).otherwise(b)
        rest = a % safe
        wrap = (rest != 0) & ((rest < 0) != (safe < 0))
        return F.when(b == 0, F.lit(0).cast("bigint")).otherwise(F.when(wrap, rest + safe).otherwise(rest))
    a, b = a.cast("double"), b.cast("double")
    safe = F.when(b == 0, F.lit(1.0)).otherwise(b)
    rest = a % safe
    wrap = (rest != 0) & ((rest < 0) != (safe < 0))
    return F.when(b == 0, nan()).otherwise(F.when(wrap, rest + safe).otherwise(rest))


def log_of(c: Column, f: Callable[[Column], Column], shift: float = 0.0) -> Column:
    x = c.cast("double") + shift
    safe = F.when((x <= 0) & ~F.isnan(x), F.lit(1.0)).otherwise(c.cast("double"))
    return F.when(F.isnan(x), nan()).when(x == 0, -inf()).when(x < 0, nan()).otherwise(f(safe))


def logaddexp(a: Column, b: Column) -> Column:
    a, b = a.cast("double"), b.cast("double")
    return F.when(F.isnan(a) | F.isnan(b), nan()).when(a == b, a + math.log(2)).otherwise(F.greatest(a, b) + F.log1p(F.exp(-F.abs(a - b))))


def either_nan(a: Column, b: Column) -> Column:
    return F.isnan(a.cast("double")) | F.isnan(b.cast("double"))


def compare(f: Callable[[Column, Column], Column], unordered: bool) -> Callable[[Column, Column], Column]:
    """Comparisons in which NaN is unordered: all false, != true."""
    return lambda a, b: F.when(either_nan(a, b), F.lit(unordered)).otherwise(f(a, b))


def power(a: Column, b: Column, integral: bool, held_as: str = "bigint") -> Column:
    """Integers exactly: a result beyond 64 bits (``WIDE``: 38 digits) is an overflow error (NumPy wraps around), a negative exponent an error as in NumPy."""
    if not integral:
        return F.pow(a.cast("double"), b.cast("double"))
    a, b, one = a.cast(held_as), b.cast("bigint"), F.lit(1).cast(held_as)
    unit = F.when(a == -1, F.when(b % 2 == 0, one).otherwise(-one)).otherwise(a)
    # 2 to the 64th (127th) overflows already, so no more factors are ever needed
    first, last = F.lit(1).cast("bigint"), F.lit(64 if held_as == "bigint" else 127).cast("bigint")
    product = F.aggregate(F.sequence(first, F.greatest(first, F.least(b, last))), one, lambda held, _: held * a)
    negative = F.raise_error(F.lit("integers to negative integer powers are not allowed")).cast(held_as)
    return F.when(b < 0, negative).when(b == 0, one).when(F.abs(F.greatest(a, F.lit(-2).cast(held_as))) < 2, unit).otherwise(product)


def least(a: Column, b: Column, floats: bool) -> Column:
    return F.when(either_nan(a, b), nan()).otherwise(F.least(a, b)) if floats else F.least(a, b)


# The language's spellings of the array functions, spelling: array function.
BINARY_NAMES = {
    "+": "add", "add": "add",
    "-": "subtract", "sub": "subtract", "subtract": "subtract",
    "*": "multiply", "mul": "multiply", "multiply": "multiply",
    "/": "divide", "div": "divide", "divide": "divide",
    "//": "floor_divide", "fld": "floor_divide", "floor_divide": "floor_divide",
    "%": "remainder", "mod": "remainder", "remainder": "remainder",
    "**": "power", "pow": "power", "power": "power",
    "==": "equal", "eq": "equal", "equal": "equal",
    "!=": "not_equal", "ne": "not_equal", "not_equal": "not_equal",
    "<": "less", "lt": "less", "less": "less",
    "<=": "less_equal", "le": "less_equal", "less_equal": "less_equal",
    ">": "greater", "gt": "greater", "greater": "greater",
    ">=": "greater_equal", "ge": "greater_equal", "greater_equal": "greater_equal",
    "&": "bitwise_and", "bitwise_and": "bitwise_and",
    "|": "bitwise_or", "bitwise_or": "bitwise_or",
    "^": "bitwise_xor", "bitwise_xor": "bitwise_xor",
    "<<": "left_shift", "lshift": "left_shift", "bitwise_left_shift": "left_shift",
    ">>": "right_shift", "rshift": "right_shift", "bitwise_right_shift": "right_shift",
    "and": "logical_and",
    "or": "logical_or",
    "min": "minimum",
    "max": "maximum",
    "logaddexp": "logaddexp",
    "logical_xor": "logical_xor",
    "atan2": "arctan2",
}
UNARY_NAMES = {
    "+": "positive", "pos": "positive", "positive": "positive",
    "-": "negative", "neg": "negative", "negative": "negative",
    "~": "invert", "invert": "invert", "bitwise_invert": "invert",
    "not": "logical_not", "logical_not": "logical_not",
    "abs": "absolute", "absolute": "absolute",
    "sqrt": "sqrt",
    "exp": "exp",
    "log": "log",
    "log1p": "log1p",
    "log10": "log10",
    "log2": "log2",
    "sin": "sin",
    "cos": "cos",
    "tan": "tan",
    "sinh": "sinh",
    "cosh": "cosh",
    "tanh": "tanh",
    "asin": "arcsin",
    "acos": "arccos",
    "atan": "arctan",
    "asinh": "arcsinh",
    "acosh": "arccosh",
    "atanh": "arctanh",
}
COMPARISONS = {"equal": lambda a, b: a == b, "not_equal": lambda a, b: a != b, "less": lambda a, b: a < b, "less_equal": lambda a, b: a <= b, "greater": lambda a, b: a > b, "greater_equal": lambda a, b: a >= b}
LOGICAL = {"logical_and": lambda a, b: a & b, "logical_or": lambda a, b: a | b, "logical_xor": lambda a, b: a != b}
BITS = {"bitwise_and": ("bitwiseAND", lambda a, b: a & b), "bitwise_or": ("bitwiseOR", lambda a, b: a | b), "bitwise_xor": ("bitwiseXOR", lambda a, b: a != b)}


#: What is exact in wide integers when asked for, and what takes such integers back to 64 bits.
EXACT = {"add": operator.add, "subtract": operator.sub, "multiply": operator.mul, "negative": operator.neg, "absolute": abs, "positive": operator.pos}
NARROWING = {"floor_divide": lambda a, b: a // b if b else 0, "remainder": lambda a, b: a % b if b else 0}


def joint(ka: str, kb: str) -> str:
    return "float" if "float" in (ka, kb) else "wide" if "wide" in (ka, kb) else "int" if "int" in (ka, kb) else "bool"


def apply_binary(name: str, a: Column, ka: str, b: Column, kb: str, wide: bool = False) -> tuple[Column, str]:
    """Column and kind (bool, int, wide, float) of a binary function; ``wide``: sums and products of integers may have up to 38 digits."""
    kind = joint(ka, kb)
    if kind == "wide" and (name in BITS or name.endswith("shift") or name == "power"):
        a, b, kind = num(ka, a).cast("bigint"), num(kb, b).cast("bigint"), "int"
        ka = kb = kind
    if name in LOGICAL:
        return LOGICAL[name](truth(ka, a), truth(kb, b)), "bool"
    if name in BITS:
        if kind == "float":
            raise TypeError(f"{name} of floats")
        method, on_bool = BITS[name]
        return (on_bool(a, b), "bool") if kind == "bool" else (getattr(num(ka, a), method)(num(kb, b)), "int")
    if kind == "bool":
        if name == "add" or name == "maximum":
            return a | b, "bool"
        if name in ("multiply", "minimum"):
            return a & b, "bool"
        if name == "subtract":
            raise TypeError("boolean subtract")
    x, y = num(ka, a), num(kb, b)
    if kind == "float":
        x, y = x.cast("double"), y.cast("double")
    if wide and kind == "int" and name in EXACT:
        kind = "wide"
    if kind == "wide":
        x, y = x.cast(WIDE), y.cast(WIDE)
    integral = kind != "float"
    number = kind if kind in ("wide", "float") else "int"
    if kind == "wide" and name in NARROWING:
        column = floor_divide(x, y, True, True) if name == "floor_divide" else remainder(x, y, True)
        return (column.cast(WIDE), "wide") if wide else (column.cast("bigint"), "int")
    if name in COMPARISONS:
        return (COMPARISONS[name](x, y) if integral else compare(COMPARISONS[name], name == "not_equal")(x, y)), "bool"
    if name == "add":
        return x + y, number
    if name == "subtract":
        return x - y, number
    if name == "multiply":
        return x * y, number
    if name == "divide":
        return divide(x, y), "float"
    if name == "floor_divide":
        return floor_divide(x, y, integral), number
    if name == "remainder":
        return remainder(x, y, integral), number
    if name == "power":
        return power(x, y, integral), number
    if name == "left_shift":
        return F.call_function("shiftleft", x, y.cast("int")), "int"
    if name == "right_shift":
        return F.call_function("shiftright", x, y.cast("int")), "int"
    if name == "minimum":
        return least(x, y, not integral), number
    if name == "maximum":
        return F.greatest(x, y), number
    if name == "logaddexp":
        return logaddexp(x, y), "float"
    if name == "arctan2":
        return F.atan2(x, y), "float"
    raise KeyError(name)


TRIG = {"sin": F.sin, "cos": F.cos, "tan": F.tan, "sinh": F.sinh, "cosh": F.cosh, "tanh": F.tanh, "arcsin": F.asin, "arccos": F.acos, "arctan": F.atan, "arcsinh": F.asinh, "arccosh": F.acosh, "arctanh": F.atanh, "exp": F.exp, "sqrt": F.sqrt}


def apply_unary(name: str, a: Column, kind: str, wide: bool = False) -> tuple[Column, str]:
    if name == "positive":
        return a, kind
    if name == "logical_not":
        return ~truth(kind, a), "bool"
    if name == "invert":
        return (~a, "bool") if kind == "bool" else (F.bitwise_not(a.cast("bigint") if kind == "wide" else a), "int")
    x = num(kind, a)
    if wide and kind == "int" and name in EXACT:
        x, kind = x.cast(WIDE), "wide"
    number = kind if kind in ("wide", "float") else "int"
    if name == "negative":
        if kind == "bool":
            raise TypeError("boolean negative")
        return -x, number
    if name == "absolute":
        return (a, "bool") if kind == "bool" else (F.abs(x), number)
    if name in TRIG:
        return TRIG[name](x.cast("double")), "float"
    if name == "log1p":
        return log_of(x, F.log1p, 1.0), "float"
    if name in ("log", "log10", "log2"):
        return log_of(x, {"log": F.ln, "log10": F.log10, "log2": F.log2}[name]), "float"
    raise KeyError(name)


NUMPY = {"left_shift": np.left_shift, "right_shift": np.right_shift}


def on_values(name: str, *values, wide: bool = False):
    """The NumPy function on Python scalars, for fill values; ``wide``, and integers beyond 64 bits: without wrapping around."""
    f = EXACT.get(name) or NARROWING.get(name)
    if f and all(kind_of_value(v) in ("int", "wide") for v in values) and (wide or any(kind_of_value(v) == "wide" for v in values)):
        return f(*(int(v) for v in values))
    with np.errstate(all="ignore"):
        out = (NUMPY.get(name) or getattr(np, name))(*values)
    return out.item() if hasattr(out, "item") else out


def kind_of_value(value) -> str:
    if isinstance(value, (bool, np.bool_)):
        return "bool"
    return ("int" if int(value) in INT64 else "wide") if isinstance(value, (int, np.integer)) else "float"
