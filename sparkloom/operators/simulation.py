"""Simulations: finite differences, particles with a cutoff, forward Euler."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import cut
from ..tensor import SparseTensor
from .linear import spmv


def burgers(u: Column) -> Column:
    return 0.5 * u * u


def buckley_leverett(u: Column) -> Column:
    return u * u / (u * u + 0.25 * (1 - u) * (1 - u))


def advection(c: float) -> Callable[[Column], Column]:
    return lambda u: c * u


def impulses(spark: SparkSession, n: int, density: float) -> SparseTensor:
    """1 at every int(1/density)-th cell, else 0."""
    step = int(1 / density)
    return SparseTensor(spark.range(0, n, step).select(F.col("id").alias("i0"), F.lit(1.0).alias("v")), (n,), 0.0)


def lax_friedrichs(u0: SparseTensor, dt: float, dx: float, flux: Callable[[Column], Column], timesteps: int) -> SparseTensor:
    """All time rows of a periodic grid; ``flux`` maps a Column to a Column."""
    n, alpha = u0.shape[0], dt / (2 * dx)
    now = cut(u0.dense().df.toDF("x", "u"))
    out = now.select(F.lit(0).cast("long").alias("i0"), "x", "u")
    for t in range(timesteps):
        # each cell sends its value to both neighbours
        sent = now.select(F.pmod(F.col("x") - 1, F.lit(n)).alias("x"), F.lit(True).alias("right"), "u").union(now.select(F.pmod(F.col("x") + 1, F.lit(n)), F.lit(False), "u"))
        both = sent.groupBy("x").agg(F.max(F.when(F.col("right"), F.col("u"))).alias("r"), F.max(F.when(~F.col("right"), F.col("u"))).alias("l"))
        now = cut(both.select("x", (0.5 * (F.col("r") + F.col("l")) - alpha * (flux(F.col("r")) - flux(F.col("l")))).alias("u")))
        out = out.union(now.select(F.lit(t + 1).cast("long").alias("i0"), "x", "u"))
    return SparseTensor(out.toDF("i0", "i1", "v"), (timesteps + 1, n), 0.0)


def lax_friedrichs_matrix(spark: SparkSession, n: int, dx: float, dt: float, const: float = 1) -> SparseTensor:
    """The stencil of a linear flux as a circulant matrix."""
    alpha = const * dt / (2 * dx)
    cells = spark.range(n).select(F.col("id").alias("i0"), F.explode(F.array(F.struct(F.lit(-1).alias("k"), F.lit(0.5 + alpha).alias("v")), F.struct(F.lit(1).alias("k"), F.lit(0.5 - alpha).alias("v")))).alias("c"))
    rows = cells.select("i0", F.pmod(F.col("i0") + F.col("c.k"), F.lit(n)).alias("i1"), F.col("c.v").alias("v")).groupBy("i0", "i1").agg(F.sum("v").alias("v"))
    return SparseTensor(rows, (n, n), 0.0)


def lax_friedrichs_by_matrix(u0: SparseTensor, m: SparseTensor, timesteps: int) -> SparseTensor:
    n, spark = u0.shape[0], u0.spark
    rows = cut(m.df)
    now = cut(u0.dense().df.toDF("i", "x"))
    out = now.select(F.lit(0).cast("long").alias("i0"), "i", "x")
    for t in range(timesteps):
        y = spmv(rows, now, n)
        now = cut(spark.range(n).withColumnRenamed("id", "i").join(y, "i", "left").select("i", F.coalesce("y", F.lit(0.0)).alias("x")))
        out = out.union(now.select(F.lit(t + 1).cast("long").alias("i0"), "i", "x"))
    return SparseTensor(out.toDF("i0", "i1", "v"), (timesteps + 1, n), 0.0)


MASS, CUTOFF, TIME_STEP = 0.01, 0.01, 0.0005


def particle_step(p: DataFrame, size: float) -> DataFrame:
    """One step of (pid, x, y, vx, vy): forces between particles within the cutoff, then moves and walls.

    Particles meet by grid cell: a particle is sent to the 3 x 3 cells around it and
    joins the residents there, so the pairs met grow with the density and not with n^2.
    """
    cx, cy = F.floor(F.col("x") / CUTOFF), F.floor(F.col("y") / CUTOFF)
    home = p.select(F.col("pid").alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay"), cx.alias("cx"), cy.alias("cy"))
    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    guests = p.select("pid", "x", "y", cx.alias("gx"), cy.alias("gy"), F.explode(around).alias("o")).select("pid", "x", "y", (F.col("gx") + F.col("o.i")).alias("cx"), (F.col("gy") + F.col("o.j")).alias("cy"))
    dx, dy = F.col("x") - F.col("ax"), F.col("y") - F.col("ay")
    met = home.join(guests, ["cx", "cy"]).where("a <> pid").select("a", dx.alias("dx"), dy.alias("dy"), (dx * dx + dy * dy).alias("r2")).where(F.col("r2") <= CUTOFF * CUTOFF)
    least = (CUTOFF / 100) ** 2
    r2 = F.greatest("r2", F.lit(least))
    pull = (1 - CUTOFF / F.sqrt(r2)) / r2 / MASS
    force = met.groupBy(F.col("a").alias("pid")).agg(F.sum(pull * F.col("dx")).alias("fx"), F.sum(pull * F.col("dy")).alias("fy"))
    out = p.join(force, "pid", "left").fillna(0.0, ["fx", "fy"])
    out = out.withColumns({"vx": F.col("vx") + F.col("fx") * TIME_STEP, "vy": F.col("vy") + F.col("fy") * TIME_STEP})
    out = out.withColumns({"x": F.col("x") + F.col("vx") * TIME_STEP, "y": F.col("y") + F.col("vy") * TIME_STEP})
    for c in "xy":
        outside = (F.col(c) < 0) | (F.col(c) > size)
        out = out.withColumns({f"v{c}": F.when(outside, -F.col(f"v{c}")).otherwise(F.col(f"v{c}")), c: F.when(F.col(c) > size, 2 * size - F.col(c)).otherwise(F.abs(c))})
    return out.select("pid", "x", "y", "vx", "vy")


def particles(p: DataFrame, size: float, steps: int) -> DataFrame:
    for _ in range(steps):
        p = cut(particle_step(p, size))
    return p


# --- ordinary differential equations --------------------------------------------


def forward_euler(dydx: Callable, span: tuple[float, float], y0: Sequence[float], step: float) -> tuple[list[float], list[list[float]]]:
    """Times and states; time grows by repeated addition and stops before the end."""
    times, now = [], span[0]
    while now < span[1]:
        times.append(now)
        now += step
    states = [list(y0)]
    for t in times[:-1]:
        y = states[-1]
        states.append([v + d * step for v, d in zip(y, dydx(t, y), strict=True)])
    return times, states[: len(times)]


def step_input(t: float) -> float:
    return 5.0 if t >= 0 else 0.0


def rc(r: float, c: float, source: Callable[[float], float] = step_input) -> Callable:
    return lambda t, y: [(source(t) - y[0]) / (r * c)]


def rlc(r: float, l: float, c: float, source: Callable[[float], float] = step_input) -> Callable:  # noqa: E741
    return lambda t, y: [y[1], (source(t) - y[0] - r * c * y[1]) / (l * c)]


def lotka_volterra(a: float, b: float, c: float, d: float) -> Callable:
    return lambda t, y: [a * y[0] - b * y[0] * y[1], d * y[0] * y[1] - c * y[1]]


SYSTEMS = {"rc": (rc, ("r", "c")), "rlc": (rlc, ("r", "l", "c")), "lotka_volterra": (lotka_volterra, ("a", "b", "c", "d"))}


def euler_scenarios(scenarios: DataFrame, system: str) -> DataFrame:
    """Many runs of a system at once: rows (run, parameters, t_end, step, y0 ARRAY) to (run, k, t, y ARRAY)."""
    make, names = SYSTEMS[system]

    def run(batches):
        for rows in batches:
            for r in rows.itertuples(index=False):
                t, y = forward_euler(make(*[getattr(r, n) for n in names]), (0.0, r.t_end), [float(v) for v in r.y0], r.step)
                yield pd.DataFrame({"run": r.run, "k": range(len(t)), "t": t, "y": y})

    return scenarios.mapInPandas(run, "run long, k long, t double, y array<double>")
