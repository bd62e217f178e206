"""Iterative solvers of A x = b on grids: Jacobi, BiCGSTAB, geometric multigrid.

The operator is a stencil, a vector a column of cells. An iteration is one matrix product (a map side sum and an
exchange) or two and a single aggregate for all its scalar products; every few iterations the state is written and read
back, so that the lineage stays short.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.operators.refine import prolongate, restrict
from tessella.operators.stencils import jacobi as jacobi_step
from tessella.operators.stencils import mat_vec
from tessella.session import written

#: Weights of the relaxation by number of stages, for 1, 2 and 3 dimensions; those of 2 and 3 stages from Yang & Mittal (2017). Fixed values.
RELAXATION = {
    0: ((), (), ()),
    1: ((1.0,), (1.0,), (1.0,)),
    2: ((0.8723, 0.5395), (1.3895, 0.5617), (1.7319, 0.5695)),
    3: ((0.9372, 0.6667, 0.5173), (1.6653, 0.8000, 0.5264), (2.2473, 0.8571, 0.5296)),
}
Stencil = Sequence[tuple[Sequence[int], float]]


def poisson(dx: float, dimensions: int = 2) -> list[tuple[tuple[int, ...], float]]:
    """The second-order Laplacian."""
    centre = (0,) * dimensions
    out = [(centre, -2.0 * dimensions / dx**2)]
    for axis in range(dimensions):
        for side in (-1, 1):
            out.append((tuple(side if a == axis else 0 for a in range(dimensions)), 1.0 / dx**2))
    return out


def diagonal(stencil: Stencil) -> float:
    return next(w for offset, w in stencil if not any(offset))


def jacobi(grid: DataFrame, index: Sequence[str], rhs: str, stencil: Stencil, omegas: Sequence[float], start: Column | None = None, cut: int = 4) -> DataFrame:
    """``x`` after weighted Jacobi steps, a weight each."""
    state = grid.withColumn("x", F.lit(0.0) if start is None else start)
    for k, omega in enumerate(omegas):
        state = mat_vec(state, [], index, "x", stencil, "_ax")
        new = jacobi_step(F.col(rhs), F.col("_ax"), diagonal(stencil), F.col("x"))
        state = state.withColumn("x", (1 - omega) * F.col("x") + omega * new).drop("_ax")
        if k % cut == cut - 1:
            state = written(state, "jacobi")
    return state


def residual(state: DataFrame, index: Sequence[str], rhs: str, stencil: Stencil) -> DataFrame:
    out = mat_vec(state, [], index, "x", stencil, "_ax")
    return out.withColumn("r", F.col(rhs) - F.col("_ax")).drop("_ax")


def bicgstab(grid: DataFrame, index: Sequence[str], rhs: str, stencil: Stencil, tolerance: float = 1e-12, most: int = 1000, relative: bool = False) -> tuple[DataFrame, int, float]:
    """``x``, the iterations made, and the root mean square of the residual."""
    state = written(grid.withColumns({"x": F.lit(0.0), "r": F.col(rhs), "r0": F.col(rhs), "p": F.col(rhs)}), "bicgstab")
    first = state.agg(F.sum(F.col("r") * F.col("r0")).alias("rho"), F.count("*").alias("n")).first()
    rho, n = first.rho or 0.0, first.n
    if not n or rho == 0.0:
        return state, 0, 0.0
    scale = (rho / n) ** 0.5 if relative else 1.0
    rms = (rho / n) ** 0.5
    for k in range(1, most + 1):
        state = mat_vec(state, [], index, "p", stencil, "v")
        state = written(state, "bicgstab")
        r0v = state.agg(F.sum(F.col("r0") * F.col("v"))).first()[0]
        alpha = rho / r0v
        state = state.withColumns({"x": F.col("x") + alpha * F.col("p"), "s": F.col("r") - alpha * F.col("v")})
        state = written(mat_vec(state, [], index, "s", stencil, "t"), "bicgstab")
        row = state.agg(F.sum(F.col("t") * F.col("s")).alias("ts"), F.sum(F.col("t") * F.col("t")).alias("tt"), F.sum(F.col("s") * F.col("s")).alias("ss")).first()
        if (row.ss / n) ** 0.5 < tolerance * scale or not row.tt:
            return state, k, (row.ss / n) ** 0.5
        omega = row.ts / row.tt
        state = state.withColumns({"x": F.col("x") + omega * F.col("s"), "r": F.col("s") - omega * F.col("t")})
        row = state.agg(F.sum(F.col("r0") * F.col("r")).alias("rho"), F.sum(F.col("r") * F.col("r")).alias("rr")).first()
        rms = (row.rr / n) ** 0.5
        if rms < tolerance * scale:
            return state, k, rms
        beta = (row.rho / rho) * (alpha / omega)
        rho = row.rho
        state = state.withColumn("p", F.col("r") + beta * (F.col("p") - omega * F.col("v"))).drop("v", "s", "t")
    return state, most, rms


def v_cycle(grid: DataFrame, index: Sequence[str], rhs: str, dx: float, n: int, stages: int = 2, coarsest: int = 4) -> DataFrame:
    """``x`` after a multigrid V-cycle in correction form from ``x`` (0 if there is none), on n cells along each axis, 0 outside.

    ``stages`` of scheduled relaxation (0 to 3) smooth before and after the correction.
    """
    start = F.col("x") if "x" in grid.columns else None
    stencil, omegas = poisson(dx, len(index)), RELAXATION[stages][len(index) - 1]
    state = written(jacobi(grid, index, rhs, stencil, omegas, start), "vcycle")
    if n <= coarsest or n % 2:
        return written(jacobi(state, index, rhs, stencil, [0.9] * 16, F.col("x")), "vcycle")
    coarse = restrict(residual(state, index, rhs, stencil), [], index, ["r"])
    error = v_cycle(coarse.select(*index, "r"), index, "r", 2 * dx, n // 2, stages, coarsest)
    fine = prolongate(error.select(*index, "x"), [], index, "x", "linear").withColumnRenamed("x", "_e")
    state = state.join(fine, list(index), "left").withColumn("x", F.col("x") + F.coalesce("_e", F.lit(0.0))).drop("_e")
    return written(jacobi(state, index, rhs, stencil, omegas, F.col("x")), "vcycle")
