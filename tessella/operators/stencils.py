"""Stencils over ordered lines of cells: reconstruction, limiters, Riemann fluxes, matrix products, interpolation.

A line is a window partitioned by block and the other indices and ordered by a unique index. Stencils of
one axis share one window, and so one exchange and sort.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tessella.functions.scalars import EPS, ratio


def line(by: Sequence[str], *index: str) -> WindowSpec:
    return Window.partitionBy(*by).orderBy(*index)


def around(q: Column, w: WindowSpec, reach: int = 1) -> list[Column]:
    """q at -reach .. +reach; null beyond the line's ends."""
    return [F.lag(q, -o).over(w) if o < 0 else F.lead(q, o).over(w) if o else q for o in range(-reach, reach + 1)]


def van_leer(qm: Column, q: Column, qp: Column) -> Column:
    """Harmonic slope, 0 at extrema."""
    left, right = q - qm, qp - q
    return F.when(left * right > 0, 2.0 * left * right / F.when(left + right != 0, left + right)).otherwise(0.0)


def mc(left: Column, right: Column) -> Column:
    """Monotonized central slope of two differences."""
    bound = F.least(F.abs(0.5 * (left + right)), F.least(2.0 * F.abs(left), 2.0 * F.abs(right)))
    return F.when(left * right > 0, F.signum(left) * bound).otherwise(0.0)


def min_mod(centre: Column, minus: Column, plus: Column, dx_minus: Column | float, dx_plus: Column | float) -> Column:
    """The smaller gradient of both sides, 0 where they differ in sign."""
    g_minus, g_plus = (centre - minus) / dx_minus, (plus - centre) / dx_plus
    return 0.5 * (F.signum(g_minus) + F.signum(g_plus)) * F.least(F.abs(g_minus), F.abs(g_plus))


def donor_cell(q: Column) -> tuple[Column, Column]:
    """Values at a cell's lower and upper face."""
    return q, q


def piecewise_linear(qm: Column, q: Column, qp: Column) -> tuple[Column, Column]:
    """Values at a cell's lower and upper face; within the neighbours' range."""
    half = 0.5 * van_leer(qm, q, qp)
    return q - half, q + half


def linear_mc(qm: Column, q: Column, qp: Column) -> tuple[Column, Column]:
    half = 0.5 * mc(q - qm, qp - q)
    return q - half, q + half


#: Fixed values of the fifth-order scheme: the candidate stencils and their ideal weights.
_CANDIDATES = ((1 / 3, -7 / 6, 11 / 6), (-1 / 6, 5 / 6, 1 / 3), (1 / 3, 5 / 6, -1 / 6))
_IDEAL = (0.1, 0.6, 0.3)


def weno5z(q: Sequence[Column]) -> tuple[Column, Column]:
    """Values at a cell's lower and upper face from five cells: WENO5-Z, blended with the limited linear ones where weights are far from ideal."""
    def smooth(a: Column, b: Column) -> Column:
        return (13.0 / 3.0) * a * a + b * b + EPS

    q0, q1, q2, q3, q4 = q
    betas = [
        smooth(q0 - 2.0 * q1 + q2, q0 - 4.0 * q1 + 3.0 * q2),
        smooth(q1 - 2.0 * q2 + q3, q3 - q1),
        smooth(q2 - 2.0 * q3 + q4, q4 - 4.0 * q3 + 3.0 * q2),
    ]
    tau = F.abs(betas[2] - betas[0])
    factors = [(b + tau) / b for b in betas]

    def side(cells: Sequence[Column], factor: Sequence[Column]) -> tuple[Column, Column]:
        w = [g * f + EPS for g, f in zip(_IDEAL, factor, strict=True)]
        total = w[0] + w[1] + w[2]
        value = sum(w[k] * sum(c * cells[k + j] for j, c in enumerate(_CANDIDATES[k])) for k in range(3)) / total
        near = 3.0 * w[0] * w[1] * w[2] / (total * (_IDEAL[2] * w[0] * w[1] + _IDEAL[1] * w[0] * w[2] + _IDEAL[0] * w[1] * w[2])) + EPS
        return value, near

    upper, near_upper = side(q, factors)
    lower, near_lower = side(q[::-1], factors[::-1])
    blend = 2.0 * near_upper * near_lower / (near_upper + near_lower)
    low_lin, up_lin = linear_mc(q1, q2, q3)
    return blend * lower + (1.0 - blend) * low_lin, blend * upper + (1.0 - blend) * up_lin


def upwind(v: Column, left: Column, right: Column) -> Column:
    return v * F.when(v > 0, left).otherwise(right)


def hll(left: Column, right: Column, f_left: Column, f_right: Column, s_left: Column, s_right: Column) -> Column:
    """HLL flux; wave speeds that are both 0 stop no division."""
    sl, sr = F.least(s_left, F.lit(0.0)), F.greatest(s_right, F.lit(0.0))
    guard = F.when(sl * sr == 0, 1.0).otherwise(0.0) * F.when(sr - sl == 0, 1.0).otherwise(0.0)
    return (sr * f_left - sl * f_right + sl * sr * (right - left)) / (sr - sl + guard)


def mat_vec(df: DataFrame, keys: Sequence[str], index: Sequence[str], value: str, stencil: Sequence[tuple[Sequence[int], float]], out: str) -> DataFrame:
    """Sum of weight times value at offset, in any number of dimensions: each cell is sent to those that use it and summed.

    The map side adds up before the exchange. Offsets without a cell add nothing.
    """
    moved = [
        F.struct(*((F.col(i) - o).alias(i) for i, o in zip(index, offset, strict=True)), (F.lit(w) * F.col(value)).alias("_v"))
        for offset, w in stencil
    ]
    sent = df.select(*keys, F.explode(F.array(*moved)).alias("_m")).select(*keys, "_m.*")
    summed = sent.groupBy(*keys, *index).agg(F.sum("_v").alias(out))
    return df.join(summed, [*keys, *index], "left").withColumn(out, F.coalesce(out, F.lit(0.0)))


def jacobi(rhs: Column, ax: Column, diagonal: Column | float, v: Column) -> Column:
    """(rhs - A v + D v) / D."""
    return (rhs - ax + diagonal * v) / diagonal


def weights(x: Column, lo: float, dx: float, n: int) -> tuple[Column, Column, Column]:
    """Lower point of n to interpolate from and the weights of it and the next; beyond the ends it extrapolates."""
    at = F.least(F.greatest(ratio(x - lo, F.lit(dx)).cast("int"), F.lit(0)), F.lit(n - 2))
    upper = ratio(x - (lo + at * dx), F.lit(dx))
    return at, 1.0 - upper, upper


def interpolate(points: DataFrame, key: str, grid: DataFrame, value: str, axes: Sequence[tuple[str, str, float, float, int]], out: str) -> DataFrame:
    """Multilinear interpolation of ``grid`` (index columns, ``value``) at ``points``: each goes to its 2^d corners by equi-join.

    ``axes``: point column, index column of the grid, first centre, spacing, number of points.
    """
    rows = points
    for x, i, lo, dx, n in axes:
        at, w0, w1 = weights(F.col(x), lo, dx, n)
        corner = F.explode(F.array(F.struct(at.alias("i"), w0.alias("w")), F.struct((at + 1).alias("i"), w1.alias("w"))))
        rows = rows.withColumn(f"_{i}", corner).withColumns({i: F.col(f"_{i}.i"), f"_w_{i}": F.col(f"_{i}.w")}).drop(f"_{i}")
    weight = F.lit(1.0)
    for _, i, *_rest in axes:
        weight = weight * F.col(f"_w_{i}")
    joined = rows.join(grid.select(*(a[1] for a in axes), value), [a[1] for a in axes])
    return joined.groupBy(key).agg(F.sum(weight * F.col(value)).alias(out))
