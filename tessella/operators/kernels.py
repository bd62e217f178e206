"""Cell-wise kernels: stage arithmetic, flux divergence, derived fields. All are projections, fused by code generation."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def weighted_sum(x: Column, y: Column, w1: float, w2: float) -> Column:
    """w1 x + w2 y; null, that is not allocated, unless both are there."""
    return w1 * x + w2 * y


def average(x: Column, y: Column) -> Column:
    return weighted_sum(x, y, 0.5, 0.5)


def advance(x: Column, dudt: Column, dt: float) -> Column:
    return x + dt * dudt


def allocated(v: Column, default: float = 0.0) -> Column:
    """A sparse value, or the default where there is none."""
    return F.coalesce(v, F.lit(default))


def on_stages(stages: dict[str, DataFrame], keys: Sequence[str], columns: Iterable[str]) -> DataFrame:
    """One row a cell with each stage's columns as ``<column>_<stage>``. Stages that are aliases of one frame are read once."""
    columns = list(columns)
    frames = []
    for name, df in stages.items():
        frames.append(df.select(*keys, *(F.col(c).alias(f"{c}_{name}") for c in columns)))
    return reduce(lambda a, b: a.join(b, list(keys)), frames)


def flux_divergence(df: DataFrame, axes: Sequence[tuple[str, Sequence[str], Column, Column]], out: str = "dudt") -> DataFrame:
    """-sum over axes of (area F at the upper face - area F at the lower face) / volume.

    ``axes``: flux column (on a cell's lower face), the other key columns of a line of cells, the index to order by, and area /
    volume. The last cell of a line has no upper face here and becomes null.
    """
    total = F.lit(0.0)
    for flux, line, index, area_per_volume in axes:
        upper = F.lead(flux).over(Window.partitionBy(*line).orderBy(index))
        total = total - area_per_volume * (upper - F.col(flux))
    return df.withColumn(out, total)


def low_storage(u0: Column, u1: Column, div: Column, gam0: float, gam1: float, beta_dt: float) -> Column:
    """The fused stage update g0 u0 + g1 u1 + beta dt div."""
    return gam0 * u0 + gam1 * u1 + beta_dt * div


def two_register(u0: Column, u1: Column, dudt: Column, delta: float, gam0: float, gam1: float, beta_dt: float) -> tuple[Column, Column]:
    """The 2S update: the second register first, with the old state, then the state with it."""
    s1 = u1 + delta * u0
    return gam0 * u0 + gam1 * s1 + beta_dt * dudt, s1


def butcher_stage(base: Column, slopes: Sequence[Column], row: Sequence[float], dt: float) -> Column:
    """base + dt sum of a[stage][prev] k[prev] over the stages before, each with its own slope."""
    out = base
    for a, k in zip(row, slopes, strict=False):
        if a:
            out = out + dt * a * k
    return out


def butcher_update(base: Column, slopes: Sequence[Column], b: Sequence[float], dt: float) -> Column:
    """base + dt sum of b[stage] k[stage]."""
    return butcher_stage(base, slopes, b, dt)


def derived(df: DataFrame, hooks: Iterable[Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """Hooks in order: before communication, before, fill, after."""
    for hook in hooks:
        df = hook(df)
    return df


def complement(q: Column) -> Column:
    return 1.0 - q


def complement_squared(q: Column) -> Column:
    return (1.0 - q) * (1.0 - q)


def from_complement_squared(s: Column) -> Column:
    return 1.0 - F.sqrt(s)


def kinetic(q: Column, *u: Column) -> Column:
    """Half a scalar times the squared speed."""
    square = u[0] * u[0]
    for v in u[1:]:
        square = square + v * v
    return 0.5 * q * square


def inside_circle(x: Column, y: Column, r: float) -> Column:
    return F.when(x * x + y * y < r * r, 1.0).otherwise(0.0)


def busy(v: Column, n: Column, times: int = 1) -> Column:
    """An artificial load: v after n steps of v -> cos v, in one expression."""
    steps = F.sequence(F.lit(1), F.greatest(n * times, F.lit(1)))
    return F.aggregate(steps, v.cast("double"), lambda acc, _: F.cos(acc))
