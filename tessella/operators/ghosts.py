"""Ghost cells and boundary conditions as index maps and joins; flux correction between levels."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Conditions by name: the source index of ghost index i (0..n-1 are inner), and the factor and shift of its value.
CONDITIONS: dict[str, Callable] = {}


def condition(name: str) -> Callable:
    def put(f: Callable) -> Callable:
        CONDITIONS[name] = f
        return f

    return put


@condition("periodic")
def _periodic(i: Column, n: int, value: Column, normal: bool, fixed: float):
    return F.pmod(i, F.lit(n)), value


@condition("outflow")
def _outflow(i, n, value, normal, fixed):
    return F.least(F.greatest(i, F.lit(0)), F.lit(n - 1)), value


@condition("reflecting")
def _reflecting(i, n, value, normal, fixed):
    mirrored = F.when(i < 0, -1 - i).when(i >= n, 2 * n - 1 - i).otherwise(i)
    outside = (i < 0) | (i >= n)
    return mirrored, F.when(outside, -value).otherwise(value) if normal else value


@condition("fixed")
def _fixed(i, n, value, normal, fixed):
    return F.least(F.greatest(i, F.lit(0)), F.lit(n - 1)), F.when((i < 0) | (i >= n), F.lit(fixed)).otherwise(value)


@condition("fixed_face")
def _fixed_face(i, n, value, normal, fixed):
    """The mean of a ghost and its mirror image is the face's value."""
    mirrored = F.when(i < 0, -1 - i).when(i >= n, 2 * n - 1 - i).otherwise(i)
    return mirrored, F.when((i < 0) | (i >= n), 2.0 * fixed - value).otherwise(value)


def with_ghosts(cells: DataFrame, keys: Sequence[str], index: str, n: int, width: int, values: Sequence[str], kind: str, normal: Sequence[str] = (), fixed: float = 0.0) -> DataFrame:
    """Cells with ``width`` ghosts on both ends of each line of n, under the named condition; ``normal``: components that a mirror turns.

    Every cell is sent to the ghosts that copy it; no join and no exchange. Sources come from the index map, tried for
    each ghost place, of which a line has 2 * width.
    """
    places = F.array(*(F.lit(g) for g in [*range(-width, 0), *range(n, n + width)]))
    source = lambda g: CONDITIONS[kind](g, n, F.lit(0.0), False, fixed)[0]
    targets = F.concat(F.array(F.col(index).cast("int")), F.filter(places, lambda g: source(g) == F.col(index)))
    spread = cells.select(*keys, F.explode(targets).alias("_i"), *values)
    mapped = [CONDITIONS[kind](F.col("_i"), n, F.col(v), v in normal, fixed)[1].alias(v) for v in values]
    return spread.select(*keys, F.col("_i").alias(index), *mapped)


def linear_ghosts(cells: DataFrame, keys: Sequence[str], index: str, n: int, width: int, value: str) -> DataFrame:
    """Constant-derivative ghosts: extrapolated from the two cells at each end."""
    ends = cells.filter(F.col(index).isin(0, 1, n - 2, n - 1)).groupBy(*keys).agg(*(F.max(F.when(F.col(index) == i, F.col(value))).alias(f"v{k}") for k, i in enumerate((0, 1, n - 2, n - 1))))
    low = [F.struct(F.lit(-g).alias("i"), (F.col("v0") + g * (F.col("v0") - F.col("v1"))).alias("v")) for g in range(1, width + 1)]
    high = [F.struct(F.lit(n - 1 + g).alias("i"), (F.col("v3") + g * (F.col("v3") - F.col("v2"))).alias("v")) for g in range(1, width + 1)]
    ghosts = ends.select(*keys, F.explode(F.array(*low, *high)).alias("g")).select(*keys, F.col("g.i").alias(index), F.col("g.v").alias(value))
    return cells.select(*keys, F.col(index).cast("int").alias(index), value).unionByName(ghosts)


def halo(cells: DataFrame, block: Sequence[str], index: Sequence[str], nx: Sequence[int], grid: Sequence[int], width: int, values: Sequence[str], default: float | None = None) -> DataFrame:
    """Blocks' cells with ghosts copied from same-level neighbours of a periodic grid of blocks, corners included.

    A cell goes to its own block and to each neighbour it borders: 3^d places at most, chosen by arithmetic, without a join.
    With ``default`` a null (not allocated) value arrives as the default.
    """
    rows = cells
    for b, i, n, blocks in zip(block, index, nx, grid, strict=True):
        own = F.struct(F.col(b).cast("long").alias("b"), F.col(i).cast("long").alias("i"))
        up = F.struct(F.pmod(F.col(b) + 1, F.lit(blocks)).cast("long").alias("b"), (F.col(i) - n).cast("long").alias("i"))
        down = F.struct(F.pmod(F.col(b) - 1, F.lit(blocks)).cast("long").alias("b"), (F.col(i) + n).cast("long").alias("i"))
        places = F.array(own, F.when(F.col(i) >= n - width, up), F.when(F.col(i) < width, down))
        spread = F.explode(F.filter(places, lambda p: p.isNotNull()))
        rows = rows.withColumn("_p", spread).withColumns({b: F.col("_p.b"), i: F.col("_p.i")}).drop("_p")
    if default is not None:
        rows = rows.withColumns({v: F.coalesce(v, F.lit(default)) for v in values})
    return rows


def corrected_fluxes(coarse: DataFrame, fine: DataFrame, keys: Sequence[str], flux: str) -> DataFrame:
    """Coarse fluxes, replaced by the mean of the fine fluxes on the same face where there are any (``fine`` has coarse keys)."""
    mean = fine.groupBy(*keys).agg(F.avg(flux).alias("_fine"))
    return coarse.join(mean, list(keys), "left").withColumn(flux, F.coalesce("_fine", flux)).drop("_fine")


def averaged_to_centres(faces: DataFrame, axes: Sequence[tuple[Sequence[str], str]], value: str) -> DataFrame:
    """Face, edge or node values to cells: the mean of two along each axis (other keys, index); a line's last place goes."""
    from tessella.operators.stencils import line

    out = faces
    for by, index in axes:
        out = out.withColumn(value, 0.5 * (F.col(value) + F.lead(value).over(line(by, index)))).filter(F.col(value).isNotNull())
    return out
