"""Staggered values: where elements are, their measures, curl and divergence, and prolongation into a coarse cell's inside."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Elements, and on which axes they sit half a cell below the centre: cells, faces, edges, nodes. Fixed values.
ELEMENTS = {
    "CC": (0, 0, 0), "F1": (1, 0, 0), "F2": (0, 1, 0), "F3": (0, 0, 1),
    "E1": (0, 1, 1), "E2": (1, 0, 1), "E3": (1, 1, 0), "NN": (1, 1, 1),
}


def position(element: str, axis: int, i: Column, lo: Column | float, dx: Column | float) -> Column:
    """Coordinate on axis 1..3 of the element with index i."""
    return lo + (i + (0.0 if ELEMENTS[element][axis - 1] else 0.5)) * dx


def measure(element: str, dx: Sequence[Column | float]) -> Column | float:
    """Length, area or volume: the product of the spacings on the axes that the element extends along; 1 for a node."""
    out = 1.0
    for offset, d in zip(ELEMENTS[element], dx, strict=True):
        if not offset:
            out = d * out
    return out


def is_boundary_of(inner: str, outer: str) -> bool:
    """Whether ``inner`` is on the boundary of ``outer``: it is flat wherever the other is, and somewhere more."""
    a, b = ELEMENTS[inner], ELEMENTS[outer]
    return a != b and all(x >= y for x, y in zip(a, b, strict=True))


def difference(values: DataFrame, keys: Sequence[str], index: str, value: str, weight: float, out: str) -> DataFrame:
    """weight * (value at index + 1 - value at index), as a map-side spread and a sum; ends without a partner go."""
    here = F.struct(F.col(index).alias("i"), (-weight * F.col(value)).alias("v"))
    below = F.struct((F.col(index) - 1).alias("i"), (weight * F.col(value)).alias("v"))
    spread = values.select(*keys, F.explode(F.array(here, below)).alias("p"))
    summed = spread.groupBy(*keys, F.col("p.i").alias(index)).agg(F.sum("p.v").alias(out), F.count("*").alias("_n"))
    return summed.filter("_n = 2").drop("_n")


def circulation(edges: DataFrame, dx: Sequence[float]) -> DataFrame:
    """Curl on faces of (te, i, j, k, value) on edges: (te, i, j, k, value), each face the sum over its boundary divided by its area."""
    axes = ("i", "j", "k")
    parts = []
    for face in range(3):
        for first, second, sign in (((face + 1) % 3, (face + 2) % 3, 1.0), ((face + 2) % 3, (face + 1) % 3, -1.0)):
            # d(edge along `second`) / d(axis `first`)
            own = edges.filter(F.col("te") == f"E{second + 1}")
            keys = [a for n, a in enumerate(axes) if n != first]
            diff = difference(own, keys, axes[first], "value", sign / dx[first], "value")
            parts.append(diff.select(F.lit(f"F{face + 1}").alias("te"), *axes, "value"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("te", *axes).agg(F.sum("value").alias("value"), F.count("*").alias("_n")).filter("_n = 2").drop("_n")


def divergence(faces: DataFrame, dx: Sequence[float]) -> DataFrame:
    """Divergence in cells of (te, i, j, k, value) on faces."""
    axes = ("i", "j", "k")
    parts = None
    for n in range(3):
        own = faces.filter(F.col("te") == f"F{n + 1}")
        diff = difference(own, [a for a in axes if a != axes[n]], axes[n], "value", 1.0 / dx[n], "value").select(*axes, "value")
        parts = diff if parts is None else parts.unionByName(diff)
    return parts.groupBy(*axes).agg(F.sum("value").alias("value"), F.count("*").alias("_n")).filter("_n = 3").drop("_n")


_SIGN = np.array([-1.0, 1.0])


def _inner_faces(normal: np.ndarray, second: np.ndarray, third: np.ndarray, d: Sequence[float]) -> np.ndarray:
    """Values between the outer faces of one direction. Arrays: rows x own axis x the next two in cyclic order, own faces 0 and 2 known."""
    # second: (own, its faces, third); third: (own, second, its faces); outer faces only
    by, bz = second[:, :, [0, 2], :], third[:, :, :, [0, 2]]
    u = (np.einsum("nabc,a,b->n", by, _SIGN, _SIGN) + np.einsum("nabc,a,c->n", bz, _SIGN, _SIGN)) / 8
    v = np.einsum("nabc,a,b,c->n", by, _SIGN, _SIGN, _SIGN) / 8 * d[2] ** 2 / (d[0] ** 2 + d[2] ** 2)
    w = np.einsum("nabc,a,b,c->n", bz, _SIGN, _SIGN, _SIGN) / 8 * d[1] ** 2 / (d[0] ** 2 + d[1] ** 2)
    mean = 0.5 * (normal[:, 0] + normal[:, 2])
    return mean + u[:, None, None] + v[:, None, None] * _SIGN[None, None, :] + w[:, None, None] * _SIGN[None, :, None]


def divergence_free_inside(cells: DataFrame, key: str, dx: Sequence[float]) -> DataFrame:
    """Fine face values inside coarse cells after Toth and Roe (2002): no divergence if the outer faces have none.

    ``b1``, ``b2``, ``b3`` of each row: arrays of 3 x 2 x 2, 2 x 3 x 2 and 2 x 2 x 3 values on fine faces by (x, y, z), x slowest;
    the inner ones are replaced.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shapes = ((3, 2, 2), (2, 3, 2), (2, 2, 3))
        for batch in batches:
            if not len(batch):
                continue
            # over the spacing, so that differences of all three add up to the divergence
            b = [np.array(batch[f"b{a + 1}"].tolist(), dtype=float).reshape(-1, *shapes[a]) / dx[a] for a in range(3)]
            new = []
            for a in range(3):
                # turn so that this direction comes first and the others follow in cyclic order
                order = (0, 1 + a, 1 + (a + 1) % 3, 1 + (a + 2) % 3)
                own = [x.transpose(order) for x in b]
                inner = _inner_faces(own[a], own[(a + 1) % 3], own[(a + 2) % 3], [dx[(a + s) % 3] for s in range(3)])
                out = np.array(batch[f"b{a + 1}"].tolist(), dtype=float).reshape(-1, *shapes[a]).transpose(order)
                out[:, 1] = inner * dx[a]
                back = np.argsort(order)
                new.append(out.transpose(back))
            yield pd.DataFrame({key: batch[key].to_numpy(), **{f"b{a + 1}": [x.ravel().tolist() for x in new[a]] for a in range(3)}})

    return cells.select(key, "b1", "b2", "b3").mapInPandas(run, f"{key} long, b1 array<double>, b2 array<double>, b3 array<double>")


def variable_mat_vec(cells: DataFrame, coefficients: DataFrame, index: Sequence[str], value: str, out: str) -> DataFrame:
    """Sum over offsets of each cell's own coefficient times the value there: (index, o_<index>, weight) per cell and offset.

    Two equi-joins on the index: coefficients look up the value they weigh, the sums go to their cell.
    """
    wanted = coefficients.select(*index, *((F.col(i) + F.col(f"o_{i}")).alias(f"at_{i}") for i in index), "weight")
    there = cells.select(*(F.col(i).alias(f"at_{i}") for i in index), F.col(value).alias("_v"))
    summed = wanted.join(there, [f"at_{i}" for i in index]).groupBy(*index).agg(F.sum(F.col("weight") * F.col("_v")).alias(out))
    return cells.join(summed, list(index), "left").withColumn(out, F.coalesce(out, F.lit(0.0)))


def face_coefficients(faces: DataFrame, axis: str, index: Sequence[str], d: str, dx: float) -> DataFrame:
    """Coefficients of -div(D grad) along one axis from D on lower faces: each face couples the cells on its sides, ends only themselves."""
    w = F.col(d) / dx**2
    own = [F.col(i).alias(i) for i in index]
    below = [(F.col(i) - 1).alias(i) if i == axis else F.col(i).alias(i) for i in index]
    at = lambda o: [F.lit(o if i == axis else 0).alias(f"o_{i}") for i in index]
    rows = [F.struct(*own, *at(0), w.alias("weight")), F.struct(*own, *at(-1), (-w).alias("weight")), F.struct(*below, *at(0), w.alias("weight")), F.struct(*below, *at(1), (-w).alias("weight"))]
    return faces.select(F.explode(F.array(*rows)).alias("c")).select("c.*").groupBy(*index, *(f"o_{i}" for i in index)).agg(F.sum("weight").alias("weight"))
