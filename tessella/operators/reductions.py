"""Reductions: each is one grouped or global aggregate, partial on the map side."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Reduction operators by name.
OPERATORS = {
    "sum": F.sum, "max": F.max, "min": F.min, "prod": F.product, "land": F.bool_and, "lor": F.bool_or,
    "band": F.bit_and, "bor": F.bit_or, "bxor": F.bit_xor,
    "lxor": lambda c: F.sum(c.cast("int")) % 2 == 1,
}


def reduce(df: DataFrame, op: str, value: Column, out: str = "value", by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(OPERATORS[op](value).alias(out))


def minmax(value: Column) -> Column:
    return F.struct(F.min(value).alias("lo"), F.max(value).alias("hi"))


def max_loc(value: Column, location: Column) -> Column:
    """Largest value and where it is; among equals the smallest location."""
    return F.max(F.struct(value.alias("value"), (-location).alias("loc")))


@dataclass(frozen=True)
class History:
    """A scalar of the history: operator (sum, max, min), expression and label; a list of expressions makes label_0, label_1, ..."""

    op: str
    value: Column | Sequence[Column]
    label: str

    def columns(self) -> list[Column]:
        if isinstance(self.value, Column):
            return [OPERATORS[self.op](self.value).alias(self.label)]
        return [OPERATORS[self.op](v).alias(f"{self.label}_{i}") for i, v in enumerate(self.value)]


def history(df: DataFrame, entries: Sequence[History], by: Sequence[str] = ()) -> DataFrame:
    """All entries in one pass: sums first, then maxima, then minima."""
    order = {"sum": 0, "max": 1, "min": 2}
    columns = [c for e in sorted(entries, key=lambda e: order[e.op]) for c in e.columns()]
    return df.groupBy(*by).agg(*columns)


def box_sum(value: Column, *bounds: tuple[Column, float, float]) -> Column:
    """Sum over a box with inclusive bounds, as one conditional aggregate."""
    inside = F.lit(True)
    for x, lo, hi in bounds:
        inside = inside & x.between(lo, hi)
    return F.sum(F.when(inside, value).otherwise(0.0))


def dot(x: Column, y: Column) -> Column:
    return F.sum(x * y)


def norm(difference: Column, p: float = 2.0, mean: bool = False) -> Column:
    """L_p norm, or that of the mean."""
    total = F.avg if mean else F.sum
    return F.pow(total(F.pow(F.abs(difference), F.lit(p))), F.lit(1.0 / p))


def relative_error(a: Column, b: Column, ignore_zero: bool = False) -> Column:
    """Difference over the mean size of both; 0 / 0 is 0, or null to be left out."""
    mean = 0.5 * (F.abs(a) + F.abs(b))
    return F.when(mean != 0, (a - b) / F.when(mean != 0, mean)).otherwise(None if ignore_zero else 0.0)


def time_step(dx: Column, speed: Column, cfl: float) -> Column:
    """Smallest crossing time of a cell; resting cells do not count."""
    return cfl * F.min(F.when(speed != 0, dx / F.abs(F.when(speed != 0, speed))))


def all_below(value: Column, threshold: float) -> Column:
    """Whether a block's values may be given back."""
    return F.bool_and(F.abs(value) <= threshold)


def any_above(value: Column, threshold: float) -> Column:
    return F.bool_or(F.abs(value) >= threshold)


def imbalance(cost: DataFrame, tolerance: float = 0.5) -> DataFrame:
    """Of (rank, cost): total, largest and mean by rank, and whether the largest exceeds the mean by more than ``tolerance``."""
    ranks = cost.groupBy("rank").agg(F.sum("cost").alias("cost"))
    out = ranks.agg(F.sum("cost").alias("total"), F.max("cost").alias("largest"), F.avg("cost").alias("mean"))
    return out.withColumn("unbalanced", F.col("largest") > (1.0 + tolerance) * F.col("mean"))


def prefix_sum(df: DataFrame, order: Sequence[str], value: str, out: str, inclusive: bool = True, buckets: int = 256) -> DataFrame:
    """Running sum over the whole table in an order that is total, without one task for all rows.

    Rows are dealt to ranges of the first order column; each range is summed by itself and shifted by the sums of those
    before. The ranges' bounds and sums, ``buckets`` at most, are all that meets in one place.
    """
    first = order[0]
    cuts = df.agg(F.percentile_approx(first, [i / buckets for i in range(1, buckets)], 50 * buckets).alias("c")).first().c or []
    cuts = sorted(set(cuts))
    bucket = F.size(F.filter(F.array(*(F.lit(c) for c in cuts)), lambda c: c <= F.col(first))) if cuts else F.lit(0)
    rows = df.withColumn("_bucket", F.when(F.col(first).isNull(), -1).otherwise(bucket))
    sums = rows.groupBy("_bucket").agg(F.sum(value).alias("_sum"))
    before = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    own = F.sum(value).over(Window.partitionBy("_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    out_rows = rows.withColumn("_own", own).join(F.broadcast(before.select("_bucket", "_before")), "_bucket")
    total = F.col("_before") + F.col("_own")
    return out_rows.withColumn(out, total if inclusive else total - F.col(value)).drop("_bucket", "_own", "_before")
