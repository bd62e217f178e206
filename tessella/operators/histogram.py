"""One- and two-dimensional weighted histograms on complete grids of bins."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Edges:
    """Bin edges: equal steps (``lin``), equal ratios (``log``) or given ones (``list``). Bins hold their lower edge, the last its upper."""

    kind: str
    values: tuple[float, ...]

    @classmethod
    def lin(cls, lo: float, hi: float, bins: int) -> Edges:
        return cls("lin", tuple(lo + (hi - lo) * i / bins for i in range(bins + 1)))

    @classmethod
    def log(cls, lo: float, hi: float, bins: int) -> Edges:
        a, b = math.log10(lo), math.log10(hi)
        return cls("log", tuple(10 ** (a + (b - a) * i / bins) for i in range(bins + 1)))

    @classmethod
    def of(cls, *values: float) -> Edges:
        if len(values) < 2 or list(values) != sorted(set(values)):
            raise ValueError("edges must ascend, and be two at least")
        return cls("list", tuple(map(float, values)))

    @property
    def bins(self) -> int:
        return len(self.values) - 1

    def bin(self, v: Column, accumulate: bool = False) -> Column:
        """Bin of a value; null outside, or the outermost bin with ``accumulate``. Null and NaN have none."""
        lo, hi, n = self.values[0], self.values[-1], self.bins
        if self.kind == "lin":
            inner = F.floor((v - lo) / ((hi - lo) / n))
        elif self.kind == "log":
            step = (math.log10(hi) - math.log10(lo)) / n
            inner = F.floor((F.log10(v) - math.log10(lo)) / step)
        else:
            inner = F.size(F.filter(F.array(*(F.lit(e) for e in self.values)), lambda e: e <= v)) - 1
        inner = F.least(F.greatest(inner.cast("int"), F.lit(0)), F.lit(n - 1))
        inside = F.when(v < lo, 0 if accumulate else None).when(v > hi, n - 1 if accumulate else None).when(v == hi, n - 1).otherwise(inner)
        return F.when(v.isNotNull() & ~F.isnan(v), inside)


@dataclass(frozen=True)
class Histogram:
    """A histogram: one or two binned expressions, and what each row adds (1 if nothing is given) times its weights."""

    x: Column
    x_edges: Edges
    y: Column | None = None
    y_edges: Edges | None = None
    value: Column | None = None
    weights: Sequence[Column] = ()
    accumulate: bool = False

    def compute(self, df: DataFrame) -> DataFrame:
        """``ybin``, ``xbin``, ``xlo``, ``xhi`` (and ``ylo``, ``yhi``) and ``value`` of every bin, empty ones with 0."""
        added = F.lit(1.0) if self.value is None else self.value.cast("double")
        for w in self.weights:
            added = added * w
        ybin = F.lit(0) if self.y is None else self.y_edges.bin(self.y.cast("double"), self.accumulate)
        binned = df.select(self.x_edges.bin(self.x.cast("double"), self.accumulate).alias("xbin"), ybin.alias("ybin"), added.alias("added"))
        binned = binned.filter(F.col("xbin").isNotNull() & F.col("ybin").isNotNull())
        sums = binned.groupBy("ybin", "xbin").agg(F.sum("added").alias("value"))
        grid = self._grid(df)
        # the grid has as many rows as the histogram has bins
        return grid.join(F.broadcast(sums), ["ybin", "xbin"], "left").withColumn("value", F.coalesce("value", F.lit(0.0)))

    def _grid(self, df: DataFrame) -> DataFrame:
        spark = df.sparkSession
        xe, ye = self.x_edges.values, self.y_edges.values if self.y_edges else None
        cell = F.col("id")
        grid = spark.range(self.x_edges.bins * (self.y_edges.bins if ye else 1))
        grid = grid.select((cell % self.x_edges.bins).cast("int").alias("xbin"), F.floor(cell / self.x_edges.bins).cast("int").alias("ybin"))
        at = lambda e, i: F.get(F.array(*(F.lit(v) for v in e)), i)
        columns = ["ybin", "xbin", at(xe, F.col("xbin")).alias("xlo"), at(xe, F.col("xbin") + 1).alias("xhi")]
        if ye:
            columns += [at(ye, F.col("ybin")).alias("ylo"), at(ye, F.col("ybin") + 1).alias("yhi")]
        return grid.select(*columns)


def counts(df: DataFrame, value: Column, out: str = "n") -> DataFrame:
    """How often each integer occurs."""
    return df.groupBy(value.alias("value")).agg(F.count("*").alias(out))
