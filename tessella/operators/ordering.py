"""Order and search: global positions without one task for all rows, partitions, bounds, alias sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.scalars import ceil_div
from tessella.operators.reductions import prefix_sum


def positions(df: DataFrame, order: str | Sequence[str], out: str, buckets: int = 256) -> DataFrame:
    """Position from 0 of each row in an order that is total."""
    order = [order] if isinstance(order, str) else list(order)
    counted = prefix_sum(df.withColumn("_one", F.lit(1).cast("long")), order, "_one", out, inclusive=False, buckets=buckets)
    return counted.drop("_one").withColumn(out, F.col(out).cast("long"))


def compacted(df: DataFrame, active: Column, order: str, out: str) -> DataFrame:
    """Active rows only, with gapless slots."""
    return positions(df.filter(active), order, out)


def cell_index(particles: DataFrame, cell: str, cells: int) -> DataFrame:
    """``cell``, ``n`` and ``first`` of every cell 0..cells-1: how many particles, and where its first stands when sorted by cell; -1 for none.

    Counts come first, so what is ordered is a row for each cell and never the particles.
    """
    counted = particles.groupBy(cell).agg(F.count("*").alias("n"))
    counted = prefix_sum(counted, [cell], "n", "first", inclusive=False)
    grid = particles.sparkSession.range(cells).withColumnRenamed("id", cell)
    out = grid.join(counted, cell, "left")
    return out.select(cell, F.coalesce("n", F.lit(0).cast("long")).alias("n"), F.coalesce(F.col("first").cast("long"), F.lit(-1).cast("long")).alias("first"))


def to_size(df: DataFrame, order: str, size: int, out: str) -> DataFrame:
    """Groups of ``size`` rows in order; the last has the rest."""
    return positions(df, order, out).withColumn(out, F.floor(F.col(out) / size).cast("long"))


def to_count(df: DataFrame, order: str, count: int, out: str) -> DataFrame:
    """At most ``count`` groups, all of the size rounded up but the last."""
    return to_size(df, order, max(1, -(-df.count() // count)), out)


def upper_bound(edges: Column, v: Column) -> Column:
    """Index of the first of the ascending ``edges`` that exceeds ``v``."""
    return F.size(F.filter(edges, lambda e: e <= v))


def alias_table(weights: Sequence[float]) -> list[tuple[float, int]]:
    """Vose's alias table: for each outcome the chance to stay with it, and the other one."""
    n, total = len(weights), sum(weights)
    scaled = [w * n / total for w in weights]
    table = [(1.0, i) for i in range(n)]
    small = [i for i, p in enumerate(scaled) if p < 1.0]
    large = [i for i, p in enumerate(scaled) if p >= 1.0]
    while small and large:
        s, big = small.pop(), large.pop()
        table[s] = (scaled[s], big)
        scaled[big] += scaled[s] - 1.0
        (small if scaled[big] < 1.0 else large).append(big)
    return table


def alias_draw(table: Sequence[tuple[float, int]], r1: Column, r2: Column) -> Column:
    """An outcome for two uniform numbers in [0, 1)."""
    at = F.floor(r1 * len(table)).cast("int")
    stay = F.get(F.array(*(F.lit(float(p)) for p, _ in table)), at)
    other = F.get(F.array(*(F.lit(int(a)) for _, a in table)), at)
    return F.when(r2 >= stay, other).otherwise(at)


__all__ = ["alias_draw", "alias_table", "ceil_div", "cell_index", "compacted", "positions", "to_count", "to_size", "upper_bound"]
