"""Refinement: tags, transfer between levels, lineage of blocks over a remesh."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.scalars import TINY
from tessella.operators.stencils import line, min_mod


def first_derivative(qm: Column, q: Column, qp: Column) -> Column:
    return 0.5 * F.abs(qp - qm) / (F.abs(q) + TINY)


def second_derivative(qm: Column, q: Column, qp: Column) -> Column:
    mean = 0.5 * (qp + qm)
    return F.abs(mean - q) / (F.abs(mean) + F.abs(q) + TINY)


def tag(worst: Column, refine: float = 0.5, derefine: float = 0.05) -> Column:
    """1 to refine, -1 to derefine, 0 to stay; a block without the field stays."""
    return F.coalesce(F.when(worst > refine, 1).when(worst < derefine, -1).otherwise(0), F.lit(0))


def tags(cells: DataFrame, block: str, axes: Sequence[tuple[Sequence[str], str]], q: str, criterion=first_derivative, refine: float = 0.5, derefine: float = 0.05) -> DataFrame:
    """``worst`` and ``tag`` of each block: the largest criterion over its inner cells and axes (line keys, index)."""
    found = []
    for by, index in axes:
        w = line(by, index)
        found.append(criterion(F.lag(q).over(w), F.col(q), F.lead(q).over(w)))
    each = found[0] if len(found) == 1 else F.greatest(*found)
    worst = cells.withColumn("_c", each).groupBy(block).agg(F.max("_c").alias("worst"))
    return worst.withColumn("tag", tag(F.col("worst"), refine, derefine))


def range_tag(lo: Column, hi: Column, refine: float, derefine: float) -> Column:
    """Refine where values span both bounds, derefine where all are below the lower one."""
    return F.when((hi > refine) & (lo < derefine), 1).when(hi < derefine, -1).otherwise(0)


def vote(*given: Column, level: Column | None = None, max_level: int | None = None) -> Column:
    """The largest of several tags; no refinement at the largest level."""
    out = given[0] if len(given) == 1 else F.greatest(*given)
    if level is not None and max_level is not None:
        out = F.when((level >= max_level) & (out > 0), 0).otherwise(out)
    return out


def consecutive(rows: DataFrame, block: str, cycle: str, tag_col: str, count: int = 10, out: str = "act") -> DataFrame:
    """Tags that take effect: refinement at once, derefinement only after ``count`` votes in a row."""
    own = Window.partitionBy(block).orderBy(cycle)
    runs = rows.withColumn("_run", F.sum((F.col(tag_col) != -1).cast("int")).over(own))
    streak = F.row_number().over(Window.partitionBy(block, "_run").orderBy(cycle))
    # a run begins with what broke the run before, unless it is a block's first
    streak = streak - F.when(F.col("_run") > 0, 1).otherwise(0)
    acted = F.when(F.col(tag_col) == 1, 1).when((F.col(tag_col) == -1) & (streak >= count), -1).otherwise(0)
    return runs.withColumn(out, acted).drop("_run")


def restrict(cells: DataFrame, keys: Sequence[str], index: Sequence[str], values: Sequence[str], volume: Column | None = None) -> DataFrame:
    """Coarse cells as volume-weighted means of their 2^d children."""
    volume = F.lit(1.0) if volume is None else volume
    coarse = [F.shiftright(F.col(i), 1).alias(i) for i in index]
    sums = [(F.sum(F.col(v) * volume) / F.sum(volume)).alias(v) for v in values]
    return cells.groupBy(*keys, *coarse).agg(*sums)


def prolongate(cells: DataFrame, keys: Sequence[str], index: Sequence[str], value: str, kind: str = "min_mod") -> DataFrame:
    """2^d children of each cell: ``min_mod`` or ``linear`` slopes, or ``constant``. At a line's end a slope is 0."""
    q = F.col(value)
    slopes = {}
    for i in index:
        by = [*keys, *(k for k in index if k != i)]
        w = line(by, i)
        qm, qp = F.lag(value).over(w), F.lead(value).over(w)
        slope = {"min_mod": lambda a=qm, b=qp: min_mod(q, a, b, 1.0, 1.0), "linear": lambda a=qm, b=qp: 0.5 * (b - a), "constant": lambda: F.lit(0.0)}[kind]()
        slopes[i] = F.coalesce(slope, F.lit(0.0))
    out = cells.select(*keys, *index, value, *(s.alias(f"_s_{i}") for i, s in slopes.items()))
    for i in index:
        out = out.withColumn(f"_d_{i}", F.explode(F.array(F.lit(0), F.lit(1))))
    fine = q
    for i in index:
        fine = fine + F.col(f"_s_{i}") * (F.col(f"_d_{i}") - 0.5) * 0.5
    return out.select(*keys, *((F.col(i) * 2 + F.col(f"_d_{i}")).alias(i) for i in index), fine.alias(value))


def lineage(old: DataFrame, new: DataFrame, axes: Sequence[str]) -> DataFrame:
    """``gid``, ``old_gid``, ``kind`` of each new leaf: the same block, refined from its parent, or derefined from its daughters."""
    o = old.select(F.col("gid").alias("old_gid"), F.col("level").alias("ol"), *(F.col(a).alias(f"o_{a}") for a in axes))
    n = new.select("gid", "level", *axes)
    place = lambda left, right: [F.expr(left.format(a=a)) == F.expr(right.format(a=a)) for a in axes]
    same = n.join(o, [F.col("level") == F.col("ol"), *place("{a}", "o_{a}")]).withColumn("kind", F.lit("same"))
    refined = n.join(o, [F.col("level") - 1 == F.col("ol"), *place("shiftright({a}, 1)", "o_{a}")]).withColumn("kind", F.lit("refined"))
    derefined = n.join(o, [F.col("level") + 1 == F.col("ol"), *place("{a}", "shiftright(o_{a}, 1)")]).withColumn("kind", F.lit("derefined"))
    return same.unionByName(refined).unionByName(derefined).select("gid", "old_gid", "kind")


def new_costs(lines: DataFrame, cost: DataFrame) -> DataFrame:
    """Cost of new blocks: inherited, or the mean of the daughters that went."""
    return lines.join(cost.select(F.col("gid").alias("old_gid"), "cost"), "old_gid").groupBy("gid").agg(F.avg("cost").alias("cost"))


def running_cost(old: Column, measured: Column, interval: int) -> Column:
    """Exponential mean of a block's measured cost."""
    return old * ((interval - 1) / interval) + measured / interval


def derefinement_order(candidates: DataFrame, level: str, gid: str) -> DataFrame:
    """Candidates by level, the finest first, as a parent can go only after its daughters went; by ``gid`` within a level."""
    return candidates.orderBy(F.desc(level), gid)
