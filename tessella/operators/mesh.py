"""Block-structured meshes: locations, trees, neighbours, ownership, balance.

A mesh has few blocks and many cells. Trees are built on the driver and become a ``blocks`` table; what
touches cells is a join or a projection.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.functions.scalars import morton


@dataclass(frozen=True, order=True)
class Location:
    """A block's address: tree, level, and its index on each axis at that level."""

    tree: int
    level: int
    lx: tuple[int, ...]

    def parent(self, up: int = 1) -> Location:
        return Location(self.tree, self.level - up, tuple(x >> up for x in self.lx))

    def daughters(self) -> list[Location]:
        offsets = itertools.product((0, 1), repeat=len(self.lx))
        return [Location(self.tree, self.level + 1, tuple(2 * x + o for x, o in zip(self.lx, off, strict=True))) for off in offsets]

    def shifted(self, offset: Sequence[int]) -> Location:
        return Location(self.tree, self.level, tuple(x + o for x, o in zip(self.lx, offset, strict=True)))

    def contains(self, other: Location) -> bool:
        return self.tree == other.tree and other.level >= self.level and other.parent(other.level - self.level) == self

    def is_neighbour(self, other: Location) -> bool:
        """Whether two blocks touch without one holding the other, whatever their levels."""
        if self.tree != other.tree or self.contains(other) or other.contains(self):
            return False
        top = max(self.level, other.level)
        touch = True
        for a, b in zip(self.lx, other.lx, strict=True):
            lo_a, hi_a = a << (top - self.level), (a + 1) << (top - self.level)
            lo_b, hi_b = b << (top - other.level), (b + 1) << (top - other.level)
            touch &= lo_a <= hi_b and lo_b <= hi_a
        return touch

    def key(self, depth: int) -> int:
        """Place in the Z-order of leaves down to level ``depth``."""
        out, at = 0, [x << (depth - self.level) for x in self.lx]
        for bit in range(max(x.bit_length() for x in at)):
            for axis, x in enumerate(at):
                out |= ((x >> bit) & 1) << (bit * len(at) + axis)
        return out


@dataclass
class Tree:
    """A refinement tree over a grid of root blocks, kept properly nested: neighbouring leaves differ by one level at most."""

    roots: tuple[int, ...]
    periodic: tuple[bool, ...] = ()
    tree: int = 0
    leaves: set[Location] = field(default_factory=set)

    def __post_init__(self):
        self.periodic = self.periodic or (False,) * len(self.roots)
        if not self.leaves:
            self.leaves = {Location(self.tree, 0, lx) for lx in itertools.product(*(range(n) for n in self.roots))}

    def _wrapped(self, loc: Location) -> Location | None:
        out = []
        for x, n, wrap in zip(loc.lx, self.roots, self.periodic, strict=True):
            size = n << loc.level
            if not wrap and not 0 <= x < size:
                return None
            out.append(x % size)
        return Location(loc.tree, loc.level, tuple(out))

    def around(self, loc: Location) -> Iterable[Location]:
        for offset in itertools.product((-1, 0, 1), repeat=len(loc.lx)):
            if any(offset) and (at := self._wrapped(loc.shifted(offset))) is not None:
                yield at

    def refine(self, loc: Location) -> int:
        """Replace a leaf with its daughters, and first coarser neighbours with theirs; the number of leaves refined."""
        if loc not in self.leaves:
            return 0
        done = 0
        for at in self.around(loc):
            up = at.parent()
            if at.level > 0 and up in self.leaves:
                done += self.refine(up)
        self.leaves.remove(loc)
        self.leaves.update(loc.daughters())
        return done + 1

    def derefine(self, loc: Location) -> bool:
        """Take back the daughters of ``loc``, if all are leaves and no neighbour of theirs is refined further."""
        daughters = loc.daughters()
        if not self.leaves.issuperset(daughters):
            return False
        for d in daughters:
            for at in self.around(d):
                if at not in daughters and any(x in self.leaves for x in at.daughters()):
                    return False
        self.leaves.difference_update(daughters)
        self.leaves.add(loc)
        return True

    def add(self, loc: Location) -> None:
        """Refine ancestors until ``loc`` is there."""
        for up in range(loc.level, 0, -1):
            self.refine(loc.parent(up))

    def refine_region(self, level: int, lo: Sequence[float], hi: Sequence[float]) -> None:
        """Static refinement: every block of ``level`` that a box (in units of the domain) touches, to whole parents."""
        spans = []
        for a, b, n in zip(lo, hi, self.roots, strict=True):
            size = n << level
            first, last = max(0, math.floor(a * size)), min(size - 1, math.ceil(b * size) - 1)
            spans.append(range(first & ~1, (last | 1) + 1))
        for lx in itertools.product(*spans):
            self.add(Location(self.tree, level, lx))

    def sorted_leaves(self) -> list[Location]:
        top = max(leaf.level for leaf in self.leaves)
        return sorted(self.leaves, key=lambda leaf: leaf.key(top))

    def neighbours(self, loc: Location) -> list[tuple[tuple[int, ...], Location]]:
        """Offset and leaf of each neighbour: of the same level, coarser, or the finer ones that touch."""
        out = []
        for offset in itertools.product((-1, 0, 1), repeat=len(loc.lx)):
            at = self._wrapped(loc.shifted(offset)) if any(offset) else None
            if at is None:
                continue
            if at in self.leaves:
                out.append((offset, at))
            elif at.level > 0 and at.parent() in self.leaves:
                out.append((offset, at.parent()))
            else:
                for d in at.daughters():
                    # finer ones on the side that faces this block
                    if d in self.leaves and all(o == 0 or (x & 1) == (o < 0) for x, o in zip(d.lx, offset, strict=True)):
                        out.append((offset, d))
        return out

    def frame(self, spark: SparkSession, lo: Sequence[float], hi: Sequence[float]) -> DataFrame:
        """The ``blocks`` table: gid in Z-order, address, bounds."""
        rows = []
        for gid, leaf in enumerate(self.sorted_leaves()):
            bounds = []
            for x, a, b, n in zip(leaf.lx, lo, hi, self.roots, strict=True):
                size = n << leaf.level
                bounds += [a + (b - a) * x / size, a + (b - a) * (x + 1) / size]
            rows.append((gid, leaf.tree, leaf.level, *leaf.lx, *bounds))
        axes = range(1, len(self.roots) + 1)
        schema = "gid long, tree long, level int, " + ", ".join(f"lx{a} long" for a in axes) + ", " + ", ".join(f"x{a}min double, x{a}max double" for a in axes)
        return spark.createDataFrame(rows, schema)


def parent_index(lx: Column, up: int = 1) -> Column:
    return F.shiftright(lx, up)


def neighbour_blocks(blocks: DataFrame, axes: Sequence[str], keys: str = "gid") -> DataFrame:
    """``gid``, ``nb_gid``, the offset and ``dlevel`` of each pair of touching leaves of (gid, level, axes): same level, coarser, finer.

    Each block looks up its 3^d - 1 places at its level, their parents, and is found by finer ones in turn; equi-joins only.
    """
    d = len(axes)
    offsets = [o for o in itertools.product((-1, 0, 1), repeat=d) if any(o)]
    spots = F.explode(F.array(*(F.struct(*(F.lit(v).alias(f"o{k}") for k, v in enumerate(o))) for o in offsets)))
    own = blocks.select(F.col(keys).alias("gid"), "level", *axes, spots.alias("o")).select("gid", "level", *axes, "o.*")
    at = own.select("gid", "level", *(f"o{k}" for k in range(d)), *((F.col(a) + F.col(f"o{k}")).alias(f"at{k}") for k, a in enumerate(axes)))
    other = blocks.select(F.col(keys).alias("nb_gid"), F.col("level").alias("nb_level"), *(F.col(a).alias(f"n{k}") for k, a in enumerate(axes)))
    same = at.join(other, [at["level"] == other["nb_level"], *(at[f"at{k}"] == other[f"n{k}"] for k in range(d))])
    up = at.join(other, [at["level"] - 1 == other["nb_level"], *(F.shiftright(at[f"at{k}"], 1) == other[f"n{k}"] for k in range(d))])
    touching = same.unionByName(up).select("gid", "nb_gid", *(f"o{k}" for k in range(d)), (F.col("nb_level") - F.col("level")).alias("dlevel"))
    # what a fine block sees as coarser sees the fine block as finer, from the other side
    finer = touching.filter("dlevel < 0").select(F.col("nb_gid").alias("gid"), F.col("gid").alias("nb_gid"), *((-F.col(f"o{k}")).alias(f"o{k}") for k in range(d)), (-F.col("dlevel")).alias("dlevel"))
    return touching.unionByName(finer)


def owners(claims: DataFrame, element: Sequence[str]) -> DataFrame:
    """The owner of each shared element among (gid, level, newly_refined, tree, morton): finest first, newly refined
    ones below others of their level, then tree, then Z-order."""
    rank = F.struct((F.col("level") * 2 - F.col("newly_refined").cast("int")).alias("a"), F.col("tree").alias("b"), F.col("morton").alias("c"))
    return claims.groupBy(*element).agg(F.max_by("gid", rank).alias("owner"))


def channel_tags(pairs: DataFrame) -> DataFrame:
    """A gapless tag for each channel of a pair of ranks: of (rank, nb_rank, gid, nb_gid)."""
    lo, hi = F.least("rank", "nb_rank"), F.greatest("rank", "nb_rank")
    own = Window.partitionBy("lo", "hi").orderBy("gid", "nb_gid")
    return pairs.withColumns({"lo": lo, "hi": hi}).withColumn("tag", F.row_number().over(own) - 1)


def assign_ranks(costs: Sequence[float], ranks: int) -> list[int]:
    """Contiguous ranks of blocks in Z-order, from the last block on: a rank takes blocks until its share of what was left is met."""
    out, rank, left = [0] * len(costs), ranks - 1, float(sum(costs))
    target, held = left / ranks, 0.0
    for i in range(len(costs) - 1, -1, -1):
        if target == 0.0:
            raise ValueError("blocks without cost cannot be balanced")
        held += costs[i]
        out[i] = rank
        if held >= target and rank > 0:
            rank -= 1
            left -= held
            held = 0.0
            target = left / (rank + 1)
    return out


def balanced(blocks: DataFrame, ranks: int, order: str = "gid", cost: str = "cost") -> DataFrame:
    """``rank`` of each block. The costs, one number for each block of the mesh, are folded on the driver."""
    rows = blocks.select(order, cost).orderBy(order).collect()
    given = assign_ranks([float(r[1]) for r in rows], ranks)
    table = blocks.sparkSession.createDataFrame([(r[0], k) for r, k in zip(rows, given, strict=True)], f"{order} long, rank int")
    return blocks.join(table, order)


def z_ordered(blocks: DataFrame, tree: str, axes: Sequence[str], level: str, depth: int, out: str = "gid") -> DataFrame:
    """Global id of leaves by tree and Z-order."""
    at = [F.shiftleft(F.col(a), 0) * F.pow(F.lit(2.0), F.lit(depth) - F.col(level)).cast("long") for a in axes]
    key = morton(*at, bits=depth + 2)
    return blocks.withColumn("_m", key).withColumn(out, (F.row_number().over(Window.orderBy(tree, "_m")) - 1).cast("long")).drop("_m")


def total_cells(blocks: Column, cells: Sequence[int]) -> Column:
    """Cells of a number of blocks of ``cells`` along each axis."""
    return blocks * math.prod(cells)


def neighbour_tree(level: Column, lx: Sequence[Column]) -> Column:
    """Which of the 3^d trees around a tree, itself in the middle, holds a block's address: base-3 digits below, inside or beyond, first axis first."""
    beyond = F.call_function("shiftleft", F.lit(1).cast("long"), F.greatest(level, F.lit(0)).cast("int"))
    digits = [F.when(x < 0, 0).when(x >= beyond, 2).otherwise(1) for x in lx]
    return sum((d * 3**k for k, d in enumerate(digits)), F.lit(0)).cast("int")
