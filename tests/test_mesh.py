import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators import ghosts, mesh, ordering, particles, refine, stencils
from tessella.operators.histogram import Edges, Histogram
from tessella.operators.mesh import Location


def test_locations():
    loc = Location(0, 2, (3, 1))
    assert loc.parent() == Location(0, 1, (1, 0)) and loc in loc.parent().daughters()
    assert loc.parent().contains(loc) and not loc.contains(loc.parent())
    assert loc.is_neighbour(Location(0, 1, (2, 0))) and not loc.is_neighbour(Location(0, 1, (3, 0)))
    assert Location(0, 1, (-3, 0)).parent().lx == (-2, 0)


def nested(tree):
    for leaf in tree.leaves:
        for _, nb in tree.neighbours(leaf):
            assert abs(nb.level - leaf.level) <= 1
    area = sum(4.0**-leaf.level for leaf in tree.leaves)
    assert area == pytest.approx(np.prod(tree.roots))


@pytest.mark.parametrize("periodic", [(False, False), (True, True)])
def test_tree_stays_nested(periodic):
    rng = random.Random(7)
    tree = mesh.Tree((3, 2), periodic)
    for _ in range(40):
        tree.refine(rng.choice([x for x in sorted(tree.leaves) if x.level < 4]))
        nested(tree)
    for _ in range(60):
        leaf = rng.choice(sorted(tree.leaves))
        if leaf.level:
            tree.derefine(leaf.parent())
            nested(tree)


def test_refine_then_derefine_is_nothing():
    tree = mesh.Tree((2, 2))
    before = set(tree.leaves)
    loc = Location(0, 0, (0, 1))
    assert tree.refine(loc) == 1 and tree.derefine(loc) and tree.leaves == before


def test_z_order_of_leaves():
    tree = mesh.Tree((2, 2))
    tree.refine(Location(0, 0, (1, 0)))
    assert [(x.level, x.lx) for x in tree.sorted_leaves()] == [(0, (0, 0)), (1, (2, 0)), (1, (3, 0)), (1, (2, 1)), (1, (3, 1)), (0, (0, 1)), (0, (1, 1))]


def test_rank_assignment():
    ranks = mesh.assign_ranks([1.0] * 10, 4)
    assert ranks == sorted(ranks) and set(ranks) == {0, 1, 2, 3}
    assert mesh.assign_ranks([1, 1, 1, 9], 2) == [0, 0, 0, 1]
    with pytest.raises(ValueError):
        mesh.assign_ranks([0.0], 1)


def test_polynomials_are_reconstructed_exactly(spark):
    df = spark.range(20).select(F.col("id").alias("i"), F.lit(0).alias("j"), (2.0 * F.col("id") + 1).alias("q"))
    w = stencils.line(["j"], "i")
    q = stencils.around(F.col("q"), w, 2)
    rows = df.select("i", *(c.alias(f"q{k}") for k, c in enumerate(q))).filter("q0 IS NOT NULL AND q4 IS NOT NULL")
    lo, hi = stencils.weno5z([F.col(f"q{k}") for k in range(5)])
    pl, ph = stencils.piecewise_linear(*(F.col(f"q{k}") for k in (1, 2, 3)))
    for r in rows.select("i", lo.alias("lo"), hi.alias("hi"), pl.alias("pl"), ph.alias("ph")).collect():
        assert r.lo == pytest.approx(2 * r.i) and r.hi == pytest.approx(2 * r.i + 2)
        assert r.pl == pytest.approx(2 * r.i) and r.ph == pytest.approx(2 * r.i + 2)


def test_restriction_conserves(spark):
    grid = spark.range(64).select((F.col("id") % 8).alias("i"), F.floor(F.col("id") / 8).alias("j"), F.sin("id").alias("q"))
    coarse = refine.restrict(grid, [], ["i", "j"], ["q"])
    assert 4 * coarse.agg(F.sum("q")).first()[0] == pytest.approx(grid.agg(F.sum("q")).first()[0])
    fine = refine.prolongate(grid, [], ["i", "j"], "q")
    assert fine.count() == 256 and fine.agg(F.sum("q")).first()[0] == pytest.approx(4 * grid.agg(F.sum("q")).first()[0])


def test_halo_has_the_neighbours_values(spark):
    cells = spark.range(16).select(F.floor(F.col("id") / 4).alias("b"), (F.col("id") % 4).alias("i"), F.col("id").cast("double").alias("q"))
    got = {(r.b, r.i): r.q for r in ghosts.halo(cells, ["b"], ["i"], [4], [4], 1, ["q"]).collect()}
    assert len(got) == 24
    assert all(got[b, -1] == (4 * b - 1) % 16 and got[b, 4] == (4 * b + 4) % 16 for b in range(4))


def test_histogram_against_numpy(spark):
    rng = np.random.default_rng(3)
    x, y, v = rng.uniform(-1, 2, 500), rng.uniform(0, 1, 500), rng.uniform(0, 1, 500)
    x[:3] = [0.0, 1.0, np.nan]
    df = spark.createDataFrame([(float(a), float(b), float(c)) for a, b, c in zip(x, y, v, strict=True)], "x double, y double, v double")
    h = Histogram(F.col("x"), Edges.lin(0.0, 1.0, 4), F.col("y"), Edges.of(0.0, 0.3, 1.0), F.col("v"))
    ok = ~np.isnan(x)
    want, _, _ = np.histogram2d(y[ok], x[ok], bins=[[0, 0.3, 1.0], np.linspace(0, 1, 5)], weights=v[ok])
    for r in h.compute(df).collect():
        assert r.value == pytest.approx(want[r.ybin, r.xbin])


def test_empty_tables_give_complete_grids(spark):
    empty = spark.createDataFrame([], "x double")
    assert [r.value for r in Histogram(F.col("x"), Edges.of(0, 1, 2)).compute(empty).collect()] == [0.0, 0.0]
    with pytest.raises(ValueError):
        Edges.of(1.0, 0.0)


def test_alias_table_keeps_the_weights():
    weights = [5.0, 1.0, 3.0, 0.5, 2.5]
    table = ordering.alias_table(weights)
    mass = [0.0] * len(weights)
    for i, (p, a) in enumerate(table):
        mass[i] += p / len(weights)
        mass[a] += (1 - p) / len(weights)
    assert mass == pytest.approx([w / sum(weights) for w in weights])


def test_particles(spark):
    tree = mesh.Tree((2, 2))
    tree.refine(Location(0, 0, (0, 0)))
    blocks = tree.frame(spark, (0.0, 0.0), (1.0, 1.0))
    swarm = particles.create(blocks, F.lit(20))
    assert swarm.count() == 20 * 7 and particles.validate(swarm, ("x", 0.0, 1.0), ("y", 0.0, 1.0)) == 0
    found = particles.locate(swarm.withColumnRenamed("gid", "made"), blocks, ["x", "y"], (2, 2), (0.0, 0.0), (1.0, 1.0), [0, 1])
    assert found.filter("gid <> made").count() == 0 and found.count() == 140
    with pytest.raises(ValueError):
        particles.add_attribute(swarm, "x", F.lit(0.0))
    with pytest.raises(ValueError):
        particles.remove_attribute(swarm, "weight")


def test_periodic_wraps_once_or_from_any_distance(spark):
    rows = spark.createDataFrame([(-1.25,), (-0.25,), (0.0,), (0.75,), (1.0,), (2.5,), (None,)], "x double")
    got = rows.select(particles.periodic(F.col("x"), 0.0, 1.0, once=True), particles.periodic(F.col("x"), 0.0, 1.0)).collect()
    assert [r[0] for r in got] == [-0.25, 0.75, 0.0, 0.75, 0.0, 1.5, None]
    assert [r[1] for r in got] == [0.75, 0.75, 0.0, 0.75, 0.0, 0.5, None]


def test_neighbours_of_the_frame_are_the_trees(spark):
    tree = mesh.Tree((3, 3))
    tree.refine(Location(0, 0, (1, 1)))
    blocks = tree.frame(spark, (0.0, 0.0), (1.0, 1.0))
    ids = {leaf: gid for gid, leaf in enumerate(tree.sorted_leaves())}
    want = {(ids[a], ids[b]) for a in tree.leaves for _, b in tree.neighbours(a)}
    got = {(r.gid, r.nb_gid) for r in mesh.neighbour_blocks(blocks, ["lx1", "lx2"]).collect()}
    touching = {(ids[a], ids[b]) for a, b in itertools.permutations(tree.leaves, 2) if a.is_neighbour(b)}
    assert got == want == touching


def test_order_of_candidates(spark):
    from tessella.operators import refine

    rows = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 3)], "gid int, level int")
    assert [r.gid for r in refine.derefinement_order(rows, "level", "gid").collect()] == [2, 4, 1, 3]
