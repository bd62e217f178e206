import json
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.sources import snapshots
from tessella.sources.deck import Deck, Schedule

DECK = """
# a comment
<mesh>
nx1 = 64      # cells
x1min = -0.5
names = a, &
        b
flag = true
<problem/output1>
dt = 0.25
next_time = 1.0
<par_end>
<ignored>
x = 1
"""


def test_deck():
    d = Deck.parse(DECK)
    assert d.integer("mesh", "nx1") == 64 and d.real("mesh", "x1min") == -0.5 and d.boolean("mesh", "flag") is True
    assert d.vector("mesh", "names") == ["a", "b"] and "ignored" not in d.blocks
    assert d.string("mesh", "system", "cartesian") == "cartesian" and d.has("mesh", "system")
    assert d.override(["mesh/nx1=32", "mesh/new=1"]) == ["mesh/new was not in the deck"] and d.integer("mesh", "nx1") == 32
    assert Deck.parse(d.dump()).blocks == d.blocks and Deck.parse(d.dump()).digest() == d.digest()
    d.roll_next_times(0.1, -1)
    assert d.real("problem/output1", "next_time") == pytest.approx(0.25)
    d.roll_next_times(0.6, 1)
    assert d.real("problem/output1", "next_time") == pytest.approx(0.75)
    with pytest.raises(KeyError):
        d.integer("mesh", "absent")
    with pytest.raises(ValueError):
        d.string("mesh", "system", allowed=["polar"])
    with pytest.raises(KeyError):
        d.require("mesh", "nx1", "nx9")
    with pytest.raises(ValueError):
        Deck.parse("a = 1")


def test_schedule():
    s = Schedule(0.5)
    assert s.due(0.0, 2.0)
    s.wrote(0.0)
    assert not s.due(0.3, 2.0) and s.due(0.3, 2.0, "now") and s.due(0.5, 2.0) and s.due(2.0, 2.0)
    s.wrote(1.2)
    assert s.next_time == 1.5
    assert not Schedule(-1.0).due(0.0, 1.0)


def frames(spark):
    blocks = spark.createDataFrame([(0, 0, 0.0, 1.0), (1, 1, 1.0, 2.0)], "gid long, level int, x1min double, x1max double")
    cells = spark.createDataFrame([(g, g, i, g + 0.1 * i, None if i else 1.0) for g in (0, 1) for i in range(4)], "gid long, level int, i int, q double, s double")
    return cells, blocks


def test_snapshot_round_trip(spark, tmp_path):
    cells, blocks = frames(spark)
    swarm = spark.createDataFrame([(0, 0.1, 0.2), (1, 1.5, 0.5)], "gid long, x double, y double")
    info = {"time": 0.5, "WallTime": 3}
    snapshots.write_snapshot(f"{tmp_path}/a", cells, blocks, info, {"cfl": 0.4}, {"tracers": swarm}, nan_for_missing=["s"])
    snapshots.write_snapshot(f"{tmp_path}/b", cells.withColumn("q", F.col("q") + 1e-3), blocks, {**info, "WallTime": 9})
    a, b = snapshots.Snapshot(spark, f"{tmp_path}/a"), snapshots.Snapshot(spark, f"{tmp_path}/b")
    assert a.info["time"] == 0.5 and a.params == {"cfl": 0.4} and a.swarms == ["tracers"]
    assert a.swarm("tracers", 1).count() == 1 and "z" in a.swarm("tracers").columns
    assert a.located([4], "q").filter("gid = 1 AND i = 0").first().x1 == pytest.approx(1.125)
    keys = ["gid", "level", "i"]
    assert snapshots.compare(a, a, keys, ["q", "s"]) == snapshots.SAME
    assert snapshots.compare(a, b, keys, ["q"]) == snapshots.DATA_DIFFERS
    assert snapshots.compare(a, b, keys, ["q"], tolerance=1e-2) == snapshots.SAME
    b.info["time"] = 0.6
    assert snapshots.compare(a, b, keys, ["q"]) == snapshots.METADATA_DIFFERS
    single = f"{tmp_path}/single"
    snapshots.write_snapshot(single, cells, blocks, info, variables=["q"], single=True)
    assert dict(snapshots.Snapshot(spark, single).cells().dtypes)["q"] == "float"


def test_diff_of_missing_rows_and_nulls(spark):
    a = spark.createDataFrame([(1, 1.0), (2, None), (3, 3.0)], "k long, v double")
    b = spark.createDataFrame([(1, 1.5), (2, 2.0), (4, 3.0)], "k long, v double")
    r = snapshots.diff(a, b, ["k"], ["v"]).first()
    assert (r.missing, r.worst, r.over) == (2, float("inf"), 2)


def test_nearest_of_crowds(spark):
    """Two crowds in one cell of the tolerance's size: 4 * 10^8 pairs, if all were formed; far, lone and odd rows beside them."""
    rng = np.random.default_rng(5)
    a, b = rng.uniform(0.001, 0.009, (20000, 2)), np.concatenate([rng.uniform(0.004, 0.006, (19000, 2)), np.repeat([[0.002, 0.002]], 1000, 0)])
    a = np.concatenate([a, [[0.014, 0.0141], [0.5, 0.5], [0.019, 0.005], [9.0, 9.0], [1e300, 0.0], [np.nan, 0.0], [np.inf, 0.0]]])
    b = np.concatenate([b, [[0.507, 0.507], [0.509, 0.5], [np.nan, 0.0], [np.inf, 0.0]]])
    points = spark.createDataFrame([(k, *map(float, r)) for k, r in enumerate(a)] + [(len(a), None, 0.0)], "k long, x double, y double")
    others = spark.createDataFrame([(k, *map(float, r)) for k, r in enumerate(b)], "m long, x double, y double")
    stop = threading.Timer(90, spark.sparkContext.cancelAllJobs)
    stop.start()
    try:
        got = {r.k: (r.m, r.distance2) for r in snapshots.nearest(points, "k", others, "m", ["x", "y"], 0.01).collect()}
    finally:
        stop.cancel()
    assert len(got) == len(a) + 1 and got[len(a)] == (None, None)
    for k in [*range(0, 20000, 40), *range(20000, len(a))]:
        dx, dy = a[k, 0] - b[:, 0], a[k, 1] - b[:, 1]
        near = np.flatnonzero((np.abs(dx) <= 0.01) & (np.abs(dy) <= 0.01))
        d = dx * dx + dy * dy
        assert got[k] == ((int(m := near[np.argmin(d[near])]), d[m]) if len(near) else (None, None))


def test_history_text(spark, tmp_path):
    rows = spark.createDataFrame([(0.0, 1.25, 2.0), (0.5, 1.5, 2.5)], "time double, total double, hi double")
    text = tmp_path / "out.hst"
    text.write_text("\n".join(snapshots.history_lines(rows, ["time", "total", "hi"])))
    back = snapshots.read_history(spark, str(text))
    assert back.columns == ["time", "total", "hi"] and back.count() == 2
    assert snapshots.history_diff(rows, back, "time", ["total", "hi"], 1e-4).count() == 0
    assert snapshots.history_diff(rows, back.withColumn("hi", F.col("hi") * 2), "time", ["hi"], 1e-4).count() == 2
    snapshots.append_history(rows, f"{tmp_path}/h")
    snapshots.append_history(rows, f"{tmp_path}/h")
    assert spark.read.option("header", True).csv(f"{tmp_path}/h").count() == 4


def test_metadata_diff_and_xdmf():
    d = snapshots.metadata_diff({"a": 1, "b": 2, "WallTime": 1}, {"b": 3, "c": 1, "WallTime": 2})
    assert d == {"only_a": ["a"], "only_b": ["c"], "differ": ["b"]}
    assert json.dumps(snapshots.xdmf("m", 2, (4, 4, 1), ["q"], "f")).count("Attribute Name") == 2
