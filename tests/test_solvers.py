import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators import solvers
from tessella.operators.integrators import BUTCHER, LARGE, LOW_STORAGE, StepControl, stage_names
from tessella.operators.tasks import Dependency, Status, TaskList


@pytest.mark.parametrize(("scheme", "order"), [(LOW_STORAGE[n], o) for n, o in (("rk1", 1), ("rk2", 2), ("vl2", 2), ("rk3", 3), ("rk4", 4))] + [(BUTCHER[n], o) for n, o in (("rk1", 1), ("rk2", 2), ("rk4", 4))])
def test_order_of_integrators(scheme, order):
    def error(n):
        u, dt = 1.0, 1.0 / n
        for k in range(n):
            u = scheme.step(u, k * dt, dt, lambda t, y: -y + math.sin(t))
        return abs(u - (1.5 * math.exp(-1) + 0.5 * (math.sin(1) - math.cos(1))))

    assert math.log2(error(16) / error(32)) > order - 0.2


def test_tenth_order():
    def error(n):
        u = 1.0
        for k in range(n):
            u = BUTCHER["rk10"].step(u, k / n, 1.0 / n, lambda t, y: -y)
        return abs(u - math.exp(-1))

    assert math.log2(error(2) / error(4)) > 10


def test_stage_names_and_step_control():
    assert stage_names(3) == ["base", "1", "2", "base"]
    c = StepControl(tlim=1.0, dt_ceil=0.4)
    assert c.next(0.0, 1, 0.1, [0.5]) == pytest.approx(0.2)
    assert c.next(0.0, 1, 0.3, [0.5]) == pytest.approx(0.4)
    assert c.next(0.9, 1, 0.3, [0.5]) == pytest.approx(0.1)
    assert StepControl(dt_force=0.7).next(0.0, 3, 0.1, [0.01]) == 0.7
    assert StepControl(dt_init=0.05).next(0.0, 0, LARGE, [0.5]) == 0.05
    with pytest.raises(RuntimeError):
        StepControl(dt_min=0.1).next(0.0, 1, 0.01, [0.02])


def test_task_graph():
    seen, tries, rounds = [], [], []
    tl = TaskList()
    a = tl.add(Dependency(), lambda: seen.append("a"))
    b = tl.add(a, lambda: (tries.append(1), Status.INCOMPLETE if len(tries) < 3 else Status.COMPLETE)[1])
    inner, done = tl.sublist(a | b, 1, 5)
    inner.add(Dependency(), lambda: (rounds.append(1), Status.ITERATE if len(rounds) < 4 else Status.COMPLETE)[1])
    tl.add(done, lambda: seen.append("end"))
    tl.execute()
    assert seen == ["a", "end"] and len(tries) == 3 and len(rounds) == 4
    with pytest.raises(ValueError):
        tl.add(Dependency(frozenset({99})), lambda: None)


def system(n):
    a = np.zeros((n * n, n * n))
    for i in range(n):
        for j in range(n):
            for (di, dj), w in solvers.poisson(1.0):
                if 0 <= i + di < n and 0 <= j + dj < n:
                    a[i * n + j, (i + di) * n + j + dj] = w
    return a


def test_bicgstab_and_multigrid(spark):
    n = 8
    b = np.sin(np.arange(n * n, dtype=float))
    grid = spark.createDataFrame([(k // n, k % n, float(v)) for k, v in enumerate(b)], "i long, j long, b double")
    want = np.linalg.solve(system(n), b)
    state, _, rms = solvers.bicgstab(grid, ["i", "j"], "b", solvers.poisson(1.0), tolerance=1e-6, most=40)
    got = {(r.i, r.j): r.x for r in state.select("i", "j", "x").collect()}
    assert rms < 1e-6
    assert np.allclose([got[k // n, k % n] for k in range(n * n)], want, atol=1e-4)
    size = lambda df: df.agg(F.sqrt(F.avg(F.col("r") * F.col("r")))).first()[0]
    one = solvers.v_cycle(grid, ["i", "j"], "b", 1.0, n, stages=2)
    first = size(solvers.residual(one, ["i", "j"], "b", solvers.poisson(1.0)))
    assert first < 0.35 * np.sqrt(np.mean(b**2))


def test_poisson_query_is_solved(spark):
    from tessella.plans import registry, solving

    sf = "/root/testdata/sf0.001"
    cells = {(r.i, r.j): float(r.b) for r in solving.right_hand_side(spark, sf).collect()}
    at = {c: k for k, c in enumerate(cells)}
    a = np.zeros((len(at), len(at)))
    for (i, j), k in at.items():
        for (di, dj), w in solvers.poisson(1.0):
            if (i + di, j + dj) in at:
                a[k, at[i + di, j + dj]] = w
    want = np.linalg.solve(a, np.array(list(cells.values())))
    rows = registry.queries()["poisson_bicgstab"](spark, sf).collect()
    x = np.zeros(len(at))
    for r in rows:
        x[at[r.i, r.j]] = r.x
    assert len(rows) == len(at) and all(r.residual < 1e-3 for r in rows)
    assert np.sqrt(np.mean((a @ x - np.array(list(cells.values()))) ** 2)) < 2e-3
    assert np.allclose(x, want, atol=1e-4 * np.abs(want).max())
