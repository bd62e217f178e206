import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators import elements


def test_elements():
    assert elements.is_boundary_of("F1", "CC") and elements.is_boundary_of("NN", "E2") and not elements.is_boundary_of("F1", "F2")
    assert elements.measure("F2", (2.0, 3.0, 5.0)) == 10.0 and elements.measure("E3", (2.0, 3.0, 5.0)) == 5.0 and elements.measure("NN", (2.0, 3.0, 5.0)) == 1.0


def test_divergence_of_curl_is_zero(spark):
    n = 3
    rng = np.random.default_rng(0)
    rows = []
    for e in range(3):
        size = [n if a == e else n + 1 for a in range(3)]
        rows += [(f"E{e + 1}", i, j, k, float(rng.normal())) for i in range(size[0]) for j in range(size[1]) for k in range(size[2])]
    edges = spark.createDataFrame(rows, "te string, i long, j long, k long, value double")
    dx = (0.5, 1.0, 2.0)
    faces = elements.circulation(edges, dx)
    assert faces.count() == 3 * n * n * (n + 1)
    cells = elements.divergence(faces, dx)
    assert cells.count() == n**3 and cells.agg(F.max(F.abs("value"))).first()[0] < 1e-12


@pytest.mark.parametrize("dx", [(1.0, 1.0, 1.0), (0.5, 1.0, 2.0)])
def test_prolongation_makes_no_divergence(spark, dx):
    rng = np.random.default_rng(4)
    rows = []
    for c in range(5):
        b = [rng.normal(size=s) for s in ((3, 2, 2), (2, 3, 2), (2, 2, 3))]
        area = [dx[1] * dx[2], dx[0] * dx[2], dx[0] * dx[1]]
        total = sum(a * (x.take(2, axis=n).sum() - x.take(0, axis=n).sum()) for n, (x, a) in enumerate(zip(b, area, strict=True)))
        b[0][2] -= total / area[0] / 4
        rows.append((c, *(x.ravel().tolist() for x in b)))
    df = spark.createDataFrame(rows, "c long, b1 array<double>, b2 array<double>, b3 array<double>")
    for r in elements.divergence_free_inside(df, "c", dx).collect():
        b1, b2, b3 = (np.array(r[f"b{a + 1}"]).reshape(s) for a, s in enumerate(((3, 2, 2), (2, 3, 2), (2, 2, 3))))
        div = np.diff(b1, axis=0) / dx[0] + np.diff(b2, axis=1) / dx[1] + np.diff(b3, axis=2) / dx[2]
        assert np.abs(div).max() < 1e-12
        assert np.array_equal(b1[[0, 2]].ravel(), np.array(rows[r.c][1]).reshape(3, 2, 2)[[0, 2]].ravel())


def test_variable_coefficients(spark):
    n, dx = 6, 0.5
    rng = np.random.default_rng(5)
    d, x = rng.uniform(1, 2, n + 1), rng.normal(size=n)
    faces = spark.createDataFrame([(i, float(v)) for i, v in enumerate(d)], "i long, d double")
    cells = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "i long, x double")
    out = elements.variable_mat_vec(cells, elements.face_coefficients(faces, "i", ["i"], "d", dx), ["i"], "x", "ax")
    padded = np.concatenate([[0], x, [0]])
    want = -np.diff(d * np.diff(padded)) / dx**2
    assert np.allclose([r.ax for r in out.orderBy("i").collect()], want)
