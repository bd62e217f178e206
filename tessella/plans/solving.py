"""Queries on solvers, snapshots' diffs, logs and cadences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions import catalog
from tessella.operators import integrators, mesh, solvers
from tessella.operators.elements import difference, face_coefficients, measure, position, variable_mat_vec
from tessella.operators.refine import running_cost
from tessella.plans.meshes import GRID, NX, grid
from tessella.plans.registry import register, table
from tessella.sources import snapshots
from tessella.streaming.cadence import cadence

#: The whole grid as the right-hand side of a Poisson problem.
SQUARE = f"{GRID}, sq AS (SELECT i, j, q / 100 AS b FROM grid)"


def right_hand_side(spark, sf_dir) -> DataFrame:
    return grid(spark, sf_dir).select("i", "j", (F.col("q") / 100).alias("b"))


def _jacobi_sql(steps: int, omega: float) -> str:
    around = " + ".join(f"coalesce({f}(x) OVER {w}, 0)" for f in ("lag", "lead") for w in ("h", "v"))
    ctes = [f"x0 AS (SELECT i, j, b, 0::DOUBLE AS x FROM sq)"]
    for k in range(steps):
        ctes.append(f"x{k + 1} AS (SELECT i, j, b, {1 - omega} * x + {omega} * ((b - ({around} - 4 * x) - 4 * x) / -4) AS x FROM x{k} WINDOW h AS (PARTITION BY j ORDER BY i), v AS (PARTITION BY i ORDER BY j))")
    return f"WITH {SQUARE}, {', '.join(ctes)} SELECT i, j, round(x, 8) AS x FROM x{steps}"


@register("poisson_jacobi", _jacobi_sql(4, 0.75))
def poisson_jacobi(spark, sf_dir):
    out = solvers.jacobi(right_hand_side(spark, sf_dir), ["i", "j"], "b", solvers.poisson(1.0), [0.75] * 4)
    return out.select("i", "j", F.round("x", 8).alias("x"))


@register("poisson_bicgstab")
def poisson_bicgstab(spark, sf_dir):
    """Solved to the tolerance, or an error; each cell with the iterations made and the root mean square of the residual."""
    state, steps, rms = solvers.bicgstab(right_hand_side(spark, sf_dir), ["i", "j"], "b", solvers.poisson(1.0), tolerance=1e-3)
    if not rms < 1e-3:
        raise RuntimeError(f"residual of {rms} after {steps} iterations")
    return state.select("i", "j", "x", F.lit(steps).alias("iterations"), F.lit(rms).alias("residual"))


@register("poisson_v_cycle")
def poisson_v_cycle(spark, sf_dir):
    return solvers.v_cycle(right_hand_side(spark, sf_dir), ["i", "j"], "b", 1.0, NX, stages=1, coarsest=25).select("i", "j", "x")


def _decay_sql() -> str:
    # u' = -k u over one step of rk3: a polynomial in k dt
    return "SELECT p_partkey, round(p_retailprice * (1 - z + z * z / 2 - z * z * z / 6), 9) AS u FROM (SELECT *, 0.01 * p_size AS z FROM (SELECT p_partkey, p_retailprice, p_size::DOUBLE AS p_size FROM part))"


@register("rk3_decay", _decay_sql())
def rk3_decay(spark, sf_dir):
    scheme, dt = integrators.LOW_STORAGE["rk3"], 0.01
    u0, u1, k = F.col("p_retailprice"), F.lit(0.0), F.col("p_size")
    for n in range(scheme.stages):
        slope = -k * u0
        u1 = u1 + scheme.delta[n] * u0
        u0 = scheme.gam0[n] * u0 + scheme.gam1[n] * u1 + scheme.beta[n] * dt * slope
    return table(spark, sf_dir, "part").select("p_partkey", F.round(u0, 9).alias("u"))


_A = "SELECT event_id AS k, value AS v, user_id::DOUBLE AS u FROM events WHERE event_type <> 'error'"
_B = "SELECT event_id AS k, value + CASE WHEN user_id < 20 THEN 0.5 ELSE 0 END AS v, user_id::DOUBLE AS u FROM events WHERE event_type <> 'view'"


@register("snapshot_diff", f"""WITH a AS ({_A}), b AS ({_B}), j AS (SELECT a.k AS ka, b.k AS kb, abs(a.v - b.v) AS dv, abs(a.u - b.u) AS du FROM a FULL JOIN b ON a.k = b.k)
SELECT 'v' AS "column", sum((ka IS NULL OR kb IS NULL)::INT)::BIGINT AS missing, round(max(dv), 8) AS worst, sum((dv > 1e-6)::INT)::BIGINT AS over FROM j
UNION ALL SELECT 'u', sum((ka IS NULL OR kb IS NULL)::INT)::BIGINT, round(max(du), 8), sum((du > 1e-6)::INT)::BIGINT FROM j""")
def snapshot_diff(spark, sf_dir):
    events, kind, user = table(spark, sf_dir, "events"), F.col("event_type"), F.col("user_id")
    a = events.filter(kind != "error").select(F.col("event_id").alias("k"), F.col("value").alias("v"), user.alias("u"))
    b = events.filter(kind != "view").select(F.col("event_id").alias("k"), (F.col("value") + F.when(user < 20, 0.5).otherwise(0.0)).alias("v"), user.alias("u"))
    return snapshots.diff(a, b, ["k"], ["v", "u"], 1e-6).withColumn("worst", F.round("worst", 8))


@register("snapshot_nearest", """WITH a AS (SELECT event_id AS k, event_type = 'click' AS own, (event_id * 7919 % 10007) / 10007.0::DOUBLE AS x, (event_id * 104729 % 10009) / 10009.0::DOUBLE AS y FROM events),
p AS (SELECT a.k, b.k AS m, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS d FROM a JOIN a b ON a.own AND NOT b.own AND abs(a.x - b.x) <= 0.01 AND abs(a.y - b.y) <= 0.01),
r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY d, m) AS r FROM p) SELECT a.k, m, round(d, 10) AS distance2 FROM a LEFT JOIN (SELECT * FROM r WHERE r = 1) r ON r.k = a.k WHERE a.own""")
def snapshot_nearest(spark, sf_dir):
    e, own = F.col("event_id"), F.col("event_type") == "click"
    points = table(spark, sf_dir, "events").select(e.alias("k"), own.alias("own"), (e * 7919 % 10007 / 10007.0).alias("x"), (e * 104729 % 10009 / 10009.0).alias("y"))
    out = snapshots.nearest(points.filter("own"), "k", points.filter("NOT own").withColumnRenamed("k", "m"), "m", ["x", "y"], 0.01)
    return out.withColumn("distance2", F.round("distance2", 10))


@register("latest_record", "SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC) AS r FROM events) WHERE r = 1")
def latest_record(spark, sf_dir):
    return snapshots.latest(table(spark, sf_dir, "events"), ["user_id", "event_type"], "ts").select("user_id", "event_type", "event_id", "value")


@register("kernel_times", """WITH s AS (SELECT event_type AS region, sum(value) AS t, sum(user_id)::BIGINT AS calls FROM events GROUP BY 1)
SELECT region, round(t, 2) AS time, calls, round(t / sum(t) OVER (), 8) AS share, round(t / calls, 8) AS per_call FROM s""")
def kernel_times(spark, sf_dir):
    out = snapshots.kernel_times(table(spark, sf_dir, "events"), "event_type", "value", "user_id")
    return out.select("region", F.round("time", 2).alias("time"), "calls", F.round("share", 8).alias("share"), F.round("per_call", 8).alias("per_call"))


@register("cadence_windows", "SELECT epoch(time_bucket(INTERVAL '6 hours', ts))::BIGINT AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def cadence_windows(spark, sf_dir):
    out = cadence(table(spark, sf_dir, "events"), "ts", "6 hours", F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"), by=("event_type",))
    return out.select(F.unix_timestamp("start").alias("start"), "event_type", "n", "total")


@register("analytic_error", f"WITH {GRID} SELECT j % 10 AS part, round(sqrt(sum(pow(abs(q - (250 + i)), 2))), 4) AS error FROM grid GROUP BY 1")
def analytic_error(spark, sf_dir):
    cells = grid(spark, sf_dir).withColumn("part", F.col("j") % 10)
    return snapshots.analytic_error(cells, "q", 250 + F.col("i"), 2.0, ["part"]).withColumn("error", F.round("error", 4))


@register("subsample", f"WITH {GRID} SELECT i, j, q FROM grid WHERE i % 4 = 0 AND j % 4 = 0")
def subsample(spark, sf_dir):
    return grid(spark, sf_dir).filter("i % 4 = 0 AND j % 4 = 0")




@register("variable_poisson", f"""WITH {GRID}, f AS (SELECT i, j, q / 250 AS d, lead(q / 250) OVER (PARTITION BY j ORDER BY i) AS dn, q, lag(q) OVER (PARTITION BY j ORDER BY i) AS ql, lead(q) OVER (PARTITION BY j ORDER BY i) AS qr FROM grid)
SELECT i, j, round((d + coalesce(dn, 0)) * q - d * coalesce(ql, 0) - coalesce(dn * qr, 0), 6) AS ax  FROM f""")
def variable_poisson(spark, sf_dir):
    cells = grid(spark, sf_dir)
    faces = cells.select("i", "j", (F.col("q") / 250).alias("d"))
    ax = variable_mat_vec(cells, face_coefficients(faces, "i", ["i", "j"], "d", 1.0), ["i", "j"], "q", "ax")
    return ax.select("i", "j", F.round("ax", 6).alias("ax"))


@register("face_divergence", f"""WITH {GRID}, d AS (SELECT i, j, (lead(q) OVER (PARTITION BY j ORDER BY i) - q) / 0.1 + (lead(q) OVER (PARTITION BY i ORDER BY j) - q) / 0.2 AS div FROM grid)
SELECT i, j, round(div, 6) AS div FROM d WHERE div IS NOT NULL""")
def face_divergence(spark, sf_dir):
    cells = grid(spark, sf_dir)
    parts = [difference(cells, [o], a, "q", 1 / d, "div").select("i", "j", "div") for a, o, d in (("i", "j", 0.1), ("j", "i", 0.2))]
    both = parts[0].unionByName(parts[1]).groupBy("i", "j").agg(F.sum("div").alias("div"), F.count("*").alias("n")).filter("n = 2")
    return both.select("i", "j", F.round("div", 6).alias("div"))


@register("element_positions", f"WITH {GRID} SELECT i, j, round(-1 + i * 0.02::DOUBLE, 8) AS f1, round(-1 + (i + 0.5) * 0.02::DOUBLE, 8) AS e1, round(0.02::DOUBLE * 0.05, 8) AS area FROM grid")
def element_positions(spark, sf_dir):
    i = F.col("i")
    return grid(spark, sf_dir).select("i", "j", F.round(position("F1", 1, i, -1.0, 0.02), 8).alias("f1"), F.round(position("E1", 1, i, -1.0, 0.02), 8).alias("e1"), F.round(measure("F1", (F.lit(3.0), F.lit(0.02), F.lit(0.05))), 8).alias("area"))


@register("merged_particles", "SELECT event_type, count(*) AS n FROM (SELECT * FROM events WHERE user_id < 75 UNION ALL SELECT * FROM events WHERE user_id >= 75) GROUP BY 1")
def merged_particles(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return events.filter("user_id < 75").unionByName(events.filter("user_id >= 75")).groupBy("event_type").agg(F.count("*").alias("n"))


@register("newly_refined", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 10)")
def newly_refined(spark, sf_dir):
    seen = table(spark, sf_dir, "lineitem").filter("l_quantity > 10").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf_dir, "orders").select("o_orderkey").join(seen, "o_orderkey", "left_anti")


@register("masked_blocks", "SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_discount > 0.095)")
def masked_blocks(spark, sf_dir):
    mask = table(spark, sf_dir, "lineitem").filter("l_discount > 0.095").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf_dir, "orders").select("o_orderkey").join(mask, "o_orderkey", "left_semi")


@register("static_region", "SELECT p_partkey, r FROM part JOIN (VALUES (0, 1, 10), (1, 8, 30), (2, 45, 50)) t(r, lo, hi) ON p_size BETWEEN lo AND hi")
def static_region(spark, sf_dir):
    # a handful of regions
    regions = spark.createDataFrame([(0, 1, 10), (1, 8, 30), (2, 45, 50)], "r int, lo int, hi int")
    return table(spark, sf_dir, "part").join(F.broadcast(regions), F.col("p_size").between(F.col("lo"), F.col("hi"))).select("p_partkey", "r")


@register("running_costs", "SELECT p_partkey, round(p_retailprice * 9 / 10.0 + p_size / 10.0, 8) AS cost FROM part")
def running_costs(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.round(running_cost(F.col("p_retailprice"), F.col("p_size"), 10), 8).alias("cost"))


@register("uid_intersection", "SELECT l_partkey AS uid FROM lineitem WHERE l_quantity > 40 INTERSECT SELECT l_partkey FROM lineitem WHERE l_discount > 0.05")
def uid_intersection(spark, sf_dir):
    lines, uid = table(spark, sf_dir, "lineitem"), F.col("l_partkey").alias("uid")
    return catalog.uid_intersection(lines.filter("l_quantity > 40").select(uid), lines.filter("l_discount > 0.05").select(uid), "uid")


@register("total_cells", "SELECT o_orderpriority, count(*) * 16 * 16 * 8 AS cells FROM orders GROUP BY 1")
def total_cells(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(mesh.total_cells(F.count("*"), (16, 16, 8)).alias("cells"))


_DIGIT = "CASE WHEN {x} < 0 THEN 0 WHEN {x} >= (1 << (p_size % 5)::INT) THEN 2 ELSE 1 END"


@register("neighbour_tree", f"""WITH p AS (SELECT p_partkey, p_size, p_partkey % 24 - 4 AS x, p_partkey // 24 % 24 - 4 AS y, p_partkey // 576 % 24 - 4 AS z FROM part)
SELECT p_partkey, ({' + '.join(f'{3**k} * ({_DIGIT.format(x=x)})' for k, x in enumerate('xyz'))})::INT AS tree FROM p""")
def neighbour_tree(spark, sf_dir):
    k = F.col("p_partkey")
    at = [k % 24 - 4, F.floor(k / 24) % 24 - 4, F.floor(k / 576) % 24 - 4]
    return table(spark, sf_dir, "part").select("p_partkey", mesh.neighbour_tree(F.col("p_size") % 5, at).alias("tree"))
