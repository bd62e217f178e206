"""Queries on reductions, histograms, order and search, scalars and selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.functions import catalog as cat
from tessella.functions import scalars as sc
from tessella.operators import kernels, ordering, reductions
from tessella.operators.histogram import Edges, Histogram, counts
from tessella.plans.registry import register, table

# ---- histograms ---------------------------------------------------------------------------------------------------


def _list_bin(edges: list[float], v: str, clamp: bool = False) -> str:
    """SQL of a list bin, as a CASE."""
    lo, hi = edges[0], edges[-1]
    outside = ("0", str(len(edges) - 2)) if clamp else ("NULL", "NULL")
    steps = " ".join(f"WHEN {v} < {e} THEN {i}" for i, e in enumerate(edges[1:]))
    return f"CASE WHEN {v} IS NULL OR isnan({v}) THEN NULL WHEN {v} < {lo} THEN {outside[0]} WHEN {v} > {hi} THEN {outside[1]} {steps} ELSE {len(edges) - 2} END"


Q_EDGES, D_EDGES = [1.0, 10.0, 25.0, 40.0, 50.0], [0.0, 0.025, 0.05, 0.075, 0.1]


@register("histogram_2d", f"""
WITH b AS (SELECT {_list_bin(Q_EDGES, 'l_quantity')} AS xbin, {_list_bin(D_EDGES, 'l_discount')} AS ybin, l_extendedprice AS v FROM lineitem),
g AS (SELECT x.i AS xbin, y.i AS ybin FROM range(4) x(i), range(4) y(i))
SELECT g.ybin::INT AS ybin, g.xbin::INT AS xbin, round(coalesce(sum(v), 0), 2) AS value FROM g LEFT JOIN b ON b.xbin = g.xbin AND b.ybin = g.ybin GROUP BY 1, 2
""")
def histogram_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = Histogram(F.col("l_quantity"), Edges.of(*Q_EDGES), F.col("l_discount"), Edges.of(*D_EDGES), F.col("l_extendedprice"))
    return h.compute(table(spark, sf_dir, "lineitem")).select("ybin", "xbin", F.round("value", 2).alias("value"))


@register("histogram_list_weighted", f"""
WITH b AS (SELECT {_list_bin(Q_EDGES, 'l_quantity')} AS xbin, l_extendedprice * (1 - l_discount) AS v FROM lineitem), g AS (SELECT i AS xbin FROM range(4) t(i))
SELECT g.xbin::INT AS xbin, round(coalesce(sum(v), 0), 2) AS value FROM g LEFT JOIN b USING (xbin) GROUP BY 1
""")
def histogram_list_weighted(spark, sf_dir):
    h = Histogram(F.col("l_quantity"), Edges.of(*Q_EDGES), value=F.col("l_extendedprice"), weights=[1 - F.col("l_discount")])
    return h.compute(table(spark, sf_dir, "lineitem")).select("xbin", F.round("value", 2).alias("value"))


@register("histogram_lin_count", """
WITH b AS (SELECT CASE WHEN l_discount = 0.1 THEN 3 WHEN l_discount BETWEEN 0 AND 0.1 THEN floor(l_discount / (0.1 / 4))::INT END AS xbin FROM lineitem), g AS (SELECT i AS xbin FROM range(4) t(i))
SELECT g.xbin::INT AS xbin, count(b.xbin)::DOUBLE AS value FROM g LEFT JOIN b USING (xbin) GROUP BY 1
""")
def histogram_lin_count(spark, sf_dir):
    return Histogram(F.col("l_discount"), Edges.lin(0.0, 0.1, 4)).compute(table(spark, sf_dir, "lineitem")).select("xbin", "value")


@register("histogram_log_count", """
WITH b AS (SELECT CASE WHEN o_totalprice = 1e6 THEN 9 WHEN o_totalprice BETWEEN 100 AND 1e6 THEN floor((log10(o_totalprice) - 2) / 0.4)::INT END AS xbin FROM orders), g AS (SELECT i AS xbin FROM range(10) t(i))
SELECT g.xbin::INT AS xbin, count(b.xbin)::DOUBLE AS value FROM g LEFT JOIN b USING (xbin) GROUP BY 1
""")
def histogram_log_count(spark, sf_dir):
    return Histogram(F.col("o_totalprice"), Edges.log(100.0, 1e6, 10)).compute(table(spark, sf_dir, "orders")).select("xbin", "value")


A_EDGES = [0.0, 1000.0, 4000.0, 6000.0]


@register("histogram_accumulate", f"""
WITH b AS (SELECT {_list_bin(A_EDGES, 'c_acctbal', True)} AS xbin, c_acctbal AS v FROM customer), g AS (SELECT i AS xbin FROM range(3) t(i))
SELECT g.xbin::INT AS xbin, round(coalesce(sum(v), 0), 2) AS value FROM g LEFT JOIN b USING (xbin) GROUP BY 1
""")
def histogram_accumulate(spark, sf_dir):
    h = Histogram(F.col("c_acctbal"), Edges.of(*A_EDGES), value=F.col("c_acctbal"), accumulate=True)
    return h.compute(table(spark, sf_dir, "customer")).select("xbin", F.round("value", 2).alias("value"))


@register("histogram_radius", """
WITH b AS (SELECT sqrt((l_quantity / 50) ** 2 + (l_discount * 10) ** 2 + (l_tax * 10) ** 2) AS r FROM lineitem), c AS (SELECT CASE WHEN r = 2 THEN 7 WHEN r BETWEEN 0 AND 2 THEN floor(r / 0.25)::INT END AS xbin FROM b),
g AS (SELECT i AS xbin FROM range(8) t(i))
SELECT g.xbin::INT AS xbin, count(c.xbin)::DOUBLE AS value FROM g LEFT JOIN c USING (xbin) GROUP BY 1
""")
def histogram_radius(spark, sf_dir):
    r = sc.radius(F.col("l_quantity") / 50, F.col("l_discount") * 10, F.col("l_tax") * 10)
    return Histogram(r, Edges.lin(0.0, 2.0, 8)).compute(table(spark, sf_dir, "lineitem")).select("xbin", "value")


@register("integer_counts", "SELECT p_size::BIGINT AS value, count(*) AS n FROM part GROUP BY 1")
def integer_counts(spark, sf_dir):
    return counts(table(spark, sf_dir, "part"), F.col("p_size").cast("long"))


# ---- reductions ---------------------------------------------------------------------------------------------------


@register("history_scalars", """
SELECT round(sum(l_extendedprice * l_quantity), 1) AS total, round(max(l_extendedprice), 4) AS hi, round(min(l_extendedprice), 4) AS lo FROM lineitem
""")
def history_scalars(spark, sf_dir):
    q = F.col("l_extendedprice")
    entries = [reductions.History("min", q, "lo"), reductions.History("sum", q * F.col("l_quantity"), "total"), reductions.History("max", q, "hi")]
    out = reductions.history(table(spark, sf_dir, "lineitem"), entries)
    return out.select(F.round("total", 1).alias("total"), F.round("hi", 4).alias("hi"), F.round("lo", 4).alias("lo"))


@register("history_powers", """
SELECT l_returnflag, round(sum(l_discount * l_quantity), 4) AS p_0, round(sum(pow(l_discount, 2) * l_quantity), 4) AS p_1, round(sum(pow(l_discount, 3) * l_quantity), 4) AS p_2 FROM lineitem GROUP BY 1
""")
def history_powers(spark, sf_dir):
    entry = reductions.History("sum", [F.pow("l_discount", F.lit(n)) * F.col("l_quantity") for n in (1, 2, 3)], "p")
    out = reductions.history(table(spark, sf_dir, "lineitem"), [entry], by=["l_returnflag"])
    return out.select("l_returnflag", *(F.round(f"p_{i}", 4).alias(f"p_{i}") for i in range(3)))


@register("reduce_logical", """
SELECT l_linestatus, bool_and(l_quantity > 0) AS land, bool_or(l_quantity > 49) AS lor, (sum((l_discount > 0.05)::INT) % 2 = 1) AS lxor FROM lineitem GROUP BY 1
""")
def reduce_logical(spark, sf_dir):
    ops = reductions.OPERATORS
    q = F.col("l_quantity")
    return table(spark, sf_dir, "lineitem").groupBy("l_linestatus").agg(
        ops["land"](q > 0).alias("land"), ops["lor"](q > 49).alias("lor"), ops["lxor"](F.col("l_discount") > 0.05).alias("lxor")
    )


@register("reduce_bits", "SELECT l_returnflag, bit_and(l_orderkey | 1) AS band, bit_or(l_partkey) AS bor, bit_xor(l_suppkey) AS bxor FROM lineitem GROUP BY 1")
def reduce_bits(spark, sf_dir):
    ops = reductions.OPERATORS
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(
        ops["band"](F.col("l_orderkey").bitwiseOR(F.lit(1).cast("long"))).alias("band"), ops["bor"](F.col("l_partkey")).alias("bor"), ops["bxor"](F.col("l_suppkey")).alias("bxor")
    )


@register("reduce_product", "SELECT n_regionkey, product(1 + n_nationkey / 100.0) AS value FROM (SELECT n_regionkey, n_nationkey::DOUBLE AS n_nationkey FROM nation) GROUP BY 1".replace("product(1 + n_nationkey / 100.0)", "round(product(1 + n_nationkey / 100.0), 8)"))
def reduce_product(spark, sf_dir):
    out = reductions.reduce(table(spark, sf_dir, "nation"), "prod", 1 + F.col("n_nationkey").cast("double") / 100.0, by=["n_regionkey"])
    return out.withColumn("value", F.round("value", 8))


@register("reduce_minmax_blocks", "SELECT l_suppkey, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem GROUP BY 1")
def reduce_minmax_blocks(spark, sf_dir):
    out = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(reductions.minmax(F.col("l_extendedprice")).alias("m"))
    return out.select("l_suppkey", "m.lo", "m.hi")


@register("reduce_max_loc", """
SELECT o_custkey, o_totalprice AS value, o_orderkey AS loc FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r = 1
""")
def reduce_max_loc(spark, sf_dir):
    out = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(reductions.max_loc(F.col("o_totalprice"), F.col("o_orderkey")).alias("m"))
    return out.select("o_custkey", "m.value", (-F.col("m.loc")).alias("loc"))


@register("box_sums", """
SELECT round(sum(CASE WHEN l_quantity BETWEEN 1 AND 25 AND l_discount BETWEEN 0 AND 0.05 THEN l_extendedprice ELSE 0 END), 2) AS low,
  round(sum(CASE WHEN l_quantity BETWEEN 25 AND 50 AND l_discount BETWEEN 0.05 AND 0.1 THEN l_extendedprice ELSE 0 END), 2) AS high FROM lineitem
""")
def box_sums(spark, sf_dir):
    q, d, v = F.col("l_quantity"), F.col("l_discount"), F.col("l_extendedprice")
    out = table(spark, sf_dir, "lineitem").agg(reductions.box_sum(v, (q, 1, 25), (d, 0, 0.05)).alias("low"), reductions.box_sum(v, (q, 25, 50), (d, 0.05, 0.1)).alias("high"))
    return out.select(F.round("low", 2).alias("low"), F.round("high", 2).alias("high"))


@register("dot_and_norms", """
SELECT round(sum(l_quantity * l_discount), 4) AS dot, round(pow(sum(pow(abs(l_discount - l_tax), 2)), 0.5), 8) AS l2, round(sum(abs(l_discount - l_tax)), 6) AS l1,
  round(pow(avg(pow(abs(l_discount - l_tax), 2)), 0.5), 10) AS rms FROM lineitem
""")
def dot_and_norms(spark, sf_dir):
    diff = F.col("l_discount") - F.col("l_tax")
    return table(spark, sf_dir, "lineitem").agg(
        F.round(reductions.dot(F.col("l_quantity"), F.col("l_discount")), 4).alias("dot"),
        F.round(reductions.norm(diff), 8).alias("l2"),
        F.round(reductions.norm(diff, 1.0), 6).alias("l1"),
        F.round(reductions.norm(diff, mean=True), 10).alias("rms"),
    )


@register("relative_errors", """
WITH d AS (SELECT l_returnflag, l_discount AS a, l_tax AS b FROM lineitem),
e AS (SELECT l_returnflag, CASE WHEN abs(a) + abs(b) <> 0 THEN (a - b) / (0.5 * (abs(a) + abs(b))) ELSE 0 END AS e, CASE WHEN abs(a) + abs(b) <> 0 THEN (a - b) / (0.5 * (abs(a) + abs(b))) END AS f FROM d)
SELECT l_returnflag, round(max(abs(e)), 8) AS worst, round(sqrt(avg(e * e)), 8) AS rms, count(f) AS counted FROM e GROUP BY 1
""")
def relative_errors(spark, sf_dir):
    e = reductions.relative_error(F.col("l_discount"), F.col("l_tax"))
    f = reductions.relative_error(F.col("l_discount"), F.col("l_tax"), ignore_zero=True)
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(
        F.round(F.max(F.abs(e)), 8).alias("worst"), F.round(reductions.norm(e, mean=True), 8).alias("rms"), F.count(f).alias("counted")
    )


@register("indicator_area", """
WITH c AS (SELECT -2 + (i + 0.5) * 0.0625 AS x, -2 + (j + 0.5) * 0.0625 AS y FROM range(64) a(i), range(64) b(j))
SELECT round(sum(CASE WHEN x * x + y * y < 2.25 THEN 1.0 ELSE 0.0 END::DOUBLE * 0.0625 * 0.0625) / 2.25, 10) AS pi FROM c
""")
def indicator_area(spark, sf_dir):
    cells = spark.range(64 * 64).select((F.col("id") % 64).alias("i"), F.floor(F.col("id") / 64).alias("j"))
    x, y = (sc.centre(F.col(c), -2.0, 0.0625) for c in "ij")
    return cells.agg(F.round(F.sum(kernels.inside_circle(x, y, 1.5) * 0.0625 * 0.0625) / 2.25, 10).alias("pi"))


@register("time_step_by_block", """
SELECT o_custkey, round(0.4 * min(CASE WHEN v <> 0 THEN 0.1 / abs(v) END), 10) AS dt FROM (SELECT o_custkey, (o_totalprice - 250000) / 1000 AS v FROM orders) GROUP BY 1
""")
def time_step_by_block(spark, sf_dir):
    v = (F.col("o_totalprice") - 250000) / 1000
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.round(reductions.time_step(F.lit(0.1), v, 0.4), 10).alias("dt"))


@register("sparse_votes", """
SELECT l_suppkey, bool_and(abs(l_discount) <= 0.099) AS give_back, bool_or(abs(l_tax) >= 0.08) AS allocate FROM lineitem GROUP BY 1
""")
def sparse_votes(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(
        reductions.all_below(F.col("l_discount"), 0.099).alias("give_back"), reductions.any_above(F.col("l_tax"), 0.08).alias("allocate")
    )


@register("rank_imbalance", """
WITH r AS (SELECT l_suppkey % 8 AS rank, sum(l_quantity) AS cost FROM lineitem GROUP BY 1)
SELECT sum(cost) AS total, max(cost) AS largest, round(avg(cost), 6) AS mean, max(cost) > 1.05 * avg(cost) AS unbalanced FROM r
""")
def rank_imbalance(spark, sf_dir):
    cost = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 8).alias("rank"), F.col("l_quantity").alias("cost"))
    return reductions.imbalance(cost, 0.05).withColumn("mean", F.round("mean", 6))


@register("prefix_sums", """
SELECT event_id, round(sum(value) OVER (ORDER BY event_id), 2) AS upto, round(sum(value) OVER (ORDER BY event_id) - value, 2) AS before FROM events
""")
def prefix_sums(spark, sf_dir):
    out = reductions.prefix_sum(table(spark, sf_dir, "events").select("event_id", "value"), ["event_id"], "value", "upto", buckets=32)
    return out.select("event_id", F.round("upto", 2).alias("upto"), F.round(F.col("upto") - F.col("value"), 2).alias("before"))


@register("rank_offsets", """
WITH c AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1)
SELECT user_id, n, (sum(n) OVER (ORDER BY user_id) - n)::BIGINT AS first, (sum(n) OVER ())::BIGINT AS total FROM c
""")
def rank_offsets(spark, sf_dir):
    counted = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"))
    out = reductions.prefix_sum(counted, ["user_id"], "n", "first", inclusive=False, buckets=16)
    total = counted.agg(F.sum("n").alias("total"))
    return out.join(F.broadcast(total), F.lit(True)).select("user_id", "n", "first", "total")


# ---- order, search ------------------------------------------------------------------------------------------------


@register("sort_by_cell", """
WITH p AS (SELECT event_id, user_id % 64 AS cell FROM events), c AS (SELECT cell, row_number() OVER (ORDER BY cell, event_id) - 1 AS at FROM p)
SELECT g.cell, count(c.cell) AS n, coalesce(min(c.at), -1)::BIGINT AS first FROM (SELECT i AS cell FROM range(70) t(i)) g LEFT JOIN c ON c.cell = g.cell GROUP BY 1
""")
def sort_by_cell(spark, sf_dir):
    particles = table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 64).alias("cell"))
    return ordering.cell_index(particles, "cell", 70)


@register("compaction", "SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS slot FROM events WHERE event_type <> 'error'")
def compaction(spark, sf_dir):
    return ordering.compacted(table(spark, sf_dir, "events").select("event_id", "event_type"), F.col("event_type") != "error", "event_id", "slot").select("event_id", "slot")


@register("partition_to_size", "SELECT c_custkey, ((row_number() OVER (ORDER BY c_custkey) - 1) // 128)::BIGINT AS part FROM customer")
def partition_to_size(spark, sf_dir):
    return ordering.to_size(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", 128, "part")


@register("partition_to_count", """
WITH n AS (SELECT ceil(count(*) / 7.0)::BIGINT AS size FROM customer) SELECT c_custkey, ((row_number() OVER (ORDER BY c_custkey) - 1) // size)::BIGINT AS part FROM customer, n
""")
def partition_to_count(spark, sf_dir):
    return ordering.to_count(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", 7, "part")


@register("upper_bound", "SELECT p_partkey, len(list_filter([1, 5, 10, 20, 35, 50], lambda e: e <= p_size))::INT AS at FROM part")
def upper_bound(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", ordering.upper_bound(F.array(*map(F.lit, (1, 5, 10, 20, 35, 50))), F.col("p_size")).alias("at"))


@register("worst_difference", "SELECT l_returnflag, max(abs(l_discount - l_tax)) AS worst FROM lineitem GROUP BY 1".replace("max(abs(l_discount - l_tax))", "round(max(abs(l_discount - l_tax)), 8)"))
def worst_difference(spark, sf_dir):
    worst = F.round(F.max(F.abs(F.col("l_discount") - F.col("l_tax"))), 8)
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(worst.alias("worst"))


@register("differences_above", "SELECT o_orderkey, round(abs(o_totalprice - 250000), 2) AS diff FROM orders WHERE abs(o_totalprice - 250000) > 200000")
def differences_above(spark, sf_dir):
    d = F.abs(F.col("o_totalprice") - 250000)
    return table(spark, sf_dir, "orders").filter(d > 200000).select("o_orderkey", F.round(d, 2).alias("diff"))


ALIAS = ordering.alias_table([5.0, 1.0, 3.0, 0.5, 2.5])


@register("alias_sample", f"""
WITH t(i, p, a) AS (VALUES {', '.join(f'({i}, {p!r}::DOUBLE, {a})' for i, (p, a) in enumerate(ALIAS))}),
r AS (SELECT event_id, ((event_id * 7919) % 10007) / 10007.0::DOUBLE AS r1, ((event_id * 104729) % 10009) / 10009.0::DOUBLE AS r2 FROM events)
SELECT event_id, CASE WHEN r2 >= p THEN a ELSE i END::INT AS drawn FROM r JOIN t ON t.i = floor(r1 * 5)
""")
def alias_sample(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    r1, r2 = ((F.col("event_id") * a % b) / float(b) for a, b in ((7919, 10007), (104729, 10009)))
    return events.select("event_id", ordering.alias_draw(ALIAS, r1, r2).alias("drawn"))


@register("morton_order", """
WITH b AS (SELECT n_nationkey AS k, n_nationkey % 5 AS x, n_nationkey // 5 AS y FROM nation),
m AS (SELECT k, (x & 1) | ((y & 1) << 1) | ((x & 2) << 1) | ((y & 2) << 2) | ((x & 4) << 2) | ((y & 4) << 3) AS morton FROM b)
SELECT k, morton::BIGINT AS morton, row_number() OVER (ORDER BY morton) - 1 AS gid FROM m
""")
def morton_order(spark, sf_dir):
    blocks = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), (F.col("n_nationkey") % 5).alias("x"), F.floor(F.col("n_nationkey") / 5).alias("y"))
    keyed = blocks.select("k", sc.morton(F.col("x"), F.col("y"), bits=8).alias("morton"))
    # a row for each block of a mesh
    return keyed.withColumn("gid", (F.row_number().over(Window.orderBy("morton")) - 1).cast("long"))


# ---- scalars ------------------------------------------------------------------------------------------------------


@register("robust_scalars", """
SELECT c_custkey, round(greatest(c_acctbal, 2.2250738585072014e-307), 2) AS positive, round(least(greatest(c_acctbal, 0 + 2.220446049250313e-15), 5000 * (1 - 2.220446049250313e-15)), 6) AS bounded,
  CASE WHEN c_acctbal - 5000 >= 0 THEN 1.0 ELSE -1.0 END::DOUBLE AS sign, round(c_acctbal / (n + CASE WHEN n >= 0 THEN 1 ELSE -1 END * 2.2250738585072014e-307), 6) AS ratio, abs(n - 3.0) < 1e-3 * 3 AS near
FROM (SELECT *, (1 + c_nationkey)::DOUBLE AS n FROM customer)
""")
def robust_scalars(spark, sf_dir):
    b, n = F.col("c_acctbal"), (1 + F.col("c_nationkey")).cast("double")
    return table(spark, sf_dir, "customer").select(
        "c_custkey", F.round(sc.make_positive(b), 2).alias("positive"), F.round(sc.make_bounded(b, 0.0, 5000.0), 6).alias("bounded"),
        sc.sgn(b - 5000).alias("sign"), F.round(sc.ratio(b, n), 6).alias("ratio"), sc.soft_equiv(n, F.lit(3.0), 1e-3).alias("near"),
    )


@register("bit_scalars", """
SELECT p_partkey, (p_partkey + 1) & -(p_partkey + 1) AS divisor, floor(log2(((p_partkey + 1) & -(p_partkey + 1))::DOUBLE) + 0.5)::INT AS zeros, (length(bin(p_partkey + 1)) - 1)::INT AS lo,
  CASE WHEN bit_count(p_partkey + 1) = 1 THEN length(bin(p_partkey + 1)) - 1 ELSE length(bin(p_partkey + 1)) END::INT AS hi, ((p_partkey + 6) // 7)::BIGINT AS sevenths FROM part
""")
def bit_scalars(spark, sf_dir):
    n = F.col("p_partkey") + 1
    return table(spark, sf_dir, "part").select(
        "p_partkey", sc.max_power_of_2_divisor(n).alias("divisor"), sc.trailing_zeros(n).alias("zeros"), sc.floor_log2(n).alias("lo"), sc.ceil_log2(n).alias("hi"),
        sc.ceil_div(F.col("p_partkey"), 7).alias("sevenths"),
    )


@register("string_scalars", """
SELECT p_partkey, trim('  ' || p_name || ' ') AS both, ltrim('  ' || p_name || ' ') AS l, rtrim('  ' || p_name || ' ') AS r, p_brand || '|' || p_type AS packed, len(string_split(p_name, ' '))::INT AS fields FROM part
""")
def string_scalars(spark, sf_dir):
    padded = F.concat(F.lit("  "), "p_name", F.lit(" "))
    return table(spark, sf_dir, "part").select(
        "p_partkey", sc.trim(padded).alias("both"), sc.trim(padded, "left").alias("l"), sc.trim(padded, "right").alias("r"),
        sc.pack(F.array("p_brand", "p_type"), "|").alias("packed"), F.size(sc.unpack(F.col("p_name"), " ")).alias("fields"),
    )


@register("coordinates", """
WITH c AS (SELECT o_orderkey, (o_orderkey % 100)::DOUBLE AS i, (o_orderkey // 100)::DOUBLE AS j FROM orders)
SELECT o_orderkey, round(-0.5 + (i + 0.5) * 0.01, 8) AS xc, round(-0.5 + i * 0.01, 8) AS xf, round(-0.5 + (j + 0.5) * 0.02, 8) AS yc, round(0.01::DOUBLE * 0.02, 8) AS area,
  round(sqrt(pow(-0.5 + (i + 0.5) * 0.01, 2) + pow(-0.5 + (j + 0.5) * 0.02, 2)), 8) AS r, round((i - 50) / 100, 8) AS sym FROM c
""")
def coordinates(spark, sf_dir):
    i, j = F.col("o_orderkey") % 100, F.floor(F.col("o_orderkey") / 100)
    x, y = sc.centre(i, -0.5, 0.01), sc.centre(j, -0.5, 0.02)
    columns = {"xc": x, "xf": sc.face(i, -0.5, 0.01), "yc": y, "area": sc.product(F.lit(0.01), F.lit(0.02)), "r": sc.radius(x, y), "sym": sc.symmetrized(i, 100, -0.5, 0.5)}
    return table(spark, sf_dir, "orders").select("o_orderkey", *(F.round(c, 8).alias(n) for n, c in columns.items()))


# ---- selection, stages --------------------------------------------------------------------------------------------


def lineitem_catalog() -> cat.Catalog:
    """Columns of ``lineitem`` as variables of a package."""
    p = cat.Package("trade")
    p.add_field("l_quantity", cat.Metadata.of("Cell", "Independent", "Conserved"))
    p.add_field("l_extendedprice", cat.Metadata.of("Cell", "Independent", "Conserved", "Advected"))
    p.add_field("l_discount", cat.Metadata.of("Cell", "Derived", "Intensive"))
    p.add_field("l_tax", cat.Metadata.of("Cell", "Derived", "Intensive", "Restart"))
    p.add_field("l_suppkey", cat.Metadata.of("Cell", "Integer", "Derived"))
    return cat.resolve([p])


@register("select_by_flags", "SELECT l_orderkey, l_linenumber, l_discount FROM lineitem")
def select_by_flags(spark, sf_dir):
    flags = cat.FlagCollection.all_of("Cell", "Intensive") - cat.FlagCollection.any_of("Restart")
    return cat.project(table(spark, sf_dir, "lineitem"), lineitem_catalog(), ["l_orderkey", "l_linenumber"], flags=flags)


@register("select_by_regex", "SELECT l_orderkey, l_discount, l_tax FROM lineitem")
def select_by_regex(spark, sf_dir):
    return cat.project(table(spark, sf_dir, "lineitem"), lineitem_catalog(), ["l_orderkey"], names=["l_(discount|tax)"], regex=True)


@register("flatten_pack", """
SELECT var, count(*) AS n, round(sum(value), 2) AS total FROM (SELECT 'l_quantity' AS var, l_quantity AS value FROM lineitem UNION ALL SELECT 'l_extendedprice', l_extendedprice FROM lineitem) GROUP BY 1
""")
def flatten_pack(spark, sf_dir):
    chosen = lineitem_catalog().select(flags=cat.FlagCollection.any_of("Conserved"))
    long = cat.flattened(table(spark, sf_dir, "lineitem"), ["l_orderkey"], chosen)
    return long.groupBy("var").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


@register("index_domain", """
SELECT CASE WHEN i < 2 THEN 'inner' WHEN i >= 98 THEN 'outer' ELSE 'interior' END AS domain, count(*) AS n FROM (SELECT o_orderkey % 100 AS i FROM orders) GROUP BY 1
""")
def index_domain(spark, sf_dir):
    i = F.col("o_orderkey") % 100
    domain = F.when(i < 2, "inner").when(i >= 98, "outer").otherwise("interior")
    return table(spark, sf_dir, "orders").groupBy(domain.alias("domain")).agg(F.count("*").alias("n"))


@register("level_counts", "SELECT p_size % 4 AS level, count(*) AS n FROM part GROUP BY 1")
def level_counts(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy((F.col("p_size") % 4).alias("level")).agg(F.count("*").alias("n"))


@register("stage_weighted_sum", """
SELECT a.o_orderkey, round(a.o_totalprice / 3.0 + b.total / 1.5, 2) AS z FROM orders a JOIN (SELECT l_orderkey, sum(l_extendedprice) AS total FROM lineitem GROUP BY 1) b ON a.o_orderkey = b.l_orderkey
""")
def stage_weighted_sum(spark, sf_dir):
    base = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("v"))
    other = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.sum("l_extendedprice").alias("v"))
    both = kernels.on_stages({"base": base, "one": other}, ["k"], ["v"])
    return both.select(F.col("k").alias("o_orderkey"), F.round(kernels.weighted_sum(F.col("v_base"), F.col("v_one"), 1 / 3, 2 / 3), 2).alias("z"))


@register("derived_fields", """
SELECT l_orderkey, l_linenumber, l_partkey, round(1 - l_discount, 8) AS one_minus, round((1 - l_discount) ** 2, 8) AS squared, round(1 - sqrt((1 - l_discount) ** 2), 8) AS back, round(log10(l_quantity + 1e-5), 8) AS logged,
  round(0.5 * l_quantity * (l_discount ** 2 + l_tax ** 2), 8) AS kinetic FROM lineitem
""")
def derived_fields(spark, sf_dir):
    q = F.col("l_discount")
    hooks = [
        lambda df: df.withColumn("one_minus", kernels.complement(q)),
        lambda df: df.withColumn("squared", kernels.complement_squared(q)),
        lambda df: df.withColumn("back", kernels.from_complement_squared(F.col("squared"))),
        lambda df: df.withColumns({"logged": F.log10(F.col("l_quantity") + 1e-5), "kinetic": kernels.kinetic(F.col("l_quantity"), q, F.col("l_tax"))}),
    ]
    out = kernels.derived(table(spark, sf_dir, "lineitem"), hooks)
    return out.select("l_orderkey", "l_linenumber", "l_partkey", *(F.round(c, 8).alias(c) for c in ("one_minus", "squared", "back", "logged", "kinetic")))


@register("sparse_default", "SELECT o_orderkey, coalesce(total, 0) AS total FROM orders LEFT JOIN (SELECT l_orderkey, round(sum(l_tax), 6) AS total FROM lineitem WHERE l_tax > 0.05 GROUP BY 1) ON o_orderkey = l_orderkey")
def sparse_default(spark, sf_dir):
    sparse = table(spark, sf_dir, "lineitem").filter("l_tax > 0.05").groupBy("l_orderkey").agg(F.round(F.sum("l_tax"), 6).alias("total"))
    out = table(spark, sf_dir, "orders").join(sparse, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return out.select("o_orderkey", kernels.allocated(F.col("total")).alias("total"))
