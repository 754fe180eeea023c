"""Queries on profiles."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from switchback.operators import profiles as P
from switchback.plans.catalog import query
from switchback.sources.views import PROF, prof


def _r(c, n=6):
    return F.round(c, n)


@query("w1_cumulative_abscissa", f"WITH {PROF} SELECT g, i, CAST(sum(5 + z % 7) OVER (PARTITION BY g ORDER BY i) AS BIGINT) AS abscissa FROM prof")
def w1(spark, sf):
    return P.cumulative(prof(spark, sf).withColumn("d", 5 + F.col("z") % 7), "d", "abscissa").select("g", "i", "abscissa")


@query("w2_delta_codec", f"WITH {PROF} SELECT g, i, coalesce(z - lag(z) OVER (PARTITION BY g ORDER BY i), z) AS delta, z AS decoded FROM prof")
def w2(spark, sf):
    return P.delta_decode(P.delta_encode(prof(spark, sf))).select("g", "i", "delta", "decoded")


def _pass(src, dst):
    return f"{dst} AS (SELECT g, i, s, z, hot, CASE WHEN hot AND abs(c - m) > 20 THEN NULL ELSE c END AS c FROM (SELECT *, quantile_cont(c, 0.5) OVER (PARTITION BY g ORDER BY i ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) AS m FROM {src}))"


_SPIKE = f"{PROF}, d0 AS (SELECT g, i, s, z, CAST(z AS DOUBLE) AS c, count(*) OVER (PARTITION BY g) >= 3 AND max(z) OVER (PARTITION BY g) - min(z) OVER (PARTITION BY g) > 20 AS hot FROM prof), {_pass('d0', 'd1')}, {_pass('d1', 'd2')}, {_pass('d2', 'd3')}"


@query("w3_despike", f"WITH {_SPIKE} SELECT g, i, c AS clean FROM d3")
def w3(spark, sf):
    return P.despike(prof(spark, sf)).select("g", "i", "clean")


_FILL = """SELECT g, i, round(CASE WHEN a IS NULL THEN b WHEN b IS NULL THEN a WHEN sa = sb THEN a ELSE a + (b - a) / (sb - sa) * (s - sa) END, 6) AS filled FROM (
SELECT g, i, s, last_value(c IGNORE NULLS) OVER p AS a, last_value(CASE WHEN c IS NOT NULL THEN s END IGNORE NULLS) OVER p AS sa, first_value(c IGNORE NULLS) OVER n AS b, first_value(CASE WHEN c IS NOT NULL THEN s END IGNORE NULLS) OVER n AS sb FROM d3
WINDOW p AS (PARTITION BY g ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), n AS (PARTITION BY g ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"""


@query("w4_fill_gaps", f"WITH {_SPIKE} {_FILL}")
def w4(spark, sf):
    return P.fill_gaps(P.despike(prof(spark, sf)), "clean").select("g", "i", _r("filled").alias("filled"))


@query("w5_smooth", f"WITH {PROF} SELECT g, i, round(CASE WHEN a IS NULL OR b IS NULL THEN z ELSE (a + z + b) / 3.0 END, 6) AS smooth FROM (SELECT *, lag(z) OVER (PARTITION BY g ORDER BY i) AS a, lead(z) OVER (PARTITION BY g ORDER BY i) AS b FROM prof)")
def w5(spark, sf):
    return P.smooth(prof(spark, sf)).select("g", "i", _r("smooth").alias("smooth"))


def _grade(m):
    return f"""WITH {PROF}, j AS (SELECT g, i, s, z, first_value(s) OVER w AS s2, first_value(z) OVER w AS z2 FROM prof WINDOW w AS (PARTITION BY g ORDER BY s RANGE BETWEEN {m} FOLLOWING AND UNBOUNDED FOLLOWING))
SELECT g, round(CASE WHEN max(s) - min(s) <= {m} THEN abs(arg_max(z, s) - arg_min(z, s)) / greatest(max(s) - min(s), 1e-6) ELSE coalesce(max(abs(z2 - z) / CAST(s2 - s AS DOUBLE)), 0.0) END, 6) AS max_grade FROM j GROUP BY g"""


@query("w6_max_grade_25m", _grade(25))
def w6(spark, sf):
    return P.max_grade(prof(spark, sf), 25).select("g", _r("max_grade").alias("max_grade"))


@query("w7_max_grade_50m", _grade(50))
def w7(spark, sf):
    return P.max_grade(prof(spark, sf), 50).select("g", _r("max_grade").alias("max_grade"))


@query("w8_display_grade", f"""WITH {PROF}, j AS (SELECT g, i, s, first_value(s) OVER a AS sa, first_value(z) OVER a AS za, coalesce(first_value(s) OVER b, last_value(s) OVER c) AS sb, coalesce(first_value(z) OVER b, last_value(z) OVER c) AS zb FROM prof
WINDOW a AS (PARTITION BY g ORDER BY s RANGE BETWEEN 25 PRECEDING AND CURRENT ROW), b AS (PARTITION BY g ORDER BY s RANGE BETWEEN 25 FOLLOWING AND UNBOUNDED FOLLOWING), c AS (PARTITION BY g ORDER BY s ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT g, i, round(CASE WHEN sb - sa > 1 THEN 100.0 * (zb - za) / (sb - sa) ELSE 0 END, 6) AS grade FROM j""")  # fmt: skip
def w8(spark, sf):
    return P.display_grades(prof(spark, sf)).select("g", "i", _r("grade").alias("grade"))


@query("w12_jump_flag", f"WITH {PROF} SELECT g, coalesce(max(abs(d)) > 100, false) AS jump FROM (SELECT g, z - lag(z) OVER (PARTITION BY g ORDER BY i) AS d FROM prof) GROUP BY g")
def w12(spark, sf):
    return prof(spark, sf).withColumn("d", P.step()).groupBy("g").agg(F.coalesce(F.max(F.abs("d")) > 100, F.lit(False)).alias("jump"))


@query("w15_hysteresis_ascent", f"""WITH RECURSIVE {PROF}, walk AS (SELECT g, i, CAST(z AS DOUBLE) AS ref, CAST(0 AS DOUBLE) AS up, false AS climbing FROM prof WHERE i = 0
UNION ALL SELECT p.g, p.i, CASE WHEN rise OR fall THEN z ELSE ref END, CASE WHEN rise THEN up + z - ref ELSE up END, CASE WHEN rise THEN true WHEN fall THEN false ELSE climbing END FROM (
SELECT p.g, p.i, p.z, w.ref, w.up, w.climbing, CASE WHEN w.climbing THEN p.z > w.ref ELSE p.z - w.ref >= 5 END AS rise, CASE WHEN w.climbing THEN w.ref - p.z >= 5 ELSE p.z < w.ref END AS fall FROM walk AS w JOIN prof AS p ON p.g = w.g AND p.i = w.i + 1) AS p)
SELECT g, arg_max(up, i) AS ascent FROM walk GROUP BY g""")  # fmt: skip
def w15(spark, sf):
    z = prof(spark, sf).groupBy("g").agg(F.array_sort(F.collect_list(F.struct("i", "z"))).alias("p"))
    return z.select("g", P.ascent_with_hysteresis(F.col("p.z")).alias("ascent"))


@query("w18_via_legs", f"""WITH {PROF}, l AS (SELECT g, i, s, z, z - lag(z) OVER w AS dz, s - lag(s) OVER w AS ds, count(*) FILTER (z % 13 = 0 AND i > 0) OVER (PARTITION BY g ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS leg FROM prof WINDOW w AS (PARTITION BY g ORDER BY i))
SELECT g, leg, CAST(sum(ds) AS BIGINT) AS length, CAST(sum(greatest(dz, 0)) AS BIGINT) AS up, CAST(sum(greatest(-dz, 0)) AS BIGINT) AS down FROM l WHERE dz IS NOT NULL GROUP BY g, leg""")  # fmt: skip
def w18(spark, sf):
    before = P.along().rowsBetween(W.unboundedPreceding, -1)
    legs = prof(spark, sf).withColumn("dz", P.step()).withColumn("ds", P.step("s")).withColumn("leg", F.count_if((F.col("z") % 13 == 0) & (F.col("i") > 0)).over(before))
    return legs.where("dz IS NOT NULL").groupBy("g", "leg").agg(F.sum("ds").alias("length"), F.sum(F.greatest("dz", F.lit(0))).alias("up"), F.sum(F.greatest(-F.col("dz"), F.lit(0))).alias("down"))


@query("w19_runs", f"""WITH {PROF}, c AS (SELECT *, CASE WHEN (z > 100) <> lag(z > 100) OVER (PARTITION BY g ORDER BY i) THEN 1 ELSE 0 END AS c FROM prof), r AS (SELECT *, sum(c) OVER (PARTITION BY g ORDER BY i) AS run FROM c)
SELECT g, CAST(run AS BIGINT) AS run, min(z) > 100 AS inside, count(*) AS n FROM r GROUP BY g, run""")  # fmt: skip
def w19(spark, sf):
    return P.runs(prof(spark, sf), F.col("z") > 100).groupBy("g", "run").agg((F.min("z") > 100).alias("inside"), F.count("*").alias("n"))


@query("w20_first_node_elevation", f"WITH {PROF} SELECT node, z FROM (SELECT z % 50 AS node, z + g AS z, row_number() OVER (PARTITION BY z % 50 ORDER BY g % 2, g, i) AS r FROM prof) WHERE r = 1")
def w20(spark, sf):
    return prof(spark, sf).groupBy((F.col("z") % 50).alias("node")).agg(F.min_by(F.col("z") + F.col("g"), F.struct((F.col("g") % 2), "g", "i")).alias("z"))


@query("a1_length_of_polyline", f"WITH {PROF} SELECT g, round(sum(sqrt(25 + d * d)), 3) AS length FROM (SELECT g, z - lag(z) OVER (PARTITION BY g ORDER BY i) AS d FROM prof) WHERE d IS NOT NULL GROUP BY g")
def a1(spark, sf):
    return prof(spark, sf).withColumn("d", P.step()).where("d IS NOT NULL").groupBy("g").agg(F.round(F.sum(F.hypot(F.lit(5.0), F.col("d"))), 3).alias("length"))


@query("a2_ascent_descent", f"WITH {PROF} SELECT g, CAST(sum(greatest(d, 0)) AS BIGINT) AS up, CAST(sum(greatest(-d, 0)) AS BIGINT) AS down FROM (SELECT g, z - lag(z) OVER (PARTITION BY g ORDER BY i) AS d FROM prof) WHERE d IS NOT NULL GROUP BY g")
def a2(spark, sf):
    return prof(spark, sf).withColumn("d", P.step()).where("d IS NOT NULL").groupBy("g").agg(F.sum(F.greatest("d", F.lit(0))).alias("up"), F.sum(F.greatest(-F.col("d"), F.lit(0))).alias("down"))


@query("h17_profile_ascent_identity", f"WITH {PROF} SELECT g, arg_max(z, i) - arg_min(z, i) AS net FROM prof GROUP BY g")
def h17(spark, sf):
    """Ascent less descent is the difference of the ends."""
    d = prof(spark, sf).withColumn("d", F.coalesce(P.step(), F.lit(0)))
    return d.groupBy("g").agg((F.sum(F.greatest("d", F.lit(0))) - F.sum(F.greatest(-F.col("d"), F.lit(0)))).alias("net"))


@query("a17_time_distribution", f"WITH {PROF} SELECT g, round(quantile_cont(z, 0.5), 6) AS median, round(quantile_cont(z, 0.1), 6) AS p10, round(avg(z), 6) AS mean FROM prof GROUP BY g")
def a17(spark, sf):
    return prof(spark, sf).groupBy("g").agg(_r(F.percentile("z", 0.5)).alias("median"), _r(F.percentile("z", 0.1)).alias("p10"), _r(F.avg("z")).alias("mean"))


@query("f6_profile_count", f"WITH {PROF} SELECT g, CAST((max(s) + 49) // 50 + 1 AS BIGINT) AS points FROM prof GROUP BY g")
def f6(spark, sf):
    return prof(spark, sf).groupBy("g").agg(F.expr("(max(s) + 49) div 50 + 1").alias("points"))


@query("f27_index_at_distance", f"""WITH {PROF}, t AS (SELECT g, max(s) * 0.37 AS d FROM prof GROUP BY g) SELECT p.g, CAST(arg_min(p.i, abs(p.s - t.d) * 1000000 + p.i) AS BIGINT) AS i FROM prof AS p JOIN t ON p.g = t.g GROUP BY p.g""")
def f27(spark, sf):
    rows = prof(spark, sf).withColumn("d", F.max("s").over(W.partitionBy("g")) * 0.37)
    return rows.groupBy("g").agg(F.min_by("i", F.struct(F.abs(F.col("s") - F.col("d")), "i")).alias("i"))
