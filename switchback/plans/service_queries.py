"""Queries on shared loops, suggestions and regions of requests."""

from __future__ import annotations

from pyspark.sql import functions as F

from switchback.operators import spatial as S
from switchback.plans.catalog import query
from switchback.plans.segment_queries import RING, _ring_sql
from switchback.sources.views import PROF, SEG, prof, seg
from switchback.storage import table

_LOOPS = f"{PROF}, lp AS (SELECT g, count(*) AS points, string_agg(CAST(z AS VARCHAR), ',' ORDER BY i) AS body FROM prof GROUP BY g)"


def _loops(spark, sf):
    rows = prof(spark, sf).groupBy("g").agg(F.array_sort(F.collect_list(F.struct("i", "z"))).alias("p"))
    return rows.select("g", F.size("p").cast("bigint").alias("points"), F.array_join(F.transform("p", lambda p: p["z"].cast("string")), ",").alias("body"))


@query("k8_shared_loop_records", f"WITH {_LOOPS} SELECT substr(sha256(body), 1, 12) AS id, min(g) AS first, max(points) AS points FROM lp WHERE points <= 50000 AND length(body) <= 2097152 GROUP BY 1")
def k8(spark, sf):
    """Accepted loops by an id of twelve characters of their digest; alike bodies are stored once."""
    kept = _loops(spark, sf).where("points <= 50000 AND length(body) <= 2097152")
    return kept.groupBy(F.substring(F.sha2("body", 256), 1, 12).alias("id")).agg(F.min("g").alias("first"), F.max("points").alias("points"))


@query("s22_shared_loop_lookup", f"WITH {_LOOPS}, k AS (SELECT DISTINCT substr(sha256(body), 1, 12) AS id, points FROM lp) SELECT g % 97 AS asked, k.points FROM lp JOIN k ON k.id = substr(sha256(lp.body), 1, 12) WHERE g % 2 = 0")
def s22(spark, sf):
    """Stored loops by id; ids that are not there give no row."""
    rows = _loops(spark, sf).withColumn("id", F.substring(F.sha2("body", 256), 1, 12))
    asked = rows.where("g % 2 = 0").select((F.col("g") % 97).alias("asked"), "id")
    return asked.join(rows.select("id", "points").distinct(), "id").select("asked", "points")


@query("h26_apply_suggestion", "SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN NULL WHEN p_size % 3 = 1 THEN CAST(p_size AS BIGINT) ELSE 60 END AS max_grade FROM part")
def h26(spark, sf):
    """A suggestion replaces a field, removes it (a null that is given) or leaves it."""
    suggestion = F.when(F.col("p_size") % 3 == 0, F.create_map(F.lit("max_grade"), F.lit(None).cast("bigint"))).when(F.col("p_size") % 3 == 1, F.create_map(F.lit("max_grade"), F.col("p_size").cast("bigint"))).otherwise(F.create_map().cast("map<string,bigint>"))
    rows = table(spark, sf, "part").select("p_partkey", suggestion.alias("s"), F.lit(60).cast("bigint").alias("max_grade"))
    return rows.select("p_partkey", F.when(F.map_contains_key("s", F.lit("max_grade")), F.try_element_at("s", F.lit("max_grade"))).otherwise(F.col("max_grade")).alias("max_grade"))


@query("l11_widened_caps", "SELECT o_orderkey, round(least(CASE WHEN o_custkey % 3 = 0 THEN o_totalprice / 1000 * 1.5 ELSE o_totalprice / 1000 END, 60.0), 6) AS cap FROM orders")
def l11(spark, sf):
    """An automatic cap without a feasible loop is widened by half, within the limit."""
    km = F.col("o_totalprice") / 1000
    return table(spark, sf, "orders").select("o_orderkey", F.round(F.least(F.when(F.col("o_custkey") % 3 == 0, km * 1.5).otherwise(km), F.lit(60.0)), 6).alias("cap"))


_SEGS = [((x0, y0), (x1, y1)) for (x0, y0), (x1, y1) in zip(RING, RING[1:] + RING[:1], strict=True)]


def _edge_distance_sql(x0, y0, x1, y1):
    n = (x1 - x0) ** 2 + (y1 - y0) ** 2
    t = f"least(greatest(((x - {x0}) * {x1 - x0} + (y - {y0}) * ({y1 - y0})) / {n}, 0.0), 1.0)"
    return f"(({x0} + {t} * ({x1 - x0}) - x) ** 2 + ({y0} + {t} * ({y1 - y0}) - y) ** 2)"


@query("p14_vias_in_region", f"WITH {SEG} SELECT id, ({_ring_sql()}) OR least({', '.join(_edge_distance_sql(*a, *b) for a, b in _SEGS)}) <= 2500 AS inside FROM seg")
def p14(spark, sf):
    """In the polygon, or within 50 m of its boundary."""
    x, y = F.col("x").cast("double"), F.col("y").cast("double")
    near = F.least(*[S.segment_distance2(x, y, F.lit(a[0]), F.lit(a[1]), F.lit(b[0]), F.lit(b[1])) for a, b in _SEGS])
    return seg(spark, sf).select("id", (S.in_polygon(x, y, RING) | (near <= 2500)).alias("inside"))


@query("s18_tiles_of_a_region", f"WITH c AS (SELECT i AS ix, j AS iy, i * 2000 + 1000.0 * a AS x, j * 2000 + 1000.0 * b AS y FROM range(0, 20) p(i), range(0, 20) q(j), range(0, 3) r(a), range(0, 3) s(b)) SELECT DISTINCT ix, iy FROM c WHERE {_ring_sql()}")
def s18(spark, sf):
    """Tiles with a corner, a middle of a side or their centre in the region."""
    cells = spark.range(20).select(F.col("id").alias("ix")).withColumn("iy", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(19).cast("bigint"))))
    at = cells.withColumn("a", F.explode(F.array(*[F.lit(k) for k in range(3)]))).withColumn("b", F.explode(F.array(*[F.lit(k) for k in range(3)])))
    x, y = F.col("ix") * 2000 + 1000.0 * F.col("a"), F.col("iy") * 2000 + 1000.0 * F.col("b")
    return at.where(S.in_polygon(x, y, RING)).select("ix", "iy").distinct()


@query("h3_edge_geometry", f"WITH {SEG}, p AS (SELECT id // 10 AS edge, row_number() OVER (PARTITION BY id // 10 ORDER BY id) AS n, x, y, x1, y1 FROM seg) SELECT edge, count(*) + 1 AS points, CAST(sum(x1 - x) AS BIGINT) AS dx FROM p GROUP BY edge")
def h3(spark, sf):
    """Pieces of an edge end to end, each but the first without the point it shares."""
    from pyspark.sql import Window as W

    n = F.row_number().over(W.partitionBy(F.expr("id div 10")).orderBy("id"))
    rows = seg(spark, sf).select(F.expr("id div 10").alias("edge"), n.alias("n"), "x", "x1")
    flat = rows.select("edge", F.explode(F.when(F.col("n") == 1, F.array("x", "x1")).otherwise(F.array("x1"))).alias("p"))
    turns = rows.groupBy("edge").agg(F.sum(F.col("x1") - F.col("x")).alias("dx"))
    return flat.groupBy("edge").agg(F.count("*").alias("points")).join(turns, "edge")
