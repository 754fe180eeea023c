"""Queries on geometry, routes and batches of requests."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from switchback.operators import geometry as M
from switchback.operators import spatial as S
from switchback.plans.catalog import query
from switchback.plans.graph_queries import _graph, _xy, per_graph
from switchback.search import graphs as G
from switchback.search import solver as L
from switchback.sources.views import EDGE, PROF, SEG, edge, prof, seg
from switchback.storage import table


def lines(spark, sf):
    geom = F.array(*[F.struct(F.col(x).alias("x"), F.col(y).alias("y")) for x, y in (("x", "y"), ("x1", "y1"), ("x2", "y2"))])
    return seg(spark, sf).select("id", geom.alias("geom"))


_SIDES = "l AS (SELECT id, 0 AS side, x AS ax, y AS ay, x1 AS bx, y1 AS b_y FROM seg UNION ALL SELECT id, 1, x1, y1, x2, y2 FROM seg), d AS (SELECT *, sqrt(CAST((bx - ax) ** 2 + (b_y - ay) ** 2 AS DOUBLE)) AS len FROM l), k AS (SELECT *, coalesce(sum(len) OVER (PARTITION BY id ORDER BY side ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS s0 FROM d)"


@query("w9_profile_sampling", f"WITH {SEG}, {_SIDES}, p AS (SELECT *, unnest(range(CAST(ceil(s0 / 25.0) AS BIGINT), CAST(ceil((s0 + len) / 25.0) AS BIGINT))) AS i FROM k WHERE len > 0) SELECT id, i, round(ax + (i * 25.0 - s0) / len * (bx - ax), 3) AS x, round(ay + (i * 25.0 - s0) / len * (b_y - ay), 3) AS y FROM p")
def w9(spark, sf):
    return M.sample(lines(spark, sf), 25.0).select("id", "i", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"))


@query("w10_densify", f"WITH {SEG}, {_SIDES}, p AS (SELECT *, greatest(CAST(ceil(len / 40.0) AS BIGINT), 1) AS n FROM k), q AS (SELECT *, unnest(range(0, n)) AS j FROM p) SELECT id, side, j AS k, round(ax + j / CAST(n AS DOUBLE) * (bx - ax), 4) AS x, round(ay + j / CAST(n AS DOUBLE) * (b_y - ay), 4) AS y FROM q")
def w10(spark, sf):
    return M.densify(lines(spark, sf), 40.0).select("id", "side", "k", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


@query("f25_polyline_clean_up", f"WITH {SEG} SELECT id, 1 + CAST(x <> x1 OR y <> y1 AS INTEGER) + CAST(x1 <> x2 OR y1 <> y2 AS INTEGER) AS n FROM seg")
def f25(spark, sf):
    return lines(spark, sf).select("id", F.size(M.without_repeats(F.col("geom"))).alias("n"))


@query("f11_proper_intersection", f"WITH {SEG} SELECT id, sign((x1 - x) * (y - y) - (y1 - y) * (x2 - x)) * sign((x1 - x) * (y1 + 3 - y) - (y1 - y) * (x1 - x)) < 0 AND sign((x1 - x2) * (y - y) - (y1 + 3 - y) * (x - x2)) * sign((x1 - x2) * (y1 - y) - (y1 + 3 - y) * (x1 - x2)) < 0 AS hit FROM seg")
def f11(spark, sf):
    """Each first side against one from (x2, y) to (x1, y1 + 3)."""
    c = F.col
    return seg(spark, sf).select("id", S.crosses(c("x"), c("y"), c("x1"), c("y1"), c("x2"), c("y"), c("x1"), c("y1") + 3).alias("hit"))


_CELLS = "cells AS (SELECT ix AS cx, iy AS cy, max(w) AS z FROM seg GROUP BY ix, iy)"


def _cells(spark, sf):
    return seg(spark, sf).groupBy(F.col("ix").alias("cx"), F.col("iy").alias("cy")).agg(F.max("w").alias("z"))


@query("j6_f7_bilinear_join", f"""WITH {SEG}, {_CELLS}, p AS (SELECT p_partkey AS key, (p_partkey * 7919) % 40000 / 2000.0 - 0.5 AS fx, (p_partkey * 104729) % 40000 / 2000.0 - 0.5 AS fy FROM part), o AS (SELECT key, floor(fx) AS bx, floor(fy) AS b_y, fx - floor(fx) AS fx, fy - floor(fy) AS fy, i, j FROM p, range(2) a(i), range(2) b(j))
SELECT key, CASE WHEN count(z) = 4 THEN CAST(round(4000000 * sum(CASE WHEN i = 1 THEN fx ELSE 1 - fx END * CASE WHEN j = 1 THEN fy ELSE 1 - fy END * z)) AS BIGINT) END AS z4m FROM o LEFT JOIN cells ON cx = bx + i AND cy = b_y + j GROUP BY key""")  # fmt: skip
def j6(spark, sf):
    """In four-millionths of a metre, of which every value is a whole number."""
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("key"), ((F.col("p_partkey") * 7919) % 40000).alias("px"), ((F.col("p_partkey") * 104729) % 40000).alias("py"))
    return M.bilinear_at(p, _cells(spark, sf), 2000).select("key", F.round(F.col("z") * 4e6).cast("bigint").alias("z4m"))


@query("f8_reliability_mask", f"WITH {SEG}, {_CELLS} SELECT a.cx AS row, a.cy AS col, NOT coalesce(max(abs(a.z - b.z)) > 15, false) AS ok FROM cells AS a LEFT JOIN cells AS b ON abs(a.cx - b.cx) + abs(a.cy - b.cy) = 1 GROUP BY a.cx, a.cy")
def f8(spark, sf):
    return M.reliable(_cells(spark, sf).toDF("row", "col", "z"), 15.0).select("row", "col", "ok")


@query("a18_downsample_and_blur", f"WITH {SEG}, {_CELLS}, d AS (SELECT cx // 2 AS i, cy // 2 AS j, avg(z) AS z FROM cells GROUP BY 1, 2) SELECT a.i, a.j, round(avg(b.z), 4) AS z FROM d AS a JOIN d AS b ON abs(a.i - b.i) <= 1 AND abs(a.j - b.j) <= 1 GROUP BY a.i, a.j")
def a18(spark, sf):
    d = _cells(spark, sf).groupBy(F.expr("cx div 2").alias("i"), F.expr("cy div 2").alias("j")).agg(F.avg("z").alias("z"))
    offsets = F.array(*[F.struct(F.lit(i).alias("di"), F.lit(j).alias("dj")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    near = d.withColumn("o", F.explode(offsets)).select((F.col("i") + F.col("o.di")).alias("i"), (F.col("j") + F.col("o.dj")).alias("j"), "z")
    return d.select("i", "j").join(near, ["i", "j"]).groupBy("i", "j").agg(F.round(F.avg("z"), 4).alias("z"))


@query("a12_covered_length", f"WITH {PROF} SELECT g, CAST(sum(wt) AS BIGINT) AS covered FROM (SELECT DISTINCT g, z, 1 + z % 9 AS wt FROM prof) GROUP BY g")
def a12(spark, sf):
    return prof(spark, sf).select("g", "z", (1 + F.col("z") % 9).alias("wt")).distinct().groupBy("g").agg(F.sum("wt").alias("covered"))


@query("j4_corridors_of_edges", f"""WITH {SEG}, p AS (SELECT id // 10 AS edge, nature * 7 + importance AS seg FROM seg), c AS (SELECT DISTINCT edge, seg FROM p) SELECT DISTINCT a.edge AS a, b.edge AS b FROM c AS a JOIN c AS b ON b.seg = a.seg AND b.edge > a.edge AND b.edge <= a.edge + 3""")
def j4(spark, sf):
    """Pairs of edges with pieces of one corridor, through the table of pieces."""
    pieces = seg(spark, sf).select(F.expr("id div 10").alias("edge"), (F.col("nature") * 7 + F.col("importance")).alias("seg")).distinct()
    near = pieces.select("edge", "seg", F.explode(F.sequence(F.col("edge") - 3, F.col("edge") - 1)).alias("a"))
    return near.join(pieces.select(F.col("edge").alias("a"), "seg"), ["a", "seg"]).select("a", F.col("edge").alias("b")).distinct()


@query("j11_nearest_elevation", f"""WITH {SEG}, n AS (SELECT s.id, m.w, m.id AS bid, (s.x - m.x1) ** 2 + (s.y - m.y1) ** 2 AS d2 FROM seg AS s JOIN seg AS m ON m.flags <> 1 AND m.id <> s.id AND m.x1 BETWEEN s.x - 120 AND s.x + 120 AND m.y1 BETWEEN s.y - 120 AND s.y + 120), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d2, bid) AS r FROM n WHERE d2 < 14400)
SELECT id, arg_min(w, d2 * 100000000 + bid) AS z FROM r WHERE r <= 4 GROUP BY id""")  # fmt: skip
def j11(spark, sf):
    rows = seg(spark, sf)
    a = rows.select(F.col("id").alias("aid"), F.col("x").alias("ax"), F.col("y").alias("ay"))
    b = rows.where("flags <> 1").select(F.col("id").alias("bid"), F.col("x1").alias("bx"), F.col("y1").alias("by"), "w")
    four = S.nearest(a, b, 120, 4, more="w", others=True)
    weighed = F.transform("near", lambda m: F.struct((m["d2"] * 100_000_000 + m["bid"]).alias("key"), m["bid"].alias("bid"), m["more"].alias("w")))
    return four.select(F.col("aid").alias("id"), F.array_min(weighed)["w"].alias("z"))


@query("j13_access_nodes", f"WITH {SEG} SELECT a.nature, arg_min(a.id, a.len * 1000000000 + a.id) AS id FROM seg AS a SEMI JOIN seg AS b ON b.ix = a.ix AND b.iy = a.iy AND b.importance = 6 WHERE a.importance < 3 GROUP BY a.nature")
def j13(spark, sf):
    rows = seg(spark, sf)
    net = rows.where("importance = 6").select("ix", "iy").distinct()
    return rows.where("importance < 3").join(net, ["ix", "iy"], "left_semi").groupBy("nature").agg(F.min_by("id", F.struct("len", "id")).alias("id"))


@query("j17_manifest_against_files", f"WITH {SEG}, a AS (SELECT ix, iy, sha256(CAST(sum(len) AS VARCHAR)) AS sha FROM seg GROUP BY ix, iy), b AS (SELECT ix, iy, sha256(CAST(sum(len) AS VARCHAR)) AS sha FROM seg WHERE nature <> 7 OR ix < 10 GROUP BY ix, iy) SELECT a.ix, a.iy, b.sha IS NOT NULL AS present FROM a LEFT JOIN b ON b.ix = a.ix AND b.iy = a.iy WHERE b.sha IS NULL OR b.sha <> a.sha")
def j17(spark, sf):
    digest = lambda rows: rows.groupBy("ix", "iy").agg(F.sha2(F.sum("len").cast("string"), 256).alias("sha"))
    rows = seg(spark, sf)
    files = digest(rows.where("nature <> 7 OR ix < 10")).withColumnRenamed("sha", "found")
    both = digest(rows).join(files, ["ix", "iy"], "left")
    return both.where(F.col("found").isNull() | (F.col("found") != F.col("sha"))).select("ix", "iy", F.col("found").isNotNull().alias("present"))


@query("j18_same_geometry", f"WITH {SEG}, l AS (SELECT id // 10 AS loop, list(DISTINCT nature ORDER BY nature) AS f FROM seg GROUP BY 1) SELECT min(loop) AS first, count(*) AS n FROM l GROUP BY f HAVING count(*) > 1")
def j18(spark, sf):
    loops = seg(spark, sf).groupBy(F.expr("id div 10").alias("loop")).agg(F.array_sort(F.collect_set("nature")).alias("f"))
    return loops.groupBy("f").agg(F.min("loop").alias("first"), F.count("*").alias("n")).where("n > 1").select("first", "n")


@query("o1_stable_row_order", f"WITH {SEG} SELECT ix, iy, id, row_number() OVER (PARTITION BY ix, iy ORDER BY id) AS row FROM seg")
def o1(spark, sf):
    return seg(spark, sf).select("ix", "iy", "id", F.row_number().over(W.partitionBy("ix", "iy").orderBy("id")).cast("bigint").alias("row"))


@query("o7_vias_by_abscissa", f"WITH {PROF} SELECT g, CAST(list(s ORDER BY s) AS VARCHAR) AS at FROM prof WHERE z % 41 = 0 GROUP BY g")
def o7(spark, sf):
    at = prof(spark, sf).where("z % 41 = 0").groupBy("g").agg(F.array_sort(F.collect_list("s")).alias("at"))
    return at.select("g", F.concat(F.lit("["), F.array_join(F.col("at").cast("array<string>"), ", "), F.lit("]")).alias("at"))


@query("o8_geocoder_top", "SELECT p_partkey, p_name FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 7")
def o8(spark, sf):
    return table(spark, sf, "part").orderBy(F.desc("p_retailprice"), "p_partkey").limit(5 + 2).select("p_partkey", "p_name")


@query("f14_poi_elevation", f"WITH {SEG}, {_CELLS} SELECT s_suppkey, max(z) AS z FROM supplier JOIN cells ON abs(cx - (s_suppkey * 7919) % 40000 // 2000) <= CASE WHEN s_suppkey % 2 = 0 THEN 1 ELSE 0 END AND abs(cy - (s_suppkey * 104729) % 40000 // 2000) <= CASE WHEN s_suppkey % 2 = 0 THEN 1 ELSE 0 END GROUP BY s_suppkey")
def f14(spark, sf):
    """Passes take the cell they are in, summits the highest around."""
    reach = F.when(F.col("s_suppkey") % 2 == 0, 1).otherwise(0)
    poi = table(spark, sf, "supplier").select("s_suppkey", F.expr("(s_suppkey * 7919) % 40000 div 2000").alias("px"), F.expr("(s_suppkey * 104729) % 40000 div 2000").alias("py"), reach.alias("r"))
    spread = poi.withColumn("i", F.explode(F.sequence(-F.col("r"), F.col("r")))).withColumn("j", F.explode(F.sequence(-F.col("r"), F.col("r")))).select("s_suppkey", (F.col("px") + F.col("i")).alias("cx"), (F.col("py") + F.col("j")).alias("cy"))
    return spread.join(_cells(spark, sf), ["cx", "cy"]).groupBy("s_suppkey").agg(F.max("z").alias("z"))


@query("g22_isolated_node_fallback", f"WITH {SEG}, t AS (SELECT ix, iy, avg(w) FILTER (flags = 3) AS mean FROM seg GROUP BY ix, iy) SELECT id, round(CASE WHEN flags = 3 THEN w ELSE mean END, 4) AS z FROM seg JOIN t USING (ix, iy)")
def g22(spark, sf):
    mean = F.avg(F.when(F.col("flags") == 3, F.col("w"))).over(W.partitionBy("ix", "iy"))
    return seg(spark, sf).withColumn("mean", mean).select("id", F.round(F.when(F.col("flags") == 3, F.col("w")).otherwise(F.col("mean")), 4).alias("z"))


@query("h5_nearest_vertex", f"WITH {SEG} SELECT CAST(min(least((x - 20000) ** 2 + (y - 20000) ** 2, CASE WHEN flags <> 0 THEN (x1 - 20000) ** 2 + (y1 - 20000) ** 2 ELSE 1e18 END)) AS BIGINT) AS d2 FROM seg")
def h5(spark, sf):
    d = lambda x, y: (F.col(x) - 20000) * (F.col(x) - 20000) + (F.col(y) - 20000) * (F.col(y) - 20000)
    return seg(spark, sf).agg(F.min(F.least(d("x", "y"), F.when(F.col("flags") != 0, d("x1", "y1")))).cast("bigint").alias("d2"))


@query("h6_segment_accessors", f"WITH {SEG} SELECT id, x AS first_x, y2 AS last_y, least(5 * 3, len) AS abscissa FROM seg")
def h6(spark, sf):
    s = lines(spark, sf).join(seg(spark, sf).select("id", "len"), "id")
    return s.select("id", F.element_at("geom", 1)["x"].alias("first_x"), F.element_at("geom", -1)["y"].alias("last_y"), F.least(F.lit(15), F.col("len")).alias("abscissa"))


@query("h12_corridor_and_junction_rules", f"WITH {EDGE}, n AS (SELECT g, count(*) AS pairs FROM edge AS e WHERE EXISTS (SELECT 1 FROM edge AS o WHERE o.g = e.g AND o.eid = e.eid + 1 AND o.w > 20) GROUP BY g), d AS (SELECT g, max(c) AS most FROM (SELECT g, u, count(*) AS c FROM edge GROUP BY g, u) GROUP BY g) SELECT d.g, coalesce(pairs, 0) AS pairs, most FROM d LEFT JOIN n ON n.g = d.g")
def h12(spark, sf):
    e = edge(spark, sf)
    mates = e.where("w > 20").select("g", (F.col("eid") - 1).alias("eid"))
    pairs = e.join(mates, ["g", "eid"], "left_semi").groupBy("g").agg(F.count("*").alias("pairs"))
    most = e.groupBy("g", "u").count().groupBy("g").agg(F.max("count").alias("most"))
    return most.join(pairs, "g", "left").select("g", F.coalesce("pairs", F.lit(0)).alias("pairs"), "most")


@query("h13_missed_vias", f"WITH {EDGE}, v AS (SELECT DISTINCT g, (g * 7 + k * 5) % 25 AS node FROM edge, range(4) t(k)) SELECT v.g, v.node FROM v WHERE NOT EXISTS (SELECT 1 FROM edge WHERE edge.g = v.g AND (edge.u = v.node OR edge.v = v.node))")
def h13(spark, sf):
    e = edge(spark, sf)
    vias = e.select("g").distinct().select("g", F.explode(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: (F.col("g") * 7 + k * 5) % 25)).alias("node")).distinct()
    return vias.join(e.select("g", F.explode(F.array("u", "v")).alias("node")).distinct(), ["g", "node"], "left_anti")


@query("h14_preferred_loop", f"WITH {SEG} SELECT ix, arg_max(id, CASE WHEN len < 400 THEN 1000000000000000 ELSE 0 END + w * 10000000 + id) AS id FROM seg GROUP BY ix")
def h14(spark, sf):
    return seg(spark, sf).groupBy("ix").agg(F.max_by("id", F.struct(F.col("len") < 400, "w", "id")).alias("id"))


@query("h20_problem_statistics", f"WITH {EDGE} SELECT g, count(*) AS edges, count(DISTINCT u) AS nodes, CAST(sum(len) AS BIGINT) AS len, CAST(sum(w) AS BIGINT) AS w FROM edge GROUP BY g")
def h20(spark, sf):
    return edge(spark, sf).groupBy("g").agg(F.count("*").alias("edges"), F.countDistinct("u").alias("nodes"), F.sum("len").alias("len"), F.sum("w").alias("w"))


@query("g15_route_points", f"WITH {EDGE} SELECT g, 2 * count(*) + 1 AS points, arg_min(u, eid) AS first, arg_min(u, eid) AS last, CAST(2 * sum(abs(u - v)) AS BIGINT) AS moved FROM edge GROUP BY g")
def g15(spark, sf):
    """The route over every edge twice, point by point: it closes, and moves as far as its edges do."""

    def kernel(k, g):
        twice = G.Graph(g.u + g.u, g.v + g.v, g.length + g.length)
        return [(k, n, e % len(g.u), twice.u[e] != a) for n, (e, a, _) in enumerate(G.circuit(twice, range(len(twice.u)), g.u[0]))]

    steps = per_graph(edge(spark, sf), kernel, "g bigint, seq bigint, edge bigint, backwards boolean")
    graph = edge(spark, sf).select("g", F.row_number().over(W.partitionBy("g").orderBy("eid")).alias("n"), "u", "v").select("g", (F.col("n") - 1).cast("bigint").alias("edge"), F.posexplode(F.array("u", "v")).alias("i", "node"))
    key = lambda rows: rows.withColumn("edge", F.struct("g", "edge"))
    points = M.route_points(key(steps).select("seq", "edge", "backwards"), key(graph).select("edge", "i", F.col("node").alias("x"), F.col("edge.g").alias("y")))
    order = F.struct("seq", "k")
    step = F.abs(F.col("x") - F.lag("x").over(W.partitionBy("y").orderBy("seq", "k")))
    moved = points.withColumn("step", step)
    return moved.groupBy(F.col("y").alias("g")).agg(F.count("*").alias("points"), F.min_by("x", order).alias("first"), F.max_by("x", order).alias("last"), F.sum("step").alias("moved"))


@query("l12_l13_relaxed_attempts", None)
def l13(spark, sf):
    """Each request is tried as asked, then with one demand relaxed at a time; the first that
    gives a feasible loop is kept, with the demand it gave up."""
    ladder = [("as asked", 600.0, 0.05), ("tolerance", 600.0, 0.3), ("distance", 900.0, 0.5)]

    def kernel(k, g):
        first = None
        for attempt, (relaxed, length, tol) in enumerate(ladder):
            case = L.Instance(g, g.u[0], "max", length, tol=tol)
            loop = L.probe(case, k, _xy(g), tries=3, rounds=8)
            row = (k, attempt, relaxed, bool(loop and case.feasible(loop)), *case.totals(loop or []))
            if row[3]:
                return [row]
            first = first or row
        return [first]

    return per_graph(edge(spark, sf), kernel, "g bigint, attempt int, relaxed string, feasible boolean, found_length double, found_w double")


@query("l9_infeasible_by_bound", f"WITH {EDGE} SELECT g, sum(w) < 1500 AS impossible FROM edge GROUP BY g")
def l9(spark, sf):
    from switchback.search.climbs import length_lower_bound

    return per_graph(edge(spark, sf), lambda k, g: [(k, length_lower_bound(g.length, g.w, [0] * len(g.u), 1500.0) is None)], "g bigint, impossible boolean")


@query("l14_l16_loop_messages", f"WITH {SEG} SELECT id, CASE WHEN len < 100 THEN 'fewer_loops' WHEN abs(len - 300) > 30 OR abs(w - 400) > 40 THEN 'target_not_reached' ELSE 'ok' END AS message FROM seg")
def l14(spark, sf):
    near = lambda c, t: F.abs(F.col(c) - t) <= 0.1 * t
    return seg(spark, sf).select("id", F.when(F.col("len") < 100, "fewer_loops").when(~(near("len", 300) & near("w", 400)), "target_not_reached").otherwise("ok").alias("message"))


@query("t4_unfinished_tiles", f"WITH {SEG}, m AS (SELECT ix, iy, count(*) AS n FROM seg GROUP BY ix, iy) SELECT ix, iy FROM m WHERE n <> 3 OR ix % 2 = 0")
def t4(spark, sf):
    m = seg(spark, sf).groupBy("ix", "iy").agg(F.count("*").alias("n"))
    done = m.where("n = 3 AND ix % 2 <> 0").select("ix", "iy", "n")
    return m.join(done, ["ix", "iy", "n"], "left_anti").select("ix", "iy")


@query("v5_label_ranges", f"WITH {SEG} SELECT count(*) FILTER (len // 34 > 15 OR len // 34 < 0) AS out_of_range, count(*) FILTER (nature NOT IN (2, 9) AND flags = 3 AND importance = 6) AS off_path FROM seg")
def v5(spark, sf):
    return seg(spark, sf).agg(F.count_if(~F.expr("len div 34").between(0, 15)).alias("out_of_range"), F.count_if(~F.col("nature").isin(2, 9) & (F.col("flags") == 3) & (F.col("importance") == 6)).alias("off_path"))


@query("k12_code_dimension", "SELECT kind, status, CAST(n AS BIGINT) AS n FROM (VALUES ('error', 400, 15), ('error', 403, 1), ('error', 404, 1), ('error', 422, 5), ('error', 500, 3), ('error', 503, 2), ('error', 504, 1), ('warning', 500, 15)) t(kind, status, n)")
def k12(spark, sf):
    from switchback.functions.messages import codes

    return codes(spark).groupBy("kind", "status").agg(F.count("*").alias("n"))


_PROBLEM = "version int, start bigint, edges array<struct<u:bigint,v:bigint,len:double,w:double>>"


@query("s20_k11_problem_documents", f"WITH {EDGE} SELECT g, count(*) AS edges, bool_or(u = g % 40 OR v = g % 40) AS valid FROM edge GROUP BY g")
def s20(spark, sf):
    """Instances written as JSON, read with a strict schema and checked; some name a start that no edge touches."""
    e = edge(spark, sf)
    made = e.groupBy("g").agg(F.to_json(F.struct(F.lit(1).alias("version"), (F.first("g") % 40).alias("start"), F.array_sort(F.collect_list(F.struct("u", "v", "len", "w"))).alias("edges"))).alias("j"))
    read = made.select("g", F.from_json("j", _PROBLEM, {"mode": "FAILFAST"}).alias("p"))
    sound = F.forall("p.edges", lambda x: (x["u"] >= 0) & (x["v"] >= 0) & (x["len"] > 0) & (x["w"] >= 0)) & F.col("p.version").between(1, 2) & F.exists("p.edges", lambda x: (x["u"] == F.col("p.start")) | (x["v"] == F.col("p.start")))
    return read.select("g", F.size("p.edges").cast("bigint").alias("edges"), sound.alias("valid"))


_DENSE = f"{_SIDES}, dn AS (SELECT *, greatest(CAST(ceil(len / 40.0) AS BIGINT), 1) AS n FROM k), dp AS (SELECT id, side, j, ax + j / CAST(n AS DOUBLE) * (bx - ax) AS x, ay + j / CAST(n AS DOUBLE) * (b_y - ay) AS y FROM (SELECT *, unnest(range(0, n)) AS j FROM dn))"


@query("f12_j7_calm_labels", f"""WITH {SEG}, {_DENSE}, mj AS (SELECT CAST(floor(x1 / 300.0) AS BIGINT) AS cx, CAST(floor(y1 / 300.0) AS BIGINT) AS cy, CAST(x1 AS DOUBLE) AS mx, CAST(y1 AS DOUBLE) AS my FROM seg WHERE nature IN (1, 5, 7, 8, 10) AND importance IN (1, 2, 3)),
nb AS (SELECT dp.*, CAST(floor(x / 300.0) AS BIGINT) + i AS cx, CAST(floor(y / 300.0) AS BIGINT) + o AS cy FROM dp, range(-1, 2) a(i), range(-1, 2) b(o)), nr AS (SELECT id, side, j, min((x - mx) ** 2 + (y - my) ** 2) AS d2 FROM nb LEFT JOIN mj USING (cx, cy) GROUP BY id, side, j)
SELECT nature, CAST(sum(CASE WHEN coalesce(d2, 1e9) < 90000 THEN 1 ELSE 0 END) AS BIGINT) AS near, round(avg(least(sqrt(coalesce(d2, 90000.0)), 300.0) / 300.0), 4) AS share FROM nr JOIN seg USING (id) GROUP BY nature""")  # fmt: skip
def calm(spark, sf):
    """How remote segments are: the distance of their points to the nearest major road, 300 m at most."""
    size, c = S.TILE_RADII * 300, F.col
    rows = seg(spark, sf).select("nature", F.array("x", "x1", "x2").alias("xs"), F.array("y", "y1", "y2").alias("ys"))
    cells = S.box_cells(F.array_min("xs"), F.array_min("ys"), F.array_max("xs"), F.array_max("ys"), size)
    dealt = rows.withColumn("t", F.explode(cells)).select("nature", "xs", "ys", c("t.i").alias("tx"), c("t.j").alias("ty"))  # a line goes to each tile that its box touches
    major = seg(spark, sf).where("nature IN (1, 5, 7, 8, 10) AND importance IN (1, 2, 3)").select(c("x1").alias("bx"), c("y1").alias("by"))
    parts = S.tiled(dealt, major, 300, _calm_kernel, "nature bigint, near bigint, points bigint, share double")
    return parts.groupBy("nature").agg(F.sum("near").alias("near"), F.round(F.sum("share") / F.sum("points"), 4).alias("share"))


def _calm_kernel(tile, rows, major):
    """For the points of a tile, by nature of their lines: how many have a major road near, how many there are, and
    the sum of their distances' shares of 300 m."""
    xs, ys = (np.stack(rows[c].combine_chunks().flatten().to_numpy().reshape(-1, 3)).astype(float) for c in ("xs", "ys"))
    nature = np.repeat(rows["nature"].to_numpy(), 2)
    row, x, y = M.densified(*(v.ravel() for v in (xs[:, :-1], ys[:, :-1], xs[:, 1:], ys[:, 1:])), 40.0)
    inside = (np.floor(x / (S.TILE_RADII * 300)) == tile[0]) & (np.floor(y / (S.TILE_RADII * 300)) == tile[1])
    kind, x, y = nature[row[inside]], x[inside], y[inside]
    d2 = np.full(len(x), np.inf)
    for at, _, found in S.nearest_rows((x, y), (major["bx"].to_numpy(), major["by"].to_numpy()), np.zeros(major.num_rows, np.int64), 300, 1):
        d2[at] = found
    kinds, place = np.unique(kind, return_inverse=True)
    total = lambda v: np.bincount(place, v, len(kinds))
    return pa.table({"nature": kinds, "near": total(d2 < 90000).astype(np.int64), "points": np.bincount(place, minlength=len(kinds)), "share": total(np.minimum(np.sqrt(d2), 300.0) / 300.0).astype(float)})


_TEN = f"{_SIDES}, dn AS (SELECT *, greatest(CAST(ceil(len / 10.0) AS BIGINT), 1) AS n FROM k), pt AS (SELECT id, side * 100000 + j AS i, s0 + j * len / n AS s, ax + j / CAST(n AS DOUBLE) * (bx - ax) AS x, ay + j / CAST(n AS DOUBLE) * (b_y - ay) AS y FROM (SELECT *, unnest(range(0, n)) AS j FROM dn))"


@query("j3_parallel_corridors", f"""WITH {SEG}, {_TEN}, g AS (SELECT *, lag(x) OVER w AS xa, lead(x) OVER w AS xb, lag(y) OVER w AS ya, lead(y) OVER w AS yb, lag(s) OVER w AS sa, lead(s) OVER w AS sb, max(s) OVER (PARTITION BY id) - min(s) OVER (PARTITION BY id) AS length FROM pt WINDOW w AS (PARTITION BY id ORDER BY i)),
h AS (SELECT id, i, x, y, length, (coalesce(sb, s) - coalesce(sa, s)) / q AS wt, (coalesce(xb, x) - coalesce(xa, x)) / q AS u, (coalesce(yb, y) - coalesce(ya, y)) / q AS v FROM (SELECT *, CASE WHEN xa IS NOT NULL AND xb IS NOT NULL THEN 2.0 ELSE 1.0 END AS q FROM g) WHERE length >= 30),
t AS (SELECT *, u / (sqrt(u * u + v * v) + 1e-12) AS tu, v / (sqrt(u * u + v * v) + 1e-12) AS tv, CAST(floor(x / 15) AS BIGINT) AS cx, CAST(floor(y / 15) AS BIGINT) AS cy FROM h), m AS (SELECT t.*, cx + i1 AS nx, cy + j1 AS ny FROM t, range(-1, 2) p(i1), range(-1, 2) r(j1)),
n AS (SELECT a.id AS a, b.id AS b, a.i AS ai, b.i AS bi, a.wt AS aw, b.wt AS bw, a.length AS al, b.length AS bl FROM t AS a JOIN m AS b ON a.cx = b.nx AND a.cy = b.ny AND a.id < b.id WHERE (a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= 225 AND abs(a.tu * b.tu + a.tv * b.tv) >= 0.9),
ca AS (SELECT a, b, sum(aw) AS c, max(least(al, bl)) AS short FROM (SELECT DISTINCT a, b, ai, aw, al, bl FROM n) GROUP BY a, b), cb AS (SELECT a, b, sum(bw) AS c FROM (SELECT DISTINCT a, b, bi, bw FROM n) GROUP BY a, b)
SELECT ca.a, ca.b, round(least(ca.c, cb.c), 3) AS covered FROM ca JOIN cb ON ca.a = cb.a AND ca.b = cb.b WHERE least(ca.c, cb.c) >= greatest(30.0, 0.6 * short)""")  # fmt: skip
def corridors(spark, sf):
    """Segments side by side: densified to 10 m, joined within 15 m, covered lengths on both sides."""
    sides = M.sides(lines(spark, sf)).withColumn("n", F.greatest(F.ceil(F.col("len") / 10.0), F.lit(1))).withColumn("j", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)))
    t = F.col("j") / F.col("n")
    points = sides.select("id", (F.col("side") * 100000 + F.col("j")).alias("i"), (F.col("s0") + F.col("j") * F.col("len") / F.col("n")).alias("s"), (F.col("ax") + t * (F.col("bx") - F.col("ax"))).alias("x"), (F.col("ay") + t * (F.col("by") - F.col("ay"))).alias("y"))
    return S.parallel_corridors(points).select("a", "b", F.round("covered", 3).alias("covered"))
