"""Queries on scalar functions, requests, texts and reports."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from switchback.functions import geo as G
from switchback.functions import messages as MS
from switchback.functions import planning as PL
from switchback.functions import text as T
from switchback.operators import spatial as S
from switchback.plans.catalog import query
from switchback.sources.views import SEG, seg
from switchback.storage import table

_E, _A = G.E, G.A
_LL = "ll AS (SELECT s_suppkey AS k, 2.0 + (s_suppkey * 37 % 500) / 100.0 AS lon, 43.0 + (s_suppkey * 53 % 700) / 100.0 AS lat FROM supplier)"


def _lonlat(spark, sf):
    s = table(spark, sf, "supplier")
    return s.select(F.col("s_suppkey").alias("k"), (2.0 + (F.col("s_suppkey") * 37 % 500) / 100.0).alias("lon"), (43.0 + (F.col("s_suppkey") * 53 % 700) / 100.0).alias("lat"))


def _iso(phi):
    return f"ln(tan({math.pi / 4!r} + {phi} / 2) * pow((1 - {_E} * sin({phi})) / (1 + {_E} * sin({phi})), {_E / 2!r}))"


_CONE = f"{G.CONE_C} * exp(-{G.CONE_N} * {_iso('radians(lat)')})"


@query("f1_conic_forward", f"WITH {_LL} SELECT k, round({G.CONE_X} + {_CONE} * sin({G.CONE_N} * radians(lon - 3.0)), 3) AS x, round({G.CONE_Y} - {_CONE} * cos({G.CONE_N} * radians(lon - 3.0)), 3) AS y FROM ll")
def f1(spark, sf):
    x, y = G.conic_forward(F.col("lon"), F.col("lat"))
    return _lonlat(spark, sf).select("k", F.round(x, 3).alias("x"), F.round(y, 3).alias("y"))


@query("f1_conic_round_trip", f"WITH {_LL} SELECT k, round(lon, 7) AS lon, round(lat, 7) AS lat FROM ll")
def f1b(spark, sf):
    x, y = G.conic_forward(F.col("lon"), F.col("lat"))
    lon, lat = G.conic_inverse(F.col("x"), F.col("y"))
    return _lonlat(spark, sf).select("k", x.alias("x"), y.alias("y")).select("k", F.round(lon, 7).alias("lon"), F.round(lat, 7).alias("lat"))


@query("f1_conic_scale", f"WITH {_LL} SELECT k, round({G.CONE_N} * {_CONE} * sqrt(1 - pow({_E} * sin(radians(lat)), 2)) / ({_A} * cos(radians(lat))), 9) AS scale FROM ll")
def f1c(spark, sf):
    return _lonlat(spark, sf).select("k", F.round(G.conic_scale(F.col("lat")), 9).alias("scale"))


@query("f2_utm_round_trip", f"WITH {_LL} SELECT k, round(lon - 5 + 57, 7) AS lon, round(lat - 65, 7) AS lat FROM ll")
def f2(spark, sf):
    rows = _lonlat(spark, sf).select("k", (F.col("lon") - 5 + 57).alias("lon"), (F.col("lat") - 65).alias("lat"))
    x, y = G.utm_forward(2975, F.col("lon"), F.col("lat"))
    lon, lat = G.utm_inverse(2975, F.col("x"), F.col("y"))
    return rows.select("k", x.alias("x"), y.alias("y")).select("k", F.round(lon, 7).alias("lon"), F.round(lat, 7).alias("lat"))


_N = "(1 / (2 * 298.257222101 - 1))"
_KRUGER = [f"({_N} / 2 - 2 * pow({_N}, 2) / 3 + 5 * pow({_N}, 3) / 16 + 41 * pow({_N}, 4) / 180)", f"(13 * pow({_N}, 2) / 48 - 3 * pow({_N}, 3) / 5 + 557 * pow({_N}, 4) / 1440)", f"(61 * pow({_N}, 3) / 240 - 103 * pow({_N}, 4) / 140)", f"(49561 * pow({_N}, 4) / 161280)"]
_UTM_SUMS = [" + ".join(f"{a} * {f}({2 * k} * xi) * {h}({2 * k} * eta)" for k, a in enumerate(_KRUGER, 1)) for f, h in (("sin", "cosh"), ("cos", "sinh"))]


@query("f2_utm_forward", f"""WITH {_LL}, p AS (SELECT k, radians(lat - 65) AS phi, radians(lon - 5) AS lam FROM ll), t AS (SELECT k, lam, sinh(atanh(sin(phi)) - {_E} * atanh({_E} * sin(phi))) AS t FROM p), x AS (SELECT k, atan2(t, cos(lam)) AS xi, atanh(sin(lam) / sqrt(1 + t * t)) AS eta FROM t),
r AS (SELECT *, 0.9996 * {_A} / (1 + {_N}) * (1 + pow({_N}, 2) / 4 + pow({_N}, 4) / 64) AS r FROM x) SELECT k, round(500000 + r * (eta + {_UTM_SUMS[1]}), 4) AS x, round(10000000 + r * (xi + {_UTM_SUMS[0]}), 4) AS y FROM r""")
def f2f(spark, sf):
    x, y = G.utm_forward(2975, F.col("lon") - 5 + 57, F.col("lat") - 65)
    return _lonlat(spark, sf).select("k", F.round(x, 4).alias("x"), F.round(y, 4).alias("y"))


@query("f3_local_frame", f"WITH {SEG} SELECT id, round((x - 20000) / 0.9995, 4) AS lx, round((y - 20000) / 0.9995, 4) AS ly FROM seg")
def f3(spark, sf):
    lx, ly = G.local_frame(F.col("x"), F.col("y"), F.lit(20000), F.lit(20000), F.lit(0.9995))
    return seg(spark, sf).select("id", F.round(lx, 4).alias("lx"), F.round(ly, 4).alias("ly"))


@query("f5_node_key", f"WITH {SEG} SELECT id, x * 4294967296 + y AS key, x AS ux, y AS uy FROM seg")
def f5(spark, sf):
    ux, uy = G.unpack_node(F.col("key"))
    return seg(spark, sf).withColumn("key", G.pack_node(F.col("x"), F.col("y"))).select("id", "key", ux.alias("ux"), uy.alias("uy"))


@query("f7_bilinear", f"WITH {SEG} SELECT id, round((w * (1 - fx) + len * fx) * (1 - fy) + (x * (1 - fx) + y * fx) * fy, 5) AS z FROM (SELECT *, (id % 10) / 10.0 AS fx, (id % 7) / 7.0 AS fy FROM seg)")
def f7(spark, sf):
    z = G.bilinear(F.col("w"), F.col("len"), F.col("x"), F.col("y"), (F.col("id") % 10) / 10.0, (F.col("id") % 7) / 7.0)
    return seg(spark, sf).select("id", F.round(z, 5).alias("z"))


@query("f9_point_segment_distance", f"""WITH {SEG}, t AS (SELECT id, x, y, x2, y2, least(greatest(((x1 - x) * (x2 - x) + (y1 - y) * (y2 - y)) / greatest(CAST((x2 - x) ** 2 + (y2 - y) ** 2 AS DOUBLE), 1e-12), 0.0), 1.0) AS t, x1, y1 FROM seg)
SELECT id, round((x + t * (x2 - x) - x1) ** 2 + (y + t * (y2 - y) - y1) ** 2, 4) AS d2 FROM t""")  # fmt: skip
def f9(spark, sf):
    d2 = S.segment_distance2(*[F.col(c).cast("double") for c in ("x1", "y1", "x", "y", "x2", "y2")])
    return seg(spark, sf).select("id", F.round(d2, 4).alias("d2"))


@query("f10_fallback_chain", f"WITH {SEG} SELECT id, coalesce(CASE WHEN flags > 2 THEN w END, CASE WHEN flags > 1 THEN len END, CASE WHEN nature > 5 THEN x END, y) AS z FROM seg")
def f10(spark, sf):
    return seg(spark, sf).select("id", F.coalesce(F.when(F.col("flags") > 2, F.col("w")), F.when(F.col("flags") > 1, F.col("len")), F.when(F.col("nature") > 5, F.col("x")), F.col("y")).alias("z"))


@query("f12_calm_label", f"WITH {SEG} SELECT id, CAST(round_even(15 * (len / 500.0) * CASE WHEN importance = 4 THEN 0.6 ELSE 1.0 END, 0) AS INTEGER) AS calm FROM seg")
def f12(spark, sf):
    return seg(spark, sf).select("id", PL.calm(F.col("len") / F.lit(500.0), F.when(F.col("importance") == 4, 0.6).otherwise(1.0)).alias("calm"))


@query("f13_version_bump", "SELECT DISTINCT p_brand || CASE WHEN p_size % 3 = 0 THEN '.' || (p_size + 1) ELSE '.1' END AS v FROM part")
def f13(spark, sf):
    v = F.when(F.col("p_size") % 3 == 0, F.concat("p_brand", F.lit("."), F.col("p_size").cast("string"))).otherwise(F.col("p_brand"))
    return table(spark, sf, "part").select(PL.next_version(v).alias("v")).distinct()


_REQ = "r AS (SELECT o_orderkey AS id, ['max', 'target', 'min_distance'][CAST(o_orderkey % 3 + 1 AS INT)] AS mode, 2000.0 + o_custkey % 98 * 1000 AS len, 50.0 + o_orderkey % 4000 AS up, 1 + o_custkey % 4 AS n FROM orders)"


def _requests(spark, sf):
    o = table(spark, sf, "orders")
    mode = F.when(F.col("o_orderkey") % 3 == 0, "max").when(F.col("o_orderkey") % 3 == 1, "target").otherwise("min_distance")
    return o.select(F.col("o_orderkey").alias("id"), mode.alias("mode"), (2000.0 + F.col("o_custkey") % 98 * 1000).alias("len"), (50.0 + F.col("o_orderkey") % 4000).alias("up"), (1 + F.col("o_custkey") % 4).alias("n"))


@query("f16_score", f"""WITH {_REQ} SELECT id, round(CASE mode WHEN 'max' THEN up - 3 * (up / greatest(len, 1.0)) * greatest(len - 40000, 0.0) - 0.5 * n WHEN 'target' THEN -(abs(len - 40000) / 40000 + abs(up - 800) / 800) ELSE -len - 100 * greatest(800 - up, 0.0) - 10 * greatest(len - 60000, 0.0) END - 1e6 * (n % 2), 5) AS score FROM r""")
def f16(spark, sf):
    s = PL.score(F.col("mode"), F.col("len"), F.col("up"), F.lit(40000), F.lit(800), F.lit(60000), F.col("n"), F.col("n") % 2)
    return _requests(spark, sf).select("id", F.round(s, 5).alias("score"))


@query("f16_feasible", f"WITH {_REQ} SELECT id, (CASE WHEN mode = 'min_distance' THEN up >= 800 AND len <= 60000 ELSE len BETWEEN 30000 AND 60000 END) AND n % 2 = 0 AS feasible FROM r")
def f16b(spark, sf):
    return _requests(spark, sf).select("id", PL.feasible(F.col("mode"), F.col("len"), F.col("up"), F.lit(30000), F.lit(60000), F.lit(800), F.col("n") % 2).alias("feasible"))


@query("f17_on_target", f"WITH {_REQ} SELECT id, abs(len - 40000) <= 0.08 * 40000 AS held FROM r")
def f17(spark, sf):
    return _requests(spark, sf).select("id", PL.on_target(F.col("len"), F.lit(40000)).alias("held"))


@query("f18_suggested_time", f"WITH {_REQ} SELECT id, least(greatest(5.0 * round((20.0 + greatest(len / 1000 - 10.0, 0.0) * 40.0 / 90.0) / 5.0), 20.0) * (1.0 + 0.5 * (n + 1)), 180.0) AS seconds FROM r")
def f18(spark, sf):
    return _requests(spark, sf).select("id", PL.suggested_seconds(F.col("len") / 1000, F.col("n") + 2).alias("seconds"))


@query("f19_default_cap", f"WITH {_REQ} SELECT id, round(least(greatest(up / CASE WHEN n < 3 THEN 15.0 ELSE 25.0 END, 3.0), 60.0), 6) AS cap FROM r")
def f19(spark, sf):
    return _requests(spark, sf).select("id", F.round(PL.cap_km(F.col("up"), F.col("n") * 200 + 1), 6).alias("cap"))


@query("f20_h22_default_radius", f"WITH {_REQ} SELECT id, round(least(len / 2.0, sqrt(0.99 * 1965e6 / {math.pi!r})), 4) AS radius FROM r")
def f20(spark, sf):
    return _requests(spark, sf).select("id", F.round(PL.radius_m(F.col("len")), 4).alias("radius"))


@query("f21_length_bounds", f"WITH {_REQ} SELECT id, round(CAST(CASE mode WHEN 'max' THEN len * 0.95 WHEN 'target' THEN 0.7 * len ELSE 0 END AS DOUBLE), 4) AS low, round(CAST(CASE mode WHEN 'max' THEN len * 1.05 WHEN 'target' THEN 1.3 * len ELSE len END AS DOUBLE), 4) AS high FROM r")
def f21(spark, sf):
    b = PL.length_bounds(F.col("mode"), F.col("len"), F.lit(0.05))
    return _requests(spark, sf).select("id", F.round(b["low"], 4).alias("low"), F.round(b["high"], 4).alias("high"))


@query("f22_region_shrink", f"WITH {_REQ} SELECT id, round(CASE WHEN up * 1000 > 650000 THEN len * 0.95 * sqrt(650000.0 / (up * 1000)) ELSE len END, 4) AS radius FROM r")
def f22(spark, sf):
    return _requests(spark, sf).select("id", F.round(PL.shrink_radius(F.col("len"), F.col("up") * 1000, 650000), 4).alias("radius"))


@query("f24_edge_angles", f"WITH {SEG} SELECT id, round(atan2(y1 - y, x1 - x), 8) AS a FROM seg")
def f24(spark, sf):
    return seg(spark, sf).select("id", F.round(G.angle_at(F.col("x"), F.col("y"), F.col("x1"), F.col("y1")), 8).alias("a"))


@query("f28_effort_km", f"WITH {_REQ} SELECT id, round(len / 1000 + up / 100.0, 4) AS effort FROM r")
def f28(spark, sf):
    return _requests(spark, sf).select("id", F.round(PL.effort_km(F.col("len") / 1000, F.col("up")), 4).alias("effort"))


@query("f29_compute_estimate", f"""WITH {_REQ} SELECT id, round(least(15.0, (3.2 + 0.085 * (len / 1000)) * (1 + 0.12 * (CASE WHEN len > 40000 AND n > 2 THEN 2 ELSE n END - 1)) * CASE WHEN mode = 'min_distance' THEN 0.6 ELSE 1.0 END * CASE WHEN n >= 3 AND mode <> 'target' THEN 1.8 ELSE 1.0 END) + 0.5, 6) AS seconds FROM r""")
def f29(spark, sf):
    return _requests(spark, sf).select("id", F.round(PL.compute_seconds(F.col("len") / 1000, F.col("n"), F.col("mode"), F.when(F.col("n") >= 3, "long").otherwise("balanced")), 6).alias("seconds"))


@query("f33_digests", "SELECT p_partkey, sha256(p_name) AS sha, upper(hex(p_name)) AS hx FROM part")
def f33(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.sha2("p_name", 256).alias("sha"), F.hex("p_name").alias("hx"))


@query("f35_slippy_tile", f"WITH {_LL} SELECT k, CAST(floor((lon + 180) / 360 * 4096.0) AS BIGINT) AS tx, CAST(floor((1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / {math.pi!r}) / 2 * 4096.0) AS BIGINT) AS ty FROM ll")
def f35(spark, sf):
    x, y = G.slippy_tile(F.col("lon"), F.col("lat"), 12)
    return _lonlat(spark, sf).select("k", x.alias("tx"), y.alias("ty"))


@query("f35_terrarium", f"WITH {SEG} SELECT id, (id % 256) * 256 + w % 256 + (x % 256) / 256.0 - 32768 AS z FROM seg")
def f35b(spark, sf):
    return seg(spark, sf).select("id", G.terrarium(F.col("id") % 256, F.col("w") % 256, F.col("x") % 256).alias("z"))


@query("f37_bearing", f"WITH {_LL} SELECT k, round((degrees(atan2((lon - 4.0) * cos(radians(45.0)), lat - 45.0)) + 360) % 360, 6) AS bearing FROM ll WHERE lon <> 4.0 OR lat <> 45.0")
def f37(spark, sf):
    return _lonlat(spark, sf).where("lon <> 4.0 OR lat <> 45.0").select("k", F.round(G.bearing(F.lit(45.0), F.lit(4.0), F.col("lat"), F.col("lon")), 6).alias("bearing"))


@query("l7_budgets", f"WITH {_REQ} SELECT id, CAST(floor(3e5 * 20.0 / (1 + 0.5 * (n - 1))) AS BIGINT) AS faces, round(least(greatest(3.5e7 / (up * 10), 5e3), 3e4) * least(1.0, 4.0 / 5.0), 4) AS classic FROM r")
def l7(spark, sf):
    return _requests(spark, sf).select("id", PL.face_iterations(F.lit(20.0), F.col("n")).alias("faces"), F.round(PL.classic_mutations(F.col("up") * 10, F.lit(4.0)), 4).alias("classic"))


@query("h18_target_error", f"WITH {_REQ} SELECT id, round(abs(len - 40000) / 40000 + abs(up - 800) / 800, 6) AS error FROM r")
def h18(spark, sf):
    return _requests(spark, sf).select("id", F.round(F.abs(F.col("len") - 40000) / 40000 + F.abs(F.col("up") - 800) / 800, 6).alias("error"))


_RULES = [("distance_out_of_range", "len < 3000 OR len > 90000"), ("dplus_out_of_range", "up > 3900"), ("candidates_reduced", "n > 3 AND len > 40000"), ("target_dplus_above_bound", "mode = 'target' AND up < 60")]


@query("p13_request_validation", f"WITH {_REQ} SELECT id, array_to_string(list_filter([{', '.join(f'''CASE WHEN {t} THEN '{c}' END''' for c, t in _RULES)}], lambda e: e IS NOT NULL), ',') AS errors FROM r")
def p13(spark, sf):
    errors = F.array_compact(F.array(*[F.when(F.expr(test), code) for code, test in _RULES]))
    return _requests(spark, sf).select("id", F.array_join(errors, ",").alias("errors"))


@query("f23_status_counts", f"WITH {_REQ} SELECT CASE WHEN len < 3000 THEN 400 WHEN up > 3900 THEN 422 WHEN n = 4 THEN 503 ELSE 500 END AS status, count(*) AS n FROM r GROUP BY ALL")
def f23(spark, sf):
    code = F.when(F.col("len") < 3000, "distance_out_of_range").when(F.col("up") > 3900, "dplus_unreachable_proven").when(F.col("n") == 4, "busy").otherwise("invariant_violated")
    return _requests(spark, sf).groupBy(MS.status_of(code).alias("status")).agg(F.count("*").alias("n"))


@query("s21_query_parameters", """SELECT page_id, split_part(split_part(url, '://', 2), '/', 1) AS host, CASE WHEN regexp_extract(url, '[?&]page=([^&#]*)', 1) = '' THEN NULL ELSE CAST(regexp_extract(url, '[?&]page=([^&#]*)', 1) AS INTEGER) END AS page FROM pages""")
def s21(spark, sf):
    pages = table(spark, sf, "pages")
    return pages.select("page_id", F.parse_url("url", F.lit("HOST")).alias("host"), F.try_parse_url("url", F.lit("QUERY"), F.lit("page")).try_cast("int").alias("page"))


@query("s19_parse_lat_lon", f"WITH {_LL} SELECT k, CASE WHEN k % 9 = 0 THEN NULL ELSE round(lat, 6) END AS lat, CASE WHEN k % 9 = 0 THEN NULL ELSE round(lon, 6) END AS lon FROM ll")
def s19(spark, sf):
    """Every ninth text has a latitude out of range."""
    lat, lon = F.format_string("%.6f", F.col("lat") + F.when(F.col("k") % 9 == 0, 90.0).otherwise(0.0)), F.format_string("%.6f", "lon")
    raw = F.when(F.col("k") % 3 == 0, F.concat(lat, F.lit(", "), lon)).when(F.col("k") % 3 == 1, F.concat(F.translate(lat, ".", ","), F.lit("; "), F.translate(lon, ".", ","))).otherwise(F.concat(lat, F.lit(" "), lon))
    p = T.parse_lat_lon(raw)
    return _lonlat(spark, sf).select("k", p["lat"].alias("lat"), p["lon"].alias("lon"))


@query("s13_f15_opl_tags", """SELECT p_partkey AS id, CASE p_size % 3 WHEN 0 THEN 'track' WHEN 1 THEN 'path' ELSE 'primary' END AS highway, CASE p_size % 3 WHEN 0 THEN p_size % 2 = 0 WHEN 1 THEN true ELSE false END AS unpaved, 2 AS nodes FROM part""")
def s13(spark, sf):
    """Ways written as OPL lines and read back."""
    kind = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("highway=track,tracktype="), F.when(F.col("p_size") % 2 == 0, "grade2").otherwise("grade1"))).when(F.col("p_size") % 3 == 1, "highway=path").otherwise("highway=primary")
    lines = table(spark, sf, "part").select(F.concat(F.lit("w"), F.col("p_partkey").cast("string"), F.lit(" v1 T"), kind, F.lit(" Nn1x2.5y48.5,n2x2.6y48.6")).alias("value"))
    ways = T.read_opl(lines).where("kind = 'w'")
    return ways.select("id", F.try_element_at("tags", F.lit("highway")).alias("highway"), T.is_unpaved(F.col("tags")).alias("unpaved"), F.size("nodes").alias("nodes"))


@query("s11_geojson_features", f"WITH {SEG} SELECT id, flags = 1 AS flat, nature NOT IN (4, 5) AS ok, 3 AS n FROM seg WHERE importance <> 6")
def s11(spark, sf):
    """Features written as JSON and read with a fixed schema; only lines are kept."""
    coords = F.array(*[F.array(F.col(x), F.col(y)) for x, y in (("x", "y"), ("x1", "y1"), ("x2", "y2"))])
    feature = F.to_json(F.struct("id", F.when(F.col("flags") == 1, "1").otherwise("0").alias("pos"), (F.col("nature") == 4).alias("private"), F.when(F.col("nature") == 5, "closed").otherwise("open").alias("state"), F.struct(F.when(F.col("importance") == 6, "Point").otherwise("LineString").alias("type"), coords.alias("coordinates")).alias("geometry")))
    schema = "id bigint, pos string, private boolean, state string, geometry struct<type:string,coordinates:array<array<double>>>"
    read = seg(spark, sf).select(F.from_json(feature, schema, {"mode": "FAILFAST"}).alias("f")).select("f.*")
    lines = read.where((F.col("geometry.type") == "LineString") & (F.size("geometry.coordinates") >= 2))
    return lines.select("id", (F.coalesce("pos", F.lit("0")) != "0").alias("flat"), (~F.col("private") & (F.col("state") == "open")).alias("ok"), F.size("geometry.coordinates").alias("n"))


@query("k6_gpx_tracks", "SELECT s_suppkey AS k, '<?xml version=\"1.0\" encoding=\"UTF-8\"?><gpx version=\"1.1\" creator=\"switchback\" xmlns=\"http://www.topografix.com/GPX/1/1\"><trk><name>' || s_name || ' &amp; co</name><trkseg>' || format('<trkpt lat=\"{:.7f}\" lon=\"{:.7f}\"><ele>{:.1f}</ele></trkpt>', 43.0 + (s_suppkey * 53 % 700) / 100.0, 2.0 + (s_suppkey * 37 % 500) / 100.0, CAST(s_suppkey AS DOUBLE)) || '</trkseg></trk></gpx>' AS gpx FROM supplier")
def k6(spark, sf):
    rows = _lonlat(spark, sf).join(table(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"), "s_name"), "k")
    return rows.select("k", T.gpx(F.concat("s_name", F.lit(" & co")), F.array(F.struct("lat", "lon", F.col("k").cast("double").alias("ele")))).alias("gpx"))


@query("k7_track_rounding", f"WITH {_LL} SELECT k, round(lat, 6) AS lat, round(lon, 6) AS lon FROM ll")
def k7(spark, sf):
    """Track JSON written and read back."""
    made = _lonlat(spark, sf).select("k", T.track_json(F.array(F.struct("lat", "lon", F.col("k").cast("double").alias("ele")))).alias("j"))
    read = made.select("k", F.from_json("j", "lat array<double>, lon array<double>, ele array<double>").alias("t"))
    return read.select("k", F.get("t.lat", F.lit(0)).alias("lat"), F.get("t.lon", F.lit(0)).alias("lon"))


@query("k14_history_top50", "SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 50")
def k14(spark, sf):
    from pyspark.sql import Window as W

    order = W.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return table(spark, sf, "events").withColumn("r", F.row_number().over(order)).where("r <= 50").select("user_id", "event_id")


@query("t1_compute_budget", "SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS start, round(sum(value), 4) AS total, count(*) AS n FROM events WHERE event_type IN ('view', 'click') GROUP BY 1 HAVING sum(value) > 90")
def t1(spark, sf):
    from switchback.streaming.alarms import compute_budget

    rows = compute_budget(table(spark, sf, "events").where("event_type IN ('view', 'click')"), 90)
    return rows.select("start", F.round("total", 4).alias("total"), "n")


@query("t2_error_windows", "SELECT time_bucket(INTERVAL 15 MINUTE, ts) AS start, count(*) FILTER (event_type = 'error') AS errors, round(max(value), 4) AS worst FROM events GROUP BY 1 HAVING count(*) FILTER (event_type = 'error') > 0")
def t2(spark, sf):
    from switchback.streaming.alarms import errors

    rows = errors(table(spark, sf, "events"))
    return rows.select("start", "errors", F.round("worst", 4).alias("worst"))


@query("t3_pauses", """WITH RECURSIVE e AS (SELECT user_id % 5 AS service, ts, value > 300 AS budget, row_number() OVER (PARTITION BY user_id % 5 ORDER BY ts, event_id) AS n FROM events WHERE event_type = 'error'),
s(service, n, start, until) AS (SELECT service, n, ts, CASE WHEN budget THEN TIMESTAMP '9999-01-01' ELSE ts + INTERVAL 3 HOUR END FROM e WHERE n = 1 UNION ALL SELECT e.service, e.n, CASE WHEN e.ts > s.until THEN e.ts ELSE s.start END, CASE WHEN e.budget THEN TIMESTAMP '9999-01-01' ELSE greatest(s.until, e.ts + INTERVAL 3 HOUR) END FROM s JOIN e ON e.service = s.service AND e.n = s.n + 1)
SELECT service, start, nullif(max(until), TIMESTAMP '9999-01-01') AS "end" FROM s GROUP BY service, start""")
def t3(spark, sf):
    """Pauses of services after errors, as islands of a table; the SQL runs the state machine row by row."""
    from switchback.streaming.alarms import pause_intervals

    trips = table(spark, sf, "events").where("event_type = 'error'").select((F.col("user_id") % 5).alias("service"), "ts", (F.col("value") > 300).alias("budget"))
    return pause_intervals(trips, 3 * 3600)


_KEY = b"a key of a service"
_PADS = [bytes(b ^ x for b in _KEY.ljust(64, b"\0")).hex() for x in (0x36, 0x5C)]


@query("k9_keyed_digest", f"SELECT p_partkey, sha256(unhex('{_PADS[1]}') || unhex(sha256(unhex('{_PADS[0]}') || encode(p_name)))) AS mac FROM part")
def k9(spark, sf):
    return table(spark, sf, "part").select("p_partkey", MS.hmac_sha256(_KEY, F.col("p_name")).alias("mac"))


_SURFACES = "unpaved compacted fine_gravel gravel pebblestone dirt earth ground grass mud sand woodchips rock clay soil stone asphalt paved wood concrete".split()


@query("p2_soft_ways", f"""SELECT p_partkey AS id, CASE p_size % 4 WHEN 0 THEN p_partkey % {len(_SURFACES)} < 16 WHEN 1 THEN p_size % 3 <> 0 WHEN 2 THEN false ELSE p_partkey % 2 = 0 END AS soft FROM part""")
def p2(spark, sf):
    """Ways by surface (the first of a list, trimmed), then by kind."""
    surface = F.get(F.array(*[F.lit(x) for x in _SURFACES]), (F.col("p_partkey") % len(_SURFACES)).cast("int"))
    tags = F.when(F.col("p_size") % 4 == 0, F.create_map(F.lit("surface"), F.concat(F.lit(" "), surface, F.lit(" ;asphalt"))))
    tags = tags.when(F.col("p_size") % 4 == 1, F.create_map(F.lit("highway"), F.lit("track"), F.lit("tracktype"), F.when(F.col("p_size") % 3 == 0, "grade1").otherwise("grade3")))
    tags = tags.when(F.col("p_size") % 4 == 2, F.create_map(F.lit("highway"), F.lit("path"), F.lit("surface"), F.lit("asphalt"))).otherwise(F.create_map(F.lit("highway"), F.when(F.col("p_partkey") % 2 == 0, "bridleway").otherwise("footway")))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), T.is_unpaved(tags).alias("soft"))
