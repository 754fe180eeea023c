import re

import pytest
from pyspark.sql import functions as F

from switchback.functions import geo
from switchback.plans import etl, requests


def test_parse(spark):
    rows = [
        "lat=45.1&lon=5.7", "?lat=45&lon=5&goal=target&dplus_m=800&distance_km=50&n_candidates=4", "lat=45&lon=5&goal=target", "lat=95&lon=5", "lat=45&lon=5&lat=46", "lat=45&lon=5&colour=red", "lat=45&lon=5&distance_km=ten",
        "lat=45&lon=5&max_grade_pct=3&roads=air&climbs=steep&seed=1000", "lat=45&lon=5&goal=min%5Fdistance&dplus_m=500", "", None, "lat=45&lon=5&polygon=1,2;3,4",
    ]
    got = {r["k"]: r for r in requests.parse(spark.createDataFrame(list(enumerate(rows)), "k int, query string")).collect()}
    errors = {k: r["errors"] for k, r in got.items()}
    assert errors == {
        0: [], 1: [], 2: ["target_dplus_required"], 3: ["invalid_request"], 4: ["invalid_request"], 5: ["invalid_request"], 6: ["invalid_request"], 7: ["roads_unknown", "climbs_unknown", "max_grade_invalid", "invalid_request"], 8: [],
        9: ["invalid_request"], 10: ["invalid_request"], 11: ["zone_invalid"],
    }
    assert (got[1]["mode"], got[1]["length"], got[1]["loops"], got[1]["warnings"]) == ("target", 50000.0, 2, ["candidates_reduced"])
    assert got[8]["mode"] == "min_distance" and got[0]["loops"] == 3 and got[3]["status"] == 400 and got[0]["status"] == 200


def world(spark, n=6, step=100.0):
    rows, k = [], 0
    z = lambda x, y: 100 + 0.05 * x + 10 * ((x // step + y // step) % 3)
    for i in range(n):
        for j in range(n):
            for di, dj in ((1, 0), (0, 1)):
                if i + di < n and j + dj < n:
                    a, b = (i * step, j * step), ((i + di) * step, (j + dj) * step)
                    geom, zs = [a, b], [z(*a), z(*b)]
                    rows.append((k, geom, zs, step, abs(zs[1] - zs[0]), 9, 5, abs(zs[1] - zs[0]) / step))
                    k += 1
    return spark.createDataFrame(rows, "id bigint, geom array<struct<x:double,y:double>>, z array<double>, len double, w double, nature int, importance int, grade double")


def test_plan_end_to_end(spark):
    parsed = requests.parse(spark.createDataFrame([(1, "lat=45&lon=5&distance_km=2&n_candidates=2"), (2, "lat=45&lon=5&max_distance_km=2&goal=min_distance&dplus_m=60"), (3, "lat=45&lon=5&roads=unpaved&distance_km=2&max_grade_pct=5")], "request_id bigint, query string"))
    asked = parsed.where("size(errors) = 0").withColumns({"x0": F.lit(200.4), "y0": F.lit(199.7)})
    loops = requests.with_texts(requests.plan(asked, world(spark)), lambda x, y: geo.conic_inverse(x + 700000, y + 6600000)).collect()
    by = {}
    for r in loops:
        by.setdefault(r["request_id"], []).append(r)
    assert set(by) == {1, 2, 3}
    for r in by[1] + by[2]:
        points = r["points"]
        assert (points[0]["x"], points[0]["y"]) == (200.0, 200.0) == (points[-1]["x"], points[-1]["y"])
        assert r["length"] == pytest.approx(100.0 * len(r["edges"])) and len(points) == len(r["edges"]) + 1
        up = sum(max(0, b["z"] - a["z"]) for a, b in zip(points, points[1:]))
        assert up == pytest.approx(r["dplus"] / 2, abs=1e-6)
        assert len(re.findall("<trkpt", r["gpx"])) == len(points)
    assert by[1][0]["feasible"] and 1900 <= by[1][0]["length"] <= 2100
    assert by[2][0]["feasible"] and by[2][0]["dplus"] >= 60
    again = requests.plan(asked, world(spark).repartition(7)).collect()
    assert sorted((r["request_id"], r["rank"], r["edges"]) for r in again) == sorted((r["request_id"], r["rank"], r["edges"]) for r in loops)


def test_parse_points_and_flags(spark):
    rows = ["lat=45&lon=5&via=45.1,5.1;45.2,5.2", "lat=45&lon=5&via=45.1", "lat=45&lon=5&polygon=5,45;6,45;6,46&no_repeat_junction=false", "lat=45&lon=5&polygon=5,45;6;7,8", "lat=45&lon=5&no_repeat_junction=maybe", "lat=45&lon=5&goal=min_distance&dplus_m=500&max_distance_km=20", "lat=45&lon=5&goal=min_distance&dplus_m=500", "lat=45&lon=5&diagnose=1"]
    got = {r["k"]: r for r in requests.parse(spark.createDataFrame(list(enumerate(rows)), "k int, query string")).collect()}
    assert [got[k]["errors"] for k in range(8)] == [[], ["invalid_request"], [], ["zone_invalid"], ["invalid_request"], [], [], ["invalid_request"]]
    assert [tuple(p) for p in got[0]["via"]] == [(45.1, 5.1), (45.2, 5.2)] and got[0]["no_repeat"] and got[0]["polygon"] is None
    assert [tuple(p) for p in got[2]["polygon"]] == [(5.0, 45.0), (6.0, 45.0), (6.0, 46.0)] and not got[2]["no_repeat"]
    assert (got[5]["length"], got[6]["length"]) == (20000.0, 20000.0)


def asked(spark, **more):
    row = {"request_id": 1, "x0": 200.0, "y0": 200.0, "mode": "max", "length": 1200.0, "ascent": None, "roads": "minor", "climbs": "balanced", "loops": 1, "seed": 0, "max_grade": 60.0, "via_xy": None, "polygon_xy": None, "no_repeat": False} | more
    schema = "request_id bigint, x0 double, y0 double, mode string, length double, ascent double, roads string, climbs string, loops int, seed int, max_grade double, via_xy array<struct<x:double,y:double>>, polygon_xy array<struct<x:double,y:double>>, no_repeat boolean"
    return spark.createDataFrame([tuple(row.values())], schema)


def sound(row, start):
    """A closed track from the start, as long as it says, that runs on the grid and uses no stretch twice."""
    xyz = [(p["x"], p["y"], p["z"]) for p in row["points"]]
    assert xyz[0][:2] == start == xyz[-1][:2]
    steps = [(a[:2], b[:2]) for a, b in zip(xyz, xyz[1:])]
    assert row["length"] == pytest.approx(sum(abs(a[0] - b[0]) + abs(a[1] - b[1]) for a, b in steps))
    assert all(a[0] == b[0] or a[1] == b[1] for a, b in steps) and len({frozenset(s) for s in steps}) == len(steps)
    assert row["dplus"] == pytest.approx(sum(abs(a[2] - b[2]) for a, b in zip(xyz, xyz[1:])), abs=1e-6)


def test_plan_cuts_a_line_at_the_start_and_passes_vias(spark):
    (row,) = requests.plan(asked(spark, x0=205.0, y0=190.0, via_xy=[(352.0, 303.0), (100.0, 240.0)], length=1400.0), world(spark)).collect()
    sound(row, (200.0, 190.0))
    assert row["feasible"] and {(352.0, 300.0), (100.0, 240.0)} <= {(p["x"], p["y"]) for p in row["points"]}
    (far,) = requests.plan(asked(spark, via_xy=[(900.0, 900.0)]), world(spark)).collect()
    assert far["messages"] == ["via_too_far"] and not far["feasible"]


def test_plan_stays_in_a_polygon_and_repeats_no_junction(spark):
    ring = [(150.0, 150.0), (450.0, 150.0), (450.0, 450.0), (150.0, 450.0)]
    (row,) = requests.plan(asked(spark, polygon_xy=ring, length=800.0, no_repeat=True), world(spark)).collect()
    sound(row, (200.0, 200.0))
    assert all(200 <= p[c] <= 400 for p in row["points"] for c in ("x", "y"))
    inner = [(p["x"], p["y"]) for p in row["points"][1:-1]]
    assert len(set(inner)) == len(inner)
    (none,) = requests.plan(asked(spark, polygon_xy=[(0.0, 0.0), (10.0, 0.0), (10.0, 10.0)]), world(spark)).collect()
    assert none["messages"] == ["no_way_in_zone"]


def test_plan_of_the_least_distance_and_preferences(spark):
    (row,) = requests.plan(asked(spark, mode="min_distance", length=2000.0, ascent=60.0), world(spark)).collect()
    sound(row, (200.0, 200.0))
    assert row["feasible"] and row["dplus"] >= 60 and row["length"] <= 2000
    (low,) = requests.plan(asked(spark, mode="min_distance", length=2000.0, ascent=9000.0), world(spark)).collect()
    assert low["messages"] == ["dplus_unreachable_proven"]
    for climbs in ("short", "long"):
        rows = requests.plan(asked(spark, climbs=climbs, loops=2), world(spark)).collect()
        for row in rows:
            sound(row, (200.0, 200.0))
        assert rows[0]["feasible"] and len({tuple(sorted(r["edges"])) for r in rows}) == len(rows)


def test_build(spark):
    rows = [(1, [(0.0, 0.0), (100.0, 0.0)], 9, 5, False), (2, [(100.0, 0.0), (160.0, 0.0)], 9, 5, True), (3, [(160.0, 0.0), (160.0, 52.0)], 7, 5, False), (4, [(0.0, 500.0), (40.0, 500.0)], 9, 5, False)]
    segments = spark.createDataFrame(rows, "id bigint, geom array<struct<x:double,y:double>>, nature int, importance int, flat boolean")
    spike = lambda x, y: F.when(y > 400, F.lit(None)).when((x > 48) & (x < 52), 300.0).when(F.abs(x - 130) < 25, 20.0).otherwise(100.0 + x * 0.1 + F.when(y > 26, 40.0).otherwise(0.0)).cast("double")
    built = {r["id"]: r for r in etl.build(segments, spike).collect()}
    assert set(built) == {1, 2, 3}  # nothing is known of 4
    assert [built[k]["len_dm"] for k in (1, 2, 3)] == [1000, 600, 520] and [len(built[k]["z_dm"]) for k in (1, 2, 3)] == [21, 13, 12]
    for r in built.values():
        z = r["z_dm"]
        assert r["dplus_dm"] - r["dminus_dm"] == z[-1] - z[0]
    assert max(built[1]["z_dm"]) <= 1101 and built[1]["z_dm"][-1] == built[2]["z_dm"][0] and built[2]["z_dm"][-1] == built[3]["z_dm"][0]
    assert max(abs(b - a) for a, b in zip(built[2]["z_dm"], built[2]["z_dm"][1:])) <= 6  # straight over the gorge
    assert max(abs(b - a) for a, b in zip(built[3]["z_dm"], built[3]["z_dm"][1:])) < 400


def test_check(spark):
    tiles = spark.createDataFrame([(0, 0, 5000, 30, 0.0, 0), (0, 1, 100, 0, 0.7, 5), (0, 2, 100, 0, 0.02, 0)], "ix int, iy int, n long, jumps long, nodata_frac double, node_fallback long")
    expected = spark.createDataFrame([(0, 0), (0, 3)], "ix int, iy int")
    got = sorted(tuple(r) for r in etl.check(tiles, expected).collect())
    assert got == [(0, 0, "jumps", True), (0, 1, "no data", True), (0, 1, "nodes without elevation", False), (0, 2, "some data missing", False), (0, 3, "missing", True)]
