import numpy as np
import pytest

from switchback.search import climbs as C
from switchback.search import graphs as G
from switchback.search import solver as L


def test_climbs_by_hand():
    z = [0, 40, 32, 70, 50, 80, 79, 80]
    assert C.climbs(z, np.arange(8) * 10.0) == [(70.0, 30.0), (30.0, 10.0)]
    s = np.array([0, 1000, 1100, 2100.0])
    assert C.climbs([0, 100, 80, 180], s) == [(180.0, 2100.0)]
    assert len(C.climbs([0, 100, 40, 140], s)) == 2
    assert len(C.climbs([0, 100, 80, 180], np.array([0, 1000, 1400, 2400.0]))) == 2
    assert C.climbs([0, 0, 0], np.arange(3.0)) == [] and C.climbs([5], [0.0]) == [] and C.climbs([], []) == []
    assert C.climbs([80, 40, 0], np.arange(3) * 10.0, descents=True) == [(80.0, 20.0)]


def test_hysteresis_by_hand(spark):
    from pyspark.sql import functions as F

    from switchback.operators.profiles import ascent_with_hysteresis

    rows = spark.createDataFrame([([100, 103, 101, 130, 126, 140, 120, 124, 121, 150],), ([7],), ([0, 4, 8, 3, 9],)], "z array<int>")
    assert [r[0] for r in rows.select(ascent_with_hysteresis(F.col("z"))).collect()] == [70.0, 0.0, 14.0]


def test_length_bound_by_hand():
    length, w = [100, 100, 1000], [50, 10, 10]
    assert C.length_lower_bound(length, w, [0, 0, 0], 55) == pytest.approx(150)
    assert C.length_lower_bound(length, w, [5000, 0, 0], 15) == pytest.approx(600)
    assert C.length_lower_bound(length, w, [5000, 0, 0], 50) == pytest.approx(5000)
    assert C.length_lower_bound(length, w, [0, 0, 0], 71) is None


def test_grade_cap():
    s = np.arange(0, 205, 5.0)
    ramp = s * 1.0
    assert np.allclose(C.cap_road_grade(s, ramp, 1.0), ramp)
    cliff = np.where(s > 100, 20.0, 0.0)
    out = C.cap_road_grade(s, cliff, 0.3)
    assert abs(np.diff(out)).max() <= 1.5 + 1e-9 and out[0] == 0 and out[-1] == 20


def test_simplify():
    x = np.arange(100.0)
    assert C.simplify(x, x * 2, 0.1).tolist() == [0, 99]
    keep = C.simplify(x, np.where(x == 50, 9.0, 0.0), 1.0)
    assert {0, 49, 50, 51, 99} == set(keep.tolist())


def two_squares():
    """Two squares joined by a bridge, a dead end at the far side."""
    u = [0, 1, 2, 3, 2, 4, 5, 6, 7, 5]
    v = [1, 2, 3, 0, 4, 5, 6, 7, 4, 8]
    return G.Graph(u, v, [100] * 10, range(10))


def test_bridges_prune_and_components():
    g = two_squares()
    assert G.bridges(g) == {4, 9}
    assert sorted(map(sorted, G.loop_components(g))) == [[0, 1, 2, 3], [5, 6, 7, 8]]
    assert G.prune(g, 0, 400) == [0, 1, 2, 3] and G.prune(g, 0, 399) == [] and G.prune(g, 8, 1e9) == []
    assert G.access_bridges(g, 0) == {4} and G.access_bridges(g, 8) == {4, 9}
    more = G.duplicate_near_start(g, 2, 150)
    assert len(more.u) == 11 and 4 not in G.bridges(more)
    multi = G.Graph([0, 0, 1, 1], [1, 1, 1, 2], [1, 1, 1, 1])
    assert G.bridges(multi) == {3}


def test_contraction():
    g = G.Graph([0, 1, 2, 2], [1, 2, 0, 3], [1, 2, 4, 8], [1, 1, 1, 1])
    small, chains = G.contract(g)
    assert sorted(small.length) == [7, 8] and sorted(map(len, chains)) == [1, 3]
    same, _ = G.contract(g, [True, False, True, False])
    assert len(same.u) == 3


def test_circuit_and_rules():
    g = two_squares()
    walk = G.circuit(g, [0, 1, 2, 3], 0)
    assert walk[0][1] == walk[-1][2] == 0 and {e for e, *_ in walk} == {0, 1, 2, 3}
    with pytest.raises(ValueError):
        G.circuit(g, [0, 1], 0)
    assert G.violations(g, [0, 1, 2, 3], 0) == [] and "odd degree" in G.violations(g, [0, 1], 0)
    assert "misses the start" in G.violations(g, [5, 6, 7, 8], 0) and G.violations(g, [], 0) == ["empty"]
    assert "two edges of a corridor" in G.violations(g, [0, 1, 2, 3], 0, corridors=[(0, 2)])


def grid(n):
    u, v = [], []
    for i in range(n):
        for j in range(n):
            if j + 1 < n:
                u.append(i * n + j), v.append(i * n + j + 1)
            if i + 1 < n:
                u.append(i * n + j), v.append(i * n + j + n)
    r = np.random.default_rng(4)
    xy = {k: (k % n * 100.0, k // n * 100.0) for k in range(n * n)}
    return G.Graph(u, v, [100.0] * len(u), r.integers(1, 30, len(u))), xy


def test_faces_of_a_grid():
    g, xy = grid(4)
    assert len(G.half_edge_cycles(g, xy)) == 10  # nine squares and the outside
    assert len(G.faces(g, xy, 400)) == 9


def test_harmonic():
    z = G.harmonic([0, 1, 2], [1, 2, 3], [1, 1, 2], {0: 0.0, 3: 8.0})
    assert z == {1: pytest.approx(2.0), 2: pytest.approx(4.0)} and G.harmonic([0], [1], [1], {0: 1.0, 1: 2.0}) == {}


@pytest.mark.parametrize("mode", ["max", "target", "min_distance"])
def test_search_against_the_cycle_space(mode):
    g, xy = grid(4)
    case = L.Instance(g, 5, mode, 1200.0, 150.0, tol=0.2)
    best = L.best_by_cycle_space(case)
    found = [L.probe(case, seed, xy) for seed in range(4)]
    assert found == [L.probe(case, seed, xy) for seed in range(4)]  # by seed only
    assert all(case.valid(loop) for loop in found)
    top = max(found, key=case.key)
    assert case.key(top) <= case.key(best)
    assert case.feasible(top) == case.feasible(best) and case.score(top) >= case.score(best) - 0.2 * abs(case.score(best))


def test_alternates_differ():
    g, xy = grid(5)
    case = L.Instance(g, 12, "max", 1200.0, tol=0.3)
    found = [loop for s in range(8) if (loop := L.probe(case, s, xy))]
    best = max(found, key=case.key)
    for loop in L.alternates(case, best, found, 2):
        assert case.valid(loop) and L.overlap(case, best, loop) <= 0.9


def test_spread_out():
    points = [(0, 0), (1, 0), (10, 0), (20, 0)]
    assert G.spread_out(points, [1, 5, 2, 3], 2, 5) == [1, 3]


def test_components_of_long_chains(spark):
    from switchback.operators.components import connected_components

    pairs = [(k, k + 1) for k in range(60)] + [(200, 201), (201, 201), (300, None), (201, 200)] + [(500, k) for k in range(501, 560)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(pairs, "u bigint, v bigint")).collect()}
    assert got == {**dict.fromkeys(range(61), 0), 200: 200, 201: 200, **dict.fromkeys(range(500, 560), 500)}
    assert connected_components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


def test_pauses(spark):
    import datetime as dt

    from switchback.streaming.alarms import pause_intervals

    at = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)
    trips = spark.createDataFrame([("a", at(0), False), ("a", at(30), False), ("a", at(200), False), ("b", at(0), True), ("b", at(90), False)], "service string, ts timestamp, budget boolean")
    got = sorted((r["service"], r["start"], r["end"]) for r in pause_intervals(trips).collect())
    assert [g[:2] for g in got] == [("a", at(0)), ("a", at(200)), ("b", at(0))]
    assert got[0][2] == at(90) and got[1][2] == at(260) and got[2][2] is None


def test_alarm_stream(spark, tmp_path):
    """The same windows from a stream as from the table."""
    from pyspark.sql import functions as F

    from switchback.streaming.alarms import compute_budget

    rows = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    want = {(r["start"], round(r["total"], 4)) for r in compute_budget(rows, 60).collect()}
    rows.orderBy("ts").coalesce(1).write.parquet(f"{tmp_path}/in")
    last = spark.createDataFrame([(-1, None, 0, "x", 0.0, "")], rows.schema).withColumn("ts", F.lit("2030-01-01").cast("timestamp")).select(*rows.columns)
    last.withColumns({f.name: F.col(f.name).cast(f.dataType) for f in rows.schema}).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    query = compute_budget(stream, 60).writeStream.outputMode("append").format("memory").queryName("budget").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert {(r["start"], round(r["total"], 4)) for r in spark.table("budget").collect()} == want


def test_projection_control_points(spark):
    from pyspark.sql import functions as F

    from switchback.functions import geo

    x, y = geo.conic_forward(F.lit(2.2713), F.lit(48.7309))
    row = spark.range(1).select(x, y).first()
    assert row[0] == pytest.approx(646404.333891, abs=1e-3) and row[1] == pytest.approx(6848111.158720, abs=1e-3)


def test_texts(spark):
    from pyspark.sql import functions as F

    from switchback.functions import text as T

    raw = [("48.5, 2.25", (48.5, 2.25)), ("48,5; 2,25", (48.5, 2.25)), ("48.5 2.25", (48.5, 2.25)), ("95, 2", None), ("x", None), (None, None), ("48, 2", (48.0, 2.0))]
    rows = spark.createDataFrame(list(enumerate(r for r, _ in raw)), "k int, t string")
    got = {r["k"]: r["p"] and tuple(r["p"]) for r in rows.select("k", T.parse_lat_lon(F.col("t")).alias("p")).collect()}
    assert got == {k: want for k, (_, want) in enumerate(raw)}
    lines = spark.createDataFrame([("w7 v1 Thighway=track,name=a%20%b%2c%c Nn1x2.5y48,n2x2.6y-4.25",), ("r9 v1 Troute=hiking Mw7@,w8@main",), ("n1 v1",)], "value string")
    ways = {r["id"]: r for r in T.read_opl(lines).collect()}
    assert ways[7]["tags"] == {"highway": "track", "name": "a b,c"} and [tuple(n) for n in ways[7]["nodes"]] == [(1, 2.5, 48.0), (2, 2.6, -4.25)]
    assert [tuple(m) for m in ways[9]["members"]] == [("w", 7), ("w", 8)] and len(ways) == 2


def test_portable_draws():
    from switchback.search import random as R

    assert R.draws(0, 3).tolist() == [0xE220A8397B1DCDAF, 0x6E789E6AA1B965F4, 0x06C45D188009454F]
    u = R.uniform(7, 4000)
    assert 0 <= u.min() and u.max() < 1 and abs(u.mean() - 0.5) < 0.03 and abs(R.normal(7, 4000).std() - 1) < 0.05


def test_messages(spark):
    import hashlib
    import hmac

    from pyspark.sql import functions as F

    from switchback.functions import messages as MS

    rows = {r["code"]: r for r in MS.codes(spark).collect()}
    assert len(rows) == 43 and rows["busy"]["status"] == 503 and rows["roads_unknown"]["status"] == 400 and rows["fewer_loops"]["params"] == ["asked", "got"]
    m = spark.range(1).select(MS.message("fewer_loops", asked=3, got=F.col("id")).alias("m"), MS.message("busy").alias("b")).first()
    assert m["m"]["params"] == {"asked": 3.0, "got": 0.0} and m["b"]["params"] == {}
    with pytest.raises(ValueError):
        MS.message("busy", km=1)
    for key in (b"k", b"x" * 100):
        got = spark.createDataFrame([("é text",), ("",)], "t string").select(MS.hmac_sha256(key, F.col("t"))).collect()
        assert [r[0] for r in got] == [hmac.new(key, t.encode(), hashlib.sha256).hexdigest() for t in ("é text", "")]


def test_reduction_access_and_corridor():
    g, _ = grid(5)
    kept = G.steep_part(g, 12, 300.0, times=2.0)
    assert sum(sorted((g.w[e] for e in range(len(g.u))), reverse=True)[:6]) <= sum(g.w[e] for e in kept) and len(kept) < len(g.u)
    assert len(G.components(g, kept)) == 1
    h = two_squares()
    assert G.access(h, 8, [0, 1, 2, 3], 2000, 2500) == [9, 5, 4] or G.access(h, 8, [0, 1, 2, 3], 2000, 2500) is not None
    assert G.access(h, 8, [0, 1, 2, 3], 400, 500) is None and G.access(h, 0, [0, 1, 2, 3], 400, 500) == []
    assert G.corridor_loop(h, 0, 2) == [0, 1, 2, 3] and G.corridor_loop(h, 0, 5) is None


def test_edge_quality_and_turns():
    s = np.arange(5) * 100.0
    assert C.edge_quality([0, 50, 100, 150, 200], s) == 20000.0 and C.edge_quality([0, 0, 0, 0, 0], s) == 0
    assert C.turn_signature([0, 50, 0]) == (1, 1, 0.5) and C.turn_signature([0, 5]) == (0, 0, 0.0) and C.turn_signature([0, 20, 40]) == (1, -1, 0.0)


def test_parallel_corridor_table(spark):
    """Pairs of lines by distance, direction and length, and whether they share a corridor."""
    from switchback.operators.spatial import parallel_corridors

    table = [
        ((0, 0, 200, 0), (0, 10, 200, 10), True), ((0, 0, 200, 0), (0, 25, 200, 25), False), ((0, 0, 200, 0), (200, 10, 0, 10), True), ((0, 0, 20, 0), (0, 5, 20, 5), False), ((0, 0, 400, 0), (0, 10, 40, 10), True),
        ((0, 0, 400, 0), (0, 10, 25, 10), False), ((0, 0, 200, 0), (100, -100, 100, 100), False), ((0, 0, 200, 0), (200, 0, 400, 0), False), ((0, 0, 200, 0), (0, 0, 173, 100), False),
    ]
    rows = []
    for k, (a, b, _) in enumerate(table):
        for n, (x0, y0, x1, y1) in enumerate((a, b)):
            length = float(np.hypot(x1 - x0, y1 - y0))
            for i in range(int(length // 5) + 1):
                t = 5 * i / length
                rows.append((2 * k + n, i, 5.0 * i, x0 + t * (x1 - x0), 5000.0 * k + y0 + t * (y1 - y0)))
    found = {(r["a"], r["b"]) for r in parallel_corridors(spark.createDataFrame(rows, "id bigint, i bigint, s double, x double, y double")).collect()}
    assert found == {(2 * k, 2 * k + 1) for k, (*_, want) in enumerate(table) if want}


def test_pause_stream(spark, tmp_path):
    import datetime as dt

    from switchback.streaming.alarms import pause_events

    at = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)
    schema = "service string, ts timestamp, budget boolean"
    for k, rows in enumerate([[("a", at(0), False), ("b", at(0), True)], [("a", at(30), False)], [("a", at(200), False), ("b", at(210), False)], [("z", at(9000), False)], [("z", at(9001), False)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    query = pause_events(stream).writeStream.outputMode("append").format("memory").queryName("pauses").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    query.awaitTermination(240)
    got = [(r["service"], r["event"], r["at"]) for r in spark.table("pauses").orderBy("service", "at").collect() if r["service"] != "z"]
    assert got == [("a", "pause", at(0)), ("a", "resume", at(90)), ("a", "pause", at(200)), ("a", "resume", at(260)), ("b", "pause", at(0))]


def test_fast_check_agrees_with_the_rules():
    g, _ = grid(3)
    rng = np.random.default_rng(1)
    case = L.Instance(g, 4, corridors=[(0, 7), (2, 3)], simple_nodes=[1, 4])
    for _ in range(4000):
        edges = sorted(rng.choice(len(g.u), size=int(rng.integers(0, 9)), replace=False).tolist())
        assert case.valid(edges) == (not G.violations(g, edges, 4, case.corridors, case.simple))
    best = L.best_by_cycle_space(L.Instance(g, 4, length=800.0))
    assert case.valid(best) == (not G.violations(g, best, 4, case.corridors, case.simple))


def climbs_by_steps(z, s):
    """The rules of climbs, one at a time, as an independent check."""
    spans, low, top = [], 0, None
    for i in range(len(z)):
        if top is None:
            low = i if z[i] < z[low] else low
            top = i if z[i] >= z[low] + 10 else None
        else:
            top = i if z[i] > z[top] else top
            if z[top] - z[i] >= sorted((10, 0.15 * (z[top] - z[low]), 25))[1]:
                spans, low, top = [*spans, (low, top)], i, None
    spans += [(low, top)] if top is not None else []
    while True:
        costs = []
        for (a, b), (c, d) in zip(spans, spans[1:]):
            costs.append(max(0, (s[c] - s[b]) / (0.25 * min(s[b] - s[a], s[d] - s[c])), (z[b] - z[c]) / (0.3 * min(z[b] - z[a], z[d] - z[c]))))
        if not costs or min(costs) > 1:
            return [(z[b] - z[a], s[b] - s[a]) for a, b in spans]
        k = costs.index(min(costs))
        spans[k : k + 2] = [(spans[k][0], spans[k + 1][1])]


def test_climbs_of_random_profiles():
    rng, merged = np.random.default_rng(5), 0
    for n in [0, 1, 2, *[120] * 150]:
        z, s = np.cumsum(rng.integers(-9, 12, n)).astype(float), np.arange(n) * 5.0
        want = climbs_by_steps(z, s) if n else []
        assert C.climbs(z, s) == want
        merged += len(C.base_climbs(z)) > len(want)
    assert merged > 5


def test_contraction_of_rings_and_random_graphs():
    ring, chains = G.contract(G.Graph([0, 1, 2], [1, 2, 0], [1, 2, 4]))
    assert (ring.u, ring.v, ring.length, len(chains[0])) == ([0], [0], [7.0], 3)
    rng = np.random.default_rng(6)
    for _ in range(60):
        u, v = rng.integers(0, 9, (2, 11))
        g = G.Graph(u, v, rng.integers(1, 9, 11))
        small, chains = G.contract(g)
        assert sorted(e for chain in chains for e in chain) == list(range(11))
        degree = lambda g: {n: sum((a == n) + (b == n) for a, b in zip(g.u, g.v)) for n in {*g.u, *g.v}}
        full = degree(g)
        assert all(full[n] == d for n, d in degree(small).items())
        for k, chain in enumerate(chains):  # a chain is a walk from one end to the other
            at = small.u[k]
            for e in chain:
                assert at in (g.u[e], g.v[e])
                at = g.other(e, at)
            assert at == small.v[k] and small.length[k] == sum(g.length[e] for e in chain)
        for n, d in degree(small).items():
            own = [e for e in range(len(small.u)) if n in (small.u[e], small.v[e])]
            assert d != 2 or len(own) == 1


def test_circuits_of_random_even_graphs():
    rng = np.random.default_rng(7)
    for _ in range(80):
        walk = rng.integers(0, 7, 14).tolist()
        nodes = [*walk, walk[0]]
        g = G.Graph(nodes[:-1], nodes[1:], [1] * 14)
        found = G.circuit(g, rng.permutation(14).tolist(), walk[3])
        assert sorted(e for e, *_ in found) == list(range(14)) and found[0][1] == found[-1][2] == walk[3]
        assert all(a[2] == b[1] for a, b in zip(found, found[1:])) and all({a, b} == {g.u[e], g.v[e]} for e, a, b in found)
