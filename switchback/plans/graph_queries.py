"""Queries on graphs and climbs: one task handles one request's small graph."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from switchback.operators.components import connected_components
from switchback.operators.grouped import map_groups
from switchback.plans.catalog import query
from switchback.search import climbs as C
from switchback.search import graphs as G
from switchback.search import solver as L
from switchback.sources.views import EDGE, PROF, edge, prof
from switchback.storage import table


def _graph(columns) -> G.Graph:
    return G.Graph(columns["u"], columns["v"], columns["len"], columns["w"], columns["eid"])


def _xy(g: G.Graph):
    return {n: (n * 37 % 101, n * 53 % 97) for n in {*g.u, *g.v}}


def per_graph(rows, kernel, schema):
    """Runs ``kernel(g, graph) -> rows`` for each graph."""
    return map_groups(rows, "g", ["eid"], lambda k, columns: kernel(k, _graph(columns)), schema)


_BOTH = "b AS (SELECT g, eid, u AS a, v AS c, len FROM edge UNION ALL SELECT g, eid, v, u, len FROM edge)"
_BRIDGE = f"{_BOTH}, r(g, skip, node) AS (SELECT g, eid, u FROM edge UNION SELECT r.g, r.skip, b.c FROM r JOIN b ON b.g = r.g AND b.a = r.node AND b.eid <> r.skip), cut AS (SELECT g, eid FROM edge AS e WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.g = e.g AND r.skip = e.eid AND r.node = e.v))"


@query("a8_degree_parity", f"WITH {EDGE} SELECT g, node, count(*) AS degree, count(*) % 2 = 0 AS even FROM (SELECT g, u AS node FROM edge UNION ALL SELECT g, v FROM edge) GROUP BY g, node")
def a8(spark, sf):
    e = edge(spark, sf)
    return e.select("g", F.explode(F.array("u", "v")).alias("node")).groupBy("g", "node").agg(F.count("*").alias("degree"), (F.count("*") % 2 == 0).alias("even"))


@query("g2_bridges", f"WITH RECURSIVE {EDGE}, {_BRIDGE} SELECT g, eid FROM cut")
def g2(spark, sf):
    return per_graph(edge(spark, sf), lambda k, g: [(k, g.ids[e]) for e in sorted(G.bridges(g))], "g bigint, eid bigint")


@query("g6_loop_components", f"WITH RECURSIVE {EDGE}, {_BRIDGE}, k AS (SELECT b.* FROM b ANTI JOIN cut ON cut.g = b.g AND cut.eid = b.eid), c(g, root, node) AS (SELECT g, a, a FROM k UNION SELECT c.g, c.root, k.c FROM c JOIN k ON k.g = c.g AND k.a = c.node), n AS (SELECT g, node, min(root) AS root FROM c GROUP BY g, node) SELECT g, count(DISTINCT root) AS parts FROM n GROUP BY g")
def g6(spark, sf):
    return per_graph(edge(spark, sf), lambda k, g: [(k, n) for n in [len(G.loop_components(g))] if n], "g bigint, parts bigint")


@query("g7_connected_components", f"WITH RECURSIVE {EDGE}, k AS (SELECT g, u AS a, v AS c FROM edge WHERE w >= 25 UNION ALL SELECT g, v, u FROM edge WHERE w >= 25), c(g, root, node) AS (SELECT g, a, a FROM k UNION SELECT c.g, c.root, k.c FROM c JOIN k ON k.g = c.g AND k.a = c.node) SELECT g * 1000 + node AS node, min(g * 1000 + root) AS root FROM c GROUP BY g, node")
def g7(spark, sf):
    """Of all graphs at once, as one large graph."""
    e = edge(spark, sf).where("w >= 25")
    return connected_components(e.select((F.col("g") * 1000 + F.col("u")).alias("u"), (F.col("g") * 1000 + F.col("v")).alias("v")))


_DIST = f"{_BOTH}, s AS (SELECT g, arg_min(u, eid) AS s FROM edge GROUP BY g), d(g, node, d) AS (SELECT g, s, CAST(0 AS BIGINT) FROM s UNION SELECT d.g, b.c, d.d + b.len FROM d JOIN b ON b.g = d.g AND b.a = d.node WHERE d.d + b.len <= 200), m AS (SELECT g, node, min(d) AS d FROM d GROUP BY g, node)"


@query("g4_g5_reach", f"WITH RECURSIVE {EDGE}, {_DIST} SELECT e.g, e.eid, CAST(a.d + e.len + c.d AS BIGINT) AS reach FROM edge AS e JOIN m AS a ON a.g = e.g AND a.node = e.u JOIN m AS c ON c.g = e.g AND c.node = e.v")
def g4(spark, sf):
    """Reach over nodes within 200 m of the start."""

    def kernel(k, g):
        start = g.u[0]
        d, _ = G.shortest(g.adjacency(), g.length, start)
        near = {n for n, x in d.items() if x <= 200}
        return [(k, g.ids[e], int(r)) for e, r in G.reach(g, start).items() if g.u[e] in near and g.v[e] in near]

    return per_graph(edge(spark, sf), kernel, "g bigint, eid bigint, reach bigint")


@query("g1_contraction", f"""WITH {EDGE}, n AS (SELECT g, node, count(*) AS ends, count(DISTINCT eid) AS edges FROM (SELECT g, eid, u AS node FROM edge UNION ALL SELECT g, eid, v FROM edge) GROUP BY g, node), p AS (SELECT g, count(*) FILTER (ends = 2 AND edges = 2) AS through FROM n GROUP BY g)
SELECT g, greatest(count(*) - max(through), 1) AS edges, CAST(sum(len) AS BIGINT) AS len, CAST(sum(w) AS BIGINT) AS w FROM edge JOIN p USING (g) GROUP BY g""")
def g1(spark, sf):
    """A connected graph loses an edge for each node of degree two; a ring keeps one."""

    def kernel(k, g):
        small, chains = G.contract(g)
        if sorted(e for chain in chains for e in chain) != list(range(len(g.u))):
            return []
        return [(k, len(small.u), int(sum(small.length)), int(sum(small.w)))]

    return per_graph(edge(spark, sf), kernel, "g bigint, edges bigint, len bigint, w bigint")


@query("g3_prune_invariants", f"WITH {EDGE} SELECT g, CAST(0 AS BIGINT) AS bad FROM edge GROUP BY g")
def g3(spark, sf):
    """After pruning no edge is a bridge, out of reach or apart from the start."""

    def kernel(k, g):
        start = g.u[0]
        kept = G.prune(g, start, 400.0)
        bad = len(G.bridges(g, kept)) + sum(r > 400 for r in G.reach(g, start, kept).values()) + (len(G.components(g, kept)) > 1)
        return [(k, bad)]

    return per_graph(edge(spark, sf), kernel, "g bigint, bad bigint")


@query("g16_faces", f"""WITH RECURSIVE {EDGE}, e AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY eid) - 1 AS k FROM edge), h AS (SELECT g, 2 * k AS h, u AS a, v AS c FROM e UNION ALL SELECT g, 2 * k + 1, v, u FROM e),
p AS (SELECT g, h, a, round(atan2((c * 53 % 97) - (a * 53 % 97), (c * 37 % 101) - (a * 37 % 101)), 9) AS t FROM h), o AS (SELECT g, h, coalesce(lead(h) OVER w, first_value(h) OVER w) AS n FROM p WINDOW w AS (PARTITION BY g, a ORDER BY t, h)), x AS (SELECT g, xor(h, 1) AS h, n FROM o),
y(g, root, h) AS (SELECT g, h, h FROM x UNION SELECT y.g, y.root, x.n FROM y JOIN x ON x.g = y.g AND x.h = y.h), z AS (SELECT g, h, min(root) AS root FROM y GROUP BY g, h) SELECT g, count(DISTINCT root) AS faces FROM z GROUP BY g""")  # fmt: skip
def g16(spark, sf):
    return per_graph(edge(spark, sf), lambda k, g: [(k, len(G.half_edge_cycles(g, _xy(g))))], "g bigint, faces bigint")


def _early(spark, sf):
    """The first part of each walk, which has more dead ends and bridges."""
    return edge(spark, sf).where("eid < 12")


_EARLY = EDGE.replace("AND u <> v)", "AND u <> v AND eid < 12)")


#: Both sides of each bridge: their nodes and edges, and whether the start is there. Peeling leaves a bridge if
#: either side has the start or a ring, that is as many edges as nodes.
_ACCESS = f"""{_BRIDGE}, s AS (SELECT g, arg_min(u, eid) AS s FROM edge GROUP BY g), side(g, skip, top, node) AS (SELECT g, eid, u, u FROM edge SEMI JOIN cut USING (g, eid) UNION SELECT g, eid, v, v FROM edge SEMI JOIN cut USING (g, eid) UNION SELECT r.g, r.skip, r.top, b.c FROM side AS r JOIN b ON b.g = r.g AND b.a = r.node AND b.eid <> r.skip),
nodes AS (SELECT side.g, skip, top, count(*) AS n, bool_or(node = s.s) AS home FROM side JOIN s ON s.g = side.g GROUP BY side.g, skip, top), inner_edges AS (SELECT side.g, skip, top, count(*) AS m FROM side JOIN edge AS e ON e.g = side.g AND e.u = side.node AND e.eid <> side.skip GROUP BY side.g, skip, top),
access AS (SELECT nodes.g, skip AS eid FROM nodes LEFT JOIN inner_edges USING (g, skip, top) GROUP BY nodes.g, skip HAVING bool_and(home OR coalesce(m, 0) >= n))"""


@query("g8_access_bridges", f"WITH RECURSIVE {_EARLY}, {_ACCESS} SELECT g, eid FROM access")
def g8(spark, sf):
    return per_graph(_early(spark, sf), lambda k, g: [(k, g.ids[e]) for e in sorted(G.access_bridges(g, g.u[0]))], "g bigint, eid bigint")


@query("g9_duplicates_near_start", f"""WITH RECURSIVE {_EARLY}, {_ACCESS}, near(g, node, d) AS (SELECT g, s, CAST(0 AS BIGINT) FROM s UNION SELECT near.g, b.c, near.d + b.len FROM near JOIN b ON b.g = near.g AND b.a = near.node WHERE near.d + b.len <= 200), m AS (SELECT DISTINCT g, node FROM near)
SELECT g, eid FROM access JOIN edge USING (g, eid) WHERE EXISTS (SELECT 1 FROM m WHERE m.g = edge.g AND m.node = edge.u) AND EXISTS (SELECT 1 FROM m WHERE m.g = edge.g AND m.node = edge.v)""")
def g9(spark, sf):
    """The access bridges within 200 m of the start, which get a copy."""

    def kernel(k, g):
        more = G.duplicate_near_start(g, g.u[0], 200.0)
        return [(k, e) for e in more.ids[len(g.u) :]]

    return per_graph(_early(spark, sf), kernel, "g bigint, eid bigint")


def _case(g: G.Graph) -> L.Instance:
    return L.Instance(g, g.u[0], "max", 600.0, tol=0.3)


@query("g13_closed_walks", f"WITH {EDGE} SELECT g, 2 * count(*) AS steps, CAST(2 * sum(len) AS BIGINT) AS len, arg_min(u, eid) AS first, arg_min(u, eid) AS last FROM edge GROUP BY g")
def g13(spark, sf):
    """One closed walk over each edge twice, from the start."""

    def kernel(k, g):
        twice = G.Graph(g.u + g.u, g.v + g.v, g.length + g.length)
        walk = G.circuit(twice, range(len(twice.u)), g.u[0])
        joined = all(a[2] == b[1] and {b[1], b[2]} == {twice.u[b[0]], twice.v[b[0]]} for a, b in zip(walk, walk[1:], strict=False))
        return [(k, len({e for e, *_ in walk}), int(sum(twice.length[e] for e, *_ in walk)), walk[0][1], walk[-1][2])] if joined else []

    return per_graph(edge(spark, sf), kernel, "g bigint, steps bigint, len bigint, first bigint, last bigint")


@query("l1_l8_best_small_loops", f"""WITH RECURSIVE {_EARLY}, b AS (SELECT g, eid, u AS a, v AS c, len, w FROM edge UNION ALL SELECT g, eid, v, u, len, w FROM edge), s AS (SELECT g, arg_min(u, eid) AS s FROM edge GROUP BY g),
t(g, node, used, len, w) AS (SELECT g, s, CAST([] AS BIGINT[]), CAST(0 AS BIGINT), CAST(0 AS BIGINT) FROM s UNION ALL SELECT t.g, b.c, list_append(t.used, b.eid), t.len + b.len, t.w + b.w FROM t JOIN b ON b.g = t.g AND b.a = t.node AND NOT list_contains(t.used, b.eid)),
c AS (SELECT t.g, len BETWEEN 420 AND 780 AS feasible, round(w - 3 * (w / greatest(CAST(len AS DOUBLE), 1.0)) * greatest(0, len - 600) - 0.5 * (greatest(0, 420 - len) + greatest(0, len - 780)), 6) AS score FROM t JOIN s ON s.g = t.g AND s.s = t.node WHERE len(used) > 0)
SELECT g, bool_or(feasible) AS feasible, coalesce(max(score) FILTER (feasible), max(score)) AS score FROM c GROUP BY g""")
def l1(spark, sf):
    """The best loop of a small graph over its cycle space; a seeded search finds no better one, and a valid one."""

    def kernel(k, g):
        case = _case(g)
        best = L.best_by_cycle_space(case)
        tried = L.probe(case, k, _xy(g), tries=4, rounds=10)
        if best is None or (tried is not None and (G.violations(g, tried, g.u[0]) or case.key(tried) > case.key(best))):
            return []
        return [(k, case.feasible(best), round(case.score(best), 6))]

    return per_graph(_early(spark, sf), kernel, "g bigint, feasible boolean, score double")


@query("l4_multi_start", None)
def l4(spark, sf):
    """Each graph is searched from several seeds, which share its faces; the best loop is kept, the first of equal ones."""

    def kernel(k, g):
        case, faces = _case(g), G.faces(g, _xy(g), 1.3 * 600.0)
        tried = [(seed, L.probe(case, seed, tries=4, rounds=12, faces=faces)) for seed in range(4)]
        best = max(((seed, loop) for seed, loop in tried if loop), key=lambda x: (case.key(x[1]), -x[0]), default=(0, None))
        seed, loop = best
        return [(k, seed, bool(loop) and case.feasible(loop), case.score(loop) if loop else None, *case.totals(loop or []), [g.ids[e] for e in loop or []])]

    return per_graph(edge(spark, sf), kernel, "g bigint, seed bigint, feasible boolean, score double, length double, w double, edges array<bigint>")


@query("g21_harmonic", f"""WITH RECURSIVE {EDGE}, b AS (SELECT g, u AS a, v AS c, len FROM edge UNION ALL SELECT g, v, u, len FROM edge), known AS (SELECT DISTINCT g, a AS node, CAST(a * a % 83 AS DOUBLE) AS z FROM b WHERE a % 3 = 0),
x(g, node, z, n) AS (SELECT g, node, coalesce(z, 0.0), 0 FROM (SELECT DISTINCT b.g, a AS node, known.z FROM b LEFT JOIN known ON known.g = b.g AND known.node = b.a WHERE b.g IN (SELECT g FROM known)) UNION ALL
SELECT y.g, y.node, coalesce(known.z, y.z), n FROM (SELECT b.g, b.a AS node, sum(x.z / b.len) / sum(CAST(1 AS DOUBLE) / b.len) AS z, max(x.n) + 1 AS n FROM x JOIN b ON b.g = x.g AND b.c = x.node WHERE x.n < 150 GROUP BY b.g, b.a) AS y LEFT JOIN known ON known.g = y.g AND known.node = y.node)
SELECT g, node, round(z, 5) AS z FROM x WHERE n = 150""")
def g21(spark, sf):
    """Free nodes are the weighted mean of their neighbours; the SQL gets there by repeated means."""

    def kernel(k, g):
        known = {n: float(n * n % 83) for n in {*g.u, *g.v} if n % 3 == 0}
        return [(k, n, round(z, 5)) for n, z in (known | G.harmonic(g.u, g.v, g.length, known)).items()] if known else []

    return per_graph(edge(spark, sf), kernel, "g bigint, node bigint, z double")


@query("a21_length_lower_bound", f"""WITH {EDGE}, e AS (SELECT g, eid, len, w, (eid * 37) % 400 AS r FROM edge), c AS (SELECT DISTINCT g, r AS cap FROM e),
o AS (SELECT c.g, cap, len, w, coalesce(sum(w) OVER q, 0) AS bw, coalesce(sum(len) OVER q, 0) AS bl FROM c JOIN e ON e.g = c.g AND e.r <= c.cap WHERE w > 0 WINDOW q AS (PARTITION BY c.g, cap ORDER BY w / greatest(len, 1e-9) DESC, eid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
k AS (SELECT g, cap, max(CASE WHEN bw < 300 AND bw + w >= 300 THEN bl + len * (300 - bw) / CAST(w AS DOUBLE) END) AS least FROM o GROUP BY g, cap) SELECT g, round(min(greatest(cap, least)), 4) AS bound FROM k WHERE least IS NOT NULL GROUP BY g""")  # fmt: skip
def a21(spark, sf):
    def kernel(k, g):
        bound = C.length_lower_bound(g.length, g.w, [e * 37 % 400 for e in g.ids], 300.0)
        return [] if bound is None else [(k, bound)]

    return per_graph(edge(spark, sf), kernel, "g bigint, bound double").select("g", F.round("bound", 4).alias("bound"))


def per_profile(rows, kernel, schema):
    return map_groups(rows, "g", ["i"], lambda k, columns: kernel(k, columns["z"].astype(float), columns["s"].astype(float)), schema)


def _base_sql(prof: str, tag: str) -> str:
    """CTEs k and base of the climbs of ``prof`` before any merge."""
    return f"""k{tag} AS (SELECT g, i, lo, lz, hi, hz, CAST(NULL AS BIGINT) AS a, CAST(NULL AS BIGINT) AS b FROM (SELECT g, i, i AS lo, z AS lz, CAST(NULL AS BIGINT) AS hi, CAST(NULL AS BIGINT) AS hz FROM {prof} WHERE i = 0)
UNION ALL SELECT g, i, CASE WHEN shut OR down THEN i ELSE lo END, CASE WHEN shut OR down THEN z ELSE lz END, CASE WHEN shut THEN NULL WHEN up THEN i ELSE hi END, CASE WHEN shut THEN NULL WHEN up THEN z ELSE hz END, CASE WHEN shut THEN lo END, CASE WHEN shut THEN hi END FROM (
SELECT p.g, p.i, p.z, k.lo, k.lz, k.hi, k.hz, k.hi IS NULL AND p.z < k.lz AS down, CASE WHEN k.hi IS NULL THEN p.z - k.lz >= 10 ELSE p.z > k.hz END AS up, k.hi IS NOT NULL AND k.hz - p.z >= least(greatest(0.15 * (k.hz - k.lz), 10.0), 25.0) AS shut FROM k{tag} AS k JOIN {prof} AS p ON p.g = k.g AND p.i = k.i + 1)),
base{tag} AS (SELECT g, a AS low, b AS top FROM k{tag} WHERE a IS NOT NULL UNION ALL SELECT g, lo, hi FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY i DESC) AS n FROM k{tag}) WHERE n = 1 AND hi IS NOT NULL)"""


_GAP = "greatest(CASE WHEN c[i + 1].sa > c[i].sb THEN (c[i + 1].sa - c[i].sb) / (CAST(0.25 AS DOUBLE) * least(c[i].sb - c[i].sa, c[i + 1].sb - c[i + 1].sa)) ELSE 0 END, CASE WHEN c[i].zb > c[i + 1].za THEN (c[i].zb - c[i + 1].za) / (CAST(0.3 AS DOUBLE) * least(c[i].zb - c[i].za, c[i + 1].zb - c[i + 1].za)) ELSE 0 END)"


def _climb_sql(prof: str, tag: str) -> str:
    """CTE climb (g, k, gain, length) after all merges, which are steps on a list of climbs."""
    return f"""{_base_sql(prof, tag)}, c0{tag} AS (SELECT e.g, list({{'sa': p.s, 'za': p.z, 'sb': q.s, 'zb': q.z}} ORDER BY e.low) AS c FROM base{tag} AS e JOIN {prof} AS p ON p.g = e.g AND p.i = e.low JOIN {prof} AS q ON q.g = e.g AND q.i = e.top GROUP BY e.g),
m{tag}(g, c) AS (SELECT g, c FROM c0{tag} UNION ALL SELECT g, c[1:p - 1] || [{{'sa': c[p].sa, 'za': c[p].za, 'sb': c[p + 1].sb, 'zb': c[p + 1].zb}}] || c[p + 2:] FROM (SELECT g, c, least_gap, list_position(gaps, least_gap) AS p FROM (SELECT g, c, gaps, list_min(gaps) AS least_gap FROM (SELECT g, c, list_transform(range(1, len(c)), lambda i: {_GAP}) AS gaps FROM m{tag} WHERE len(c) > 1))) WHERE least_gap <= 1),
l{tag} AS (SELECT g, c FROM m{tag} QUALIFY row_number() OVER (PARTITION BY g ORDER BY len(c)) = 1), climb{tag} AS (SELECT g, k, CAST(c[k + 1].zb - c[k + 1].za AS DOUBLE) AS gain, CAST(c[k + 1].sb - c[k + 1].sa AS DOUBLE) AS length FROM (SELECT g, c, unnest(range(len(c))) AS k FROM l{tag}))"""


@query("w13_base_climbs", f"WITH RECURSIVE {PROF}, {_base_sql('prof', '')} SELECT g, low, top FROM base")
def w13(spark, sf):
    return per_profile(prof(spark, sf), lambda g, z, s: [(g, a, b) for a, b in C.base_climbs(z)], "g bigint, low bigint, top bigint")


def _walk(spark, sf, span, down):
    """Rolling profiles: running sums of small steps."""
    over = W.partitionBy("g").orderBy("i").rowsBetween(W.unboundedPreceding, 0)
    return prof(spark, sf).withColumn("z", F.sum(F.col("z") % span - down).over(over))


def _walk_sql(span, down):
    return f"{PROF}, walk AS (SELECT g, i, s, CAST(sum(z % {span} - {down}) OVER (PARTITION BY g ORDER BY i) AS BIGINT) AS z FROM prof)"


@query("w14_merged_climbs", f"WITH RECURSIVE {_walk_sql(21, 9)}, {_climb_sql('walk', '')} SELECT g, k, gain, length FROM climb")
def w14(spark, sf):
    return per_profile(_walk(spark, sf, 21, 9), lambda g, z, s: [(g, k, *c) for k, c in enumerate(C.climbs(z, s))], "g bigint, k bigint, gain double, length double")


@query("a10_track_summary", f"""WITH RECURSIVE {_walk_sql(21, 9)}, {_climb_sql('walk', '')}, a AS (SELECT g, count(*) FILTER (gain >= 20) AS n, arg_max(gain, {{'l': length, 'k': -k}}) AS lg, max(length) AS ll, sum(gain * gain) / sum(gain) AS wg, 100 * sum(gain) / sum(length) AS mg FROM climb GROUP BY g)
SELECT g, coalesce(n, 0) AS count, coalesce(lg, 0.0) AS longest_gain, coalesce(ll, 0.0) AS longest_length, round(coalesce(wg, 0.0), 9) AS weighted_gain, round(coalesce(mg, 0.0), 9) AS mean_grade FROM (SELECT DISTINCT g FROM prof) LEFT JOIN a USING (g)""")
def a10(spark, sf):
    schema = "g bigint, count bigint, longest_gain double, longest_length double, weighted_gain double, mean_grade double"
    found = per_profile(_walk(spark, sf, 21, 9), lambda g, z, s: [(g, *C.summary(z, s).values())], schema)
    return found.withColumns({c: F.round(c, 9) for c in ("weighted_gain", "mean_grade")})


@query("f26_track_direction", f"""WITH RECURSIVE {_walk_sql(21, 9)}, back AS (SELECT g, max(i) OVER w - i AS i, max(s) OVER w - s AS s, z FROM walk WINDOW w AS (PARTITION BY g)), {_climb_sql('walk', '')}, {_climb_sql('back', '_r')},
a AS (SELECT g, sum(gain * gain) / sum(gain) AS x FROM climb GROUP BY g), r AS (SELECT g, sum(gain * gain) / sum(gain) AS x FROM climb_r GROUP BY g)
SELECT g, coalesce(r.x, 0) > coalesce(a.x, 0) AS long_reversed, coalesce(r.x, 0) < coalesce(a.x, 0) AS short_reversed FROM (SELECT DISTINCT g FROM prof) LEFT JOIN a USING (g) LEFT JOIN r USING (g)""")
def f26(spark, sf):
    return per_profile(_walk(spark, sf, 21, 9), lambda g, z, s: [(g, C.prefer_reverse(z, s, True), C.prefer_reverse(z, s, False))], "g bigint, long_reversed boolean, short_reversed boolean")


_WIDE = "abs(z[least(k + 1 + r, len(z))] - z[greatest(k - r, 1)]) <= CAST(0.3 AS DOUBLE) * 5 * (least(k + 1 + r, len(z)) - greatest(k - r, 1)) OR (k - r <= 1 AND k + 1 + r >= len(z))"


@query("w11_grade_cap", f"""WITH RECURSIVE {_walk_sql(5, 2)}, c(g, z) AS (SELECT g, list(CAST(z AS DOUBLE) ORDER BY i) FROM walk GROUP BY g), x(g, n, z, ended) AS (SELECT g, 0, z, false FROM c UNION ALL
SELECT g, n + 1, list_transform(range(1, len(z) + 1), lambda i: CASE WHEN i BETWEEN a AND b THEN z[a] + (z[b] - z[a]) * (i - a) / (b - a) ELSE z[i] END), a = 1 AND b = len(z) FROM (SELECT g, n, z, greatest(k - r, 1) AS a, least(k + 1 + r, len(z)) AS b FROM (
SELECT g, n, z, k, list_filter(range(0, len(z)), lambda r: {_WIDE})[1] AS r FROM (SELECT g, n, z, list_position(list_transform(range(1, len(z)), lambda i: abs(z[i + 1] - z[i]) > 1.5 + 1e-9), true) AS k FROM x WHERE NOT ended) WHERE k > 0))),
l AS (SELECT g, z FROM x QUALIFY row_number() OVER (PARTITION BY g ORDER BY n DESC) = 1) SELECT g, i, round(z[i + 1], 4) AS z FROM (SELECT g, z, unnest(range(len(z))) AS i FROM l)""")
def w11(spark, sf):
    """Profiles without a step of over 30 %."""
    return per_profile(_walk(spark, sf, 5, 2), lambda g, z, s: [(g, i, x) for i, x in enumerate(C.cap_road_grade(s, z, 0.3))], "g bigint, i bigint, z double").withColumn("z", F.round("z", 4))


@query("f30_simplified_lines", f"""WITH RECURSIVE {PROF}, d(g, a, b) AS (SELECT g, CAST(0 AS BIGINT), max(i) FROM prof GROUP BY g UNION ALL SELECT g, unnest([a, j]), unnest([j, b]) FROM (SELECT g, a, b, -far.i AS j FROM (
SELECT g, a, b, max({{'f': round(sqrt(pow(px - t * dx, 2) + pow(pz - t * dz, 2)), 9), 'i': -i}}) AS far FROM (SELECT *, least(greatest((px * dx + pz * dz) / greatest(CAST(dx * dx + dz * dz AS DOUBLE), 1e-12), 0), 1) AS t FROM (
SELECT d.g, d.a, d.b, p.i, p.s - l.s AS px, p.z - l.z AS pz, r.s - l.s AS dx, r.z - l.z AS dz FROM d JOIN prof AS p ON p.g = d.g AND p.i > d.a AND p.i < d.b JOIN prof AS l ON l.g = d.g AND l.i = d.a JOIN prof AS r ON r.g = d.g AND r.i = d.b)) GROUP BY g, a, b) WHERE far.f > 40))
SELECT DISTINCT g, i FROM (SELECT g, a AS i FROM d UNION ALL SELECT g, b FROM d)""")
def f30(spark, sf):
    """The points that a line within 40 m keeps."""
    return per_profile(prof(spark, sf), lambda g, z, s: [(g, int(i)) for i in C.simplify(s, z, 40.0)], "g bigint, i bigint")


@query("o4_spread_out_points", f"""WITH RECURSIVE {PROF}, o(g, n, c) AS (SELECT DISTINCT g, 0, CAST([] AS STRUCT(i BIGINT, s BIGINT, z BIGINT)[]) FROM prof UNION ALL SELECT g, n + 1, list_append(c, {'{'}'i': -best.i, 's': best.s, 'z': best.z{'}'}) FROM (
SELECT o.g, o.n, o.c, max({'{'}'z': p.z, 'i': -p.i, 's': p.s{'}'}) AS best FROM o JOIN prof AS p ON p.g = o.g WHERE o.n < 6 AND len(list_filter(o.c, lambda q: (q.s - p.s) * (q.s - p.s) + (q.z - p.z) * (q.z - p.z) < 3600)) = 0 GROUP BY o.g, o.n, o.c))
SELECT g, n - 1 AS rank, c[n].i AS i FROM o WHERE n > 0""")
def o4(spark, sf):
    def kernel(g, z, s):
        return [(g, k, p) for k, p in enumerate(G.spread_out(list(zip(s, z, strict=True)), list(z), 6, 60.0))]

    return per_profile(prof(spark, sf), kernel, "g bigint, rank bigint, i bigint")


@query("j2_split_at_shared_nodes", """WITH w AS (SELECT l_orderkey AS way, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS i, (l_partkey * 7919 + l_suppkey * 31) % 60013 AS node FROM lineitem), u AS (SELECT node FROM w GROUP BY node HAVING count(DISTINCT way) > 1),
c AS (SELECT w.*, i = 1 OR i = max(i) OVER (PARTITION BY way) OR u.node IS NOT NULL AS cut FROM w LEFT JOIN u ON u.node = w.node), p AS (SELECT *, count(*) FILTER (cut) OVER (PARTITION BY way ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS piece FROM c)
SELECT way, piece, count(*) AS steps FROM p WHERE i > 1 GROUP BY way, piece""")  # fmt: skip
def j2(spark, sf):
    li = table(spark, sf, "lineitem")
    i = F.row_number().over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    w = li.select(F.col("l_orderkey").alias("way"), i.alias("i"), ((F.col("l_partkey") * 7919 + F.col("l_suppkey") * 31) % 60013).alias("node"))
    shared = w.groupBy("node").agg(F.min("way").alias("lo"), F.max("way").alias("hi")).where("lo <> hi").select("node", F.lit(True).alias("shared"))
    marked = w.join(shared, "node", "left").withColumn("cut", (F.col("i") == 1) | (F.col("i") == F.max("i").over(W.partitionBy("way"))) | F.col("shared").isNotNull())
    before = W.partitionBy("way").orderBy("i").rowsBetween(W.unboundedPreceding, -1)
    return marked.withColumn("piece", F.count_if("cut").over(before)).where("i > 1").groupBy("way", "piece").agg(F.count("*").alias("steps"))


@query("p9_clip_runs", f"""WITH {PROF}, c AS (SELECT *, z BETWEEN 40 AND 260 AS inside FROM prof), d AS (SELECT *, CASE WHEN inside <> lag(inside) OVER (PARTITION BY g ORDER BY i) THEN 1 ELSE 0 END AS n FROM c), r AS (SELECT *, sum(n) OVER (PARTITION BY g ORDER BY i) AS run FROM d)
SELECT g, CAST(run AS BIGINT) AS run, min(s) AS s0, max(s) AS s1 FROM r WHERE inside GROUP BY g, run HAVING count(*) >= 2""")  # fmt: skip
def p9(spark, sf):
    """Maximal stretches inside a region, of two points or more."""
    from switchback.operators.profiles import runs

    inside = F.col("z").between(40, 260)
    return runs(prof(spark, sf), inside).where(inside).groupBy("g", "run").agg(F.min("s").alias("s0"), F.max("s").alias("s1"), F.count("*").alias("n")).where("n >= 2").drop("n")
