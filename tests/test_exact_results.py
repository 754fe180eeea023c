"""Made-up tables on which rounding, ties or large keys decide, against the SQL."""

import random

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from switchback.operators.spatial import nearest_rows
from switchback.plans import registry
from switchback.plans.segment_queries import RING


def same(spark, folder, name, **tables):
    con = duckdb.connect()
    for t, columns in tables.items():
        pq.write_table(pa.table(columns), f"{folder}/{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    want = con.execute(registry.oracle_sql()[name]).fetchdf()
    got = registry.queries()[name](spark, str(folder)).toPandas()[list(want.columns)]
    rows = lambda frame: sorted(tuple(r) for r in frame.itertuples(index=False))
    assert rows(got) == rows(want)
    return rows(want)


def events(*profiles):
    values = [(g, i, float(v)) for g, p in enumerate(profiles) for i, v in enumerate(p)]
    g, ts, value = zip(*values, strict=True)
    return {"event_id": list(range(len(values))), "user_id": list(g), "ts": list(ts), "value": list(value)}


def segments(points, first=0):
    """Line items whose segments start at ``points``, with ids from ``10 * first`` on."""
    n = len(points)
    part = [x * pow(7919, -1, 40000) % 40000 for x, _ in points]
    supplier = [(y - 31) * pow(104729, -1, 40000) % 40000 for _, y in points]
    return {"l_orderkey": [first + k for k in range(n)], "l_linenumber": [1] * n, "l_partkey": part, "l_suppkey": supplier, "l_quantity": [9.0] * n, "l_extendedprice": [100.0] * n}


def on_sides():
    """Points on the sides of the ring, and beside them."""
    found = set()
    for (x0, y0), (x1, y1) in zip(RING, RING[1:] + RING[:1], strict=True):
        dx, dy = int(x1 - x0), int(y1 - y0)
        for k in range(0, 1001):
            if dx * k % 1000 == 0 == dy * k % 1000:
                x, y = int(x0) + dx * k // 1000, int(y0) + dy * k // 1000
                found |= {(x - 1, y), (x, y), (x + 1, y)}
    return sorted(found)


def test_f30_equal_distances(spark, tmp_path):
    """Points that are equally far from a line but for rounding: the first is kept."""
    r = random.Random(4)
    profiles = [[r.choice((0, 45, 60, 90, 120)) for _ in range(60)] for _ in range(200)]
    same(spark, tmp_path, "f30_simplified_lines", events=events(*profiles))


def test_w11_line_within_the_cap_but_for_rounding(spark, tmp_path):
    """A stretch exactly as steep as the cap is flat enough, whatever lines were drawn before."""
    p = [282, 115, 933, 971, 23, 894, 431, 448, 888, 906, 1, 863, 669, 892, 604, 98, 660, 375, 475, 41, 966, 160]
    q = [942, 142, 679, 676, 270, 347, 830, 409, 610, 681, 49, 153, 698, 873, 927, 438, 228, 169, 495, 715, 841, 880, 402, 858, 701, 724, 187, 904, 224, 678, 934]
    same(spark, tmp_path, "w11_grade_cap", events=events(p, q))


def test_p5_points_on_sides(spark, tmp_path):
    same(spark, tmp_path, "p5_region_bbox_then_polygon", lineitem=segments(on_sides()))


def test_p6_points_on_sides(spark, tmp_path):
    same(spark, tmp_path, "p6_region_shortcuts", lineitem=segments(on_sides()))


def test_u6_points_on_sides(spark, tmp_path):
    same(spark, tmp_path, "u6_polygon_and_disk", lineitem=segments(on_sides()))


def test_j12_large_ids(spark, tmp_path):
    """Ids of tens of millions outweigh a small difference of squared distances."""
    near, far = segments([(1000, 1000), (3000, 1000)], 3_000_000), segments([(1001, 1000), (3001, 1001)], 1_500_000)
    assert same(spark, tmp_path, "j12_snap_to_start", lineitem={c: near[c] + far[c] for c in near})


def test_nearest_rows_against_all_pairs():
    """Ties, points on one spot, points far from all, and the same id left out."""
    r = np.random.default_rng(6)
    for n, m, k, radius, wide in ((300, 200, 4, 12, 100), (200, 500, 1, 30, 40), (50, 60, 6, 9, 8), (40, 1, 2, 5, 60), (30, 0, 2, 5, 60)):
        (ax, ay), (bx, by), ids = r.integers(-wide, wide, (2, n)), r.integers(-wide, wide // 2, (2, m)), r.permutation(m)
        own = np.arange(n) % max(m, 1)
        got = {}
        for parts in zip(*[np.concatenate(x) if x else [] for x in zip(*nearest_rows((ax, ay), (bx, by), ids, radius, k, own), strict=True)], strict=True):
            got.setdefault(int(parts[0]), []).append((int(parts[2]), int(ids[parts[1]])))
        near = [sorted((int((ax[a] - bx[b]) ** 2 + (ay[a] - by[b]) ** 2), int(ids[b])) for b in range(m) if ids[b] != own[a]) for a in range(n)]
        want = {a: [p for p in found if p[0] < radius**2][:k] for a, found in enumerate(near)}
        assert got == {a: found for a, found in want.items() if found}


@pytest.mark.parametrize("name", ["j8_knn_within", "j11_nearest_elevation", "f12_j7_calm_labels"])
def test_nearest_queries_form_few_pairs(spark, tmp_path, monkeypatch, name):
    """As the SQL over several tiles, and without a join or window over all pairs in reach."""
    r = random.Random(2)
    points = [(r.randrange(40000), r.randrange(40000)) for _ in range(200)] + [(r.randrange(20000, 20300), r.randrange(9000, 9300)) for _ in range(900)]
    rows = segments(points)
    rows["l_suppkey"] = [s + 40000 * r.randrange(50) for s in rows["l_suppkey"]]
    rows["l_partkey"] = [p + 40000 * r.randrange(50) for p in rows["l_partkey"]]
    assert len(same(spark, tmp_path, name, lineitem=rows)) > 10
    plan = registry.queries()[name](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Window" not in plan


def test_j3_share_of_exactly_the_least(spark, tmp_path):
    """Two segments side by side over 60 % of the shorter, but for the rounding of the sum."""
    con = duckdb.connect()
    rows = con.execute("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice FROM '/root/testdata/sf0.1/lineitem.parquet' WHERE l_orderkey * 10 + l_linenumber IN (1078836, 1468954)").fetchdf()
    assert same(spark, tmp_path, "j3_parallel_corridors", lineitem=rows.to_dict("list")) == [(1078836, 1468954, 84.938)]
