import random

import numpy as np
import pytest

from switchback.llm import hamming_topk as K


def brute(rows, queries, k):
    out = []
    for q, c in set(queries):
        near = sorted(((c ^ d) & (1 << 64) - 1).bit_count() * 10**9 + i for i, d in rows)
        out += [(q, n % 10**9, n // 10**9, r + 1) for r, n in enumerate(near[:k])]
    return sorted(out)


def check(spark, rows, queries, k=5, **more):
    signed = lambda pairs: [(i, c - (1 << 64) if c >> 63 else c) for i, c in pairs]
    a, b = (spark.createDataFrame(signed(x), "id bigint, code bigint") for x in (rows, queries))
    got = sorted((r["query_id"], r["neighbour_id"], r["distance"], r["rank"]) for r in K.top_k(a, b, k, **more).collect())
    assert got == brute(rows, queries, k)


def test_against_brute_force(spark):
    r = random.Random(2)
    base = [r.getrandbits(64) for _ in range(12)]
    rows = []
    for i in range(150):
        c = r.choice(base)
        for _ in range(r.randint(0, 9)):
            c ^= 1 << r.randrange(64)
        rows.append((i, c))
    rows += [(1000 + i, base[0]) for i in range(40)] + [(5, rows[5][1])]  # ties, a hot code, a repeated row
    check(spark, rows, [rows[k] for k in range(0, 150, 25)] + [(9999, r.getrandbits(64))])
    check(spark, rows, rows[:20], shard_rows=10)


def test_fewer_rows_than_k_and_none(spark):
    check(spark, [(1, 3), (2, 1 << 63)], [(1, 3)])
    check(spark, [(1, 3)], [])


def test_sign_code(spark):
    rows = spark.createDataFrame([(1, [0.5, -1.0, None, 2.0]), (2, [0.0] * 63 + [1.0]), (3, [1.0] * 70)], "id bigint, e array<float>")
    got = {r["id"]: r["c"] & (1 << 64) - 1 for r in rows.select("id", K.sign_code(rows.e).alias("c")).collect()}
    assert got == {1: 0b1001, 2: 1 << 63, 3: (1 << 64) - 1}


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_given_tables_are_answered_by_rounds_of_probes(spark, sf):
    rows = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")
    got = rows.select("vec_id", K.sign_code(rows.embedding).alias("code")).orderBy("vec_id").toPandas()
    ids, codes = got.vec_id.to_numpy(), got.code.to_numpy(np.int64).view(np.uint64)
    index = K.MultiIndex(ids, codes)
    some = codes[ids % 50 == 0]
    q, row, distance = index.search(some, 10)
    far = np.bitwise_count(some[:, None] ^ codes[None, :]).astype(np.int64) * 10**6 + np.arange(len(codes))
    want = np.sort(far, axis=1)[:, :10]
    assert index.rounds > 1 and len(index.tables) > 3
    assert [sorted((distance * 10**6 + row)[q == k].tolist()) for k in range(len(some))] == want.tolist()


def test_wide_searches_end_with_the_last_round():
    """Queries far from all rows, fewer rows than k, and tables of one row."""
    codes = np.array([0, 1, 3, 7], np.uint64)
    index = K.MultiIndex(np.arange(4), codes)
    q, row, distance = index.search(np.array([2**64 - 1, 0], np.uint64), 3)
    assert sorted(zip(q.tolist(), row.tolist(), distance.tolist(), strict=True)) == [(0, 1, 63), (0, 2, 62), (0, 3, 61), (1, 0, 0), (1, 1, 1), (1, 2, 2)]
    q, row, distance = K.MultiIndex(np.arange(1), codes[:1]).search(np.array([2**64 - 1], np.uint64), 3)
    assert (q.tolist(), row.tolist(), distance.tolist()) == ([0], [0], [64])


def test_null_ids_vectors_and_extra_columns(spark):
    vectors = [(0, [1.0] * 64), (1, [-1.0] * 64), (None, [1.0] * 64), (2, None), (3, []), (50, [0.5, None, 2.0]), (50, [0.5, None, 2.0])]
    table = spark.createDataFrame([(i, v, "x", 1) for i, v in vectors], "vec_id bigint, embedding array<float>, code string, shard int")
    rows = table.where("vec_id IS NOT NULL AND size(embedding) > 0").select(table.vec_id.alias("id"), K.sign_code(table.embedding).alias("code"))
    got = sorted((r["query_id"], r["rank"], r["neighbour_id"], r["distance"]) for r in K.top_k(rows, rows.where("id % 50 = 0"), 3).collect())
    assert got == [(0, 1, 0, 0), (0, 2, 50, 62), (0, 3, 50, 62), (50, 1, 50, 0), (50, 2, 50, 0), (50, 3, 1, 2)]
