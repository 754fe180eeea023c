import numpy as np

from switchback.operators.grouped import map_groups


def test_groups_are_whole_and_ordered(spark):
    """Groups across batches, of one row, and a large one; and no rows at all."""
    sizes = {k: (1 if k % 3 else 40) for k in range(60)} | {99: 25_000}
    rows = spark.createDataFrame([(k, i, float(i * k)) for k, n in sizes.items() for i in range(n)], "k bigint, i bigint, x double").repartition(7)
    kernel = lambda k, c: [(k, len(c["i"]), bool((np.diff(c["i"]) == 1).all()), float(c["x"].sum()), [int(c["i"][0]), int(c["i"][-1])])]
    out = map_groups(rows, "k", ["i"], kernel, "k bigint, n bigint, ordered boolean, total double, ends array<bigint>")
    got = sorted(tuple(r) for r in out.collect())
    assert got == [(k, n, True, float(k) * n * (n - 1) / 2, [0, n - 1]) for k, n in sorted(sizes.items())]
    assert map_groups(rows.limit(0), "k", ["i"], kernel, "k bigint, n bigint, ordered boolean, total double, ends array<bigint>").count() == 0
    assert map_groups(rows, "k", ["i"], lambda k, c: [], "k bigint").count() == 0
