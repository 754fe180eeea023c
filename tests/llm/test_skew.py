from collections import Counter

import pytest

from switchback.llm import skew


@pytest.mark.parametrize("most", [10_000, 3])
def test_join_by_key(spark, monkeypatch, most):
    monkeypatch.setattr(skew, "HOT_ROWS", most)
    monkeypatch.setattr(skew, "HOT_KEYS", 4)
    keys = [None, "a", *"b" * 30, *"c" * 8, "d", "none"]
    rows = spark.createDataFrame(list(enumerate(keys)), "uid int, k string")
    n = Counter(k for k in keys if k not in (None, "none"))
    facts = spark.createDataFrame([(k, v, k.upper()) for k, v in n.items()], "k string, n bigint, fact string")
    got = skew.join_by_key(rows, facts, "k", "n").collect()
    assert sorted((r["uid"], r["fact"]) for r in got) == [(u, k.upper()) for u, k in enumerate(keys) if k in n]
    assert skew.join_by_key(rows, facts.limit(0), "k", "n").count() == 0
