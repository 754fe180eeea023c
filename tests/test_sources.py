import json

import numpy as np
import pytest

from switchback.sources import tiles as T


def archive(path, ids=(10, 20), bad=False):
    n = len(ids)
    delta = lambda a: np.diff(np.array(a), prepend=0)
    lengths = np.array([100, 260][:n], np.int32)
    counts = [T.profile_count(int(x)) for x in lengths]
    np.savez_compressed(
        path, id_d=delta(ids).astype(np.int64), len_dm=lengths, dplus_dm=np.ones(n, np.int32), dminus_dm=np.ones(n, np.int32), max_grade_pm=np.full(n, 60000, np.uint16), nature=np.full(n, 9, np.uint8), importance=np.full(n, 5, np.uint8),
        flags=np.array([3, 2][:n], np.uint8), geom_n=np.array([2, 3][:n], np.int32), geom_x=np.array([5, 10, 7, 1, 1][: 5 - bad], np.int32), geom_y=np.array([5, -1, 7, 2, 2], np.int32),
        prof_d=np.concatenate([[0] + [3] * (c - 1) for c in counts]).astype(np.int16), prof_z0_dm=np.array([1000, 2000][:n], np.int32), par_n=np.array([1, 0][:n], np.uint16), par_id=np.array([20], np.int64),
    )


def test_archives(spark, tmp_path):
    archive(tmp_path / "32_-1.npz")
    rows = {r["id"]: r for r in T.read_archives(spark, str(tmp_path)).collect()}
    a, b = rows[10], rows[20]
    assert (a["ix"], a["iy"], a["flat"], a["ok"], b["flat"]) == (32, -1, True, True, False) and a["max_grade_pm"] == 60000
    assert [tuple(p) for p in a["geom"]] == [(6_400_005, -199_995), (6_400_015, -199_996)] and len(b["geom"]) == 3
    assert a["z_dm"] == [1000, 1003, 1006] and len(b["z_dm"]) == 7 and a["parallel_ids"] == [20] and b["parallel_ids"] == []


def test_damaged_archive(spark, tmp_path):
    archive(tmp_path / "1_2.npz", bad=True)
    with pytest.raises(Exception, match="vertices do not add up"):
        T.read_archives(spark, str(tmp_path)).collect()


def test_write_resume_merge(spark, tmp_path):
    archive(tmp_path / "1_2.npz")
    archive(tmp_path / "3_4.npz")
    rows = T.read_archives(spark, str(tmp_path))
    T.write_tiles(rows, f"{tmp_path}/out")
    back = spark.read.parquet(f"{tmp_path}/out")
    assert back.count() == 4 and sorted((r["ix"], r["iy"]) for r in back.select("ix", "iy").distinct().collect()) == [(1, 2), (3, 4)]
    T.write_tiles(rows.where("ix = 1 AND id = 10"), f"{tmp_path}/out")
    assert spark.read.parquet(f"{tmp_path}/out").count() == 3
    done = T.manifest(spark.read.parquet(f"{tmp_path}/out"))
    assert [(r["ix"], r["iy"]) for r in T.unfinished(rows, done).collect()] == [(1, 2)]
    assert T.merge([rows.where("ix = 1"), rows.where("ix = 3")]).count() == 4
    with pytest.raises(ValueError, match="two shards"):
        T.merge([rows, rows])


def test_manifest_and_list(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"format": "tiles/1", "version": "x", "tiles": {"1_2": {"n": 3, "sha256": "ab"}}}))
    assert [tuple(r) for r in T.read_manifest(spark, f"{tmp_path}/m.json").collect()] == [("1_2", 3, "ab")]
    (tmp_path / "n.json").write_text(json.dumps({"format": "tiles/2", "version": "x", "tiles": {}}))
    with pytest.raises(Exception, match="unknown tile format"):
        T.read_manifest(spark, f"{tmp_path}/n.json").collect()
    (tmp_path / "list.txt").write_text("32_342\n\nre/17_-382\n")
    assert sorted(tuple(r) for r in T.read_list(spark, f"{tmp_path}/list.txt").collect()) == [(17, -382), (32, 342)]


def test_large_tiles_in_parts(spark, tmp_path, monkeypatch):
    """A tile of many segments is several files, each read back as it was; small tiles stay one file."""
    monkeypatch.setattr(T, "FILE_ROWS", 10)
    rows = [(k % 40 // 39, -1, 7 * k, 100, 1, 1, 0, 9, 5, k % 2 == 0, k % 3 == 0, [(k, -k), (k + 5, 3), (0, 0)][: 2 + k % 2], [k, 4, -9], [k + 1] * (k % 3)) for k in range(200)]
    segments = spark.createDataFrame(rows, T.SCHEMA)
    written = T.write_archives(segments, f"file://{tmp_path}/tiles").collect()
    assert sum(r["n"] for r in written) == 200 and max(r["n"] for r in written) < 40 and {r["part"] for r in written if r["ix"] == 1} == {0}
    assert sorted(p.name for p in (tmp_path / "tiles").iterdir() if p.name.endswith("npz")) == sorted(f"{r['ix']}_-1_{r['part']}.npz" if r["part"] else f"{r['ix']}_-1.npz" for r in written)
    assert sorted(map(repr, T.read_archives(spark, f"{tmp_path}/tiles").collect())) == sorted(map(repr, segments.collect()))
