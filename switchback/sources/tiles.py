"""Tiles: import of zipped integer arrays, partitioned Parquet, manifests and checks."""

from __future__ import annotations

import io
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "ix int, iy int, id bigint, len_dm int, dplus_dm int, dminus_dm int, max_grade_pm int, nature smallint, importance smallint, flat boolean, ok boolean, geom array<struct<x:bigint,y:bigint>>, z_dm array<int>, parallel_ids array<bigint>"
TILE_DM = 200_000
PROFILE_DM = 50
FORMAT = "tiles/1"
FILE_ROWS = 1 << 16  # of a tile file, about


def profile_count(len_dm: int) -> int:
    return -(-len_dm // PROFILE_DM) + 1


def _pieces(values, counts):
    out, at = [], 0
    for n in counts:
        out.append(values[at : at + n])
        at += n
    return out


def decode(raw: bytes, ix: int, iy: int) -> dict[str, list]:
    """Columns of one tile file, deltas undone and lengths checked."""
    import numpy as np

    with np.load(io.BytesIO(raw), allow_pickle=False) as f:
        data = {name: f[name].astype(np.int64) for name in f.files}
    n = len(data["id_d"])
    lengths, vertices, parallels = data["len_dm"], data["geom_n"], data["par_n"]
    profiles = [profile_count(int(x)) for x in lengths]
    rules = {
        "columns differ in length": any(len(data[c]) != n for c in ("len_dm", "dplus_dm", "dminus_dm", "max_grade_pm", "nature", "importance", "flags", "geom_n", "prof_z0_dm", "par_n")),
        "a segment of under two vertices": bool((vertices < 2).any()), "vertices do not add up": vertices.sum() != len(data["geom_x"]) or vertices.sum() != len(data["geom_y"]),
        "parallels do not add up": parallels.sum() != len(data["par_id"]), "a segment without length": bool((lengths < 1).any()), "profiles do not add up": sum(profiles) != len(data["prof_d"]),
    }
    if broken := [name for name, bad in rules.items() if bad]:
        raise ValueError(f"tile {ix}_{iy}: {', '.join(broken)}")
    xs = [np.cumsum(p) + ix * TILE_DM for p in _pieces(data["geom_x"], vertices)]
    ys = [np.cumsum(p) + iy * TILE_DM for p in _pieces(data["geom_y"], vertices)]
    return {
        "ix": [ix] * n, "iy": [iy] * n, "id": np.cumsum(data["id_d"]).tolist(), **{c: data[c].tolist() for c in ("len_dm", "dplus_dm", "dminus_dm", "max_grade_pm", "nature", "importance")},
        "flat": ((data["flags"] & 1) > 0).tolist(), "ok": ((data["flags"] & 2) > 0).tolist(), "geom": [[{"x": int(x), "y": int(y)} for x, y in zip(a, b, strict=True)] for a, b in zip(xs, ys, strict=True)],
        "z_dm": [(np.cumsum(p) + z).tolist() for p, z in zip(_pieces(data["prof_d"], profiles), data["prof_z0_dm"], strict=True)], "parallel_ids": [p.tolist() for p in _pieces(data["par_id"], parallels)],
    }


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Segments of all tile files named ``<ix>_<iy>.npz``, or ``<ix>_<iy>_<part>.npz``, below ``path``."""
    kinds = [pa.int32()] * 2 + [pa.int64()] + [pa.int32()] * 4 + [pa.int16()] * 2 + [pa.bool_()] * 2 + [pa.list_(pa.struct([("x", pa.int64()), ("y", pa.int64())])), pa.list_(pa.int32()), pa.list_(pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, raw in zip(*batch.columns, strict=True):
                ix, iy, *_ = map(int, name.as_py().rpartition("/")[2].removesuffix(".npz").split("_"))
                data = decode(raw.as_py(), ix, iy)
                for at in range(0, len(data["id"]), 1 << 13):
                    yield pa.RecordBatch.from_arrays([pa.array(c[at : at + (1 << 13)], k) for c, k in zip(data.values(), kinds, strict=True)], list(data))

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npz").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInArrow(run, SCHEMA)


def _deltas(values, first=0):
    import numpy as np

    return np.diff(np.asarray(values, np.int64), prepend=first)


def encode(rows: pa.Table, ix: int, iy: int) -> bytes:
    """A tile file of rows of ``SCHEMA``, in the order of ids: what ``decode`` reads."""
    import numpy as np

    rows = rows.sort_by("id").combine_chunks()
    one = lambda c: pc.fill_null(rows[c].cast(pa.int64()), 0).to_numpy()

    def many(name: str):
        """The values of all lists after each other, and how many each has."""
        lists = pa.concat_arrays([*rows[name].chunks, pa.array([], rows[name].type)])
        return lists.flatten(), pc.fill_null(pc.list_value_length(lists), 0).to_numpy().astype(np.int64)

    def deltas(values, counts, at: int):
        """Differences within each list, its first one from ``at``."""
        out = np.diff(np.asarray(values, np.int64), prepend=0)
        first = (np.cumsum(counts) - counts)[counts > 0]
        out[first] = np.asarray(values, np.int64)[first] - at
        return out

    geom, vertices = many("geom")
    heights, steps = many("z_dm")
    parallel, links = many("parallel_ids")
    heights = heights.cast(pa.int64()).to_numpy()
    starts = np.cumsum(steps) - steps
    profile = np.diff(heights, prepend=0)
    profile[starts] = 0
    columns = {
        "id_d": _deltas(one("id")), **{c: one(c) for c in ("len_dm", "dplus_dm", "dminus_dm", "max_grade_pm", "nature", "importance")}, "flags": one("flat") | 2 * one("ok"),
        "geom_n": vertices, **{f"geom_{c}": deltas(geom.field(c).to_numpy(), vertices, at * TILE_DM) for c, at in (("x", ix), ("y", iy))},
        "prof_z0_dm": heights[starts], "prof_d": profile, "par_n": links, "par_id": parallel.to_numpy(),
    }
    out = io.BytesIO()
    np.savez_compressed(out, **{name: np.asarray(values, np.int64) for name, values in columns.items()})
    return out.getvalue()


def write_archives(segments: DataFrame, folder: str) -> DataFrame:
    """Writes the files of each tile of ``segments`` (``SCHEMA``) below ``folder`` and returns (ix, iy, part, n, sha256) of each. A tile
    of up to ``FILE_ROWS`` segments is one file, a larger one is parted by a hash of the ids, so that no task holds more than
    a part. A file gets its name only once it is whole, so readers and tasks that run again never see a part of one."""

    def run(key, rows):
        import hashlib
        import uuid

        from pyarrow import fs

        ix, iy, part = (k.as_py() for k in key)
        raw = encode(rows, ix, iy)
        system, path = fs.FileSystem.from_uri(folder)
        system.create_dir(path, recursive=True)
        name = f"{ix}_{iy}_{part}" if part else f"{ix}_{iy}"
        draft = f"{path}/{name}.{uuid.uuid4().hex}.part"
        with system.open_output_stream(draft, compression=None) as out:
            out.write(raw)
        system.move(draft, f"{path}/{name}.npz")
        return pa.table({"ix": pa.array([ix], pa.int32()), "iy": pa.array([iy], pa.int32()), "part": pa.array([part], pa.int32()), "n": [rows.num_rows], "sha256": [hashlib.sha256(raw).hexdigest()]})

    parts = segments.groupBy("ix", "iy").agg(F.ceil(F.count("*") / F.lit(FILE_ROWS)).alias("__parts"))
    dealt = segments.join(F.broadcast(parts), ["ix", "iy"]).withColumn("part", F.pmod(F.xxhash64("id"), "__parts").cast("int"))  # a row for each tile
    return dealt.drop("__parts").groupBy("ix", "iy", "part").applyInArrow(run, "ix int, iy int, part int, n bigint, sha256 string")


def write_tiles(segments: DataFrame, path: str) -> None:
    """One folder for each tile; only the tiles in ``segments`` are replaced."""
    rows = segments.repartition("ix", "iy").sortWithinPartitions("ix", "iy", "id")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("ix", "iy").parquet(path)


def manifest(segments: DataFrame) -> DataFrame:
    """Statistics and a digest of each tile."""
    return segments.groupBy("ix", "iy").agg(F.count("*").alias("n"), F.round(F.sum("len_dm") / 10000.0, 3).alias("km"), F.sum(F.size("parallel_ids")).alias("par_links"), F.sha2(F.array_join(F.array_sort(F.collect_list("id")).cast("array<string>"), ","), 256).alias("sha256"))


def unfinished(segments: DataFrame, done: DataFrame) -> DataFrame:
    """Tiles whose digest is not in ``done``: what a resumed build still has to write."""
    return manifest(segments).join(done.select("ix", "iy", "sha256"), ["ix", "iy", "sha256"], "left_anti")


def merge(shards: list[DataFrame]) -> DataFrame:
    """All shards' tiles; a tile in two shards is an error."""
    keys = reduce(DataFrame.unionByName, [shard.select("ix", "iy").distinct() for shard in shards])
    twice = keys.groupBy("ix", "iy").count().where("count > 1").take(1)
    if twice:
        raise ValueError(f"tile {twice[0]['ix']}_{twice[0]['iy']} is in two shards")
    return reduce(DataFrame.unionByName, shards)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(tile, n, sha256) of a manifest file; another format is refused."""
    rows = spark.read.schema("format string, version string, tiles map<string,struct<n:bigint,sha256:string>>").json(path, multiLine=True, mode="FAILFAST")
    tiles = rows.select(F.when(F.col("format") == FORMAT, F.col("tiles")).otherwise(F.raise_error(F.lit("unknown tile format")).cast("map<string,struct<n:bigint,sha256:string>>")).alias("tiles"))
    return tiles.select(F.explode("tiles").alias("tile", "t")).select("tile", "t.n", "t.sha256")


def read_list(spark: SparkSession, path: str) -> DataFrame:
    """Tile keys, one in a line."""
    key = F.trim("value")
    return spark.read.text(path).where(key != "").select(F.regexp_extract(key, r"(-?\d+)_(-?\d+)$", 1).cast("int").alias("ix"), F.regexp_extract(key, r"(-?\d+)_(-?\d+)$", 2).cast("int").alias("iy"))
