"""Tiles from raw features: profiles cleaned in a fixed order, node elevations made unique.

The order matters: spikes go before nodes are read, ground before bridges gives a node its
elevation, ends are set before gaps are filled, roads are capped before they are smoothed, and
profiles are quantised last. Nodes are grouped over the whole table, so a tile needs
no margin of its neighbours and the result does not depend on how the work is cut.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from switchback.operators import geometry as M
from switchback.operators import profiles as P
from switchback.operators import relations as R
from switchback.search.climbs import cap_road_grade

STEP_M = 5.0


def profile_points(segments: DataFrame, elevation: Callable) -> DataFrame:
    """(g, i, s, x, y, z): positions each 5 m and the end, with sampled elevations. ``segments``:
    (id, geom); ``elevation(x, y)`` is a column."""
    inner = M.sample(segments, STEP_M).select(F.col("id").alias("g"), F.col("i").cast("bigint").alias("i"), "s", "x", "y")
    side = M.sides(segments).groupBy("id").agg(F.sum("len").alias("length"), F.max_by(F.struct("bx", "by"), "side").alias("end"))
    last = side.where("length > 0").select(F.col("id").alias("g"), F.ceil(F.col("length") / STEP_M).alias("i"), F.col("length").alias("s"), F.col("end.bx").cast("double").alias("x"), F.col("end.by").cast("double").alias("y"))
    return inner.unionByName(last).withColumn("z", elevation(F.col("x"), F.col("y")))


def node_elevations(points: DataFrame, segments: DataFrame) -> DataFrame:
    """(nx, ny, zn): the first known elevation at each end point; ground before bridges and tunnels, then by id."""
    flags = segments.select(F.col("id").alias("g"), "flat")
    ends = points.groupBy("g").agg(F.min_by(F.struct("x", "y", F.col("clean").alias("z")), "i").alias("a"), F.max_by(F.struct("x", "y", F.col("clean").alias("z")), "i").alias("b")).join(flags, "g")
    both = ends.select("g", "flat", F.posexplode(F.array("a", "b")).alias("side", "p")).select("g", "flat", "side", F.round("p.x", 1).alias("nx"), F.round("p.y", 1).alias("ny"), "p.z")
    return both.where("z IS NOT NULL").groupBy("nx", "ny").agg(F.min_by("z", F.struct("flat", "g", "side")).alias("zn"))


def _finish(pdf: pd.DataFrame) -> pd.DataFrame:
    """One segment: cap roads, straighten bridges, smooth the rest, quantise to decimetres."""
    pdf = pdf.sort_values("i")
    s, z = pdf.s.to_numpy(float), pdf.filled.to_numpy(float)
    first = pdf.iloc[0]
    if first.road:
        z = cap_road_grade(s, z)
    if first.flat:
        z = z[0] + (z[-1] - z[0]) * s / max(s[-1], 1e-9)
    elif len(z) > 2:
        z = np.concatenate([[z[0]], (z[:-2] + z[1:-1] + z[2:]) / 3, [z[-1]]])
    dm = np.rint(z * 10).astype(np.int64)
    step = np.diff(dm)
    return pd.DataFrame([(int(first.g), dm.tolist(), int(step[step > 0].sum()), int(-step[step < 0].sum()), bool((abs(step) > 100).any()))], columns=["id", "z_dm", "dplus_dm", "dminus_dm", "jump"])


def build(segments: DataFrame, elevation: Callable) -> DataFrame:
    """``segments`` (id, geom, nature, importance, flat) with length, profile and ascent. A segment without any
    known elevation is left out."""
    points = P.despike(profile_points(segments, elevation))
    nodes = node_elevations(points, segments)
    last = points.groupBy("g").agg(F.max("i").alias("last"))
    ends = points.join(last, "g").withColumn("nx", F.when((F.col("i") == 0) | (F.col("i") == F.col("last")), F.round("x", 1))).withColumn("ny", F.round("y", 1))
    fixed = ends.join(nodes, ["nx", "ny"], "left").withColumn("clean", F.coalesce("zn", "clean"))
    filled = P.fill_gaps(fixed, "clean").where("filled IS NOT NULL")
    kinds = segments.select(F.col("id").alias("g"), "flat", F.col("nature").isin(*R.ROADS).alias("road"))
    done = filled.select("g", "i", "s", "filled").join(kinds, "g").groupBy("g").applyInPandas(_finish, "id bigint, z_dm array<int>, dplus_dm bigint, dminus_dm bigint, jump boolean")
    length = M.sides(segments).groupBy("id").agg(F.bround(10 * F.sum("len")).cast("bigint").alias("len_dm"))
    return segments.join(length, "id").join(done, "id")


def check(tiles: DataFrame, expected: DataFrame) -> DataFrame:
    """Problems of built tiles: (ix, iy, problem, severe)."""
    gone = expected.join(tiles.select("ix", "iy"), ["ix", "iy"], "left_anti").select("ix", "iy", F.lit("missing").alias("problem"), F.lit(True).alias("severe"))
    tests = F.array_compact(F.array(
        F.when(F.col("jumps") > F.greatest(F.lit(10.0), 0.005 * F.col("n")), F.struct(F.lit("jumps").alias("problem"), F.lit(True).alias("severe"))),
        F.when(F.col("nodata_frac") > 0.6, F.struct(F.lit("no data").alias("problem"), F.lit(True).alias("severe"))).when(F.col("nodata_frac") > 0.01, F.struct(F.lit("some data missing").alias("problem"), F.lit(False).alias("severe"))),
        F.when(F.col("node_fallback") > 0.002 * F.col("n"), F.struct(F.lit("nodes without elevation").alias("problem"), F.lit(False).alias("severe"))),
    ))
    found = tiles.select("ix", "iy", F.explode(tests).alias("t")).select("ix", "iy", "t.problem", "t.severe")
    return gone.unionByName(found)
