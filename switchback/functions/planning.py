"""Scalar rules of requests and loops as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def suggested_seconds(distance_km: Column, loops: Column) -> Column:
    """20 s up to 10 km and 60 s at 100 km, in steps of five; half as much again for each further loop; 180 s at most."""
    base = 20.0 + F.greatest(distance_km - 10.0, F.lit(0.0)) * 40.0 / 90.0
    return F.least(F.greatest(5.0 * F.round(base / 5.0), F.lit(20.0)) * (1.0 + 0.5 * (F.greatest(loops, F.lit(1)) - 1)), F.lit(180.0))


def cap_km(ascent: Column, relief: Column) -> Column:
    """The longest distance for a wanted ascent; plains need more."""
    return clamp(ascent / F.when(relief < 600, 15.0).otherwise(25.0), 3.0, 60.0)


def radius_m(distance_m: Column) -> Column:
    """Half the distance, but never over an area of 1,965 km²."""
    return F.least(distance_m / 2.0, F.lit((0.99 * 1965e6 / 3.141592653589793) ** 0.5))


def length_bounds(mode: Column, length: Column, tol: Column) -> Column:
    """struct(target, low, high) of a request's length."""
    low = F.when(mode == "max", length * (1 - tol)).when(mode == "target", 0.7 * length).otherwise(0.0)
    high = F.when(mode == "max", length * (1 + tol)).when(mode == "target", 1.3 * length).otherwise(length)
    return F.struct(length.alias("target"), low.alias("low"), high.alias("high"))


def on_target(value: Column, target: Column, share: float = 0.08) -> Column:
    return F.abs(value - target) <= share * target


def score(mode: Column, length: Column, ascent: Column, target: Column, wanted: Column, high: Column, violation: Column, missed: Column) -> Column:
    """What a solver maximises."""
    best = ascent - 3 * (ascent / F.greatest(length, F.lit(1.0))) * F.greatest(length - target, F.lit(0.0)) - 0.5 * violation
    near = -(F.abs(length - target) / target + F.abs(ascent - wanted) / wanted)
    short = -length - 100 * F.greatest(wanted - ascent, F.lit(0.0)) - 10 * F.greatest(length - high, F.lit(0.0))
    return F.when(mode == "max", best).when(mode == "target", near).otherwise(short) - 1e6 * missed


def feasible(mode: Column, length: Column, ascent: Column, low: Column, high: Column, wanted: Column, missed: Column) -> Column:
    held = F.when(mode == "min_distance", (ascent >= wanted) & (length <= high)).otherwise(length.between(low, high))
    return held & (missed == 0)


def face_iterations(seconds: Column, loops: Column) -> Column:
    return F.floor(3e5 * seconds / (1 + 0.5 * (loops - 1)))


def classic_mutations(edges: Column, seconds: Column) -> Column:
    return clamp(3.5e7 / edges, 5e3, 3e4) * F.least(F.lit(1.0), seconds / 5.0)


def effort_km(km: Column, ascent: Column) -> Column:
    return km + ascent / 100.0


def compute_seconds(km: Column, loops: Column, goal: Column, climbs: Column) -> Column:
    """Seconds of a request with ``goal`` max, target or min_distance; above 40 km at most two loops are searched."""
    searched = F.when(km > 40, F.least(loops, F.lit(2))).otherwise(loops)
    factor = F.when(goal == "min_distance", 0.6).otherwise(1.0) * F.when((climbs == "long") & (goal != "target"), 1.8).otherwise(1.0)
    return F.least(F.lit(15.0), (3.2 + 0.085 * km) * (1 + 0.12 * (searched - 1)) * factor) + 0.5


def next_version(version: Column) -> Column:
    """``base`` becomes ``base.1`` and ``base.n`` becomes ``base.n+1``."""
    number = F.regexp_extract(version, r"\.(\d+)$", 1)
    return F.when(number == "", F.concat(version, F.lit(".1"))).otherwise(F.concat(F.regexp_replace(version, r"\.\d+$", ""), F.lit("."), (F.nullif(number, F.lit("")).cast("int") + 1).cast("string")))


def calm(share: Column, own: Column) -> Column:
    """0 to 15; rounds half to even."""
    return F.bround(15 * share * own).cast("int")


def shrink_radius(radius: Column, rows: Column, cap: int) -> Column:
    """One step of fitting a region to a number of rows."""
    return F.when(rows > cap, radius * 0.95 * F.sqrt(F.lit(float(cap)) / rows)).otherwise(radius)
