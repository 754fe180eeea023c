"""Ordered operators on elevation profiles: rows (g, i, s, z) of many profiles at once.

Every function takes and returns rows; windows are partitioned by the profile, so work
is spread over profiles and one shuffle serves a chain of steps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SPIKE_POINTS, SPIKE_M, SPIKE_ROUNDS = 4, 20, 3


def along(key: str = "g", order: str = "i"):
    return W.partitionBy(key).orderBy(order)


def step(column: str = "z") -> Column:
    """Difference to the point before; null at the first."""
    return F.col(column) - F.lag(column).over(along())


def cumulative(rows: DataFrame, part: str, name: str = "s") -> DataFrame:
    """The abscissa of each point: the sum of the step lengths up to it."""
    return rows.withColumn(name, F.sum(part).over(along().rowsBetween(W.unboundedPreceding, 0)))


def delta_encode(rows: DataFrame, column: str = "z") -> DataFrame:
    return rows.withColumn("delta", F.coalesce(step(column), F.col(column)))


def delta_decode(rows: DataFrame, name: str = "decoded") -> DataFrame:
    return rows.withColumn(name, F.sum("delta").over(along().rowsBetween(W.unboundedPreceding, 0)))


def despike(rows: DataFrame, column: str = "z") -> DataFrame:
    """Points over 20 m away from the median of ±4 points become null, three times over.
    Profiles under three points or within 20 m of range stay as they are."""
    whole = W.partitionBy("g")
    active = (F.count("*").over(whole) >= 3) & (F.max(column).over(whole) - F.min(column).over(whole) > SPIKE_M)
    out = rows.withColumn("__on", active).withColumn("clean", F.col(column).cast("double"))
    near = along().rowsBetween(-SPIKE_POINTS, SPIKE_POINTS)
    for _ in range(SPIKE_ROUNDS):
        out = out.withColumn("clean", F.when(F.col("__on") & (F.abs(F.col("clean") - F.percentile("clean", 0.5).over(near)) > SPIKE_M), None).otherwise(F.col("clean")))
    return out.drop("__on")


def fill_gaps(rows: DataFrame, column: str = "z", name: str = "filled") -> DataFrame:
    """Nulls between known points are interpolated along s; past the ends the nearest
    known value holds; a profile without a known point stays null."""
    known = F.when(F.col(column).isNotNull(), F.struct("s", F.col(column).alias("v")))
    before = F.last(known, True).over(along().rowsBetween(W.unboundedPreceding, 0))
    after = F.first(known, True).over(along().rowsBetween(0, W.unboundedFollowing))
    out = rows.withColumn("__a", before).withColumn("__b", after)
    slope = (F.col("__b.v") - F.col("__a.v")) / (F.col("__b.s") - F.col("__a.s"))
    value = (
        F.when(F.col("__a").isNull(), F.col("__b.v")).when(F.col("__b").isNull(), F.col("__a.v")).when(F.col("__a.s") == F.col("__b.s"), F.col("__a.v"))
        .otherwise(F.col("__a.v") + slope * (F.col("s") - F.col("__a.s")))
    )
    return out.withColumn(name, value).drop("__a", "__b")


def smooth(rows: DataFrame, column: str = "z", name: str = "smooth") -> DataFrame:
    """The mean of three points; the ends stay, as do profiles of two points."""
    first, last = F.lag("i").over(along()).isNull(), F.lead("i").over(along()).isNull()
    mean = (F.lag(column).over(along()) + F.col(column) + F.lead(column).over(along())) / 3.0
    return rows.withColumn(name, F.when(first | last, F.col(column).cast("double")).otherwise(mean))


def max_grade(rows: DataFrame, metres: int, column: str = "z") -> DataFrame:
    """(g, max_grade): the steepest slope from any point to the first one at least ``metres``
    on; profiles of at most that length count end to end."""
    ahead = F.first(F.struct("s", F.col(column).alias("z"))).over(along(order="s").rangeBetween(metres, W.unboundedFollowing))
    graded = rows.withColumn("__j", ahead)
    slope = F.abs(F.col("__j.z") - F.col(column)) / (F.col("__j.s") - F.col("s"))
    ends = graded.groupBy("g").agg(F.max(slope).alias("steep"), (F.max("s") - F.min("s")).alias("length"), F.min_by(column, "s").alias("z0"), F.max_by(column, "s").alias("z1"))
    flat = F.abs(F.col("z1") - F.col("z0")) / F.greatest(F.col("length"), F.lit(1e-6))
    return ends.select("g", F.when(F.col("length") <= metres, flat).otherwise(F.coalesce("steep", F.lit(0.0))).alias("max_grade"))


def display_grades(rows: DataFrame, half: int = 25, column: str = "z") -> DataFrame:
    """The slope in percent over the points from the first within ``half`` metres behind
    to the first at least as far ahead; 0 over a metre or less."""
    point = F.struct("s", F.col(column).alias("z"))
    behind = F.first(point).over(along(order="s").rangeBetween(-half, 0))
    ahead = F.coalesce(F.first(point).over(along(order="s").rangeBetween(half, W.unboundedFollowing)), F.last(point).over(along(order="s").rowsBetween(0, W.unboundedFollowing)))
    out = rows.withColumn("__a", behind).withColumn("__b", ahead)
    run = F.col("__b.s") - F.col("__a.s")
    return out.withColumn("grade", F.when(run > 1, 100.0 * (F.col("__b.z") - F.col("__a.z")) / run).otherwise(0.0)).drop("__a", "__b")


def ascent_with_hysteresis(z: Column, threshold: float = 5.0) -> Column:
    """Ascent of an array of elevations: a climb opens once ``threshold`` above the last low
    and closes once as far below its top."""
    start = F.struct(F.get(z, F.lit(0)).cast("double").alias("ref"), F.lit(0.0).alias("up"), F.lit(False).alias("climbing"))

    def move(acc, e):
        e = e.cast("double")
        rise = F.when(acc["climbing"], e > acc["ref"]).otherwise(e - acc["ref"] >= threshold)
        fall = F.when(acc["climbing"], acc["ref"] - e >= threshold).otherwise(e < acc["ref"])
        return (
            F.when(rise, F.struct(e.alias("ref"), (acc["up"] + e - acc["ref"]).alias("up"), F.lit(True).alias("climbing")))
            .when(fall, F.struct(e.alias("ref"), acc["up"].alias("up"), F.lit(False).alias("climbing"))).otherwise(acc)
        )

    return F.aggregate(F.slice(z, 2, F.greatest(F.size(z) - 1, F.lit(0))), start, move, lambda acc: acc["up"])


def runs(rows: DataFrame, flag: Column, name: str = "run") -> DataFrame:
    """Numbers the maximal runs of equal ``flag`` along each profile."""
    out = rows.withColumn("__f", flag)
    change = F.when(F.col("__f") != F.lag("__f").over(along()), 1).otherwise(0)
    return out.withColumn("__c", change).withColumn(name, F.sum("__c").over(along().rowsBetween(W.unboundedPreceding, 0))).drop("__f", "__c")
