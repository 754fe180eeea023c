"""Views of the driver's tables in the shapes of the data model, as DataFrames and as SQL.

``prof``: elevation profiles (g, i, s, z). ``seg``: road and path segments with an id, lengths, classes
and a three-vertex polyline. ``edge``: one small connected multigraph for each g. All integers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from switchback.storage import table

PROF = """prof AS (SELECT g, i, 5 * i AS s, z FROM (SELECT user_id AS g, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, CAST(floor(value) AS BIGINT) AS z FROM events))"""
SEG = """seg AS (SELECT id, len, w, nature, importance, flags, x, y, x + id % 97 - 48 AS x1, y + id % 89 - 44 AS y1, x + id % 193 - 96 AS x2, y + (id // 7) % 181 - 90 AS y2, x // 2000 AS ix, y // 2000 AS iy FROM (
SELECT l_orderkey * 10 + l_linenumber AS id, CAST(max(l_quantity) AS BIGINT) * 10 AS len, CAST(floor(max(l_extendedprice) / 100) AS BIGINT) AS w, min(l_suppkey) % 11 AS nature, min(l_partkey) % 7 AS importance, min(l_suppkey + l_partkey) % 4 AS flags,
(min(l_partkey) * 7919) % 40000 AS x, (min(l_suppkey) * 104729 + min(l_linenumber) * 31) % 40000 AS y FROM lineitem GROUP BY l_orderkey * 10 + l_linenumber))"""
EDGE = f"""{PROF}, edge AS (SELECT g, eid, u, v, len, w FROM (SELECT g, i AS eid, z % 25 AS u, lead(z) OVER (PARTITION BY g ORDER BY i) % 25 AS v, 20 + (z * 7) % 80 AS len, abs(lead(z) OVER (PARTITION BY g ORDER BY i) - z) % 60 AS w FROM prof) WHERE v IS NOT NULL AND u <> v)"""


def prof(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value")
    i = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return rows.select(F.col("user_id").alias("g"), i.cast("bigint").alias("i"), F.floor("value").alias("z")).select("g", "i", (5 * F.col("i")).alias("s"), "z")


def seg(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    base = li.groupBy((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id")).agg(
        (F.max("l_quantity").cast("bigint") * 10).alias("len"), F.floor(F.max("l_extendedprice") / 100).alias("w"), (F.min("l_suppkey") % 11).alias("nature"), (F.min("l_partkey") % 7).alias("importance"),
        (F.min(F.col("l_suppkey") + F.col("l_partkey")) % 4).alias("flags"), ((F.min("l_partkey") * 7919) % 40000).alias("x"), ((F.min("l_suppkey") * 104729 + F.min("l_linenumber") * 31) % 40000).alias("y"),
    )
    return base.select(
        "id", "len", "w", "nature", "importance", "flags", "x", "y", F.expr("x + id % 97 - 48").alias("x1"), F.expr("y + id % 89 - 44").alias("y1"),
        F.expr("x + id % 193 - 96").alias("x2"), F.expr("y + (id div 7) % 181 - 90").alias("y2"), F.expr("x div 2000").alias("ix"), F.expr("y div 2000").alias("iy"),
    )


def edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    nxt = F.lead("z").over(W.partitionBy("g").orderBy("i"))
    rows = prof(spark, sf_dir).select("g", F.col("i").alias("eid"), (F.col("z") % 25).alias("u"), (nxt % 25).alias("v"), (20 + (F.col("z") * 7) % 80).alias("len"), (F.abs(nxt - F.col("z")) % 60).alias("w"))
    return rows.where("v IS NOT NULL AND u <> v")
