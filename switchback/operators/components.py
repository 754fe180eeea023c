"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from switchback.storage import discard, materialize


def connected_components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """``(node, root)`` for each node with an edge to another node; ``root`` is the least
    node of its component. Rows with a null end, loops and repeated edges are ignored.

    Each round rewires neighbours to the least node seen and is written to the shared
    folder; the number of rounds grows with the logarithm of the component's diameter.
    Minima are pre-aggregated before each shuffle, and joins with a hub's rows
    can be split by adaptive execution.
    """
    pairs = edges.select(F.greatest(u, v).alias("a"), F.least(u, v).alias("b")).where(F.col(u).isNotNull() & F.col(v).isNotNull() & (F.col(u) != F.col(v))).distinct()
    stars, seen = materialize(pairs, "stars"), None
    while True:
        mark = stars.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first()
        if tuple(mark) == seen:
            return stars.select(F.col("a").alias("node"), F.col("b").alias("root")).union(stars.select(F.col("b"), F.col("b"))).distinct()
        seen = tuple(mark)
        both = stars.select(F.col("a").alias("x"), F.col("b").alias("y")).union(stars.select("b", "a"))
        least = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = both.where("y > x").join(least, "x").select(F.col("y").alias("a"), F.col("m").alias("b")).distinct()
        floor = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(floor, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(floor.select("a", F.col("m").alias("b"))).distinct()
        done = stars
        stars = materialize(small, "stars")
        discard(done)
