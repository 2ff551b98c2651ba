"""Connected components by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def connected(edges: DataFrame) -> DataFrame:
    """(u, v) long edges to (id, root): root is the smallest id reachable from id.

    Each round points every vertex's larger neighbours, then its smaller ones, at its
    smallest neighbour; rounds end when the edges stay the same, after about log(n).
    Vertices of any degree are reduced by min() with map-side partial sums.
    """

    def tidy(df: DataFrame) -> DataFrame:
        return df.where("u <> v").distinct()

    def mark(df: DataFrame):
        return df.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()

    now = stored(tidy(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))), "edges")
    seen = mark(now)
    while seen["n"]:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = tidy(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        small = small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        now = stored(tidy(small), "edges")
        last, seen = seen, mark(now)
        if seen == last:
            break
    roots = now.select(F.col("u").alias("id"), F.col("v").alias("root"))
    return roots.union(now.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())
