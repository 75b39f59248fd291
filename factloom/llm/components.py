"""Connected components of a link table, without collecting links or components anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import removed, shared_dir, stored


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _pull(near: DataFrame, keep_self: bool) -> DataFrame:
    """Points each neighbour b of a at the smallest vertex that a sees; the minima are combined before the shuffle."""
    least = near.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("u", "m").alias("m"))
    if keep_self:  # small star: a and its smaller neighbours
        joined = near.join(least, near.a == least.u).select("b", "m").union(least.select(F.col("u").alias("b"), "m"))
    else:  # large star: the larger neighbours of a
        joined = near.join(least, near.a == least.u).where(F.col("b") > F.col("a")).select("b", "m")
    return joined.where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(v, component): the smallest vertex reachable, for each vertex of edges (a, b) that isn't it.

    Large-star and small-star rounds alternate until only stars are left: no vertex has two smaller neighbours, and none
    has both a smaller and a larger one.  Each round is written to the shared folder, so lineage stays short, and the
    round before it is deleted.  Loops and repeated edges do no harm; an empty table gives an empty table.
    """
    spark = edges.sparkSession
    folder, number = shared_dir(spark), 0
    now = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "0", folder)
    while True:
        ends = now.select(F.col("a").alias("v"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(now.select("b", F.lit(0), F.lit(1)))
        if ends.groupBy("v").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 OR up + down > 1").isEmpty():
            return now.select(F.col("a").alias("v"), F.col("b").alias("component"))
        larger = _pull(_both(now), keep_self=False)
        now, number = stored(_pull(larger, keep_self=True), str(number + 1), folder), number + 1
        removed(spark, f"{folder}/{number - 1}")
