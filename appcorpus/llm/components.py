"""Connected components of an edge table, by alternating star contractions."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, dealt_anew


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(dealt_anew("u").alias("u"), F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least.select(dealt_anew("u").alias("u"), "m"), "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b")
    return moved.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges: (a, b) in any order and number. Returns (a, b): each node that isn't its component's smallest, and the smallest.

    Each round is two shuffles of at most the edges there were; the rounds grow with the logarithm of a component's
    size. A large component becomes a star around one node: minima are partial sums, and the joins that bring them back
    deal out both sides, so adaptive execution splits the star's key. Only counts reach the driver. Loops (a = b) and nulls are dropped; no edges give no rows.
    """
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        state = now.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
        if state[0] == 0 or state == before:
            return now
        before = state
        now = cut(_small_star(_large_star(now)))
