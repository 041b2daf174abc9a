"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remove, save

MOST_ROUNDS = 60


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One step: every node's neighbours (all for large, the smaller for small) go to its least neighbour.

    The least neighbour is found with partial sums before the shuffle, then joined back, so a node
    with very many edges is split like any skewed join key.
    """
    pairs = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = pairs.join(least, "u")
    if large:
        out = joined.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.filter(F.col("u") != F.col("v")).distinct()


def connected_components(edges: DataFrame, where: str, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the least node reachable, for every node with an edge to another.

    Rounds are written tables, so a lost executor costs no more than the round; each halves the depth of the stars
    at least, and the end is a round that changes nothing. Self-loops and repeated edges do no harm.
    """
    spark = edges.sparkSession
    now = save(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u is not null and v is not null and u <> v").distinct(), f"{where}/cc-0")
    mark = None
    for k in range(1, MOST_ROUNDS + 1):
        after = save(_stars(_stars(now, True), False), f"{where}/cc-{k}")
        remove(spark, f"{where}/cc-{k - 1}")
        sums = after.agg(F.count(F.lit(1)), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).first()
        now = after
        if tuple(sums) == mark:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        mark = tuple(sums)
    raise RuntimeError("components did not settle")
