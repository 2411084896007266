"""Connected components of links held in a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint


def _towards_least(links: DataFrame, large: bool) -> DataFrame:
    """One star step over links (u > v): each node's larger (or smaller) neighbours move to its least neighbour."""
    both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else links
    least = both.groupBy("u").agg(F.min("v").alias("least")).select("u", F.least("u", "least").alias("least"))
    moved = both.join(least, "u")
    out = moved.filter("v > u" if large else "v <> least").select(F.col("v").alias("u"), F.col("least").alias("v"))
    return (out if large else out.union(least.select("u", F.col("least").alias("v")))).filter("u <> v").distinct()


def components(links: DataFrame) -> DataFrame:
    """node, component: for every node in links (columns a, b), the least node that links reach; nodes on no link aren't there.

    Alternates large-star and small-star steps until the links don't change, each pair of steps written to the
    checkpoint folder. The driver sees a count and a checksum of each round.
    """
    now = checkpoint(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    seen = None
    while True:
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == seen or state[0] == 0:
            break
        seen = state
        now = checkpoint(_towards_least(_towards_least(now, True), False))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
