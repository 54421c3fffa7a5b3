"""Connected components of a table of links, by alternating large-star and small-star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rivulet.llm.common import materialise


def _distinct(edges: DataFrame) -> DataFrame:
    return edges.filter("u != v").groupBy("u", "v").agg(F.lit(1).alias("_")).select("u", "v")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
    return _distinct(both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return _distinct(moved.unionAll(least.select("u", F.col("m").alias("v"))))


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """id and component (the smallest id reachable) for each id with a link to another; ids are non-null longs.

    Each round is two aggregations and two joins over the links, written to the shared folder; the number of rounds
    grows with the logarithm of the longest path. Nothing but a count and a checksum reaches the driver."""
    now = materialise(_distinct(edges.select(F.col(a).alias("u"), F.col(b).alias("v"))))
    mark = _mark(now)
    while mark[0]:
        now = materialise(_small_star(_large_star(now)))
        if (new := _mark(now)) == mark:
            break
        mark = new
    return now.select(F.col("u").alias("id"), F.col("v").alias("component"))
