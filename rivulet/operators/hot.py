"""Joins of rows with one fact for each key, whatever share of the rows a key has."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: So many of the most frequent keys have their facts sent to all tasks; any other key has less than this share of the rows.
FREQUENT = 256
#: Rows that meet nothing are dealt to so many parts.
SPREAD = 10_000


def frequent(rows: DataFrame, key: list[str], most: int = FREQUENT) -> DataFrame:
    """The most frequent keys, none of them null, and their number n."""
    there = reduce(lambda a, b: a & b, [F.col(f"`{k}`").isNotNull() for k in key])
    return rows.filter(there).groupBy(*key).agg(F.count("*").alias("n")).orderBy(F.desc("n"), *key).limit(most)


def join_facts(rows: DataFrame, facts: DataFrame, key: list[str], small: bool = False, source: DataFrame | None = None) -> DataFrame:
    """rows with the columns of facts, null where there is none (key: columns of both; facts has one row for a key).

    small: facts is known to be small enough for all tasks. Else the facts of the most frequent keys are, at most
    FREQUENT; rows of these keys and of null ones are dealt evenly, and only the others by their key. source: a frame in
    which keys are as frequent as in rows, where rows are dear to make: they are then read once."""
    if small:
        return rows.join(F.broadcast(facts), key, "left")
    made = [c for c in facts.columns if c not in key]
    top = F.broadcast(frequent(rows if source is None else source, key).select(*key, F.lit(True).alias("__top")))
    near = facts.join(top, key, "left_semi").select(*key, *[F.col(f"`{c}`").alias(f"__near_{c}") for c in made])
    marked = rows.join(top, key, "left").join(F.broadcast(near), key, "left")
    missing = reduce(lambda a, b: a | b, [F.col(f"`{k}`").isNull() for k in key])
    # A part of the key that no fact has, so that such rows meet nothing and do not lie together.
    apart = 1 + F.pmod(F.monotonically_increasing_id(), F.lit(SPREAD))
    marked = marked.withColumn("__part", F.when(F.col("__top") | missing, apart).otherwise(F.lit(0).cast("bigint")))
    met = marked.join(facts.withColumn("__part", F.lit(0).cast("bigint")), [*key, "__part"], "left")
    return met.select(*[F.col(f"`{c}`") for c in rows.columns], *[F.coalesce(F.col(f"`__near_{c}`"), F.col(f"`{c}`")).alias(c) for c in made])
