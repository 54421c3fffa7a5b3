"""Summaries of events: counts, first and last times and distinct counts by keys and bucket, as states that merge.

Distinct counts are HyperLogLog sketches of 2**PRECISION registers, whose standard error is below one per cent: any
number of partial rows, of any buckets, gives one estimate. An engine that is given a Summary with its table answers
`stats`, `chart` and `timechart` with count and estdc by the keys from it, and reads raw events at the range's edges only."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivulet.plans import times
from rivulet.plans.ast import Agg, Field, Query
from rivulet.plans.errors import QueryError
from rivulet.plans.profile import Profile

PRECISION = 14


def sketch(c: Column) -> Column:
    """State of the distinct values of a column; empty text and null are none."""
    text = c.cast("string")
    return F.hll_sketch_agg(F.when(text != "", text), F.lit(PRECISION))


@dataclass(frozen=True)
class Summary:
    """keys: columns by which events are counted. distinct: columns whose values are. time: of the events. width: of a
    bucket, in seconds. table: partial rows, or what returns them."""

    keys: tuple[str, ...]
    distinct: tuple[str, ...]
    time: str
    width: float = 3600
    table: Any = None

    def partials(self, df: DataFrame) -> DataFrame:
        """Partial rows of events, which may be any part of them."""
        states = [sketch(F.col(f"`{c}`")).alias(f"{c}_state") for c in self.distinct]
        at = F.col(f"`{self.time}`").cast("timestamp")
        return df.groupBy(*[F.col(f"`{k}`") for k in self.keys], times.bucket(at, self.width).alias("bucket")).agg(
            F.count("*").alias("events"), F.min(at).alias("first_event"), F.max(at).alias("last_event"), *states
        )

    def merge(self, partials: DataFrame, span: float | None = None) -> DataFrame:
        """Partial rows of the same keys and bucket as one; span: of coarser buckets."""
        states = [F.hll_union_agg(f"{c}_state").alias(f"{c}_state") for c in self.distinct]
        return partials.groupBy(*[F.col(f"`{k}`") for k in self.keys], times.bucket(F.col("bucket"), span or self.width).alias("bucket")).agg(
            F.sum("events").alias("events"), F.min("first_event").alias("first_event"), F.max("last_event").alias("last_event"), *states
        )

    def profile(self, base: Profile) -> Profile:
        aliases = {k: "bucket" if v == self.time else v for k, v in base.aliases.items()}
        return Profile(f"{base.name}_summary", "bucket", (), aliases, build=lambda scope, a, time: self.of(base, a))

    def of(self, base: Profile, a: Agg) -> Column:
        """An aggregate of events from partial rows."""
        if a.func == "count" and a.arg is None:
            return F.coalesce(F.sum("events"), F.lit(0))
        if a.func == "estdc" and isinstance(a.arg, Field):
            name = base.aliases.get(a.arg.name, a.arg.name)
            return F.coalesce(F.hll_sketch_estimate(F.hll_union_agg(f"{name}_state")), F.lit(0))
        raise QueryError(f"{a.func} can't be made of a summary")

    def answers(self, q: Query, base: Profile) -> bool:
        from rivulet.streaming.rollups import by_key

        name = lambda n: base.aliases.get(n, n)
        if len(q.stages) != 1 or by_key(q.search, set(self.keys), name) is None:
            return False
        s = q.stages[0]
        if s.name not in ("stats", "chart", "timechart") or not s.args["aggs"]:
            return False
        if s.name == "timechart" and (s.get("by") or not s.get("span") or times.seconds(s.get("span")) % self.width):
            return False
        if not {name(n) for n in [*s.get("by", []), *s.get("over", [])]} <= set(self.keys):
            return False
        count = lambda a: a.func == "count" and a.arg is None and a.where is None
        distinct = lambda a: a.func == "estdc" and isinstance(a.arg, Field) and name(a.arg.name) in self.distinct and a.where is None
        return any(distinct(a) for a in s.args["aggs"]) and all(count(a) or distinct(a) for a in s.args["aggs"])
