"""Ledger of first sightings: for each day the values that entities had in their dimensions, so that a baseline over
months reads one row for an entity, value and day instead of all events.

A day's rows are written to a folder of their own, and count from the commit on that marks the day as complete. A run
that broke off leaves no mark, and its day is made anew; so is one for which late events have come, by `rebuild`. What
is read of a range: the marked days that lie in it as a whole, and the raw events of the rest."""

from __future__ import annotations

import uuid
from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.operators.views import first_seen
from rivulet.streaming.ledger import Ledger

SCHEMA = "kind string, entity string, dim string, val string, day date, first_seen timestamp, event_count bigint"


class FirstSeen:
    """entities: kind of entity (host, user, ip) to its column. dims: columns whose values are kept. time: of the events."""

    def __init__(self, spark: SparkSession, path: str, entities: dict[str, str], dims: tuple[str, ...], time: str):
        self.spark, self.entities, self.dims, self.time = spark, dict(entities), tuple(dims), time
        self.book = Ledger(spark, path, spark.createDataFrame([], SCHEMA).schema)

    def days(self) -> dict[date, str]:
        """The complete days and their folders."""
        return {date.fromisoformat(d): f for d, f in self.book.latest()[1].get("days", {}).items()}

    def of(self, events: DataFrame) -> DataFrame:
        """The rows of events, by all kinds of entities, without their day's mark."""
        made = None
        for kind, column in self.entities.items():
            one = first_seen(events, F.col(f"`{column}`"), [d for d in self.dims if d != column], self.time, whole=True).withColumn("kind", F.lit(kind))
            made = one if made is None else made.unionByName(one)
        return made.select(self.book.schema.names)

    def build(self, events: DataFrame, days: list[date], again: bool = False) -> int:
        """Makes the days that are not complete, or all of them again; how many. Each is one job over the day's events."""
        done, known = 0, self.days()
        at = F.col(f"`{self.time}`").cast("timestamp")
        for day in days:
            if day in known and not again:
                continue
            start = datetime(day.year, day.month, day.day)
            name = f"{day.isoformat()}-{uuid.uuid4().hex}"
            rows = self.of(events.filter((at >= F.lit(start)) & (at < F.lit(start + timedelta(days=1)))))
            rows.write.parquet(f"{self.book.path}/data/{name}")

            def mark(now: dict, name=name, day=day) -> dict:
                before = now.setdefault("days", {}).get(day.isoformat())
                now["days"][day.isoformat()] = name
                now["folders"] = [f for f in now["folders"] if f[0] != before] + [[name, 0]]
                now["gone"] += [[before, datetime.now().timestamp()]] if before else []
                return now

            self.book.commit(mark)
            done += 1
        return done

    def rebuild(self, events: DataFrame, days: list[date]) -> int:
        return self.build(events, days, again=True)

    def between(self, events: DataFrame, kind: str, start: datetime, end: datetime) -> DataFrame:
        """entity, dim, val, day, first_seen, event_count of a range: of complete days from here, of the rest from events."""
        first = date(start.year, start.month, start.day) + timedelta(days=start != datetime(start.year, start.month, start.day))
        whole = [d for d in self.days().items() if first <= d[0] and datetime(d[0].year, d[0].month, d[0].day) + timedelta(days=1) <= end]
        at = F.col(f"`{self.time}`").cast("timestamp")
        rest = events.filter((at >= F.lit(start)) & (at < F.lit(end)))
        # Complete days that follow each other are left out of the raw rows as one range.
        for lo, hi in _stretches([d for d, _ in whole]):
            rest = rest.filter((at < F.lit(lo)) | (at >= F.lit(hi)))
        column = self.entities[kind]
        raw = first_seen(rest, F.col(f"`{column}`"), [d for d in self.dims if d != column], self.time, whole=True)
        if not whole:
            return raw
        told = self.spark.read.schema(self.book.schema).parquet(*[f"{self.book.path}/data/{f}" for _, f in whole])
        return raw.unionByName(told.filter(F.col("kind") == kind).drop("kind"))


def _stretches(days: list[date]) -> list[tuple[datetime, datetime]]:
    out: list[list[datetime]] = []
    for d in sorted(days):
        start = datetime(d.year, d.month, d.day)
        if out and out[-1][1] == start:
            out[-1][1] = start + timedelta(days=1)
        else:
            out.append([start, start + timedelta(days=1)])
    return [tuple(x) for x in out]

