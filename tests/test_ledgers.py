"""The ledger of first sightings and the index of traces against raw events."""

import random
from dataclasses import replace
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from rivulet.engine import Engine
from rivulet.operators import views
from rivulet.plans.profile import LOGS, SPANS
from rivulet.streaming.firstseen import FirstSeen

D0 = datetime(2026, 9, 1)
DIMS = ("process_name", "dest_ip", "action")


@pytest.fixture(scope="module")
def logs(spark):
    rng, rows = random.Random(5), []
    for i in range(3000):
        day = rng.randrange(30)
        rows.append((
            D0 + timedelta(days=day, seconds=rng.randrange(86400)), rng.choice(("WEB1", "web1", "db", None, "")), rng.choice(("ann", "bob")),
            rng.choice(("a", "b", "", None, f"p{day}")), f"10.0.0.{rng.randrange(3 + day)}", rng.choice(("ok", "fail")), "m",
        ))
    return spark.createDataFrame(rows, "timestamp timestamp, src_host string, user string, process_name string, dest_ip string, action string, message string").cache()


def ledger(spark, tmp_path):
    return FirstSeen(spark, f"file://{tmp_path}/seen", {"host": "src_host", "user": "user"}, DIMS, "timestamp")


def rows(df):
    return sorted(map(str, df.collect()))


def test_baseline_from_the_ledger(spark, tmp_path, logs):
    """All days, some days and none in the ledger give the raw result, also where the window begins within a day."""
    seen = ledger(spark, tmp_path)
    told, plain = (Engine(spark, {"logs": (logs, LOGS)}, first_seen=f) for f in ({"logs": seen}, None))
    ask = [("* | baseline host=web1 window=20d dims=process_name,dest_ip", D0 + timedelta(days=24, hours=7), D0 + timedelta(days=30)), ("* | baseline user=b* window=14d", D0 + timedelta(days=20), D0 + timedelta(days=22, hours=5)), ("* | baseline user=none window=5d", D0 + timedelta(days=20), D0 + timedelta(days=22))]
    want = [rows(plain.run(*x)) for x in ask]
    assert want[0] and want[1]
    assert [rows(told.run(*x)) for x in ask] == want
    days = [(D0 + timedelta(days=i)).date() for i in range(30)]
    assert seen.build(logs, days[3:9] + days[11:12] + days[15:19]) == 11
    assert [rows(told.run(*x)) for x in ask] == want
    assert seen.build(logs, days) == 19 and seen.build(logs, days) == 0
    assert [rows(told.run(*x)) for x in ask] == want
    # The window's whole days come from the ledger alone.
    part = seen.between(logs.filter("1 = 0"), "host", D0 + timedelta(days=2, hours=3), D0 + timedelta(days=5, hours=1))
    assert {r.day for r in part.select("day").distinct().collect()} == set(days[3:5])


def test_a_day_that_broke_off_is_made_anew(spark, tmp_path, logs):
    seen, day = ledger(spark, tmp_path), date(2026, 9, 4)
    seen.of(logs.limit(5)).write.parquet(f"{seen.book.path}/data/{day}-broken")  # written, but not marked
    assert day not in seen.days()
    one = logs.filter(F.to_date("timestamp") == F.lit(day))
    assert seen.build(logs, [day]) == 1
    total = lambda: seen.book.read().filter("dim = '*' AND kind = 'user'").agg(F.sum("event_count")).first()[0]
    assert total() == one.count()
    assert seen.rebuild(logs.union(one), [day]) == 1 and total() == 2 * one.count()
    assert len(seen.book.latest()[1]["folders"]) == 1
    seen.book.clean(keep=-1)
    assert total() == 2 * one.count()


def spans(spark, n=3000):
    i = F.col("id")
    start = F.lit(D0).cast("timestamp") + F.make_dt_interval(days=(i % 100).cast("int"), secs=i % 1000)
    return spark.range(n).select(
        F.concat(F.lit("t"), (i % 100 * 7 + i % 7).cast("string")).alias("trace_id"), i.cast("string").alias("span_id"), start.alias("start_time"), F.to_date(start).alias("day"),
        F.lit("svc").alias("service_name"), F.lit("op").alias("span_name"), F.lit("OK").alias("status_code"),
    )


def test_a_trace_is_read_from_its_days_only(spark, tmp_path):
    """Of a hundred files, one for each day, the index leaves one to read."""
    path = str(tmp_path / "spans")
    spans(spark).repartition(1, "day").write.partitionBy("day").parquet(path)
    read = lambda: spark.read.parquet(path)
    halves = [views.trace_times(read().filter(F.col("span_id").cast("long") % 2 == k)) for k in (0, 1)]
    index = views.merged_trace_times(halves[0].unionByName(halves[1])).cache()
    told, plain = (Engine(spark, {"spans": (read, replace(SPANS, day="day"))}, default="spans", trace_index=x) for x in (index, None))

    def files(e):
        """Files that the scan reads, from the plan that has run."""
        df = e.run("* | trace t45")
        got = sorted(r.span_id for r in df.collect())
        plan = df._jdf.queryExecution().executedPlan()
        plan = plan.executedPlan() if plan.nodeName() == "AdaptiveSparkPlan" else plan
        while plan.children().nonEmpty() or "QueryStage" in plan.nodeName():
            plan = plan.plan() if "QueryStage" in plan.nodeName() else plan.children().head()
        return got, plan.metrics().get("numFiles").get().value()

    (a, few), (b, all_) = files(told), files(plain)
    assert a == b and a and all_ == 100 and few == 1
    assert told.run("* | trace nothing").collect() == []
    window = plain.run("* | stats count", D0 + timedelta(days=3), D0 + timedelta(days=5))
    assert window.first()[0] == 60 and "PartitionFilters: [isnotnull(day" in window._jdf.queryExecution().toString()
