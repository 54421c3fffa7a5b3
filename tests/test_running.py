"""Running aggregates that are split over tasks against the plain window."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from rivulet.engine import Engine
from rivulet.operators import running
from rivulet.plans.profile import EVENTS

T0 = datetime(2026, 10, 1)


@pytest.fixture(scope="module")
def events(spark):
    """Bursts, times of several events, null times, values and keys; a key of most rows."""
    rng, rows = random.Random(7), []
    for i in range(4000):
        at = T0 + timedelta(seconds=rng.choice((rng.randrange(50), rng.randrange(10**6))))
        rows.append((i, None if rng.random() < 0.01 else at, rng.choice((1, 1, 1, 1, 2, None, i % 300)), rng.choice("abc"), None if rng.random() < 0.1 else float(rng.randrange(1000)), "{}"))
    return spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").repartition(7).cache()


AGGS = "count as n, count(value) as m, sum(value) as s, avg(value) as a, min(value) as lo, max(value) as hi, range(value) as r, first(event_type) as f, last(value) as l"


@pytest.mark.parametrize("by", ["", " by user_id"])
@pytest.mark.parametrize("options", ["", "current=false ", "window=5 ", "window=3 current=false ", "window=40 "])
def test_split_rows_have_the_same_results(events, spark, monkeypatch, by, options):
    monkeypatch.setattr(running, "CHUNK", 90)
    text = f"* | streamstats {options}{AGGS}{', dc(event_type) as d, stdev(value) as v' if 'window' in options else ''}{by}"
    got = {r.event_id: r for r in Engine(spark, {"logs": (events, EVENTS)}, split_keys=True).run(text).collect()}
    plain = text if by else text + " by one"
    want = {r.event_id: r for r in Engine(spark, {"logs": (events.withColumn("one", F.lit(1)), EVENTS)}).run(plain).collect()}
    assert len(got) == len(want) == 4000
    close = lambda x, y: x == y or isinstance(x, float) and isinstance(y, float) and abs(x - y) <= 1e-9 * max(1, abs(y))
    for i, w in want.items():
        for k, y in w.asDict().items():
            if k != "one":
                assert close(got[i][k], y), (i, k, got[i][k], y)


def test_conditions_and_other_aggregates(events, spark):
    """count(eval(...)), and functions that need all rows of a window in one task."""
    e, one = Engine(spark, {"logs": (events, EVENTS)}), Engine(spark, {"logs": (events.withColumn("one", F.lit(1)), EVENTS)})
    for aggs in ("count(eval(value>500)) as n, sum(value) as s", "dc(event_type) as d"):
        got = {r.event_id: r[-2:] for r in e.run(f"* | streamstats {aggs}").collect()}
        want = {r.event_id: r[-2:] for r in one.run(f"* | streamstats {aggs} by one").collect()}
        assert {i: r[-1] for i, r in got.items()} == {i: r[-1] for i, r in want.items()}


def test_all_rows_are_in_many_tasks(events, spark):
    """No window takes all rows without a key."""
    for text in ("* | streamstats sum(value) as s", "* | streamstats window=4 avg(value) as a"):
        df = Engine(spark, {"logs": (events, EVENTS)}).run(text)
        df.collect()
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        windows = [line for line in plan.split("\n") if "Window [" in line]
        assert windows and all("__slice" in w or "__chunk" in w for w in windows)
        sizes = running.sliced(events, [], "ts").groupBy("__slice").count()
        assert sizes.count() > 100 and sizes.agg(F.max("count")).first()[0] < 400
