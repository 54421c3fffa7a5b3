from datetime import datetime, timedelta

from pyspark.sql import functions as F
from rivulet.engine import Engine
from rivulet.plans.errors import QueryError, UnsupportedQuery
from rivulet.plans.profile import LOGS, METRICS
from rivulet.streaming import cron, rollups, rules

import pytest

T0 = datetime(2026, 10, 1)


def metrics(spark, n=200):
    rows = [("m", f"s{i % 2}", T0 + timedelta(seconds=17 * i), float(i % 37)) for i in range(n)]
    return spark.createDataFrame(rows, "metric_name string, service_name string, timestamp timestamp, value double")


def test_rollups_merge_to_the_whole(spark):
    df = metrics(spark)
    parts = rollups.metric_partials(df.filter("value < 20")).unionByName(rollups.metric_partials(df.filter("value >= 20")))
    got = {(r.service_name, r.bucket): (r.value_sum, r.value_count) for r in rollups.metric_merge(parts, 3600).collect()}
    want = {(r.service_name, r.b): (r.s, r.n) for r in df.groupBy("service_name", F.date_trunc("hour", "timestamp").alias("b")).agg(F.sum("value").alias("s"), F.count("*").alias("n")).collect()}
    assert got == want


def test_stream_writes_each_batch_once(spark, tmp_path):
    src = str(tmp_path / "in")
    metrics(spark).repartition(4).write.parquet(src)
    stream = spark.readStream.schema(metrics(spark).schema).option("maxFilesPerTrigger", 2).parquet(src)
    for _ in range(2):  # a second run finds nothing new
        rollups.stream(stream, rollups.metric_partials, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    out = rollups.metric_merge(spark.read.parquet(str(tmp_path / "out")), 3600)
    assert out.agg(F.sum("value_count")).first()[0] == 200


def test_routing_and_clamp(spark):
    assert rollups.route(7 * 86400, ["avg"]) == "1h" and rollups.route(6 * 3600, ["avg", "max"], 60) == "1m"
    assert rollups.route(3600, ["avg"]) is None and rollups.route(7 * 86400, ["dc"]) is None and rollups.route(8 * 86400, ["avg"], by=("host",)) is None
    df = spark.createDataFrame([(T0,), (T0 + timedelta(days=9),)], "t timestamp")
    got = rollups.clamp_future(df, "t", F.lit(T0)).orderBy("t").collect()
    assert got[0].original_t is None and got[1].t == T0 + timedelta(hours=1) and got[1].original_t == T0 + timedelta(days=9)


def events(spark):
    rows = [(T0 + timedelta(minutes=i), f"u{i % 5}", "fail" if i % 3 else "ok", "m") for i in range(60)]
    return spark.createDataFrame(rows, "timestamp timestamp, user string, action string, message string")


def test_scheduled_rules(spark):
    e = Engine(spark, {"logs": (events(spark), LOGS)}, now=T0 + timedelta(hours=1))
    rule = rules.Rule("r", "action=fail | risk score=30 entity=user", lookback="1h")
    found = rules.findings(e, rule, T0 + timedelta(hours=1))
    assert found.count() == 40
    few = rules.bounded(found, 3)
    assert few.select("entity").distinct().count() == 5 and few.count() <= 8
    first = rules.alerts(found, found.limit(0), 3600)
    assert first.count() == 5 and rules.alerts(found, first, 3600).count() == 0
    assert rules.next_run(rule, T0) == T0 + timedelta(seconds=300)


def test_risk_decay(spark):
    rows = [("r", "a", 100, T0 - timedelta(hours=h)) for h in (1, 30, 80, 130, 200)]
    got = rules.risk(spark.createDataFrame(rows, "rule string, entity string, score int, timestamp timestamp"), F.lit(T0).cast("timestamp")).first()
    assert (got.risk_24h, got.risk_7d, got.finding_count) == (100, 230, 4)


def test_realtime_rules(spark, tmp_path):
    src = str(tmp_path / "ev")
    events(spark).write.parquet(src)
    stream = spark.readStream.schema(events(spark).schema).parquet(src)
    e = Engine(spark, {})
    out = rules.realtime(e, rules.Rule("r", "action=fail", entity="user"), stream, LOGS, window="2 hours")
    q = out.writeStream.format("memory").queryName("signals_out").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("signals_out").count() == 5
    with pytest.raises(UnsupportedQuery):
        rules.realtime(e, rules.Rule("r", "action=fail | stats count by user"), stream, LOGS)


def test_cron_against_every_minute():
    """The next time by a walk over all minutes."""
    names = {"mon": 1, "fri": 5}
    for text, fits in {
        "*/7 * * * *": lambda t: t.minute % 7 == 0,
        "0 9,17 * * mon-fri": lambda t: t.minute == 0 and t.hour in (9, 17) and names["mon"] <= (t.weekday() + 1) % 7 <= names["fri"],
        "15 3 1-5/2 feb,10 *": lambda t: (t.minute, t.hour) == (15, 3) and t.day in (1, 3, 5) and t.month in (2, 10),
        "30 4 * * 7": lambda t: (t.minute, t.hour) == (30, 4) and t.weekday() == 6,
    }.items():
        t = T0
        for _ in range(4):
            want = t + timedelta(minutes=1)
            while not fits(want):
                want += timedelta(minutes=1)
            assert cron.following(text, t) == want
            t = want
    assert cron.following("10 0 0 * * *", T0) == T0 + timedelta(seconds=10)
    for bad in ("* * * *", "61 * * * *", "*/0 * * * *", "5-1 * * * *", "x * * * *"):
        with pytest.raises(QueryError):
            cron.following(bad, T0)
    with pytest.raises(QueryError):
        cron.following("0 0 31 2 *", T0)


def test_rules_have_their_own_place_on_a_schedule():
    at = {n: cron.offset("*/5 * * * *", T0, n) for n in ("a", "b", "c")}
    assert len(set(at.values())) == 3 and all(timedelta(0) <= x < timedelta(seconds=150) for x in at.values())
    assert max(cron.offset("0 9 * * *", T0, str(i)) for i in range(50)) < timedelta(seconds=300)
    rule = rules.Rule("a", "x=1", cron="*/5 * * * *")
    first = rules.next_run(rule, T0)
    assert first == T0 + at["a"] and rules.next_run(rule, first) == first + timedelta(minutes=5)
    assert cron.next_run("*/5 * * * *", T0, "a", cap=0) == T0 + timedelta(minutes=5)


def test_engine_reads_a_rollup_where_it_answers(spark):
    """The same results from partial rows as from the samples; other queries read the samples."""
    raw = metrics(spark, 5000).withColumns({"unit": F.lit("s"), "attributes": F.create_map().cast("map<string,string>"), "resource_attributes": F.create_map().cast("map<string,string>")})
    parts = rollups.metric_partials(raw)
    tell = Engine(spark, {"metrics": (raw, METRICS)}, default="metrics", rollups={"metrics": {"1m": parts}})
    plain = Engine(spark, {"metrics": (raw, METRICS)}, default="metrics")
    end = T0 + timedelta(days=1)

    def routed(text):
        return "value_sum" in tell.compile(rules.parse(text), None, T0, end).df._jdf.queryExecution().analyzed().toString()

    for text in ("metric_name=m | stats avg(value) as a, min(value) as b, max(value) as c by service", "* | timechart span=1h avg(value) as a, max(value) as b", "service=s1 | stats avg(value) as a"):
        assert routed(text), text
        a, b = (sorted(map(repr, e.run(text, T0, end).collect())) for e in (tell, plain))
        assert a == b and a
    (m,), (w,) = (e.run("* | stats median(value) as m", T0, end).collect() for e in (tell, plain))
    assert abs(m.m - w.m) <= 1
    for text in ("* | stats sum(value) as s", "service=s* | stats avg(value) as a", "* | stats avg(value) as a by unit", "value>3 | stats avg(value) as a", "* | eval x=1 | stats avg(value) as a", "* | timechart span=30s avg(value) as a"):
        assert not routed(text), text
    assert tell.run("* | stats sum(value) as s", T0, end).first().s == raw.agg(F.sum("value")).first()[0]


def test_bounded_counts_equal_matches(spark):
    """Three matches of one instant are three, whether they are among the newest or not."""
    at = lambda m: T0 + timedelta(minutes=m)
    rows = [("r", "a", 5, at(9))] * 3 + [("r", "b", 5, at(8))] * 2 + [("r", "c", 5, at(1))] * 2 + [("r", None, 5, at(0))] + [("r", "a", 5, at(2))]
    df = spark.createDataFrame(rows, "rule string, entity string, score int, timestamp timestamp")
    got = lambda n: sorted((str(r.entity), (r.timestamp - T0).total_seconds() / 60) for r in rules.bounded(df, n).collect())
    assert got(4) == [("None", 0), ("a", 9), ("a", 9), ("a", 9), ("b", 8), ("c", 1)]
    assert len(got(100)) == 9 and got(1) == [("None", 0), ("a", 9), ("b", 8), ("c", 1)]


def test_risk_and_signals_are_datasets(spark):
    """Any range of a query gives the same risk; signals keep to it."""
    rows = [("r1", "a", 100, T0 - timedelta(hours=1)), ("r2", "a", 10, T0 - timedelta(hours=30)), ("r1", "b", 40, T0 - timedelta(hours=100)), ("r1", "c", 40, T0 - timedelta(hours=200))]
    schema = "rule string, entity string, score int, timestamp timestamp"
    live = spark.createDataFrame([("live", "a", 70, T0 - timedelta(minutes=5))], schema)
    e = Engine(spark, rules.datasets(spark.createDataFrame(rows, schema), live, T0), now=T0)
    text = "dataset=risk risk_7d>5 | table entity risk_24h risk_7d rule_count"
    wide = sorted(map(tuple, e.run(text, T0 - timedelta(days=30), T0).collect()))
    assert wide == sorted(map(tuple, e.run(text, T0 - timedelta(minutes=15), T0).collect())) == [("a", 100, 107, 2), ("b", 0, 16, 1)]
    count = lambda start: {(r.kind, r.rule_name): r["count"] for r in e.run("dataset=signals | stats count by kind rule_name", start, T0).collect()}
    assert count(T0 - timedelta(hours=2)) == {("realtime", "live"): 1, ("scheduled", "r1"): 1}
    assert count(T0 - timedelta(days=30)) == {("realtime", "live"): 1, ("scheduled", "r1"): 3, ("scheduled", "r2"): 1}
    with pytest.raises(QueryError):
        e.run("dataset=risk | risk score=5 entity=entity")
