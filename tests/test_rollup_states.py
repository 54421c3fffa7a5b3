"""States of rollups against raw rows, and their upkeep while they are read and written."""

import random
import threading
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from rivulet.engine import Engine
from rivulet.plans.profile import LOGS, METRICS, SPANS
from rivulet.streaming import ledger, rollups, rules, summaries

T0 = datetime(2026, 10, 1)


def metrics(spark, n=3000, step=17.3):
    """Counters of two series that fall back to zero now and then, some at the same instant, some null."""
    rng, rows, at = random.Random(4), [], {}
    for i in range(n):
        s = f"s{i % 2}"
        at[s] = 0.0 if rng.random() < 0.01 else at.get(s, 0.0) + rng.randrange(9)
        rows.append(("m", s, T0 + timedelta(seconds=step * (i // 2)), None if rng.random() < 0.02 else at[s]))
    df = spark.createDataFrame(rows, "metric_name string, service_name string, timestamp timestamp, value double")
    empty = F.create_map().cast("map<string,string>")
    return df.withColumns({"attributes": empty, "resource_attributes": empty})


ALL = "stats earliest(value) as a, latest(value) as b, avg(value) as c, min(value) as d, max(value) as e, rate(value) as f by metric_name service_name"


def reads(engine, text, start, end, column):
    """Whether a query's plan has a column of partial rows."""
    return column in engine.compile(rules.parse(text), None, start, end).df._jdf.queryExecution().analyzed().toString()


def both(spark, raw, parts, text, start, end):
    told = Engine(spark, {"metrics": (raw, METRICS)}, default="metrics", rollups={"metrics": {"1m": parts}})
    plain = Engine(spark, {"metrics": (raw, METRICS)}, default="metrics")
    routed = reads(told, text, start, end, "value_rise")
    rows = [sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in e.run(text, start, end).collect()) for e in (told, plain)]
    return routed, *rows


def test_states_answer_as_the_raw_rows(spark):
    """Also where the range begins and ends within buckets."""
    raw = metrics(spark).cache()
    parts = rollups.metric_partials(raw).cache()
    for start, end in ((T0, T0 + timedelta(days=1)), (T0 + timedelta(seconds=95), T0 + timedelta(hours=6, seconds=150)), (T0 + timedelta(seconds=7.5), T0 + timedelta(hours=6, minutes=30))):
        for text in (f"* | {ALL}", "service_name=s1 metric_name=m | stats rate(value) as f, latest(value) as b", "* | timechart span=10m latest(value) as b, max(value) as c", "* | stats first(value) as a, last(value) as b by service"):
            routed, a, b = both(spark, raw, parts, text, start, end)
            assert routed and a == b and a, text
    routed, a, b = both(spark, raw, parts, "* | stats rate(value) as f", T0, T0 + timedelta(days=1))
    assert not routed and a == b  # series that lie in each other have their rate from the samples


def test_states_merge_in_any_order(spark):
    """Parts cut by time, dealt to partial rows and merged in several orders and groupings."""
    raw = metrics(spark)
    cuts = [T0, *(T0 + timedelta(seconds=s) for s in (20, 610, 3000, 3033, 9999)), T0 + timedelta(days=9)]
    parts = [rollups.metric_partials(raw.filter((F.col("timestamp") >= a) & (F.col("timestamp") < b))) for a, b in zip(cuts, cuts[1:])]
    cols = ["value_sum", "value_count", "value_min", "value_max", "value_first", "value_last", "value_rise"]
    flat = lambda df: sorted(tuple(r) for r in rollups.metric_merge(df, 86400).select("service_name", *cols).collect())
    want = flat(rollups.metric_partials(raw, 86400))
    rng = random.Random(1)
    for _ in range(2):
        rng.shuffle(parts)
        left = parts[0].unionByName(rollups.metric_merge(parts[1].unionByName(parts[2]), 60))
        assert flat(left.unionByName(parts[3]).unionByName(parts[4]).unionByName(parts[5])) == want


def test_samples_that_lie_in_each_other_are_read_raw(spark):
    """Partial rows of one bucket from two batches at the same time have no rate; the engine reads the samples."""
    raw = metrics(spark, 6000)
    third = F.pmod(F.xxhash64("timestamp", "service_name"), F.lit(3))
    parts = rollups.metric_partials(raw.filter(third == 0)).unionByName(rollups.metric_partials(raw.filter(third != 0)))
    assert rollups.mixed(parts) and not rollups.mixed(rollups.metric_partials(raw))
    routed, a, b = both(spark, raw, parts, f"* | {ALL}", T0, T0 + timedelta(days=1))
    assert not routed and a == b
    routed, a, b = both(spark, raw, parts, "* | stats latest(value) as b, max(value) as c by service", T0, T0 + timedelta(days=1))
    assert routed and a == b


def test_services_from_partial_rows(spark):
    """Counts as from the spans, also at edges within a minute; quantiles close to theirs."""
    rng = random.Random(6)
    rows = [(f"s{rng.randrange(3)}", T0 + timedelta(seconds=i * 7.7), rng.randrange(10**6, 10**9), rng.choice(("OK", "OK", "ERROR"))) for i in range(3000)]
    spans = spark.createDataFrame(rows, "service_name string, start_time timestamp, duration_ns long, status_code string").cache()
    told, plain = (Engine(spark, {"spans": (spans, SPANS)}, default="spans", rollups=r) for r in ({"spans": {"red": rollups.red_partials(spans)}}, None))
    for text in ("| services", "service=s1 | services"):
        for start, end in ((T0, T0 + timedelta(days=1)), (T0 + timedelta(seconds=100), T0 + timedelta(hours=3, seconds=7))):
            assert reads(told, text, start, end, "duration_state")
            a, b = ({r.service_name: r for r in e.run(text, start, end).collect()} for e in (told, plain))
            assert a.keys() == b.keys() and a
            for k in a:
                assert (a[k].requests, a[k].errors, a[k].error_rate) == (b[k].requests, b[k].errors, b[k].error_rate)
                for p in ("p50_ms", "p95_ms", "p99_ms"):
                    assert abs(a[k][p] - b[k][p]) <= 0.04 * 1000
    assert not reads(told, "status=OK | services", T0, T0 + timedelta(days=1), "duration_state")


# -- distinct counts ------------------------------------------------------------------------------------------
SUMMARY = summaries.Summary(("action",), ("user", "src_ip"), "timestamp")


def logs(spark):
    i = F.col("id")
    return spark.range(40_000).select(
        (F.lit(T0).cast("timestamp") + F.make_dt_interval(secs=i * 7)).alias("timestamp"), F.concat(F.lit("u"), F.when(i % 5 == 0, 1).otherwise(i % 7919)).alias("user"),
        F.when(i % 11 == 0, "").otherwise(F.concat(F.lit("10.0."), (i % 200).cast("string"), F.lit("."), (i % 251).cast("string"))).alias("src_ip"), F.when(i % 3 == 0, "ok").otherwise("fail").alias("action"),
    )


def test_distinct_counts_from_summaries(spark):
    df = logs(spark).cache()
    halves = [SUMMARY.partials(df.filter(F.col("timestamp").cast("long") % 2 == k)) for k in (0, 1)]
    table = halves[0].unionByName(halves[1])
    told = Engine(spark, {"logs": (df, LOGS)}, rollups={"logs": summaries.Summary(SUMMARY.keys, SUMMARY.distinct, "timestamp", table=table)})
    plain = Engine(spark, {"logs": (df, LOGS)})
    for start, end in ((T0, T0 + timedelta(days=4)), (T0 + timedelta(minutes=7), T0 + timedelta(days=1, minutes=50))):
        for text in ("* | stats count, {}(user) as u, {}(src_ip) as i by action", "action=fail | stats {}(user) as u", "* | timechart span=6h count, {}(user) as u"):
            assert reads(told, text.replace("{}", "estdc"), start, end, "user_state")
            est = sorted(told.run(text.replace("{}", "estdc"), start, end).collect(), key=str)
            exact = sorted(plain.run(text.replace("{}", "dc"), start, end).collect(), key=str)
            key = lambda rows: {tuple(v for v in r if isinstance(v, (str, datetime))): r for r in rows}
            est, exact = key(est), key(exact)
            assert est.keys() == exact.keys()
            for k, r in est.items():
                for name in ("u", "i"):
                    if name in r:
                        assert abs(r[name] - exact[k][name]) <= 0.02 * exact[k][name], (text, k)
                if "count" in r:
                    assert r["count"] == exact[k]["count"]
    for text in ("* | stats dc(user) as u", "user=u1 | stats estdc(src_ip) as u", "* | stats estdc(user) as u by src_ip", "* | timechart span=1m estdc(user) as u", "* | stats count"):
        assert not reads(told, text, T0, T0 + timedelta(days=4), "user_state"), text
    merged = SUMMARY.merge(table, 86400)
    assert merged.agg(F.sum("events")).first()[0] == 40_000
    assert merged.groupBy("action").agg(F.hll_sketch_estimate(F.hll_union_agg("user_state")).alias("n")).count() == 2


# -- upkeep ---------------------------------------------------------------------------------------------------
COUNTS = "k string, n bigint"


def merge(df):
    return df.groupBy("k").agg(F.sum("n").alias("n"))


def part(spark, i):
    return spark.createDataFrame([(f"k{j}", i) for j in range(3)], COUNTS).coalesce(1)


def total(book):
    return {r.k: r.n for r in merge(book.read()).collect()}


@pytest.fixture
def book(spark, tmp_path):
    return ledger.Ledger(spark, f"file://{tmp_path}/book", spark.createDataFrame([], COUNTS).schema)


def test_batches_count_once(spark, book):
    assert book.read().count() == 0 and book.compact(merge) == 0
    for i in range(9):
        assert book.append(part(spark, i), i) and not book.append(part(spark, i), i)
        assert not book.append(part(spark, 99), max(0, i - 1))  # an older batch is known as well
        book.compact(merge, fan=3)
    assert book.append(part(spark, 5), 0, "other")
    assert total(book) == {f"k{j}": 41 for j in range(3)}
    folders = book.latest()[1]["folders"]
    assert sorted(level for _, level in folders) == [0, 2]


def test_readers_see_all_while_folders_are_merged(spark, book):
    """A plan made before a merge still reads what it planned; clean() leaves what is there and takes the rest."""
    for i in range(4):
        book.append(part(spark, i), i)
    planned = book.read()
    assert book.compact(merge, fan=4) == 1
    assert sum(r.n for r in planned.collect()) == 18 == sum(r.n for r in book.read().collect())
    assert planned.count() == 12 and book.read().count() == 3
    book.clean(keep=3600)
    assert planned.count() == 12
    part(spark, 77).write.parquet(f"{book.path}/data/failed-attempt")
    book.clean(keep=-1)
    names = [s.getPath().getName() for s in book._fs.listStatus(book._at("data"))]
    assert names == [name for name, _ in book.latest()[1]["folders"]]
    assert total(book) == {f"k{j}": 6 for j in range(3)}


def test_two_writers(spark, book):
    """Two streams add and merge at once; no batch is lost or counted twice."""
    errors = []

    def work(name):
        try:
            mine = ledger.Ledger(spark, book.path, book.schema)
            for i in range(5):
                mine.append(part(spark, 1), i, name)
                mine.compact(merge, fan=3)
        except Exception as e:  # noqa: BLE001
            errors.append(e)

    threads = [threading.Thread(target=work, args=(n,)) for n in ("a", "b")]
    [t.start() for t in threads]
    seen = [sum(total(book).values()) for _ in range(5)]
    [t.join() for t in threads]
    assert not errors and total(book) == {f"k{j}": 10 for j in range(3)}
    assert seen == sorted(seen) and all(n % 3 == 0 for n in seen)


def test_a_stream_that_is_started_again(spark, book, tmp_path):
    src = str(tmp_path / "in")
    for i in range(6):
        spark.createDataFrame([(f"k{i % 3}",)] * 10, "k string").coalesce(1).write.mode("append").parquet(src)
        if i in (1, 5):
            stream = spark.readStream.schema("k string").option("maxFilesPerTrigger", 1).parquet(src)
            counted = lambda b: b.groupBy("k").agg(F.count("*").alias("n"))
            book.stream(stream, counted, merge, str(tmp_path / "cp"), fan=3).awaitTermination()
    assert total(book) == {f"k{j}": 20 for j in range(3)}
    assert len(book.latest()[1]["folders"]) == 2
