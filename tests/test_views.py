from datetime import datetime, timedelta

import pytest
from rivulet.engine import Engine
from rivulet.plans.errors import QueryError
from rivulet.plans.profile import LOGS, METRICS, SPANS
from rivulet.sources import files, sql

T0 = datetime(2026, 10, 1)


def engine(spark, rows, schema, **more):
    return Engine(spark, {"logs": (spark.createDataFrame(rows, "timestamp timestamp, " + schema), LOGS)}, more, now=T0 + timedelta(days=1))


def test_tree_with_cycle_and_root(spark):
    rows = [(T0, "1", None, "a"), (T0, "2", "1", "b"), (T0, "3", "2", "c"), (T0, "4", "9", "d"), (T0, "5", "5", "e"), (T0, "6", "7", "f"), (T0, "7", "6", "g")]
    e = engine(spark, rows, "pid string, ppid string, name string")
    got = {(r.node, r.depth): r.path for r in e.run("* | tree parent=ppid child=pid label=name").collect()}
    assert got == {("1", 0): "1", ("2", 1): "1 > 2", ("3", 2): "1 > 2 > 3", ("9", 0): "9", ("4", 1): "9 > 4", ("5", 0): "5"}
    assert {r.node for r in e.run("* | tree parent=ppid child=pid label=name root=b").collect()} == {"2", "3"}


def test_lateral_follows_time(spark):
    rows = [(T0, "u", "a", "b"), (T0 + timedelta(minutes=1), "u", "b", "c"), (T0 - timedelta(minutes=1), "u", "b", "d"), (T0 + timedelta(minutes=2), "v", "c", "a")]
    e = engine(spark, rows, "user string, src_host string, dest_host string")
    got = {(r.src_host, r.dest_host): r.hop_number for r in e.run("* | lateral entity=a seed=host").collect()}
    assert got == {("a", "b"): 1, ("b", "c"): 2, ("c", "a"): 3}


def test_identity_as_of(spark):
    ident = spark.createDataFrame([("1.1.1.1", T0, "ann"), ("1.1.1.1", T0 + timedelta(hours=2), "bob")], "ip string, observed_at timestamp, user string")
    rows = [(T0 + timedelta(hours=h), "1.1.1.1") for h in (-1, 1, 3)] + [(T0, None)]
    e = engine(spark, rows, "src_ip string", identities=ident)
    got = [r.identity_user for r in e.run("* | resolve_identity src_ip | sort timestamp | table identity_user, src_ip").collect()]
    assert sorted(map(str, got)) == ["None", "None", "ann", "bob"]


def test_prevalence_and_baseline(spark):
    rows = [(T0 + timedelta(hours=i), f"h{i % 7}", "common", "p1") for i in range(100)] + [(T0 + timedelta(hours=99), "h1", "odd", "p2")]
    e = engine(spark, rows, "src_host string, file_hash string, process_name string")
    assert {r.file_hash for r in e.run("* | prevalence hash_prevalence < 5 | table file_hash").collect()} == {"odd"}
    out = e.run("* | baseline host=h1 window=30d dims=process_name", T0 + timedelta(hours=90), T0 + timedelta(hours=200)).collect()
    assert [(r.val, r.coverage) for r in out] == [("p2", "thin")]


def test_observability(spark):
    spans = [("t1", "1", "", T0, T0 + timedelta(seconds=1), 10**9, "s", "root", "OK", {"http.method": "GET"}, {}), ("t1", "2", "1", T0, T0, 5 * 10**6, "s", "db", "ERROR", {}, {"env": "x"})]
    s = spark.createDataFrame(spans, "trace_id string, span_id string, parent_span_id string, start_time timestamp, end_time timestamp, duration_ns long, service_name string, span_name string, status_code string, attributes map<string,string>, resource_attributes map<string,string>")
    m = spark.createDataFrame([("lat", "s", T0, [1, 2, 1], [10.0, 20.0])], "metric_name string, service_name string, timestamp timestamp, bucket_counts array<long>, explicit_bounds array<double>")
    e = Engine(spark, {"spans": (s, SPANS), "metrics": (m, METRICS)}, default="spans")
    assert e.run("http.method=get | table span_id").first()[0] == "1" and e.run("env=x | table span_id").first()[0] == "2"
    r = e.run("| services").first()
    assert (r.requests, r.errors) == (2, 1) and e.run("trace t1").count() == 2
    assert e.run("dataset=metrics lat | stats histogram_quantile(bucket_counts, 50) as q").first()[0] == 15.0


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("k,v,n\nx,1,\ny,2.5,true\n")
    (tmp_path / "b.json").write_text('{"items": [{"k": "x", "a": {"b": 1}}, {"k": "z", "a": {"b": 2, "c": [1]}}]}')
    e = Engine(spark, {}, folders=(str(tmp_path),))
    assert e.run(f'| inputlookup url="{tmp_path}/a.csv" | sort k').collect()[1]["v"] == 2.5
    assert e.run(f'| inputlookup url="{tmp_path}/b.json" format=json | where k=z').first()["a.b"] == 2
    for bad in ("http://x/a.csv", "/etc/passwd", f"{tmp_path}/../x.csv"):
        with pytest.raises(QueryError):
            e.run(f'| inputlookup url="{bad}"')
    assert files.scalar("007") == "007" and files.scalar("-3") == -3


@pytest.mark.parametrize("text", ["DROP TABLE x", "SELECT 1; SELECT 2", "SELECT reflect('a','b')", "SELECT * FROM parquet.`/etc`", "INSERT INTO x VALUES (1)",
    "SELECT '--' AS a, java_method('java.lang.System','getProperty','user.home')", "SELECT `java_method`('java.lang.System','getProperty','user.home')",
    "SELECT * FROM events e, parquet.`/path`", "SELECT * FROM events e, parquet . x", "SELECT 1 /* /* */ ' */ , reflect('a','b') --'", "SELECT r'\\', reflect('a','b') --'", "SELECT 'a", "SELECT 1 /* x"])
def test_guarded_sql(spark, text):
    with pytest.raises(QueryError):
        sql.guarded(spark, text)


def test_guarded_sql_runs(spark):
    assert sql.guarded(spark, "SELECT ';' AS a -- DROP\n").first()[0] == ";"
    assert sql.guarded(spark, "SELECT `a b` FROM (SELECT 'x''y -- /* ' AS `a b`) /* drop ; */").first()[0] == "x'y -- /* "
    assert sql.guarded(spark, "SELECT id FROM range(20000)").count() == 20_000


IDENT = ["SELECT IDENTIFIER('java_method')('java.lang.System','getProperty','user.home')", "SELECT count(*) FROM IDENTIFIER('parquet.`/path`')", "SELECT count(*) FROM IDENTIFIER('par' || 'quet.`/path`')"]


@pytest.mark.parametrize("text", [
    *IDENT, "SELECT * FROM (SELECT * FROM parquet.`/etc`)", "SELECT 1 WHERE EXISTS (SELECT * FROM csv.`/etc/passwd`)", "SELECT (SELECT max(value) FROM text.`/etc/passwd`)", "SELECT 1 IN (SELECT 1 FROM json.`/x`)",
    "WITH a AS (SELECT * FROM orc.`/x`) SELECT * FROM a", "SELECT * FROM read_files('/etc')", "SELECT * FROM guarded_events, LATERAL (SELECT * FROM text.`/etc/passwd`)", "SELECT input_file_name() FROM guarded_events",
    "SELECT transform(array(1), x -> reflect('java.lang.System', 'nanoTime'))", "SELECT system.builtin.java_method('a','b')", "SELECT other.f(1)", "SELECT mine(1)", "SELECT current_user()", "SELECT raise_error('x')",
    "SELECT TRANSFORM (a) USING 'cat' AS b FROM guarded_events", "FROM guarded_events INSERT OVERWRITE DIRECTORY '/tmp/x' SELECT *", "SHOW TABLES", "EXPLAIN SELECT 1", "SET a=1", "CACHE TABLE x AS SELECT 1", "SELECT * FROM nothing_there", "SELECT :a", "SELECT", "",
    "SELECT * FROM guarded_events ORDER BY try_reflect('a','b')", "SELECT * FROM guarded_events JOIN parquet.`/x` USING (a)", "SELECT sum(a) OVER (ORDER BY java_method('a','b')) FROM guarded_events", "SELECT * FROM python_worker_logs()", "SELECT * FROM sql_keywords()",
])
def test_guard_reads_what_would_run(spark, text):
    spark.createDataFrame([(1, "x")], "a int, b string").createOrReplaceTempView("guarded_events")
    spark.udf.register("mine", lambda x: x)
    with pytest.raises(QueryError):
        sql.guarded(spark, text)


def test_guard_lets_queries_through(spark):
    spark.createDataFrame([(1, "x"), (2, "y"), (2, "z")], "a int, b string").createOrReplaceTempView("guarded_events")
    for text, n in {
        "WITH t AS (SELECT a, count(*) AS n FROM guarded_events GROUP BY a HAVING count(*) > 0), u AS (SELECT * FROM t) SELECT u.a, rank() OVER (ORDER BY n DESC) AS r FROM u JOIN guarded_events e ON e.a = u.a WHERE e.b IN (SELECT b FROM guarded_events) ORDER BY 1 LIMIT 5": 3,
        "SELECT a FROM guarded_events UNION ALL SELECT a FROM guarded_events EXCEPT SELECT 1": 1,
        "SELECT x FROM guarded_events LATERAL VIEW explode(array(1, 2)) t AS x": 6,
        "SELECT * FROM guarded_events PIVOT (count(a) FOR b IN ('x', 'y'))": 1,
        "SELECT CASE WHEN a > 1 THEN upper(b) ELSE coalesce(b, 'n') END AS c, sha2(b, 256), date_trunc('day', timestamp '2024-01-01') FROM guarded_events": 3,
        "SELECT percentile_approx(a, 0.5), approx_count_distinct(b), max_by(b, a), collect_set(b) FROM guarded_events": 1,
        "SELECT * FROM (VALUES (1, 'a'), (2, 'b')) AS t(k, v)": 2,
        "SELECT filter(array(a, 2), x -> x > 1), get_json_object('{\"k\": 1}', '$.k'), from_json('{}', 'k INT'), b LIKE 'x%', b RLIKE 'y', a BETWEEN 1 AND 2, a DIV 2, -a FROM guarded_events": 3,
        "SELECT e.* FROM guarded_events e WHERE EXISTS (SELECT 1 FROM guarded_events f WHERE f.a = e.a AND f.b > e.b)": 1,
    }.items():
        assert sql.guarded(spark, text).count() == n, text
    assert sql.page(spark, "SELECT id FROM range(30) ORDER BY id", 10, 25).count() == 5 and sql.page(spark, "SELECT id FROM range(20000)").count() == 10_000
