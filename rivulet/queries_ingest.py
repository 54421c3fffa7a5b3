"""Registered queries of what is made while events come in: enrichment, ledgers, sessions, states."""

from __future__ import annotations

from dataclasses import replace
from datetime import date, datetime, timedelta
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.engine import Engine, events_engine
from rivulet.operators import enrich, views
from rivulet.plans.profile import EVENTS, LOGS, METRICS, SPANS
from rivulet.queries import NOW, ORACLE, QUERIES, _metrics, _spans
from rivulet.sources import ingest
from rivulet.sources.scratch import folder
from rivulet.streaming import keyed, rollups, rules, summaries
from rivulet.streaming.firstseen import FirstSeen
from rivulet.streaming.ledger import Ledger
from rivulet.streaming.rules import Rule, realtime


def with_sql(sql: str | None):
    """Registers a query, and the SQL for the same rows."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Addresses of events, and networks of customers, which nest and overlap: lengths of 8 to 32 over the same addresses.
_ADDRESS = "user_id % 8 * 16777216 + event_id % 65536"
_BASE, _LENGTH = "c_custkey % 9 * 16777216 + c_custkey * 37 % 65536", "8 + c_custkey * 7 % 25"


def _dotted(number: str) -> str:
    return "concat_ws('.', " + ", ".join(f"CAST(({number}) // {1 << s} % 256 AS VARCHAR)" for s in (24, 16, 8, 0)) + ")"


@with_sql(
    f"""
WITH e AS (SELECT event_id, user_id, {_ADDRESS} AS a FROM events),
n AS (SELECT c_name, c_mktsegment, {_LENGTH} AS length, ({_BASE}) // CAST(2 ** (32 - ({_LENGTH})) AS BIGINT) AS prefix, c_custkey FROM customer),
one AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY length, prefix ORDER BY c_custkey DESC) = 1),
met AS (SELECT event_id, c_name, c_mktsegment, row_number() OVER (PARTITION BY event_id ORDER BY length DESC) AS k
        FROM e JOIN one ON e.a // CAST(2 ** (32 - length) AS BIGINT) = prefix)
SELECT e.event_id, {_dotted("e.a")} AS src_ip, c_name AS enriched_src_as_name, c_mktsegment AS enriched_src_country
FROM e LEFT JOIN (SELECT * FROM met WHERE k = 1) m ON m.event_id = e.event_id
"""
)
def ingest_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses of all events in the longest of the customers' networks."""
    text = lambda n: F.concat_ws(".", *[F.expr(f"CAST(({n}) DIV {1 << s} % 256 AS STRING)") for s in (24, 16, 8, 0)])
    networks = read(spark, sf_dir, "customer").select(
        F.concat(text(_BASE), F.lit("/"), F.expr(f"CAST({_LENGTH} AS STRING)")).alias("network"), F.col("c_mktsegment").alias("country"), F.col("c_name").alias("as_name"), "c_custkey"
    )
    facts = ("country", "as_name")
    events = read(spark, sf_dir, "events").select("event_id", text(_ADDRESS).alias("src_ip"))
    e = enrich.Enricher(enrich.network_table(networks, facts, updated="c_custkey"), facts=facts)
    return e.enrich(events)


@with_sql(
    """
WITH f AS (SELECT host, threat_type, malware, confidence FROM (
    SELECT regexp_extract(lower(url), '://([^/?#:]*)', 1) AS host, 'seen' AS threat_type, CAST(page_id AS VARCHAR) AS malware, CAST(page_id % 101 AS INTEGER) AS confidence,
           row_number() OVER (PARTITION BY regexp_extract(lower(url), '://([^/?#:]*)', 1) ORDER BY page_id DESC) AS k FROM pages WHERE page_id % 3 = 0) WHERE k = 1 AND host <> '')
SELECT page_id, threat_type AS ioc_domain_threat_type, malware AS ioc_domain_malware, confidence AS ioc_domain_confidence, f.host IS NOT NULL AS ioc_matched, confidence AS ioc_confidence
FROM pages LEFT JOIN f ON f.host = regexp_extract(lower(url), '://([^/?#:]*)', 1)
"""
)
def ingest_indicators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts of all pages among indicators, of which the newest of a host counts."""
    host = F.regexp_extract(F.col("url"), "://([^/?#:]*)", 1)
    pages = read(spark, sf_dir, "pages").select("page_id", host.alias("domain"))
    rows = pages.filter("page_id % 3 = 0").select(F.col("domain").alias("indicator"), F.lit("seen").alias("threat_type"), F.col("page_id").cast("string").alias("malware"), (F.col("page_id") % 101).cast("int").alias("confidence"), "page_id")
    return enrich.Enricher(indicators=enrich.indicator_table(rows, updated="page_id")).enrich(pages).drop("domain")


def _streamed(spark: SparkSession, parts: list[DataFrame], make) -> DataFrame:
    """What make(stream) has put out once all parts have come, each in micro-batches of its own."""
    at, n = folder(spark, "stream"), spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(min(int(n), 8)))  # each is a state store
    try:
        for i, part in enumerate(parts):
            part.coalesce(1).write.parquet(f"{at}/in/part={i}")
            made = make(spark.readStream.schema(part.schema).option("maxFilesPerTrigger", 1).parquet(f"{at}/in/part=*"))
            out = made.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state")
            out.trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", n)
    return spark.read.schema(made.schema).parquet(f"{at}/out")


@with_sql(
    """
WITH e AS (SELECT user_id, ts, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) > INTERVAL 2 HOUR AS apart FROM events),
g AS (SELECT user_id, ts, sum(CASE WHEN apart THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM e)
SELECT user_id, min(ts) AS transaction_start, max(ts) AS transaction_end, count(*) AS eventcount, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS duration FROM g GROUP BY user_id, k
"""
)
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of all events as they come in three parts, each with events of the whole time: the sessions of a batch."""
    events = read(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value", "props", "event_id")
    end = events.agg((F.max("ts") + F.expr("INTERVAL 900 DAYS")).alias("ts"), F.max("user_id").alias("user_id")).select(
        "ts", "user_id", *[F.lit(None).cast(events.schema[c].dataType).alias(c) for c in ("event_type", "value", "props", "event_id")]
    )
    third = F.pmod(F.xxhash64("event_id"), F.lit(3))
    parts = [events.filter(third == 0), events.filter(third == 1), events.filter(third == 2), end]
    engine = events_engine(spark, sf_dir, now=NOW)
    return _streamed(spark, parts, lambda s: keyed.streamed(engine, "* | transaction user_id maxpause=2h", s, EVENTS, "800 days"))


@with_sql(
    """
WITH RECURSIVE e AS (SELECT user_id, ts FROM events WHERE event_type = 'error'),
n AS (SELECT a.user_id, a.ts, min(b.ts) AS next FROM e a LEFT JOIN e b ON b.user_id = a.user_id AND b.ts >= a.ts + INTERVAL 2 DAY GROUP BY 1, 2),
f AS (SELECT user_id, min(ts) AS ts FROM e GROUP BY 1 UNION ALL SELECT n.user_id, n.next FROM f JOIN n ON n.user_id = f.user_id AND n.ts = f.ts WHERE n.next IS NOT NULL)
SELECT 'errors' AS rule, CAST(user_id AS VARCHAR) AS entity, 40 AS score, ts AS timestamp FROM f
"""
)
def stream_cooldown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts of a real-time rule on all events, two days apart by entity, the query being started again between parts."""
    rule = Rule("errors", "event_type=error", score=40, entity="user_id")
    events = read(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    cuts = ["1970-01-01", "2024-01-08", "2024-01-20", "9999-01-01"]
    parts = [events.filter((F.col("ts") >= a) & (F.col("ts") < b)) for a, b in zip(cuts, cuts[1:])]
    engine = events_engine(spark, sf_dir, now=NOW)
    return _streamed(spark, parts, lambda s: keyed.cooled(realtime(engine, rule, s, EVENTS), 2 * 86400, "5 days"))


def _routed(spark: SparkSession, sf_dir: str, text: str, start: datetime, end: datetime) -> DataFrame:
    """A query of metrics that reads partial rows, made by thirds of the time, and raw rows at the range's edges."""
    raw = _metrics(spark, sf_dir)
    days = [F.col("timestamp") < "2024-01-11", (F.col("timestamp") >= "2024-01-11") & (F.col("timestamp") < "2024-01-21"), F.col("timestamp") >= "2024-01-21"]
    parts = reduce(DataFrame.unionByName, [rollups.metric_partials(raw.filter(d)) for d in days])
    engine = Engine(spark, {"metrics": (raw, METRICS)}, default="metrics", now=NOW, rollups={"metrics": {"1h": rollups.metric_merge(parts, 3600)}})
    return engine.run(text, start, end)


_M = "(SELECT 'm_' || event_type AS m, 'svc-' || user_id % 5 AS s, ts, value AS v FROM events WHERE ts >= TIMESTAMP '2024-01-02 03:04:05' AND ts < TIMESTAMP '2024-01-28 17:40:00')"


@with_sql(
    f"""
WITH e AS {_M}, d AS (SELECT *, CASE WHEN v >= lag(v) OVER w THEN v - lag(v) OVER w WHEN lag(v) OVER w IS NOT NULL THEN v END AS up FROM e WINDOW w AS (PARTITION BY m, s ORDER BY ts, v))
SELECT m AS metric_name, s AS service_name, arg_min(v, ts) AS a, arg_max(v, ts) AS b, min(v) AS c, max(v) AS d,
       CASE WHEN count(*) > 1 THEN round(sum(up) / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6), 9) END AS f FROM d GROUP BY 1, 2
"""
)
def rollup_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First, last, extremes and rate of counters over weeks, from hourly partial rows."""
    text = "* | stats earliest(value) as a, latest(value) as b, min(value) as c, max(value) as d, rate(value) as f by metric_name service_name"
    return _routed(spark, sf_dir, text, datetime(2024, 1, 2, 3, 4, 5), datetime(2024, 1, 28, 17, 40)).withColumn("f", F.round("f", 9))


@with_sql(
    """
SELECT event_type, count(*) AS count, count(DISTINCT user_id) AS exact, true AS near FROM events
WHERE ts >= TIMESTAMP '2024-01-02 03:04:05' AND ts < TIMESTAMP '2024-01-28 17:40:00' GROUP BY 1
"""
)
def summary_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """estdc of users by kind from hourly sketches: counts are exact, estimates within two per cent."""
    start, end = datetime(2024, 1, 2, 3, 4, 5), datetime(2024, 1, 28, 17, 40)
    raw = read(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    made = summaries.Summary(("event_type",), ("user_id",), "ts")
    halves = [made.partials(raw.filter(F.pmod("event_id", F.lit(2)) == k)) for k in (0, 1)]
    table = made.merge(halves[0].unionByName(halves[1]))
    engine = Engine(spark, {"logs": (raw, EVENTS)}, now=NOW, rollups={"logs": replace(made, table=table)})
    told = engine.run("* | stats count, estdc(user_id) as est by event_type", start, end)
    exact = engine.run("* | stats dc(user_id) as exact by event_type", start, end)
    return told.join(exact, "event_type").select("event_type", "count", "exact", (F.abs(F.col("est") - F.col("exact")) <= 0.02 * F.col("exact")).alias("near"))


@with_sql("SELECT event_type AS source, time_bucket(INTERVAL 5 MINUTE, ts, TIMESTAMP '1970-01-01') AS bucket, count(*) AS events, max(ts) AS newest FROM events GROUP BY 1, 2")
def ledger_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by source and five minutes, added in batches of which one is repeated, and merged in between."""
    events = read(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    partials = lambda df: rollups.source_partials(df, "event_type", "ts")
    book = Ledger(spark, folder(spark, "ledger"), partials(events).schema)
    for i in (0, 1, 1, 2, 3):
        if book.append(partials(events.filter(F.pmod("event_id", F.lit(4)) == i)), i):
            book.compact(rollups.source_merge, fan=2)
    return rollups.source_merge(book.read())


@with_sql(
    """
WITH e AS (SELECT user_id, ts, event_type, event_id, max(CASE WHEN event_type = 'purchase' THEN ts END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS t0 FROM events),
k AS (SELECT user_id, min(CASE WHEN event_type = 'purchase' THEN ts END) AS f0, min(CASE WHEN event_type = 'signup' AND ts - t0 <= INTERVAL 30 MINUTE THEN ts END) AS f1, max(ts) AS last, arg_max(event_type, ts) AS action FROM e GROUP BY 1),
r AS (SELECT CASE WHEN f1 IS NULL THEN 1 ELSE 2 END AS level, (epoch_us(last) - epoch_us(f0)) / 1e6 AS idle, action FROM k WHERE f0 IS NOT NULL),
v AS (SELECT action, count(*) AS n FROM r WHERE level = 1 GROUP BY 1), t AS (SELECT count(*) AS n FROM r WHERE level = 1),
j AS (SELECT '[' || string_agg('{"field":"action","value":"' || action || '","count":' || v.n || ',"pct":' || round(100.0 * v.n / t.n, 1) || '}', ',' ORDER BY v.n DESC, action) || ']' AS top FROM v, t)
SELECT 1 AS funnel_level, count(*) AS count, count(*) FILTER (level = 1) AS dropper_count, round(quantile_cont(idle, 0.5) FILTER (level = 1), 3) AS dropper_median_idle_s, coalesce(max(top), '[]') AS dropper_top_attrs FROM r, j
UNION ALL SELECT 2, count(*) FILTER (level = 2), 0, NULL, '[]' FROM r
"""
)
def funnel_droppers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who bought and did not sign up within half an hour: how many, how long idle, and what they did last."""
    got = events_engine(spark, sf_dir, now=NOW).run("* | funnel by user_id window=30m [event_type=purchase] [event_type=signup]")
    return got.select("funnel_level", "count", "dropper_count", F.round("dropper_median_idle_s", 3).alias("dropper_median_idle_s"), "dropper_top_attrs")


@with_sql(
    """
WITH h AS (SELECT ts, user_id, CASE WHEN value > 60 THEN 'x' || (event_id % 101) END AS url FROM events),
o AS (SELECT DISTINCT user_id, url FROM h WHERE url IS NOT NULL AND ts >= TIMESTAMP '2024-01-12 06:00:00' AND ts < TIMESTAMP '2024-01-25')
SELECT CAST(h.user_id AS VARCHAR) AS entity, 'url' AS dim, h.url AS val, min(ts) AS first_seen, count(*) AS event_count FROM h LEFT JOIN o ON o.user_id = h.user_id AND o.url = h.url
WHERE h.url IS NOT NULL AND o.url IS NULL AND ts >= TIMESTAMP '2024-01-25' AND ts < TIMESTAMP '2024-01-31' GROUP BY h.user_id, h.url
"""
)
def baseline_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New values of all users against a ledger of which some days are there, and raw events for the rest."""
    e = read(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("timestamp"), F.col("user_id").cast("string").alias("user"), F.when(F.col("value") > 60, F.concat(F.lit("x"), (F.col("event_id") % 101))).alias("url"))
    seen = FirstSeen(spark, folder(spark, "seen"), {"user": "user"}, ("url",), "timestamp")
    seen.build(e, [date(2024, 1, d) for d in (11, 12, 14, 15, 16, 20, 23, 24)])
    engine = Engine(spark, {"logs": (e, LOGS)}, now=NOW, first_seen={"logs": seen})
    return engine.run("* | baseline user=* window=306h dims=url | table entity dim val first_seen event_count", datetime(2024, 1, 25), datetime(2024, 1, 31))


@with_sql("SELECT CAST(event_id AS VARCHAR) AS span_id FROM events WHERE user_id = 11")
def trace_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A trace's spans, from its place in time as an index of partial rows has it."""
    spans = _spans(spark, sf_dir)
    halves = [views.trace_times(spans.filter(F.pmod(F.xxhash64("span_id"), F.lit(2)) == k)) for k in (0, 1)]
    index = views.merged_trace_times(halves[0].unionByName(halves[1]))
    return Engine(spark, {"spans": (spans, SPANS)}, default="spans", now=NOW, trace_index=index).run("* | trace 11 | table span_id")


@with_sql(
    """
SELECT CAST(user_id AS VARCHAR) AS trace_id, lower(to_hex(event_id)) AS span_id, ts AS start_time, CAST(round(value * 1000000) AS BIGINT) AS duration_ns, 'svc-' || user_id % 5 AS service_name,
       event_type AS span_name, CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'OK' END AS status_code, CAST(json_extract(props, '$.k') AS VARCHAR) AS k, NULL AS reason FROM events WHERE event_id % 97 <> 0
UNION ALL SELECT NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'span without trace id' FROM events WHERE event_id % 97 = 0
UNION ALL SELECT NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'not JSON of this shape' FROM (SELECT DISTINCT user_id, CAST(ts AS DATE) FROM events)
"""
)
def ingest_otlp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as a collector would send them, a body for each user and day and a broken one beside it, taken apart;
    spans without an id of a trace and broken bodies with their reason."""
    e = read(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    text = lambda key, c: F.struct(F.lit(key).alias("key"), F.struct(c.cast("string").alias("stringValue")).alias("value"))
    start = F.unix_micros("ts") * 1000
    span = F.struct(
        F.when(F.col("event_id") % 97 == 0, "").otherwise(F.col("user_id").cast("string")).alias("traceId"), F.hex("event_id").alias("spanId"), F.col("event_type").alias("name"), start.cast("string").alias("startTimeUnixNano"),
        (start + F.round(F.col("value") * 1e6).cast("long")).cast("string").alias("endTimeUnixNano"), F.array(text("k", F.get_json_object("props", "$.k"))).alias("attributes"),
        F.struct(F.when(F.col("event_type") == "error", 2).otherwise(1).alias("code")).alias("status"),
    )
    days = e.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.collect_list(span).alias("spans"))  # a user's day
    resource = F.struct(F.array(text("service.name", F.concat(F.lit("svc-"), F.col("user_id") % 5))).alias("attributes"))
    body = F.to_json(F.struct(F.array(F.struct(resource.alias("resource"), F.array(F.struct("spans")).alias("scopeSpans"))).alias("resourceSpans")))
    bodies = days.select(F.explode(F.array(body, F.substring(body, 1, 40))).alias("value"))
    rows, bad = ingest.spans(bodies)
    cols = ["trace_id", "span_id", "start_time", "duration_ns", "service_name", "span_name", "status_code"]
    return rows.select(*cols, F.col("attributes")["k"].alias("k")).unionByName(bad.select("reason"), allowMissingColumns=True)


def _risk_engine(spark: SparkSession, sf_dir: str) -> Engine:
    """Findings of a scheduled rule and signals of a real-time one as datasets."""
    end = datetime(2024, 1, 31)
    engine = events_engine(spark, sf_dir, now=end)
    found = rules.findings(engine, Rule("errors", "event_type=error value>50", lookback="31d", score=10, entity="user_id"), end)
    st = engine.compile(rules.parse("event_type=purchase value>150"), None, datetime(2024, 1, 1), end)
    return Engine(spark, rules.datasets(found, rules.findings_of(st, Rule("buys", "", score=30, entity="user_id")), end), now=end)


_FOUND = "(SELECT CAST(user_id AS VARCHAR) AS e, ts, (epoch_us(TIMESTAMP '2024-01-31') - epoch_us(ts)) / 3.6e9 AS h FROM events WHERE event_type = 'error' AND value > 50 AND ts >= TIMESTAMP '2023-12-31' AND ts < TIMESTAMP '2024-01-31')"


@with_sql(
    f"""
SELECT e AS entity, CAST(round(sum(CASE WHEN h < 24 THEN 10.0 ELSE 0 END)) AS BIGINT) AS risk_24h, CAST(round(sum(10 * CASE WHEN h < 24 THEN 1.0 WHEN h < 72 THEN 0.7 WHEN h < 120 THEN 0.4 ELSE 0.2 END)) AS BIGINT) AS risk_7d, max(ts) AS last_finding_at, count(*) AS finding_count
FROM {_FOUND} WHERE h < 168 GROUP BY 1 HAVING risk_7d >= 10
"""
)
def risk_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities at risk, by a query of the dataset over a quarter of an hour, which changes nothing."""
    end = datetime(2024, 1, 31)
    return _risk_engine(spark, sf_dir).run("dataset=risk risk_7d>=10 | table entity risk_24h risk_7d last_finding_at finding_count", end - timedelta(minutes=15), end)


@with_sql(
    f"""
SELECT 'scheduled' AS kind, 'errors' AS rule_name, count(*) AS count, count(DISTINCT e) AS entities FROM {_FOUND} WHERE ts >= TIMESTAMP '2024-01-10'
UNION ALL SELECT 'realtime', 'buys', count(*), count(DISTINCT user_id) FROM events WHERE event_type = 'purchase' AND value > 150 AND ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-31'
"""
)
def signals_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals of both kinds of rules in three weeks, none of a rule as zero."""
    told = _risk_engine(spark, sf_dir).run("dataset=signals | stats count, dc(entity) as entities by kind rule_name", datetime(2024, 1, 10), datetime(2024, 1, 31))
    both = spark.createDataFrame([("scheduled", "errors"), ("realtime", "buys")], "kind string, rule_name string")
    return both.join(told, ["kind", "rule_name"], "left").fillna(0, ["count", "entities"])


@with_sql(
    """
SELECT 'svc-' || user_id % 5 AS service_name, count(*) AS requests, count(*) FILTER (event_type = 'error') AS errors, round(count(*) FILTER (event_type = 'error') * 1.0 / count(*), 6) AS error_rate, true AS near
FROM events WHERE ts >= TIMESTAMP '2024-01-02 03:04:05' AND ts < TIMESTAMP '2024-01-28 17:40:30' GROUP BY 1
"""
)
def services_rolled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The view of services over weeks from partial rows by minute: exact counts, quantiles near those of the spans."""
    start, end = datetime(2024, 1, 2, 3, 4, 5), datetime(2024, 1, 28, 17, 40, 30)
    spans = _spans(spark, sf_dir)
    halves = [rollups.red_partials(spans.filter(F.pmod(F.xxhash64("span_id"), F.lit(2)) == k)) for k in (0, 1)]
    told, plain = (Engine(spark, {"spans": (spans, SPANS)}, default="spans", now=NOW, rollups=r).run("| services", start, end) for r in ({"spans": {"red": halves[0].unionByName(halves[1])}}, None))
    both = told.alias("a").join(plain.alias("b"), "service_name")
    near = F.greatest(*[F.abs(F.col(f"a.{p}") - F.col(f"b.{p}")) for p in ("p50_ms", "p95_ms")]) <= 0.05 * F.col("b.p99_ms")
    return both.select("service_name", "a.requests", "a.errors", F.round("a.error_rate", 6).alias("error_rate"), near.alias("near"))
