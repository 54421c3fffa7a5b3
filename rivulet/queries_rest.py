"""Registered queries of stages and aggregates that the other modules have none for, each with its SQL."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.engine import Engine, events_engine
from rivulet.plans.profile import EVENTS, METRICS
from rivulet.queries import NOW, _metrics
from rivulet.queries_ingest import _streamed, read, with_sql
from rivulet.queries_more import _H, JAN25, JAN31, _over_hosts
from rivulet.sources.scratch import folder
from rivulet.streaming import rollups, rules

JAN10, JAN20 = datetime(2024, 1, 10), datetime(2024, 1, 20)


@with_sql(
    """
SELECT event_type, array_to_string(list(n ORDER BY b), ',') AS s FROM (
  SELECT event_type, time_bucket(INTERVAL 12 HOUR, ts, TIMESTAMP '1970-01-01') AS b, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-20' GROUP BY 1, 2) GROUP BY 1
"""
)
def stats_sparkline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by twenty buckets of ten days, by kind."""
    out = events_engine(spark, sf_dir, now=NOW).run("* | stats sparkline() as s by event_type", JAN10, JAN20)
    return out.select("event_type", F.array_join(F.transform("s", lambda n: n.cast("string")), ",").alias("s"))


@with_sql(
    """
WITH c AS (SELECT user_id % 5 AS k, count(*) FILTER (value < 20) AS a, count(*) FILTER (value >= 20 AND value < 60) AS b, count(*) FILTER (value >= 60) AS c FROM events GROUP BY 1), w AS (SELECT *, (a + b + c) * 0.75 AS w FROM c)
SELECT 'svc-' || k AS service_name, round(CASE WHEN a >= w THEN 20 * w / a WHEN a + b >= w THEN 20 + 40 * (w - a) / b ELSE 60 END, 6) AS q FROM w
"""
)
def stats_histogram_quantile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The third quartile of all values by service, from a histogram for each event."""
    v = F.col("value")
    counts = F.array(*[F.when(c, 1).otherwise(0).cast("bigint") for c in (v < 20, (v >= 20) & (v < 60), v >= 60)])
    raw = _metrics(spark, sf_dir).withColumns({"bucket_counts": counts, "explicit_bounds": F.array(F.lit(20.0), F.lit(60.0))})
    engine = Engine(spark, {"metrics": (raw, METRICS)}, default="metrics", now=NOW)
    return engine.run("* | stats histogram_quantile(bucket_counts, 75) as q by service_name").withColumn("q", F.round("q", 6))


@with_sql("SELECT date_trunc('day', ts)::TIMESTAMP AS time_bucket, 'm_' || event_type AS metric_name, max(value) AS m FROM events WHERE user_id % 5 = 2 GROUP BY 1, 2")
def metrics_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily series of a service's metrics, days without samples left out."""
    engine = Engine(spark, {"metrics": (_metrics(spark, sf_dir), METRICS)}, default="metrics", now=NOW)
    return engine.run("service=svc-2 | timechart span=1d max(value) as m by metric_name", datetime(2023, 12, 1), NOW)


@with_sql("SELECT user_id, count(*) AS n, max(value) AS m FROM events WHERE event_type = 'purchase' GROUP BY 1")
def output_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a destination has got, read again."""
    at = folder(spark, "sink")
    engine = events_engine(spark, sf_dir, now=NOW, sinks={"report": lambda df: df.write.mode("overwrite").parquet(at)})
    engine.run("event_type=purchase | stats count as n, max(value) as m by user_id | output report")
    return spark.read.parquet(at)


@with_sql(
    """
SELECT event_id, CASE WHEN value > 100 THEN 'bad' ELSE 'fine' END AS ai_verdict, 0.5 AS ai_confidence, 'why: ' || event_type AS ai_reasoning FROM (
  SELECT *, row_number() OVER (ORDER BY ts DESC, event_id DESC) AS k FROM events WHERE event_type = 'error') WHERE k <= 40
"""
)
def ai_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts of a function on the forty newest errors, which is what the stage asks about."""

    def judge(df: DataFrame, prompt: str) -> DataFrame:
        return df.withColumns({"ai_verdict": F.when(F.col("value") > 100, "bad").otherwise("fine"), "ai_confidence": F.lit(0.5), "ai_reasoning": F.concat(F.lit(f"{prompt}: "), "event_type")})

    engine = events_engine(spark, sf_dir, now=NOW, ai=judge)
    return engine.run('event_type=error | ai prompt="why" max_rows=40 | table event_id ai_verdict ai_confidence ai_reasoning')


@with_sql("SELECT event_id, least(ts, TIMESTAMP '2024-01-15 01:00:00') AS ts, CASE WHEN ts > TIMESTAMP '2024-01-15 01:00:00' THEN ts END AS original_ts FROM events")
def ingest_clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times of all events as if they came in on the fifteenth: none is more than an hour ahead."""
    e = read(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    return rollups.clamp_future(e, "ts", F.lit(datetime(2024, 1, 15)).cast("timestamp"))


@with_sql("SELECT DISTINCT 'spend' AS rule, CAST(user_id AS VARCHAR) AS entity FROM events WHERE event_type = 'purchase' AND value > 60")
def realtime_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A real-time rule with one signal for each entity in a window that holds all events."""
    engine = events_engine(spark, sf_dir, now=NOW)
    rule = rules.Rule("spend", "event_type=purchase value>60", score=30, entity="user_id")
    events = read(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    got = _streamed(spark, [events.filter("event_id % 2 = 0"), events.filter("event_id % 2 = 1")], lambda s: rules.realtime(engine, rule, s, EVENTS, window="400 days"))
    return got.select("rule", "entity")


@with_sql(
    """
WITH e AS (SELECT user_id, ts, row_number() OVER (ORDER BY ts DESC) AS k, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS own FROM events WHERE event_type = 'view' AND ts >= TIMESTAMP '2024-01-08' AND ts < TIMESTAMP '2024-01-30')
SELECT 'views' AS rule, CAST(user_id AS VARCHAR) AS entity, 20 AS score, ts AS timestamp FROM e WHERE k <= 60 OR own = 1
"""
)
def rule_bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scheduled rule's run with a bound: the newest matches, and the newest of every entity."""
    engine = events_engine(spark, sf_dir, now=NOW)
    rule = rules.Rule("views", "event_type=view | risk score=20 entity=user_id", lookback="22d", entity="user_id")
    end = datetime(2024, 1, 30)
    st = engine.compile(rules.parse(rule.query), None, datetime(2024, 1, 8), end)
    return rules.bounded(rules.findings_of(st, rule), 60)


@with_sql(
    f"SELECT url AS indicator, count(*) AS matches, count(DISTINCT src_host) AS assets, count(DISTINCT user) AS users, min(ts) AS first_seen, max(ts) AS last_seen FROM {_H} WHERE url IS NOT NULL AND ts >= TIMESTAMP '2024-01-25' AND ts < TIMESTAMP '2024-01-31' GROUP BY 1"
)
def retro_indicator(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches of indicators in six days, by indicator."""
    return _over_hosts(spark, sf_dir, "dataset=hosts url=* | eval ioc=url | retro by indicator", JAN25, JAN31)


@with_sql("SELECT page_id FROM pages WHERE lower(url) IN (SELECT lower(url) FROM pages WHERE page_id % 11 = 0)")
def search_ioc_threatfox(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose address a registered feed has."""
    feed = read(spark, sf_dir, "pages").filter("page_id % 11 = 0").select("url")
    return events_engine(spark, sf_dir, now=NOW, lookups={"threatfox:recent": feed, "threatfox:": feed, "threatfox": feed}).run("dataset=pages ioc in threatfox(\"recent\") | table page_id")


@with_sql(
    """
SELECT event_id, n_name, c_mktsegment, round(c_acctbal, 2) AS c_acctbal, c_acctbal > 0 AS solvent FROM events LEFT JOIN customer ON c_custkey = user_id LEFT JOIN nation ON n_nationkey = c_nationkey
"""
)
def lookup_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text, whole numbers, fractions and truth values of lookups, one by what the other has given."""
    customer = read(spark, sf_dir, "customer").withColumn("solvent", F.col("c_acctbal") > 0)
    out = events_engine(spark, sf_dir, now=NOW, lookups={"clients": customer}).run("* | lookup clients c_custkey AS user_id OUTPUT c_nationkey, c_mktsegment, c_acctbal, solvent | lookup nation n_nationkey AS c_nationkey OUTPUT n_name | table event_id n_name c_mktsegment c_acctbal solvent")
    return out.withColumn("c_acctbal", F.round("c_acctbal", 2))


@with_sql("SELECT count(*) AS n FROM pages WHERE lower(url) IN (SELECT lower(url) FROM pages WHERE page_id % 11 = 0)")
def search_ioc_subsearch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose address a lookup has that the search names in brackets."""
    feed = read(spark, sf_dir, "pages").filter("page_id % 11 = 0").select("url")
    return events_engine(spark, sf_dir, now=NOW, lookups={"bad": feed}).run("dataset=pages ioc in [| inputlookup bad] | stats count as n")
