"""Builders over spans and metrics that stand beside the language."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rivulet.operators.views import red, tag_keys, tag_values
from rivulet.plans import times

__all__ = ["tag_keys", "tag_values"]


def metric_names(metrics: DataFrame) -> DataFrame:
    return metrics.groupBy("metric_name", "metric_type").agg(F.count("*").alias("samples"), F.max("timestamp").alias("newest"))


def metric_timeseries(metrics: DataFrame, name: str, agg: str = "avg", span: float = 60, by: str | None = None, tags: dict[str, str] | None = None) -> DataFrame:
    """time_bucket, the tag `by` if given, and value, of the samples with all the tags."""
    tag = lambda k: F.coalesce(F.col("attributes").getItem(k), F.col("resource_attributes").getItem(k))
    df = metrics.filter(F.col("metric_name") == name)
    for k, v in (tags or {}).items():
        df = df.filter(tag(k) == v)
    keys = [times.bucket(F.col("timestamp"), span).alias("time_bucket"), *([tag(by).alias(by)] if by else [])]
    how = {"avg": F.avg, "sum": F.sum, "min": F.min, "max": F.max, "count": F.count, "p95": lambda c: F.percentile(c, F.lit(0.95))}[agg]
    return df.groupBy(*keys).agg(how("value").alias("value"))


def metric_scalar(metrics: DataFrame, name: str, agg: str = "avg") -> DataFrame:
    how = {"avg": F.avg, "sum": F.sum, "min": F.min, "max": F.max, "count": F.count}[agg]
    return metrics.filter(F.col("metric_name") == name).agg(how("value").alias("value"))


def service_timeseries(spans: DataFrame, service: str, span: float = 60) -> DataFrame:
    """requests, errors and durations of a service by time."""
    return red(spans.filter(F.col("service_name") == service), [times.bucket(F.col("start_time"), span).alias("time_bucket")])


def services_sparkline(spans: DataFrame, span: float = 3600) -> DataFrame:
    """By service, the requests of each bucket in order of time."""
    cells = spans.groupBy("service_name", times.bucket(F.col("start_time"), span).alias("t")).agg(F.count("*").alias("n"))
    return cells.groupBy("service_name").agg(F.transform(F.array_sort(F.collect_list(F.struct("t", "n"))), lambda r: r["n"]).alias("requests"))


def service_endpoints(spans: DataFrame, service: str) -> DataFrame:
    return red(spans.filter(F.col("service_name") == service), [F.col("span_name")])


def service_exemplars(spans: DataFrame, service: str, n: int = 3) -> DataFrame:
    """The n slowest traces of each endpoint."""
    w = W.partitionBy("span_name").orderBy(F.desc("duration_ns"), "trace_id", "span_id")
    own = spans.filter(F.col("service_name") == service).withColumn("rank", F.row_number().over(w))
    return own.filter(F.col("rank") <= n).select("span_name", "rank", "trace_id", "span_id", "duration_ns")


def slo_coverage(spans: DataFrame, gap: float) -> DataFrame:
    """By service: first and last time, and how many gaps longer than gap seconds lie between its spans."""
    w = W.partitionBy("service_name").orderBy("start_time")
    before = F.lag("start_time").over(w)
    wide = (F.unix_micros("start_time") - F.unix_micros(before)) > int(gap * 1e6)
    return spans.withColumn("__gap", F.coalesce(wide, F.lit(False))).groupBy("service_name").agg(F.min("start_time").alias("first"), F.max("start_time").alias("last"), F.count_if("__gap").alias("gaps"))


def hosts(spans: DataFrame) -> DataFrame:
    """Inventory: spans, services and times by host."""
    host = F.coalesce(F.col("resource_attributes").getItem("host.name"), F.col("attributes").getItem("host.name"))
    return spans.select(host.alias("host"), "service_name", "start_time").filter("host is not null").groupBy("host").agg(F.count("*").alias("spans"), F.count_distinct("service_name").alias("services"), F.max("start_time").alias("newest"))


def page_views(spans: DataFrame) -> DataFrame:
    """Views and the quantiles of the largest paint by page, of browser spans."""
    page = F.col("attributes").getItem("page.url")
    lcp = F.col("attributes").getItem("web_vital.lcp").try_cast("double")
    return spans.filter(page.isNotNull()).groupBy(page.alias("page")).agg(F.count("*").alias("views"), F.percentile(lcp, F.lit(0.75)).alias("lcp_p75"))


def synthetic_checks(spans: DataFrame) -> DataFrame:
    """Runs and share of successes by check."""
    name = F.col("attributes").getItem("synthetic.check")
    ok = ~F.upper("status_code").isin("ERROR", "STATUS_CODE_ERROR", "2")
    return spans.filter(name.isNotNull()).groupBy(name.alias("check")).agg(F.count("*").alias("runs"), (F.count_if(ok) / F.count("*")).alias("success"))


def entity_signals(spans: DataFrame, signals: DataFrame, entity: str = "user") -> DataFrame:
    """By service and entity seen in its spans: the signals of that entity."""
    who = F.coalesce(F.col("attributes").getItem(entity), F.col("resource_attributes").getItem(entity))
    seen = spans.select("service_name", who.alias("entity")).filter("entity is not null").distinct()
    counts = signals.groupBy("entity").agg(F.count("*").alias("signals"), F.max("score").alias("score"), F.max("timestamp").alias("newest"))
    return seen.join(counts, "entity")
