"""Rollups: partial states by bucket that merge, in batches or as a stream.

A stream's micro-batches are aggregated to partial rows and appended under the batch's id, so that a batch that is
repeated after a failure overwrites its own rows. Readers merge the partial rows; late rows just land in their bucket.
Far-future times are clamped to `ahead` from now, with the original kept."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rivulet.plans import times
from rivulet.plans.ast import Agg, Field, Keyword, Lit, Op, Query, Term
from rivulet.plans.errors import QueryError
from rivulet.plans.profile import METRICS, Profile

AHEAD = timedelta(hours=1)


def clamp_future(df: DataFrame, time: str, now: Column | None = None, ahead: timedelta = AHEAD) -> DataFrame:
    now = F.current_timestamp() if now is None else now
    limit = F.timestamp_micros(F.unix_micros(now) + int(ahead.total_seconds() * 1e6))
    t = F.col(time)
    return df.withColumn(f"original_{time}", F.when(t > limit, t)).withColumn(time, F.least(t, limit))


#: States of the samples at both ends of a bucket: of its earliest and latest, and for rates in the order that they have there.
_EDGES = ("value_first", "value_last", "rate_first", "rate_last")


def _fold(rows: Column) -> Column:
    """The rise over pieces of one series, in order: each has rate_first, rate_last (time, value) and value_rise. A fall
    is a start from 0. Null where pieces lie in each other, so that their samples' order is not known."""
    start = F.struct(F.lit(None).cast("struct<t:bigint,v:double>").alias("last"), F.lit(0.0).alias("rise"))

    def step(acc, r):
        a, b = acc["last"], r["rate_first"]
        between = F.when(a.isNull(), 0.0).when(b < a, F.lit(None)).when(b["v"] >= a["v"], b["v"] - a["v"]).otherwise(b["v"])
        return F.struct(F.greatest(a, r["rate_last"]).alias("last"), (acc["rise"] + between + r["value_rise"]).alias("rise"))

    return F.aggregate(rows, start, step, lambda acc: acc["rise"])


def _merged_rise() -> Column:
    whole = F.when(F.col("rate_first").isNotNull(), F.struct("rate_first", "rate_last", F.col("value_rise")))
    return _fold(F.array_sort(F.collect_list(whole)))


def metric_partials(df: DataFrame, span: float = 60) -> DataFrame:
    """metric_name, service_name, bucket and the mergeable state of the values: sum, count, min, max, a KLL sketch, the
    first and the last by time, and how much a counter rose between them. A bucket's samples are held while its
    rise is made; they are those of one series in span seconds."""
    at = F.when(F.col("value").isNotNull(), F.struct(F.col("timestamp").alias("t"), F.col("value").cast("string").alias("k"), F.col("value").alias("v")))
    sample = F.when(F.col("value").isNotNull(), F.struct(F.unix_micros("timestamp").alias("t"), F.col("value").cast("double").alias("v")))
    pieces = F.transform(F.array_sort(F.collect_list(sample)), lambda x: F.struct(x.alias("rate_first"), x.alias("rate_last"), F.lit(0.0).alias("value_rise")))
    return df.groupBy("metric_name", "service_name", times.bucket(F.col("timestamp"), span).alias("bucket")).agg(
        F.sum("value").alias("value_sum"), F.count("value").alias("value_count"), F.min("value").alias("value_min"), F.max("value").alias("value_max"), F.kll_sketch_agg_double("value").alias("value_state"),
        F.min(at).alias("value_first"), F.max(at).alias("value_last"), F.min(sample).alias("rate_first"), F.max(sample).alias("rate_last"), _fold(pieces).alias("value_rise"),
    )


def metric_merge(partials: DataFrame, span: float) -> DataFrame:
    """Coarser buckets of partial rows."""
    edges = [(F.min if c.endswith("first") else F.max)(c).alias(c) for c in _EDGES]
    return partials.groupBy("metric_name", "service_name", times.bucket(F.col("bucket"), span).alias("bucket")).agg(
        F.sum("value_sum").alias("value_sum"), F.sum("value_count").alias("value_count"), F.min("value_min").alias("value_min"), F.max("value_max").alias("value_max"), F.kll_merge_agg_double("value_state").alias("value_state"),
        *edges, _merged_rise().alias("value_rise"),
    )


#: Aggregates that a rollup answers, and from which length of the range on each rollup is read.
ROUTED = frozenset(("avg", "min", "max", "earliest", "latest", "first", "last", "median", "percentile", "rate"))
ROUTES = ((7 * 86400, "1h", 3600), (6 * 3600, "1m", 60))
WIDTHS = {name: width for _, name, width in ROUTES}


def route(range_seconds: float, aggregates: list[str], span: float | None = None, by: tuple[str, ...] = (), percentiles: tuple[float, ...] = ()) -> str | None:
    """The rollup a metrics query may read, or None for the raw rows."""
    if not set(aggregates) <= ROUTED or not set(by) <= {"metric_name", "service_name"} or not set(percentiles) <= {50, 95, 99}:
        return None
    return next((name for least, name, width in ROUTES if range_seconds >= least and (span is None or span % width == 0)), None)


def of_partials(scope, a: Agg, time: str | None) -> Column:
    """An aggregate of the values from partial rows."""
    if a.func == "avg":
        return F.try_divide(F.sum("value_sum"), F.sum("value_count"))
    if a.func in ("min", "max"):
        return F.min("value_min") if a.func == "min" else F.max("value_max")
    if a.func in ("median", "percentile"):
        return F.kll_sketch_get_quantile_double(F.kll_merge_agg_double("value_state"), F.lit(0.5 if a.func == "median" else a.param / 100))
    if a.func in ("first", "earliest"):
        return F.min("value_first")["v"]
    if a.func in ("last", "latest"):
        return F.max("value_last")["v"]
    if a.func == "rate":
        first, last = F.min("rate_first"), F.max("rate_last")
        return F.when(F.sum("value_count") > 1, F.try_divide(_merged_rise(), (last["t"] - first["t"]) / 1e6))
    raise QueryError(f"{a.func} can't be made of a rollup")


#: Partial rows as a dataset.
PARTIALS = Profile("metrics_rollup", "bucket", (), {k: "bucket" if v == "timestamp" else v for k, v in METRICS.aliases.items()}, build=of_partials)


def by_key(x, keys: set[str], name) -> set[str] | None:
    """The keys for which a search asks a value each, if it asks for nothing else."""
    if x is None or isinstance(x, Lit) and x.value is True or isinstance(x, Keyword) and x.text == "*":
        return set()
    if isinstance(x, Op) and x.op == "and":
        found = [by_key(y, keys, name) for y in x.args]
        return None if None in found else set().union(*found)
    if isinstance(x, Term) and x.op == "=" and name(x.field) in keys and not set("*?") & set(str(x.value.value)):
        return {name(x.field)}
    return None


def routed(q: Query, seconds: float) -> str | None:
    """The rollup that answers a query over so many seconds: a search by keys and one stats, chart or timechart without
    series, whose series are ranked by their samples. Rates are answered for single series only. None for other
    queries, which read the raw rows."""
    name = lambda n: METRICS.aliases.get(n, n)
    keys = {"metric_name", "service_name"}
    if len(q.stages) != 1 or (fixed := by_key(q.search, keys, name)) is None:
        return None
    s = q.stages[0]
    if s.name not in ("stats", "chart", "timechart") or s.name == "timechart" and (s.get("by") or not s.get("span")):
        return None
    aggs = s.args["aggs"]
    if not aggs or not all(isinstance(a.arg, Field) and name(a.arg.name) == "value" and a.where is None for a in aggs):
        return None
    by = tuple(name(n) for n in [*s.get("by", []), *s.get("over", [])])
    if any(a.func == "rate" for a in aggs) and fixed | set(by) != keys:
        return None
    percentiles = tuple(a.param for a in aggs if a.func == "percentile")
    return route(seconds, [a.func for a in aggs], times.seconds(s.get("span")) if s.get("span") else None, by, percentiles)


def asks_rate(q: Query) -> bool:
    return any(a.func == "rate" for s in q.stages for a in s.get("aggs") or ())


def mixed(partials: DataFrame) -> bool:
    """Whether samples of a series lie in each other that are in different partial rows, so that rates need the samples."""
    order = W.partitionBy("metric_name", "service_name").orderBy("rate_first", "rate_last")
    before = F.max("rate_last").over(order.rowsBetween(W.unboundedPreceding, -1))
    rows = partials.select("metric_name", "service_name", "rate_first", "rate_last", "value_rise").filter("rate_first IS NOT NULL")
    return not rows.withColumn("before", before).filter("before > rate_first OR value_rise IS NULL").isEmpty()


def inner(start: datetime, end: datetime, width: float) -> tuple[datetime, datetime] | None:
    """The first and the last border of buckets in a range, if a whole one lies between."""
    zero = datetime(1970, 1, 1)
    a, b = ((x - zero).total_seconds() for x in (start, end))
    lo, hi = -(-a // width) * width, b // width * width
    return (zero + timedelta(seconds=lo), zero + timedelta(seconds=hi)) if lo < hi else None


def red_partials(spans: DataFrame, span: float = 60) -> DataFrame:
    """Requests, errors and a sketch of the durations by service and bucket."""
    error = F.upper("status_code").isin("ERROR", "STATUS_CODE_ERROR", "2")
    return spans.groupBy("service_name", times.bucket(F.col("start_time"), span).alias("bucket")).agg(F.count("*").alias("requests"), F.count_if(error).alias("errors"), F.kll_sketch_agg_double(F.col("duration_ns") / 1e6).alias("duration_state"))


def red_merge(partials: DataFrame, span: float) -> DataFrame:
    merged = partials.groupBy("service_name", times.bucket(F.col("bucket"), span).alias("bucket")).agg(F.sum("requests").alias("requests"), F.sum("errors").alias("errors"), F.kll_merge_agg_double("duration_state").alias("s"))
    return merged.select("service_name", "bucket", "requests", "errors", *[F.kll_sketch_get_quantile_double("s", F.lit(p)).alias(f"p{round(p * 100)}_ms") for p in (0.5, 0.95, 0.99)])


#: Partial rows of spans as a dataset.
RED = Profile("spans_red", "bucket", (), {"service": "service_name", "_time": "bucket", "timestamp": "bucket"})


def asks_services(q: Query) -> bool:
    """Whether a query is the view of services, of all or of one by its name."""
    name = lambda n: RED.aliases.get(n, n)
    return len(q.stages) == 1 and q.stages[0].name == "services" and by_key(q.search, {"service_name"}, name) is not None


def red_view(partials: DataFrame) -> DataFrame:
    """The view of services from partial rows; quantiles are those of the merged sketches."""
    merged = partials.groupBy("service_name").agg(F.sum("requests").alias("requests"), F.sum("errors").alias("errors"), F.kll_merge_agg_double("duration_state").alias("s"))
    quantiles = [F.kll_sketch_get_quantile_double("s", F.lit(p)).alias(f"p{round(p * 100)}_ms") for p in (0.5, 0.95, 0.99)]
    return merged.select("service_name", "requests", "errors", (F.col("errors") / F.col("requests")).alias("error_rate"), *quantiles)


def source_partials(df: DataFrame, source: str, time: str, span: float = 300) -> DataFrame:
    """Events by source and five minutes."""
    return df.groupBy(F.col(source).alias("source"), times.bucket(F.col(time), span).alias("bucket")).agg(F.count("*").alias("events"), F.max(time).alias("newest"))


def source_merge(partials: DataFrame) -> DataFrame:
    return partials.groupBy("source", "bucket").agg(F.sum("events").alias("events"), F.max("newest").alias("newest"))


def stream(df: DataFrame, partials, path: str, checkpoint: str):
    """Starts a query that writes partials(batch) of each micro-batch under path."""

    def write(batch: DataFrame, batch_id: int) -> None:
        partials(batch).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
