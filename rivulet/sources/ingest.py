"""What collectors send, as rows: traces and metrics in the JSON of OTLP, events in that of an HTTP event collector.

A body is one text. Its nested arrays are taken apart with from_json and explode, attribute lists become maps of text,
and nothing leaves the JVM. What can't be read goes to a side output with the reason, whole bodies as well as single
entries, so that one bad span does not cost the others. In a stream each micro-batch is added to ledgers under its
number; a batch that is repeated after a failure is not there twice."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivulet.streaming.ledger import Ledger

_VALUE = "value STRUCT<stringValue STRING, boolValue BOOLEAN, intValue STRING, doubleValue DOUBLE, arrayValue STRING, kvlistValue STRING, bytesValue STRING>"
_ATTRIBUTES = f"attributes ARRAY<STRUCT<key STRING, {_VALUE}>>"
_SPAN = f"traceId STRING, spanId STRING, parentSpanId STRING, name STRING, kind STRING, startTimeUnixNano STRING, endTimeUnixNano STRING, {_ATTRIBUTES}, status STRUCT<code STRING, message STRING>"
_POINT = f"timeUnixNano STRING, asDouble DOUBLE, asInt STRING, count STRING, sum DOUBLE, bucketCounts ARRAY<STRING>, explicitBounds ARRAY<DOUBLE>, {_ATTRIBUTES}"
_POINTS = f"STRUCT<dataPoints ARRAY<STRUCT<{_POINT}>>, aggregationTemporality STRING, isMonotonic BOOLEAN>"
TRACES = f"resourceSpans ARRAY<STRUCT<resource STRUCT<{_ATTRIBUTES}>, scopeSpans ARRAY<STRUCT<spans ARRAY<STRUCT<{_SPAN}>>>>>>"
METRICS = f"resourceMetrics ARRAY<STRUCT<resource STRUCT<{_ATTRIBUTES}>, scopeMetrics ARRAY<STRUCT<metrics ARRAY<STRUCT<name STRING, unit STRING, gauge {_POINTS}, sum {_POINTS}, histogram {_POINTS}>>>>>>"
HEC = "time STRING, host STRING, source STRING, sourcetype STRING, index STRING, event STRING, fields MAP<STRING, STRING>"
#: Fixed names of OTLP's numbers.
STATUS = {"0": "UNSET", "1": "OK", "2": "ERROR"}
KINDS = {"1": "INTERNAL", "2": "SERVER", "3": "CLIENT", "4": "PRODUCER", "5": "CONSUMER"}


def attributes(a: Column) -> Column:
    """A list of keys and values as a map of text; of a repeated key the last value counts, an entry without one goes."""
    v = lambda x: x["value"]
    text = lambda x: F.coalesce(*[v(x)[k].cast("string") for k in ("stringValue", "intValue", "doubleValue", "boolValue", "arrayValue", "kvlistValue", "bytesValue")])
    known = F.filter(a, lambda x: x["key"].isNotNull() & text(x).isNotNull())
    last = F.aggregate(
        known, F.create_map().cast("map<string,string>"),
        lambda acc, x: F.map_concat(F.map_filter(acc, lambda k, _: k != x["key"]), F.create_map(x["key"], text(x))),
    )
    return F.coalesce(last, F.create_map().cast("map<string,string>"))


def _nanos(c: Column) -> Column:
    return c.try_cast("decimal(20,0)").try_cast("long")


def _time(nanos: Column) -> Column:
    return F.timestamp_micros(F.call_function("div", nanos, F.lit(1000)))  # whole numbers, as doubles are too coarse


def _named(c: Column, names: dict[str, str]) -> Column:
    """Numbers, or names with any prefix, as plain names."""
    out = F.upper(F.regexp_replace(c, "^(STATUS_CODE|SPAN_KIND)_", ""))
    for number, name in names.items():
        out = F.when(c == number, name).otherwise(out)
    return out


def _read(bodies: DataFrame, schema: str, top: str) -> tuple[DataFrame, DataFrame]:
    """Bodies (a column value) whose list `top` can be read, as x, and the others with a reason."""
    each = bodies.select("value", F.from_json("value", f"{schema}, _bad STRING", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("x"))
    good = F.col(f"x.{top}").isNotNull() & F.col("x._bad").isNull()
    reason = F.when(F.col("value").isNull() | (F.trim("value") == ""), "empty").when(F.col("x._bad").isNotNull() | F.col("x").isNull(), "not JSON of this shape").otherwise(f"no {top}")
    return each.filter(good), each.filter(~F.coalesce(good, F.lit(False))).select("value", reason.alias("reason"))


def _side(df: DataFrame, reason: Column) -> tuple[DataFrame, DataFrame]:
    """Rows without a reason to leave them out, and the others: as JSON, with it."""
    marked = df.withColumn("__reason", reason)
    return marked.filter("__reason IS NULL").drop("__reason"), marked.filter("__reason IS NOT NULL").select(F.to_json(F.struct(*[F.col(c) for c in df.columns])).alias("value"), F.col("__reason").alias("reason"))


def spans(bodies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of spans, and what could not be read (value, reason). A span that ends before it begins lasts no time."""
    good, bad = _read(bodies, TRACES, "resourceSpans")
    each = good.select(F.explode("x.resourceSpans").alias("r")).select(F.col("r.resource.attributes").alias("ra"), F.explode("r.scopeSpans").alias("s")).select("ra", F.explode("s.spans").alias("s"))
    start, end = _nanos(F.col("s.startTimeUnixNano")), _nanos(F.col("s.endTimeUnixNano"))
    reason = F.when(F.coalesce(F.col("s.traceId"), F.lit("")) == "", "span without trace id").when(F.coalesce(F.col("s.spanId"), F.lit("")) == "", "span without id").when(start.isNull(), "span without start")
    ok, worse = _side(each, reason)
    end = F.greatest(start, F.coalesce(end, start))
    attrs, resource = attributes(F.col("s.attributes")), attributes(F.col("ra"))
    rows = ok.select(
        F.lower("s.traceId").alias("trace_id"), F.lower("s.spanId").alias("span_id"), F.lower(F.coalesce("s.parentSpanId", F.lit(""))).alias("parent_span_id"),
        _time(start).alias("start_time"), _time(end).alias("end_time"), (end - start).alias("duration_ns"),
        F.coalesce(resource["service.name"], F.lit("")).alias("service_name"), F.coalesce("s.name", F.lit("")).alias("span_name"),
        F.coalesce(_named(F.col("s.kind"), KINDS), F.lit("UNSPECIFIED")).alias("span_kind"), F.coalesce(_named(F.col("s.status.code"), STATUS), F.lit("UNSET")).alias("status_code"),
        F.coalesce("s.status.message", F.lit("")).alias("status_message"), attrs.alias("attributes"), resource.alias("resource_attributes"),
    )
    return rows, bad.unionByName(worse)


def metrics(bodies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of data points of gauges, sums and histograms, and what could not be read. A histogram's value is its mean."""
    good, bad = _read(bodies, METRICS, "resourceMetrics")
    each = good.select(F.explode("x.resourceMetrics").alias("r")).select(F.col("r.resource.attributes").alias("ra"), F.explode("r.scopeMetrics").alias("s")).select("ra", F.explode("s.metrics").alias("m"))
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"m.{k}").alias("d")) for k in ("gauge", "sum", "histogram")])
    typed = each.select("ra", "m.name", "m.unit", F.explode(F.filter(kinds, lambda k: k["d"].isNotNull())).alias("k"))
    points = typed.select("ra", "name", "unit", "k.kind", "k.d.aggregationTemporality", "k.d.isMonotonic", F.explode("k.d.dataPoints").alias("p"))
    at, count = _nanos(F.col("p.timeUnixNano")), F.col("p.count").try_cast("long")
    value = F.when(F.col("kind") == "histogram", F.try_divide(F.col("p.sum"), count)).otherwise(F.coalesce("p.asDouble", F.col("p.asInt").try_cast("double")))
    reason = F.when(F.coalesce("name", F.lit("")) == "", "metric without name").when(at.isNull(), "point without time").when(value.isNull() & (F.col("kind") != "histogram"), "point without value")
    ok, worse = _side(points, reason)
    resource = attributes(F.col("ra"))
    rows = ok.select(
        F.col("name").alias("metric_name"), F.col("kind").alias("metric_type"), F.coalesce("unit", F.lit("")).alias("unit"), _time(at).alias("timestamp"), value.alias("value"),
        F.coalesce(count, F.lit(0)).alias("count"), F.coalesce("p.sum", F.lit(0.0)).alias("sum"), F.coalesce(F.col("p.bucketCounts").cast("array<bigint>"), F.array().cast("array<bigint>")).alias("bucket_counts"),
        F.coalesce("p.explicitBounds", F.array().cast("array<double>")).alias("explicit_bounds"), attributes(F.col("p.attributes")).alias("attributes"), resource.alias("resource_attributes"),
        F.coalesce(resource["service.name"], F.lit("")).alias("service_name"), F.coalesce(_named(F.col("aggregationTemporality"), {"1": "DELTA", "2": "CUMULATIVE"}), F.lit("")).alias("aggregation_temporality"), F.coalesce("isMonotonic", F.lit(False)).alias("is_monotonic"),
    )
    return rows, bad.unionByName(worse)


def events(bodies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of events of a collector's bodies (one object, or one a line): timestamp, host, source, source_type, message
    (a text, or JSON), fields; and what could not be read. Times are seconds of the epoch; without one the row has none."""
    lines = bodies.select(F.explode(F.split(F.coalesce("value", F.lit("")), r"\r?\n")).alias("value")).filter(F.trim("value") != "")
    each = lines.select("value", F.from_json("value", f"{HEC}, _bad STRING", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("x"))
    seconds = F.col("x.time").try_cast("decimal(20,6)")
    reason = (
        F.when(F.col("x").isNull() | F.col("x._bad").isNotNull(), "not JSON of this shape")
        .when(F.coalesce(F.trim("x.event"), F.lit("")) == "", "no event")
        .when(F.col("x.time").isNotNull() & seconds.isNull(), "time is no number")
    )
    ok = each.withColumn("reason", reason)
    empty = bodies.filter(F.coalesce(F.trim("value"), F.lit("")) == "").select("value", F.lit("empty").alias("reason"))
    rows = ok.filter("reason IS NULL").select(
        F.timestamp_micros((seconds * 1000000).cast("long")).alias("timestamp"), F.col("x.host").alias("host"), F.col("x.source").alias("source"), F.coalesce("x.sourcetype", F.lit("unknown")).alias("source_type"),
        F.col("x.event").alias("message"), F.coalesce("x.fields", F.create_map().cast("map<string,string>")).alias("fields"),
    )
    return rows, ok.filter("reason IS NOT NULL").select("value", "reason").unionByName(empty)


KNOWN: dict[str, Callable[[DataFrame], tuple[DataFrame, DataFrame]]] = {"spans": spans, "metrics": metrics, "events": events}


def ledgers(spark, path: str, kind: str, enrich: Callable[[DataFrame], DataFrame] = lambda df: df) -> tuple[Ledger, Ledger]:
    """The ledgers of the rows of a kind and of what could not be read, under path."""
    rows, bad = KNOWN[kind](spark.createDataFrame([], "value string"))
    return Ledger(spark, f"{path}/{kind}", enrich(rows).schema), Ledger(spark, f"{path}/{kind}_bad", bad.schema)


def stream(bodies: DataFrame, kind: str, path: str, checkpoint: str, enrich: Callable[[DataFrame], DataFrame] = lambda df: df):
    """Starts a query that adds the rows of bodies (value) to the ledgers under path, enriched as they come in."""
    good, bad = ledgers(bodies.sparkSession, path, kind, enrich)

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            rows, rest = KNOWN[kind](batch.select("value"))
            good.append(enrich(rows), number)
            bad.append(rest, number)
        finally:
            batch.unpersist()

    return bodies.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
