"""What collectors send, as rows: nested arrays, attributes of all kinds, bad entries to the side, batches once."""

import json
from datetime import datetime

from rivulet.engine import Engine
from rivulet.plans.profile import METRICS, SPANS
from rivulet.sources import ingest


def kv(**values):
    return [{"key": k.replace("__", "."), "value": v} for k, v in values.items()]


TRACES = {
    "resourceSpans": [
        {
            "resource": {"attributes": kv(service__name={"stringValue": "shop"}, pid={"intValue": "7"})},
            "scopeSpans": [
                {"spans": [
                    {"traceId": "ABCD", "spanId": "01", "name": "get", "kind": 2, "startTimeUnixNano": "1700000000000000500", "endTimeUnixNano": "1700000000250000500", "attributes": kv(ok={"boolValue": True}, n={"doubleValue": 1.5}, a={"arrayValue": {"values": [{"stringValue": "x"}]}}, none={}), "status": {"code": 2, "message": "boom"}},
                    {"traceId": "abcd", "spanId": "02", "parentSpanId": "01", "name": "db", "kind": "SPAN_KIND_CLIENT", "startTimeUnixNano": "1700000000100000000", "endTimeUnixNano": "1700000000000000000", "status": {"code": "STATUS_CODE_OK"}},
                ]},
                {"spans": [{"traceId": "", "spanId": "03", "startTimeUnixNano": "1"}, {"traceId": "ef", "spanId": "04", "startTimeUnixNano": "soon"}, {"traceId": "ef", "spanId": "05", "startTimeUnixNano": "0", "attributes": kv(k={"stringValue": "1"}) + kv(k={"stringValue": "2"})}]},
            ],
        },
        {"scopeSpans": None},
        {"resource": None, "scopeSpans": [{"spans": [{"traceId": "99", "spanId": "06", "startTimeUnixNano": "1700000000000000000"}]}]},
    ]
}


def frame(spark, *bodies):
    return spark.createDataFrame([(b if b is None or isinstance(b, str) else json.dumps(b),) for b in bodies], "value string")


def test_spans(spark):
    rows, bad = ingest.spans(frame(spark, TRACES, "{broken", "", None, '{"other": 1}', "[1]", {"resourceSpans": []}))
    got = {r.span_id: r for r in rows.collect()}
    assert set(got) == {"01", "02", "05", "06"}
    a, b = got["01"], got["02"]
    assert (a.trace_id, a.service_name, a.span_name, a.span_kind, a.status_code, a.status_message, a.duration_ns, a.parent_span_id) == ("abcd", "shop", "get", "SERVER", "ERROR", "boom", 250_000_000, "")
    assert a.start_time == datetime(2023, 11, 14, 22, 13, 20) and a.attributes == {"ok": "true", "n": "1.5", "a": '{"values":[{"stringValue":"x"}]}'}
    assert a.resource_attributes == {"service.name": "shop", "pid": "7"}
    assert (b.duration_ns, b.end_time, b.span_kind, b.status_code, b.parent_span_id) == (0, b.start_time, "CLIENT", "OK", "01")
    assert got["05"].attributes == {"k": "2"} and got["06"].service_name == "" and got["06"].status_code == "UNSET"
    reasons = sorted(r.reason for r in bad.collect())
    assert reasons == ["empty", "empty", "no resourceSpans", "not JSON of this shape", "not JSON of this shape", "span without start", "span without trace id"]
    told = Engine(spark, {"spans": (rows, SPANS)}, default="spans").run("| services").collect()
    assert {(r.service_name, r.requests, r.errors) for r in told} == {("shop", 3, 1), ("", 1, 0)}


def test_metrics(spark):
    point = lambda t, **v: {"timeUnixNano": str(t * 10**9), **v}
    body = {"resourceMetrics": [{"resource": {"attributes": kv(service__name={"stringValue": "s"})}, "scopeMetrics": [{"metrics": [
        {"name": "temp", "unit": "C", "gauge": {"dataPoints": [point(1, asDouble=1.5, attributes=kv(room={"stringValue": "r1"})), point(2, asInt="3"), point(3), {"asDouble": 1}]}},
        {"name": "hits", "sum": {"aggregationTemporality": 2, "isMonotonic": True, "dataPoints": [point(4, asInt="10")]}},
        {"name": "lat", "histogram": {"aggregationTemporality": 1, "dataPoints": [point(5, count="4", sum=10.0, bucketCounts=["1", "2", "1"], explicitBounds=[10.0, 20.0])]}},
        {"name": "", "gauge": {"dataPoints": [point(6, asDouble=1.0)]}},
        {"name": "nothing"},
    ]}]}]}
    rows, bad = ingest.metrics(frame(spark, body, "no"))
    got = sorted((r.metric_name, r.metric_type, r.value, r.aggregation_temporality, r.is_monotonic, r.bucket_counts) for r in rows.collect())
    assert got == [("hits", "sum", 10.0, "CUMULATIVE", True, []), ("lat", "histogram", 2.5, "DELTA", False, [1, 2, 1]), ("temp", "gauge", 1.5, "", False, []), ("temp", "gauge", 3.0, "", False, [])]
    assert sorted(r.reason for r in bad.collect()) == ["metric without name", "not JSON of this shape", "point without time", "point without value"]
    told = Engine(spark, {"metrics": (rows, METRICS)}, default="metrics")
    assert told.run("lat | stats histogram_quantile(bucket_counts, 50) as q").first().q == 15.0
    assert told.run("room=r1 | stats count").first()[0] == 1


def test_events(spark):
    lines = "\n".join(json.dumps(x) for x in ({"time": 1700000000.25, "host": "h", "sourcetype": "web", "event": {"a": 1}, "fields": {"k": "v", "n": 2}}, {"time": "1700000001", "event": "plain text"}, {"event": "no time"}, {"host": "h"}, {"time": "noon", "event": "x"}))
    rows, bad = ingest.events(frame(spark, lines + "\r\n\n{oops", None, " "))
    got = sorted((str(r.timestamp), r.host, r.source_type, r.message, r.fields) for r in rows.collect())
    assert got == [("2023-11-14 22:13:20.250000", "h", "web", '{"a":1}', {"k": "v", "n": "2"}), ("2023-11-14 22:13:21", None, "unknown", "plain text", {}), ("None", None, "unknown", "no time", {})]
    assert sorted(r.reason for r in bad.collect()) == ["empty", "empty", "no event", "not JSON of this shape", "time is no number"]


def test_a_stream_adds_each_batch_once(spark, tmp_path):
    src, path = tmp_path / "in", f"file://{tmp_path}/out"
    src.mkdir()
    for i in range(3):
        (src / f"{i}.json").write_text(json.dumps(TRACES) + "\n{broken\n")
        stream = spark.readStream.option("maxFilesPerTrigger", 1).text(str(src))
        ingest.stream(stream, "spans", path, str(tmp_path / "cp")).awaitTermination()
    good, bad = ingest.ledgers(spark, path, "spans")
    assert good.read().count() == 12 and bad.read().count() == 9
    rows, rest = ingest.spans(frame(spark, TRACES, "{broken"))
    assert not good.append(rows, 2) and not bad.append(rest, 1)  # a replay of known batches
    assert good.read().count() == 12
