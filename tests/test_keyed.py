"""Sessions and cooldowns of streams against batches, in any split into micro-batches and with restarts between them."""

import random
from datetime import datetime, timedelta

import pytest

from rivulet.engine import Engine
from rivulet.plans.errors import UnsupportedQuery
from rivulet.plans.profile import LOGS
from rivulet.streaming import keyed

T0 = datetime(2026, 10, 1)
EVENTS = "timestamp timestamp, user string, action string, message string"


def drive(spark, tmp_path, schema, batches, make, restart=True):
    """Rows of make(stream) once each of the batches has come; the query is stopped and started between them."""
    src, out, cp = (str(tmp_path / n) for n in ("in", "out", "cp"))
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        if restart or i == len(batches) - 1:
            stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
            made = make(stream)
            made.writeStream.format("parquet").option("path", out).option("checkpointLocation", cp).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out)


def events(rng, n=200):
    """Events of some users, one of whom has most; pauses of every kind."""
    rows, at = [], 0.0
    for _ in range(n):
        at += rng.choice((1, 30, 299, 300, 301, 700)) + rng.random()
        rows.append((T0 + timedelta(seconds=at), rng.choice(("hot", "hot", "hot", "a", "b", None)), rng.choice(("ok", "fail")), "m"))
    return rows


def plain(rows, pause):
    by = {}
    for t, user, *_ in sorted(rows, key=lambda r: r[0]):
        found = by.setdefault(user, [])
        if found and t - found[-1][1] <= timedelta(seconds=pause):
            found[-1] = [found[-1][0], t, found[-1][2] + 1]
        else:
            found.append([t, t, 1])
    return {(u, s, e, n) for u, found in by.items() for s, e, n in found}


@pytest.mark.parametrize("seed", [1, 2])
def test_sessions_are_those_of_the_batch(spark, tmp_path, seed):
    rng = random.Random(seed)
    rows = events(rng)
    parts = [[], [], []]
    for r in rows:
        parts[rng.randrange(3)].append(r)  # rows of all times in each batch, so that late ones join open sessions
    parts.append([(T0 + timedelta(days=90), "end", "ok", "m")])
    got = drive(spark, tmp_path, EVENTS, parts, lambda s: keyed.sessions(s, ["user"], "timestamp", 300, "10 days"))
    found = {(r.user, r.transaction_start, r.transaction_end, r.eventcount) for r in got.collect()}
    assert found == plain(rows, 300)
    batch = Engine(spark, {"logs": (spark.createDataFrame(rows, EVENTS), LOGS)}).run("* | transaction user maxpause=5m")
    assert {(r.user, r.duration, r.eventcount) for r in got.collect()} == {(r.user, r.duration, r.eventcount) for r in batch.collect()}


def test_a_late_row_joins_two_open_sessions(spark, tmp_path):
    at = lambda m: (T0 + timedelta(minutes=m), "u", "ok", "m")
    parts = [[at(0), at(8)], [at(4)], [(T0 + timedelta(days=1), "end", "ok", "m")]]
    got = drive(spark, tmp_path, EVENTS, parts, lambda s: keyed.sessions(s, ["user"], "timestamp", 300, "1 hour"))
    assert [(r.user, r.duration, r.eventcount) for r in got.collect()] == [("u", 480.0, 3)]


def test_streamed_query(spark, tmp_path):
    rows = events(random.Random(3), 60)
    text = "action=fail | eval who=upper(user) | transaction who maxpause=5m"
    engine = Engine(spark)
    parts = [rows[::2], rows[1::2], [(T0 + timedelta(days=90), "end", "fail", "m")]]
    got = drive(spark, tmp_path, EVENTS, parts, lambda s: keyed.streamed(engine, text, s, LOGS, "10 days"), restart=False)
    want = Engine(spark, {"logs": (spark.createDataFrame(rows, EVENTS), LOGS)}).run(text)
    assert {(r.who, r.transaction_start, r.eventcount) for r in got.collect()} == {(r.who, r.transaction_start, r.eventcount) for r in want.collect()}
    stream = spark.readStream.schema(EVENTS).parquet(str(tmp_path / "in"))
    for bad in ("* | transaction user maxspan=5m", "* | transaction user maxpause=5m maxevents=3", "* | stats count | transaction user maxpause=1m"):
        with pytest.raises(UnsupportedQuery):
            keyed.streamed(engine, bad, stream, LOGS)


FINDINGS = "rule string, entity string, score int, timestamp timestamp"


def test_cooldown_survives_restarts(spark, tmp_path):
    at = lambda m, e="u", score=10: ("r", e, score, T0 + timedelta(minutes=m))
    parts = [
        [at(0), at(10), at(59), at(5, "v")],
        [at(30), at(59.9)],  # within the hour, in another run of the query
        [at(60), at(61), at(0, "w", 5), at(0, "w", 9)],
        [at(119), at(121), at(20), at(64, "v"), at(66, "v")],
    ]
    got = drive(spark, tmp_path, FINDINGS, parts, lambda s: keyed.cooled(s, 3600, "1 day"))
    found = sorted((r.entity, (r.timestamp - T0).total_seconds() / 60, r.score) for r in got.collect())
    assert found == [("u", 0, 10), ("u", 60, 10), ("u", 121, 10), ("v", 5, 10), ("v", 66, 10), ("w", 0, 9)]


def test_cooldown_of_late_findings(spark, tmp_path):
    """A late finding alerts only if it is cooldown away from the alerts on both sides; old state is forgotten."""
    at = lambda m: ("r", "u", 10, T0 + timedelta(minutes=m))
    got = drive(spark, tmp_path, FINDINGS, [[at(300)], [at(250), at(200)], [at(2000)], [at(2030), at(2061)]], lambda s: keyed.cooled(s, 3600, "10 hours"))
    assert sorted((r.timestamp - T0).total_seconds() / 60 for r in got.collect()) == [200, 300, 2000, 2061]
