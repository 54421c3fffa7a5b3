"""Operators with state by key over a stream: sessions that late rows may join, and a cooldown of alerts.

State is in Spark's state store under the query's checkpoint, so that a query that is started again goes on where it was
stopped. Times of events decide, not those of arrival: how rows are dealt to micro-batches changes no result, as long
as no row is later than `late`. Later rows are dropped by the watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from rivulet.engine import Engine
from rivulet.operators.rows import q
from rivulet.plans import times
from rivulet.plans.ast import Query
from rivulet.plans.errors import UnsupportedQuery
from rivulet.plans.parser import parse
from rivulet.plans.profile import Profile

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def prepare(spark: SparkSession) -> None:
    """State by key with timers needs RocksDB as the store."""
    if "RocksDB" not in spark.conf.get(_PROVIDER, ""):
        spark.conf.set(_PROVIDER, _ROCKS)


def merged(pieces: list[tuple[int, int, int]], pause: int) -> list[tuple[int, int, int]]:
    """Start, end and number of events of sessions, joined where no more than pause lies between them."""
    out: list[tuple[int, int, int]] = []
    for start, end, n in sorted(pieces):
        if out and start - out[-1][1] <= pause:
            out[-1] = (out[-1][0], max(out[-1][1], end), out[-1][2] + n)
        else:
            out.append((start, end, n))
    return out


def _timer(micros: int) -> int:
    """Milliseconds of a timer that goes off once the watermark is beyond micros."""
    return micros // 1000 + 1


class _Sessions(StatefulProcessor):
    def __init__(self, pause: int, names: list[str]):
        self.pause, self.names = pause, names

    def init(self, handle):
        self.handle = handle
        self.open = handle.getListState("open", "start bigint, end bigint, n bigint")

    def _keep(self, sessions):
        for t in self.handle.listTimers():
            self.handle.deleteTimer(t)
        if sessions:
            self.open.put(sessions)
            self.handle.registerTimer(_timer(min(e for _, e, _ in sessions) + self.pause))
        else:
            self.open.clear()

    def _held(self):
        return [tuple(r) for r in self.open.get()] if self.open.exists() else []

    def handleInputRows(self, key, rows, timerValues):
        new = [(r["__start"], r["__end"], r["__n"]) for r in rows]
        self._keep(merged(self._held() + new, self.pause))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        from pyspark.sql import Row

        now = timerValues.getCurrentWatermarkInMs() * 1000
        held = self._held()
        done = [s for s in held if s[1] + self.pause < now]
        self._keep([s for s in held if s[1] + self.pause >= now])
        for start, end, n in done:
            yield Row(**dict(zip(self.names, (*key, start, end, n))))

    def close(self):
        pass


def pieces(df: DataFrame, keys: list[str], time: str, pause: int) -> DataFrame:
    """keys, __at, __start, __end, __n: the events of each part of a task joined to pieces of sessions, so that a key of many
    events is few rows before it is dealt."""
    schema = T.StructType([*[df.schema[k] for k in keys], T.StructField("__start", T.LongType()), T.StructField("__end", T.LongType()), T.StructField("__n", T.LongType())])

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for batch in batches:
            by: dict = {}
            for *key, at in zip(*[c.to_pylist() for c in batch.columns]):
                if at is not None:
                    by.setdefault(tuple(key), []).append((at, at, 1))
            rows = [(*key, *s) for key, all_ in by.items() for s in merged(all_, pause)]
            yield pa.RecordBatch.from_pylist([dict(zip(arrow.names, r)) for r in rows], schema=arrow)

    made = df.select(*[q(k) for k in keys], F.unix_micros(q(time)).alias("__t")).mapInArrow(run, schema)
    return made.withColumn("__at", F.timestamp_micros("__end"))


def sessions(stream: DataFrame, keys: list[str], time: str, pause: float, late: str = "1 hour") -> DataFrame:
    """keys, duration, eventcount, transaction_start, transaction_end of the sessions of a stream of events: those of
    `transaction keys maxpause=pause`. A session comes out once the watermark, the newest event less late, is more than
    pause behind its last event. Rows without a time are in no session; null keys are keys."""
    prepare(stream.sparkSession)
    micros = int(pause * 1e6)
    parts = pieces(stream, keys, time, micros).withWatermark("__at", late)
    schema = T.StructType([*[stream.schema[k] for k in keys], *[T.StructField(n, T.LongType()) for n in ("__start", "__end", "__n")]])
    found = parts.groupBy(*[q(k) for k in keys]).transformWithState(_Sessions(micros, schema.names), schema, "Append", "EventTime")
    return found.select(
        *[q(k) for k in keys], ((F.col("__end") - F.col("__start")) / 1e6).alias("duration"), F.col("__n").alias("eventcount"),
        F.timestamp_micros("__start").alias("transaction_start"), F.timestamp_micros("__end").alias("transaction_end"),
    )


def streamed(engine: Engine, text: str, stream: DataFrame, profile: Profile, late: str = "1 hour") -> DataFrame:
    """A query over a stream: row-local stages, and behind them `transaction` with keys and maxpause alone."""
    from rivulet.streaming.rules import ROW_LOCAL

    parsed = parse(text)
    last = parsed.stages[-1] if parsed.stages and parsed.stages[-1].name == "transaction" else None
    local = parsed.stages[:-1] if last else parsed.stages
    if bad := next((s.name for s in local if s.name not in ROW_LOCAL), None):
        raise UnsupportedQuery(f"a query of a stream can't have {bad}")
    inner = Engine(engine.spark, {"stream": (stream, profile)}, lookups=engine.lookups, default="stream", now=engine.now)
    st = inner.compile(Query(parsed.search, local, parsed.dataset, parsed.earliest, parsed.latest))
    if not last:
        return st.df
    if extra := [k for k in ("maxspan", "maxevents", "startswith", "endswith") if last.get(k)]:
        raise UnsupportedQuery(f"transactions of a stream can't have {extra[0]}")
    if not last.get("maxpause") or not last.args["by"]:
        raise UnsupportedQuery("transactions of a stream need keys and maxpause")
    scope, keys = st.scope(), last.args["by"]
    df = st.df.select(*[scope.column(k).col.alias(k) for k in keys], q(st.time).alias("__time"))
    return sessions(df, keys, "__time", times.seconds(last.args["maxpause"]), late)


class _Cooldown(StatefulProcessor):
    """Alerts of the last while: no other comes less than cooldown from one of them, before or behind it."""

    def __init__(self, cooldown: int):
        self.cooldown = cooldown

    def init(self, handle):
        self.handle = handle
        self.alerts = handle.getListState("alerts", "at bigint")

    def handleInputRows(self, key, rows, timerValues):
        from pyspark.sql import Row

        held = [r[0] for r in self.alerts.get()] if self.alerts.exists() else []
        new = []
        for r in sorted(((r["__t"], -(r["score"] or 0), r["score"]) for r in rows), key=lambda r: r[:2]):
            if all(abs(r[0] - at) >= self.cooldown for at in held):
                held.append(r[0])
                new.append(r)
        if new:
            # One timer for the newest alert: what is older goes with it, or when another one comes.
            past = timerValues.getCurrentWatermarkInMs() * 1000 - self.cooldown
            held = [at for at in held if at > past] or held[-1:]
            self.alerts.put([(at,) for at in held])
            for t in self.handle.listTimers():
                self.handle.deleteTimer(t)
            self.handle.registerTimer(_timer(max(held) + self.cooldown))
        for at, _, score in new:
            yield Row(rule=key[0], entity=key[1], score=score, __t=at)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.alerts.clear()
        return iter(())

    def close(self):
        pass


def cooled(findings: DataFrame, cooldown: float, late: str = "1 hour") -> DataFrame:
    """rule, entity, score, timestamp of the alerts of a stream of findings: of a rule and entity the first one, by the
    time of its event, and later ones at least cooldown seconds from every other alert. The highest score of an instant
    counts. What has alerted is kept with the query's checkpoint, and forgotten once no finding can be affected."""
    prepare(findings.sparkSession)
    rows = findings.withWatermark("timestamp", late).withColumn("__t", F.unix_micros("timestamp"))
    schema = "rule string, entity string, score int, __t bigint"
    out = rows.groupBy("rule", "entity").transformWithState(_Cooldown(int(cooldown * 1e6)), schema, "Append", "EventTime")
    return out.select("rule", "entity", "score", F.timestamp_micros("__t").alias("timestamp"))
