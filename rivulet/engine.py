"""Engine: text of a query to a DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rivulet.operators import aggregate, joins, rows, sessions, sets, views
from rivulet.plans import profile as profiles
from rivulet.plans import times
from rivulet.plans.ast import Ioc, Query, Stage
from rivulet.plans.errors import QueryError
from rivulet.plans.expressions import folded
from rivulet.plans.parser import parse
from rivulet.plans.profile import Profile
from rivulet.plans.state import State

STAGES: dict[str, Callable[[State, dict], State]] = rows.STAGES | aggregate.STAGES | sets.STAGES | joins.STAGES | sessions.STAGES | views.STAGES
#: Stages behind a stats or chart that make the automatic sort needless, and aggregates that give nothing to sort by.
ORDERING = ("sort", "top", "rare")
UNORDERED = ("values", "list", "first", "last", "earliest", "latest", "mode", "sparkline")
#: Stages that look at a row alone.
ROW_LOCAL = ("where", "search", "regex", "eval", "rename", "table", "fields", "fillnull", "rex", "extract", "spath", "lookup", "risk")
#: An indicator list of more values is refused.
IOC_CAP = 50_000


class Engine:
    """datasets: name to (frame or factory, profile); `logs` is the default. lookups: name to frame or factory. sinks:
    name to a function of a frame. ai: a function of a frame and a prompt. folders: where files may be looked up.
    rollups: dataset of metrics to its rollups, name (1m, 1h) to frame or factory of partial rows; of spans to its own by
    service and minute, named red; other datasets to a Summary with its table. first_seen: name of a profile to its ledger of first sightings, which baselines read.
    trace_index: frame or factory of trace_id, start, end, from which a trace's place in time is read. split_keys: whether
    running aggregates by key split keys of many rows over tasks, at the cost of two more passes over their columns."""

    def __init__(self, spark: SparkSession, datasets: dict | None = None, lookups: dict | None = None, sinks: dict | None = None, ai: Callable | None = None, folders: tuple[str, ...] = (), default: str = "logs", now: datetime | None = None, rollups: dict | None = None, first_seen: dict | None = None, trace_index=None, split_keys: bool = False):
        self.spark, self.datasets, self.lookups, self.sinks = spark, dict(datasets or {}), dict(lookups or {}), dict(sinks or {})
        self.ai, self.folders, self.default, self.now = ai, folders, default, now
        self.rollups, self.first_seen, self.trace_index = dict(rollups or {}), dict(first_seen or {}), trace_index
        self.split_keys = split_keys
        self._small: dict[str, bool] = {}
        self._ranges: dict = {}

    # -- queries ----------------------------------------------------------------------------------------------
    def run(self, text: str, start: datetime | None = None, end: datetime | None = None) -> DataFrame:
        """The rows of a query over [start, end), in its order. Only what the query names is planned; nothing runs but
        look-ups of sizes and of the range of times where a stage needs them."""
        q = auto_sorted(parse(text))
        st = self.compile(q, None, start, end)
        out = st.ordered()
        return out.select([F.col(f"`{c}`") for c in out.columns if not c.startswith("__")])

    def histogram(self, text: str, start: datetime, end: datetime, buckets: int = 100) -> DataFrame:
        """Counts over time of the events that a query's search and first row-local filters let through."""
        q = parse(text)
        keep = []
        for s in q.stages:
            if s.name not in ("where", "search", "regex"):
                break
            keep.append(s)
        st = self.compile(Query(q.search, keep, q.dataset, q.earliest, q.latest), None, start, end)
        span = times.ladder_span(*self.time_range(st), buckets)
        return st.df.groupBy(times.bucket(F.col(f"`{st.time}`"), span).alias("time_bucket")).agg(F.count("*").alias("count")).orderBy("time_bucket")

    def page(self, text: str, start: datetime | None, end: datetime | None, offset: int, limit: int) -> DataFrame:
        """Rows offset to offset + limit of a query's result; limits within the query stay what they are."""
        return self.run(text, start, end).offset(offset).limit(limit)

    def total(self, text: str, start: datetime | None = None, end: datetime | None = None) -> int:
        """Rows of a query's whole result, which pages are parts of."""
        return self.run(text, start, end).count()

    def days(self, text: str, start: datetime, end: datetime):
        """The result of a row-local query, day by day, the newest first: pairs of a day's start and its rows. Whoever
        has enough of them stops, and the days before are never read."""
        q = parse(text)
        if bad := next((s.name for s in q.stages if s.name not in ROW_LOCAL), None):
            raise QueryError(f"{bad} needs all rows, and can't be given day by day")
        at = times.resolve(q.latest, self.now or datetime.now(timezone.utc).replace(tzinfo=None)) if q.latest else end
        first = times.resolve(q.earliest, self.now or datetime.now(timezone.utc).replace(tzinfo=None)) if q.earliest else start
        plain = Query(q.search, q.stages, q.dataset, None, None)
        while at > first:
            day = max(first, times.snap(at - timedelta(microseconds=1), "d"))
            out = self.compile(plain, None, day, at).ordered()
            yield day, out.select([F.col(f"`{c}`") for c in out.columns if not c.startswith("__")])
            at = day

    def compile(self, q: Query, outer: State | None = None, start: datetime | None = None, end: datetime | None = None) -> State:
        now = self.now or (outer.now if outer else datetime.now(timezone.utc).replace(tzinfo=None))
        start = times.resolve(q.earliest, now) if q.earliest else start or (outer.start if outer else None)
        end = times.resolve(q.latest, now) if q.latest else end or (outer.end if outer else None)
        first = q.stages[0] if q.stages else None
        if first and first.name == "inputlookup" and q.search is None and not first.get("key"):
            st = State(self.spark.range(0), Profile("lookup", "_time"), self, start, end, now, None)
            st = joins.inputlookup(st, first.args)
            return self.stages(st, q.stages[1:])
        st = self.rollup(q, start, end, now) or self.scan(q.dataset or self.default, start, end, now)
        return self.stages(rows.filtered(st, q.search, search=True), q.stages)

    def rollup(self, q: Query, start, end, now) -> State | None:
        """Partial rows for a query over a long range that they answer: those of the whole buckets in it, and for the
        parts of buckets at its edges partial rows made of the raw ones. So the range is the same as without them."""
        name = q.dataset or self.default
        levels = self.rollups.get(name)
        if not levels or not (start and end):
            return None
        from rivulet.streaming import rollups, summaries

        if isinstance(levels, summaries.Summary):
            width, make, profile = levels.width, levels.partials, levels.profile(self.datasets[name][1])
            if not levels.answers(q, self.datasets[name][1]):
                return None
            table = levels.table
        elif "red" in levels:
            if not rollups.asks_services(q):
                return None
            width, table, make, profile = 60, levels["red"], rollups.red_partials, rollups.RED
        else:
            level = rollups.routed(q, (end - start).total_seconds())
            if level not in levels:
                return None
            width, table = rollups.WIDTHS[level], levels[level]
            make, profile = lambda df: rollups.metric_partials(df, width), rollups.PARTIALS
        if not (whole := rollups.inner(start, end, width)):
            return None
        df = table() if callable(table) else table
        df = df.filter((F.col("bucket") >= F.lit(whole[0])) & (F.col("bucket") < F.lit(whole[1])))
        for a, b in ((start, whole[0]), (whole[1], end)):
            if a < b:
                df = df.unionByName(make(self.scan(name, a, b, now).df), allowMissingColumns=True)
        if profile is rollups.PARTIALS and rollups.asks_rate(q) and ("value_rise" not in df.columns or rollups.mixed(df)):
            return None
        return State(df, profile, self, start, end, now, None)

    def scan(self, name: str, start, end, now) -> State:
        if name not in self.datasets:
            raise QueryError(f"there is no dataset {name!r}")
        df, profile = self.datasets[name]
        df = df() if callable(df) else df
        kinds = {f.name: f.dataType for f in df.schema}
        if profile.time in kinds and name != "risk":  # risk looks back by itself
            df = self.within(df, profile, start, end)
        plain = [n for n, k in kinds.items() if isinstance(k, T.TimestampNTZType)]
        if plain:  # the session is in UTC
            df = df.withColumns({n: F.col(f"`{n}`").cast("timestamp") for n in plain})
        order = ((profile.time, True),) if profile.time in df.columns else None
        return State(df, profile, self, start, end, now, order)

    def within(self, df: DataFrame, profile: Profile, start, end) -> DataFrame:
        """The rows of [start, end): by the column as it is stored, so that the scan can skip by it, and by days where
        the dataset is partitioned by them."""
        kinds = {f.name: f.dataType for f in df.schema}
        t, at = F.col(f"`{profile.time}`"), lambda x: F.lit(x).cast(kinds[profile.time])
        day = F.col(f"`{profile.day}`").cast("date") if profile.day in kinds else None
        if start:
            df = df.filter(t >= at(start))
            df = df.filter(day >= F.lit(start.date())) if day is not None else df
        if end:
            df = df.filter(t < at(end))
            df = df.filter(day <= F.lit(end.date())) if day is not None else df
        return df

    def stages(self, st: State, stages: list[Stage]) -> State:
        for s in stages:
            if s.name == "risk" and st.profile.name == "risk":
                raise QueryError("risk over the risk dataset would feed on itself")
            st = STAGES[s.name](st, s.args)
        return st

    # -- what stages ask for ----------------------------------------------------------------------------------
    def source(self, st: State) -> DataFrame:
        """The whole dataset of a state, without its range of times."""
        name = next(n for n, v in self.datasets.items() if v[1].name == st.profile.name)
        return self.scan(name, None, None, st.now).df

    def time_range(self, st: State) -> tuple[datetime, datetime]:
        """The query's range, or that of its rows."""
        if st.start and st.end:
            return st.start, st.end - timedelta(microseconds=1)
        if not st.time:
            raise QueryError("a range of times is needed")
        t = F.col(f"`{st.time}`")
        r = st.df.agg(F.min(t).alias("a"), F.max(t).alias("b")).first()
        zero = datetime(1970, 1, 1)
        return st.start or r["a"] or zero, (st.end - timedelta(microseconds=1) if st.end else None) or r["b"] or zero

    def lookup(self, name: str) -> DataFrame:
        if name not in self.lookups:
            raise QueryError(f"there is no lookup {name!r}")
        t = self.lookups[name]
        return t() if callable(t) else t

    def lookup_is_small(self, name: str, rows: int) -> bool:
        """Whether a lookup has at most so many rows, counted once."""
        if name not in self._small:
            self._small[name] = self.lookup(name).limit(rows + 1).count() <= rows
        return self._small[name]

    def ioc_values(self, x: Ioc) -> list[str]:
        t = self.lookup(x.name if x.source == "lookup" else f"{x.source}:{x.name}")
        column = x.column or t.columns[0]
        some = t.select(F.col(f"`{column}`").alias("v")).filter("v is not null").distinct().limit(IOC_CAP + 1).collect()
        if len(some) > IOC_CAP:
            raise QueryError(f"{x.name} has more than {IOC_CAP} values; use a lookup or a subsearch")
        return [folded(str(r[0])) for r in some]

    def fetch(self, url: str, kind: str | None, max_rows: int) -> DataFrame:
        from rivulet.sources.files import fetch

        return fetch(self.spark, url, kind, max_rows, self.folders)

    def sink(self, name: str, df: DataFrame) -> None:
        if name not in self.sinks:
            raise QueryError(f"there is no destination {name!r}")
        self.sinks[name](df)

    def identities(self) -> DataFrame:
        return self.lookup("identities")

    def prevalence(self, st: State, field: str, seconds: float) -> DataFrame:
        """A table of rarity registered as lookup `prevalence_<field>`, else one made of the dataset."""
        if (name := f"prevalence_{field}") in self.lookups:
            return self.lookup(name)
        df = self.source(st)
        end = st.end or st.now
        host = next((c for c in ("src_host", "host", "user", "user_id") if c in df.columns), None)
        if host is None:
            raise QueryError("rarity needs a host or a user")
        t = F.col(f"`{st.profile.time}`")
        if st.end:
            df = df.filter((t < F.lit(end)) & (t >= F.lit(end - timedelta(seconds=seconds))))
        return joins.summary(df, field, host, st.profile.time)

    def cut(self, df: DataFrame) -> DataFrame:
        """df with its lineage cut, by a reliable checkpoint where the session has a folder for it."""
        if self.spark.conf.get("spark.checkpoint.dir", None) or self.spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
            return df.checkpoint()
        return df


def auto_sorted(q: Query) -> Query:
    """The last grouped stats or chart is sorted by its count, or else its first aggregate with an order, unless a stage
    behind it sorts. So `head` behind it takes the largest groups."""
    from rivulet.functions.aggregates import names

    for i in range(len(q.stages) - 1, -1, -1):
        s = q.stages[i]
        if s.name in ORDERING:
            return q
        if s.name in ("stats", "chart") and (keys := s.get("by", []) + s.get("over", [])):
            cols = list(zip(names(s.args["aggs"]), s.args["aggs"]))
            lead = next((c for c, a in cols if a.func == "count" and a.arg is None), None) or next((c for c, a in cols if a.func not in UNORDERED), None)
            if lead:
                q.stages.insert(i + 1, Stage("sort", {"n": None, "keys": [(lead, True), *[(k, False) for k in keys]]}))
            return q
    return q


def events_engine(spark: SparkSession, sf_dir: str, **more) -> Engine:
    """The driver's tables as datasets and lookups."""
    read = lambda name: lambda: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    P = Profile
    datasets = {
        "logs": (read("events"), profiles.EVENTS),
        "orders": (read("orders"), P("orders", "o_orderdate", ("o_orderpriority", "o_orderstatus"))),
        "lineitem": (read("lineitem"), P("lineitem", "l_shipdate", ("l_returnflag", "l_linestatus"))),
        "documents": (read("documents"), P("documents", "_time", ("text",))),
        "pages": (read("pages"), P("pages", "_time", ("url", "html"))),
        "conversations": (lambda: conversations(spark, sf_dir), P("conversations", "at", ("text",))),
    }
    lookups = {t: read(t) for t in ("customer", "supplier", "nation", "region", "part", "labels")}
    return Engine(spark, datasets | more.pop("datasets", {}), lookups | more.pop("lookups", {}), **more)


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as events: a turn a minute from the epoch."""
    df = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return df.withColumn("at", F.timestamp_seconds(F.col("turn") * 60))
