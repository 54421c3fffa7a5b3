"""Stages that follow the events of a key in time: transaction, sequence, funnel.

Events are dealt by key and sorted by key and time. Funnels, and transactions without maxspan, are windows over that
order. What depends on all choices before (maxspan from a first event, matches without overlap) is walked once, with
the state of one key at a time, so that a key of any size needs no more memory than another."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql import types as T

from rivulet.operators.rows import q
from rivulet.plans import times
from rivulet.plans.errors import QueryError
from rivulet.plans.state import State


def walk(df: DataFrame, keys: list[str], order: list[str], schema: T.StructType, make) -> DataFrame:
    """Rows of schema that make().row(row) and .end() of each key return. df has keys, order and what row reads."""
    n, names = len(keys), schema.names

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, current, state, out = to_arrow_schema(schema), None, None, []
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                key = row[:n]
                if key != current:
                    if state:
                        out += state.end()
                    current, state = key, make(key)
                out += state.row(row[n:])
            if len(out) >= 4096:
                yield pa.RecordBatch.from_pylist([dict(zip(arrow.names, r)) for r in out], schema=arrow)
                out = []
        if state:
            out += state.end()
        if out:
            yield pa.RecordBatch.from_pylist([dict(zip(arrow.names, r)) for r in out], schema=arrow)

    # Names without dots on the way, as those of structs are no longer told apart.
    plain = {c: f"__w{i}" for i, c in enumerate(df.columns)}
    df = df.select([q(c).alias(n) for c, n in plain.items()])
    schema = T.StructType([T.StructField(f"__o{i}", f.dataType) for i, f in enumerate(schema.fields)])
    dealt = df.repartition(*[plain[k] for k in keys]) if keys else df.coalesce(1)
    return dealt.sortWithinPartitions(*[plain[c] for c in (*keys, *order)]).mapInArrow(run, schema).toDF(*names)


def _events(st: State, keys: list[str], conditions: dict, extra: list[str]) -> tuple[DataFrame, list[str]]:
    """keys, __t (microseconds), an id for ties, the conditions as booleans, extra columns as they are."""
    if not st.time:
        raise QueryError("this stage needs the time column")
    scope = st.scope()
    id_ = next((c for c in ("id", "event_id") if c in st.df.columns), None)
    cols = [scope.column(k).col.alias(k) for k in keys]
    cols += [F.unix_micros(q(st.time)).alias("__t"), (q(id_).cast("string") if id_ else F.lit(None).cast("string")).alias("__id")]
    cols += [F.coalesce(c, F.lit(False)).alias(n) for n, c in conditions.items()]
    cols += [scope.column(e).col.alias(f"__x{i}") for i, e in enumerate(extra)]
    return st.df.select(*cols), [id_] if id_ else []


def _segments(df: DataFrame, keys: list[str], pause: int | None, most: int, starts: bool, ends: bool) -> DataFrame:
    """keys, duration, eventcount, __s, __l of transactions whose borders each event shows by itself and the one before."""
    by = [q(k) for k in keys]
    order = W.partitionBy(*by).orderBy("__t", "__id")
    border = F.lit(False)
    if pause is not None:
        border = border | F.coalesce(F.col("__t") - F.lag("__t").over(order) > pause, F.lit(False))
    if starts:
        border = border | F.col("__b")
    if ends:
        border = border | F.coalesce(F.lag("__e").over(order), F.lit(False))
    upto = order.rowsBetween(W.unboundedPreceding, 0)
    df = df.withColumn("__border", border).withColumn("__g", F.sum(F.col("__border").cast("long")).over(upto))
    groups = [*by, F.col("__g")]
    if most:
        df = df.withColumn("__n", F.row_number().over(W.partitionBy(*groups).orderBy("__t", "__id")))
        df = df.withColumn("__part", F.floor((F.col("__n") - 1) / most))
        # A full transaction is followed by another one, but where only a start opens one.
        df, groups = (df.filter("__part = 0") if starts else df), [*groups, F.col("__part")]
    out = df.groupBy(*groups).agg(
        ((F.max("__t") - F.min("__t")) / 1e6).alias("duration"), F.count("*").alias("eventcount"), F.min("__t").alias("__s"), F.max("__t").alias("__l"), F.max("__b").alias("__opened")
    )
    # Where a start opens a transaction it is a border too, so that a group has it first or not at all.
    out = out.filter("__opened") if starts else out
    return out.select(*by, "duration", "eventcount", "__s", "__l")


class _Transaction:
    def __init__(self, key, maxspan, maxevents, maxpause, starts, ends):
        self.key, self.maxspan, self.maxevents, self.maxpause, self.starts, self.ends = key, maxspan, maxevents, maxpause, starts, ends
        self.first = self.last = None
        self.n = 0

    def end(self):
        if not self.n:
            return []
        out = (*self.key, (self.last - self.first) / 1e6, self.n, self.first, self.last)
        self.n = 0
        return [out]

    def row(self, row):
        t, _, begins, closes = row[:4]
        out = []
        if self.n and (self.maxspan is not None and t - self.first > self.maxspan or self.maxpause is not None and t - self.last > self.maxpause or self.starts and begins):
            out = self.end()
        if not self.n:
            if self.starts and not begins:
                return out
            self.first = t
        self.last = t
        self.n += 1
        if self.ends and closes or self.maxevents and self.n >= self.maxevents:
            out += self.end()
        return out


def transaction(st: State, a: dict) -> State:
    """Events of the keys in time order, a new transaction where one would span more than maxspan from its first event,
    pause longer than maxpause, hold more than maxevents, start anew or has ended."""
    keys = a["by"]
    scope = st.scope()
    yes = lambda x: scope.search(x) if x is not None else F.lit(False)
    df, _ = _events(st, keys, {"__b": yes(a.get("startswith")), "__e": yes(a.get("endswith"))}, [])
    micros = lambda k: int(times.seconds(a[k]) * 1e6) if k in a else None
    span, pause, most = micros("maxspan"), micros("maxpause"), int(a.get("maxevents", 0))
    starts, ends = "startswith" in a, "endswith" in a
    fields = [df.schema[k] for k in keys] + [T.StructField("duration", T.DoubleType()), T.StructField("eventcount", T.LongType()), T.StructField("__s", T.LongType()), T.StructField("__l", T.LongType())]
    if span is pause is None and not (most or starts or ends):
        out = df.groupBy(*[q(k) for k in keys]).agg(((F.max("__t") - F.min("__t")) / 1e6).alias("duration"), F.count("*").alias("eventcount"), F.min("__t").alias("__s"), F.max("__t").alias("__l"))
    elif span is None:
        out = _segments(df, keys, pause, most, starts, ends)
    else:
        out = walk(df, keys, ["__t", "__id"], T.StructType([T.StructField(f.name, f.dataType) for f in fields]), lambda key: _Transaction(key, span, most, pause, starts, ends))
    out = out.withColumns({"transaction_start": F.timestamp_micros("__s"), "transaction_end": F.timestamp_micros("__l")}).drop("__s", "__l")
    return st.rows(out, order=(("transaction_start", True),))


class _Sequence:
    """Earliest greedy match, not overlapping: an event takes the next step if it fits; else it may start anew."""

    def __init__(self, key, steps, maxspan, maxgap, funnel=False):
        self.key, self.steps, self.maxspan, self.maxgap = key, steps, maxspan, maxgap
        self.at: list[tuple] = []
        self.count = 0

    def end(self):
        return []

    def row(self, row):
        t, id_, fits, extra = row[0], row[1], row[2 : 2 + self.steps], row[2 + self.steps :]
        if self.at and (self.maxspan is not None and t - self.at[0][0] > self.maxspan or self.maxgap is not None and t - self.at[-1][0] > self.maxgap):
            self.at = []
        if fits[len(self.at)]:
            self.at.append((t, id_, extra))
        elif len(self.at) == 1 and fits[0]:
            self.at = [(t, id_, extra)]  # a later first step leaves more time for the rest
        if len(self.at) < self.steps:
            return []
        self.count += 1
        out = [*self.key]
        for t, id_, extra in self.at:
            out += [t, id_, *extra]
        out += [(self.at[-1][0] - self.at[0][0]) / 1e6, self.count]
        self.at = []
        return [tuple(out)]


def sequence(st: State, a: dict) -> State:
    """step1_time, step1_event_id, step1_<field> …, sequence_duration_seconds, sequence_duration, sequence_count (the
    number of the match within its key)."""
    keys, n = a["by"], len(a["steps"])
    scope = st.scope()
    conditions = {f"__c{i}": scope.search(s) for i, s in enumerate(a["steps"])}
    df, _ = _events(st, keys, conditions, a["fields"])
    fits = [F.col(c) for c in conditions]
    any_fit = fits[0]
    for c in fits[1:]:
        any_fit = any_fit | c
    df = df.filter(any_fit)
    fields = [T.StructField(k, df.schema[k].dataType) for k in keys]
    for i in range(n):
        fields += [T.StructField(f"__t{i}", T.LongType()), T.StructField(f"step{i + 1}_event_id", T.StringType())]
        fields += [T.StructField(f"step{i + 1}_{f.replace('.', '_')}", df.schema[f"__x{j}"].dataType) for j, f in enumerate(a["fields"])]
    fields += [T.StructField("sequence_duration_seconds", T.DoubleType()), T.StructField("sequence_count", T.LongType())]
    micros = lambda k: int(times.seconds(a[k]) * 1e6) if k in a else None
    span, gap = micros("maxspan"), micros("maxgap")
    out = walk(df, keys, ["__t", "__id"], T.StructType(fields), lambda key: _Sequence(key, n, span, gap))
    out = out.withColumns({f"step{i + 1}_time": F.timestamp_micros(f"__t{i}") for i in range(n)}).drop(*[f"__t{i}" for i in range(n)])
    seconds = F.col("sequence_duration_seconds").cast("long")
    out = out.withColumn("sequence_duration_seconds", seconds).withColumn("sequence_duration", F.format_string("%02d:%02d:%02d", F.floor(seconds / 3600), F.floor(seconds / 60) % 60, seconds % 60))
    # The events' own names stay usable behind it: the time is that of the last step.
    out = out.withColumn(st.time, F.col(f"step{n}_time"))
    return st.rows(out, order=((st.time, True),), aliases=dict(st.profile.aliases))


#: Fields of which a funnel tells the most frequent values among those who went no further, where the dataset has them.
DROPPER_FIELDS = ("src_ip", "dest_ip", "user", "src_host", "dest_host", "url", "domain", "user_agent", "action", "enriched_src_country")
TOP_VALUES = 5


def _reached(df: DataFrame, keys: list[str], steps: int, window: int | None, fields: int = 0) -> DataFrame:
    """Of each key that reached a step: level, the longest prefix of the steps within the window from a first step, idle,
    the seconds from there to the key's last event, and __a0, __a1 …, the key's latest values of __x0, __x1 … as text.
    A step follows the latest chain that reached the step before."""
    by = [q(k) for k in keys]
    before = W.partitionBy(*by).orderBy("__t", "__id").rowsBetween(W.unboundedPreceding, -1)
    df = df.withColumn("__start0", F.when(F.col("__c0"), F.col("__t")))
    for i in range(1, steps):
        df = df.withColumn("__from", F.last(f"__start{i - 1}", ignorenulls=True).over(before))
        fits = F.col(f"__c{i}") if window is None else F.col(f"__c{i}") & (F.col("__t") - F.col("__from") <= window)
        df = df.withColumn(f"__start{i}", F.when(fits, F.col("__from")))
    firsts = [F.min(F.when(F.col(f"__start{i}").isNotNull(), F.col("__t"))).alias(f"__first{i}") for i in range(steps)]
    value = lambda i: F.col(f"__x{i}").cast("string")
    latest = [F.max_by(value(i), F.when(value(i).isNotNull(), F.struct("__t", "__id", value(i)))).alias(f"__a{i}") for i in range(fields)]
    of_key = df.groupBy(*by).agg(F.max("__t").alias("__last"), *firsts, *latest).filter("__first0 is not null")
    level, at = F.lit(1), F.col("__first0")
    for i in range(1, steps):
        level = F.when(F.col(f"__first{i}").isNotNull(), i + 1).otherwise(level)
        at = F.coalesce(f"__first{i}", at)
    return of_key.select(*by, level.alias("level"), ((F.col("__last") - at) / 1e6).alias("idle"), *[f"__a{i}" for i in range(fields)])


def _top_values(reached: DataFrame, fields: list[str]) -> DataFrame:
    """level and top: JSON of the most frequent values of each field among the keys that stopped there, with their
    number and share. All keys are counted, not a sample of them."""
    pairs = F.array(*[F.struct(F.lit(i).alias("f"), F.col(f"__a{i}").alias("value")) for i in range(len(fields))])
    counts = reached.select("level", F.explode(pairs).alias("p")).select("level", "p.*").filter("value <> ''").groupBy("level", "f", "value").agg(F.count("*").alias("count"))
    # The best of each task are picked before they meet.
    best = W.partitionBy("level", "f").orderBy(F.desc("count"), "value")
    some = counts.withColumn("__k", F.row_number().over(best)).filter(F.col("__k") <= TOP_VALUES)
    all_ = reached.groupBy("level").agg(F.count("*").alias("n"))
    some = some.join(F.broadcast(all_), "level")  # a row for each level
    name = F.get(F.array(*map(F.lit, fields)), F.col("f"))
    one = F.struct("f", "__k", F.struct(name.alias("field"), "value", "count", F.round(100 * F.col("count") / F.col("n"), 1).alias("pct")).alias("x"))
    return some.groupBy("level").agg(F.to_json(F.transform(F.array_sort(F.collect_list(one)), lambda r: r["x"])).alias("top"))


def funnel(st: State, a: dict) -> State:
    """A row for each level: how many keys reached it, how many went no further and were then idle for how long, and as
    dropper_top_attrs what these had in common: JSON of field, value, count and pct, the TOP_VALUES most frequent of each
    of DROPPER_FIELDS, by their latest event with a value."""
    keys, n = a["by"], len(a["steps"])
    scope = st.scope()
    real = lambda f: f if f in st.df.columns else st.profile.aliases.get(f, f)
    fields = [f for f in DROPPER_FIELDS if real(f) in st.df.columns and real(f) not in {real(k) for k in keys}]
    df, _ = _events(st, keys, {f"__c{i}": scope.search(s) for i, s in enumerate(a["steps"])}, fields)
    span = a.get("window") or a.get("maxspan")
    window = int(times.seconds(span) * 1e6) if span else None
    reached = _reached(df, keys, n, window, len(fields))
    ends = reached.groupBy("level").agg(F.count("*").alias("n"), F.percentile("idle", F.lit(0.5)).alias("idle"))
    names = [a["names"][i] or f"step{i + 1}" for i in range(n)]
    levels = st.df.sparkSession.createDataFrame([(i + 1, x) for i, x in enumerate(names)], "funnel_level int, step_name string")
    met = levels.join(F.broadcast(ends), F.col("level") >= F.col("funnel_level"), "left")  # at most n by n rows
    own = F.col("level") == F.col("funnel_level")
    last = F.col("funnel_level") == n
    out = met.groupBy("funnel_level", "step_name").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("count"),
        F.coalesce(F.sum(F.when(own & ~last, F.col("n"))), F.lit(0)).alias("dropper_count"),
        F.max(F.when(own & ~last, F.col("idle"))).alias("dropper_median_idle_s"),
    )
    if fields:
        tops = _top_values(reached.filter(F.col("level") < n), fields)
        out = out.join(F.broadcast(tops), F.col("level") == F.col("funnel_level"), "left").drop("level")
    out = out.withColumn("dropper_top_attrs", F.coalesce(F.col("top") if fields else F.lit(None).cast("string"), F.lit("[]"))).drop("top")
    return st.rows(out, order=(("funnel_level", False),))


STAGES = {"transaction": transaction, "sequence": sequence, "funnel": funnel}
