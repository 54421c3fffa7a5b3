"""Aggregating stages: stats, chart, timechart, top, rare, eventstats, streamstats, anomaly."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rivulet.functions import aggregates as ag
from rivulet.operators import running
from rivulet.operators.rows import q
from rivulet.plans import times
from rivulet.plans.ast import Agg, Field
from rivulet.plans.errors import QueryError
from rivulet.plans.state import State

#: Columns of the rarity enrichment that stats carries through, and how.
CARRIED = {"host_count": F.min, "is_rare": F.max, "prevalence_score": F.max, "first_seen": F.min, "last_seen": F.max, "total_occurrences": F.sum}
SERIES, MOST_SERIES, MOST_BUCKETS = 10, 100, 1440


def keyed(st: State, names: list[str]) -> tuple[State, list[str]]:
    """The keys as columns of the names asked for; an array becomes a row for each element."""
    df = st.df
    for n in names:
        t = st.to(df).scope().column(n)
        c = F.explode(t.col) if t.array else t.col
        if t.array or n not in df.columns:
            df = df.withColumn(n, c)
            st = st.to(df, created=st.created | {n})
    return st.to(df), names


def sparkline(st: State, a: Agg, by: list[str], name: str) -> DataFrame:
    """By group, the counts (or the inner aggregate of the field) in twenty buckets of the time."""
    first, last = st.engine.time_range(st)
    span = times.ladder_span(first, last, 20)
    inner = F.count(F.lit(1)) if a.arg is None else F.sum(st.scope().compile(a.arg).number())
    cells = st.df.groupBy(*[q(b) for b in by], times.bucket(q(st.time), span).alias("__t")).agg(inner.alias("__v"))
    return cells.groupBy(*[q(b) for b in by]).agg(F.transform(F.array_sort(F.collect_list(F.struct("__t", "__v"))), lambda r: r["__v"]).alias(name))


def join_groups(a: DataFrame, b: DataFrame, by: list[str]) -> DataFrame:
    if not by:
        return a.crossJoin(F.broadcast(b))  # one row each
    b = b.select(*[q(k).alias(f"__k{i}") for i, k in enumerate(by)], *[q(c) for c in b.columns if c not in by])
    on = reduce(lambda x, y: x & y, [q(k).eqNullSafe(q(f"__k{i}")) for i, k in enumerate(by)])
    return a.join(b, on, "left").drop(*[f"__k{i}" for i in range(len(by))])


def grouped(st: State, aggs: list[Agg], by: list[str], carry: bool = True) -> tuple[DataFrame, list[str], State]:
    st, by = keyed(st, by)
    names = ag.names(aggs)
    scope, time = st.scope(), st.time
    lines = [i for i, a in enumerate(aggs) if a.func == "sparkline"]
    build = st.profile.build or ag.build
    cols = [build(scope, a, time).alias(n) for i, (a, n) in enumerate(zip(aggs, names)) if i not in lines]
    if carry:
        cols += [how(q(c)).alias(c) for c, how in CARRIED.items() if c in st.df.columns and c not in by and c not in names]
    df = st.df.groupBy(*[q(b) for b in by]).agg(*cols) if cols else st.df.select(*[q(b) for b in by]).distinct()
    for i in lines:
        df = join_groups(df, sparkline(st, aggs[i], by, names[i]), by)
    return df, names, st


def stats(st: State, a: dict) -> State:
    df, names, _ = grouped(st, a["aggs"], a["by"])
    return st.rows(df, aliases=ag.reference_names(a["aggs"], names))


def chart(st: State, a: dict) -> State:
    return stats(st, {"aggs": a["aggs"], "by": a["over"] + a["by"]})


def timechart(st: State, a: dict) -> State:
    if not st.time:
        raise QueryError("timechart needs the time column")
    first, last = st.engine.time_range(st)
    if a.get("span"):
        span = times.seconds(a["span"])
    else:
        span = times.ladder_span(first, last, int(a.get("bins", 100)))
    while (last - first).total_seconds() / span > MOST_BUCKETS:
        span = next((s for s in times.LADDER if s > span), span * 2)
    df = st.df.withColumn("time_bucket", times.bucket(q(st.time), span))
    st2 = st.to(df, created=st.created | {"time_bucket"})
    by = a["by"]
    if by:
        st2, by = keyed(st2, by)
        limit = min(int(a.get("limit", SERIES)), MOST_SERIES)
        other = a.get("useother", "true").lower() != "false"
        if limit > 0:
            st2 = top_series(st2, by[0], limit, other)
    names = ag.names(a["aggs"])
    out, _, _ = grouped(st2, a["aggs"], ["time_bucket", *by], carry=False)
    if a.get("cont", "true" if not by else "false").lower() == "true" and span < times.MONTH:
        out = filled(out, names, a["aggs"], by, times.bucket_starts(first, last, span))
    order = (("time_bucket", False),)
    return st.rows(out, order=order, aliases=ag.reference_names(a["aggs"], names))


def top_series(st: State, by: str, limit: int, other: bool) -> State:
    """The series with most rows keep their names; the rest are OTHER, or go. Ranked before any bucket is made."""
    text = q(by).cast("string")
    top = st.df.groupBy(text.alias("__series")).agg(F.count("*").alias("__n")).filter("__series is not null").orderBy(F.desc("__n"), "__series").limit(limit).select("__series")
    df = st.df.join(F.broadcast(top), text == F.col("__series"), "left" if other else "left_semi")
    if other:
        df = df.withColumn(by, F.when(F.col("__series").isNotNull(), F.col("__series")).when(text.isNotNull(), "OTHER")).drop("__series")
    return st.to(df)


def filled(df: DataFrame, names: list[str], aggs: list[Agg], by: list[str], starts: list) -> DataFrame:
    """A row for every bucket (and series): counts and sums 0 where there was nothing."""
    spark = df.sparkSession
    spine = spark.createDataFrame([(t,) for t in starts], "time_bucket timestamp")  # at most MOST_BUCKETS
    if by:
        spine = spine.crossJoin(F.broadcast(df.select(*[q(b) for b in by]).distinct().limit(MOST_SERIES + 1)))
    keys = ["time_bucket", *by]
    out = join_groups(spine, df, keys)
    zero = [n for n, a in zip(names, aggs) if ag.ALIASES.get(a.func, a.func) in ag.ZERO_IN_GAPS]
    return out.withColumns({n: F.coalesce(q(n), F.lit(0)) for n in zero}) if zero else out


def top(st: State, a: dict, rare: bool = False) -> State:
    st, names = keyed(st, a["by"] + a["fields"])
    by, fields = a["by"], a["fields"]
    aggs = [F.count("*").alias("count")]
    if a.get("_bounds", "").lower() == "true" and st.time:
        aggs += [F.min(q(st.time)).alias("_first_seen"), F.max(q(st.time)).alias("_last_seen")]
    df = st.df.groupBy(*[q(n) for n in names]).agg(*aggs)
    present = reduce(lambda x, y: x & y, [q(f).isNotNull() for f in fields])
    df = df.filter(present)
    totals = df.groupBy(*[q(b) for b in by]).agg(F.sum("count").alias("__total"))
    df = join_groups(df, totals, by).withColumn("percent", F.col("count") * 100.0 / F.col("__total")).drop("__total")
    order = [F.col("count").asc() if rare else F.col("count").desc(), *[q(f).asc_nulls_first() for f in fields]]
    if by:
        df = df.withColumn("__n", F.row_number().over(W.partitionBy(*[q(b) for b in by]).orderBy(*order))).filter(F.col("__n") <= a["n"]).drop("__n")
    else:
        df = df.orderBy(*order).limit(a["n"])
    drop = [c for c, flag in (("count", "showcount"), ("percent", "showperc")) if a.get(flag, "true").lower() == "false"]
    order_by = tuple((c, d) for c, d in [("count", not rare), *[(f, False) for f in fields]] if c not in drop)
    return st.rows(df.drop(*drop), order=order_by if "count" not in drop else None)


def rare(st: State, a: dict) -> State:
    return top(st, a, rare=True)


def eventstats(st: State, a: dict) -> State:
    """Aggregates joined back to every row: an aggregation by key and a join, so that no group is held in one task."""
    df, names, st = grouped(st, a["aggs"], a["by"], carry=False)
    taken = [n for n in names if n in st.df.columns]
    out = join_groups(st.df.drop(*taken), df, a["by"])
    return st.to(out, created=st.created | set(names), aliases=st.aliases | ag.reference_names(a["aggs"], names))


def streamstats(st: State, a: dict) -> State:
    """Running aggregates in ascending time, whatever sort came before."""
    if not st.time:
        raise QueryError("streamstats needs the time column")
    st, by = keyed(st, a["by"])
    names = ag.names(a["aggs"])
    current = a.get("current", "true").lower() not in ("false", "f", "0")
    n = int(a.get("window", 0))
    last = 0 if current else -1
    first = W.unboundedPreceding if not n else last - n + 1
    ties = [q(c) for c in ("id", "event_id") if c in st.df.columns]
    order = [q(st.time).asc_nulls_first(), *ties]
    w = W.partitionBy(*[q(b) for b in by]).orderBy(*order).rowsBetween(first, last)
    scope = st.scope()

    def made(df: DataFrame, w) -> DataFrame:
        for agg, name in zip(a["aggs"], names):
            if agg.func in ("dc", "distinct_count"):
                df = df.withColumn(name, F.size(F.collect_set(ag.present(scope.compile(agg.arg))).over(w)))
            elif agg.func in ("last", "latest", "first", "earliest"):
                f = F.last if agg.func in ("last", "latest") else F.first
                df = df.withColumn(name, f(scope.compile(agg.arg).col).over(w))
            else:
                df = df.withColumn(name, over(ag.build(scope, agg, None), agg, scope, w))
        return df

    for agg in a["aggs"]:
        over_checked(agg)
    # Without keys all rows would be one task's, and with them those of a hot key.
    split = not by or st.engine.split_keys
    if split and n:
        df = running.last_rows(st.df, made, by, st.time, order, n, last)
    elif split and running.can_add(a["aggs"]):
        df = running.added(st.df, scope, a["aggs"], names, by, st.time, [q(st.time), *ties], last)
    else:
        df = made(st.df, w)
    return st.to(df, created=st.created | set(names))


def over_checked(agg: Agg) -> None:
    if agg.func in ("values", "list", "rate", "histogram_quantile", "sparkline"):
        raise QueryError(f"{agg.func} is not for streamstats")


def over(c, agg: Agg, scope, w):
    if agg.func == "range":
        x = scope.compile(agg.arg).number()
        return F.max(x).over(w) - F.min(x).over(w)
    return c.over(w)


def anomaly(st: State, a: dict) -> State:
    """Distance of a value from its group's, in standard deviations or median absolute deviations."""
    method, threshold = a.get("method", "zscore").lower(), float(a.get("threshold", 3))
    if method not in ("zscore", "mad"):
        raise QueryError("method is zscore or mad")
    by = list(a["by"])
    if agg := a["agg"]:
        keys = by
        if a.get("span"):
            df = st.df.withColumn("time_bucket", times.bucket(q(st.time), times.seconds(a["span"])))
            st = st.to(df, created=st.created | {"time_bucket"})
            keys = ["time_bucket", *by]
        field = agg.arg.name.replace(".", "_") if isinstance(agg.arg, Field) else ""
        name = agg.alias or (f"{agg.func}_{field}" if field else agg.func)
        df, _, _ = grouped(st, [Agg(agg.func, agg.arg, name, agg.param, agg.where)], keys, carry=False)
        st = st.rows(df)
        groups = by if a.get("span") else []
    else:
        name = a.get("field") or ""
        st, groups = keyed(st, by)
        name = st.profile.aliases.get(name, name) if name not in st.df.columns else name
    x = st.scope().column(name).number().cast("double")
    df = st.df.withColumn("__x", x)
    keys = [q(g) for g in groups]
    if method == "zscore":
        facts = df.groupBy(*keys).agg(F.avg("__x").alias("avg_val"), F.stddev_samp("__x").alias("stddev_val"))
        df = join_groups(df, facts, groups)
        score = F.coalesce(F.try_divide(F.col("__x") - F.col("avg_val"), F.col("stddev_val")), F.lit(0.0))
    else:
        df = join_groups(df, df.groupBy(*keys).agg(F.percentile("__x", F.lit(0.5)).alias("median_val")), groups)
        away = df.withColumn("__d", F.abs(F.col("__x") - F.col("median_val")))
        df = join_groups(df, away.groupBy(*keys).agg(F.percentile("__d", F.lit(0.5)).alias("mad_val")), groups)
        # 0.6745 makes the deviation comparable with a standard deviation.
        score = F.coalesce(F.try_divide(0.6745 * (F.col("__x") - F.col("median_val")), F.col("mad_val")), F.lit(0.0))
    df = df.withColumn("anomaly_score", score).withColumn("is_anomaly", F.when(F.abs(F.col("anomaly_score")) > threshold, 1).otherwise(0)).drop("__x")
    made = ("anomaly_score", "is_anomaly", "avg_val", "stddev_val", "median_val", "mad_val")
    return st.to(df, created=st.created | set(made))


STAGES = {"stats": stats, "chart": chart, "timechart": timechart, "top": top, "rare": rare, "eventstats": eventstats, "streamstats": streamstats, "anomaly": anomaly}
