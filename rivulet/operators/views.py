"""Views for investigation and observability."""

from __future__ import annotations

import re
from datetime import timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rivulet.operators.rows import q
from rivulet.plans import times
from rivulet.plans.errors import QueryError
from rivulet.plans.expressions import fold, folded, java_regex
from rivulet.plans.state import State

#: Levels of a tree, and hops of a movement, that are followed at most.
MOST_DEPTH, MOST_HOPS = 20, 10
PLACEHOLDERS = ("", "0", "-", "null", "none", "unknown", "{00000000-0000-0000-0000-000000000000}")


def matches(c: Column, pattern: str) -> Column:
    """pattern: /regex/, a text with * and ?, or an exact text; in any case."""
    if m := re.fullmatch(r"/(.*)/", pattern, re.S):
        return c.rlike(java_regex(m[1]))
    if re.search(r"[*?]", pattern):
        return fold(c).rlike("(?s)^" + "".join(".*" if x == "*" else "." if x == "?" else re.escape(x) for x in folded(pattern)) + "$")
    return fold(c) == folded(pattern)


def tree(st: State, a: dict) -> State:
    """The forest of parent and child ids: node, parent, depth, path (ids from the root), label, detail, count. Each
    level is a join of the one before with the edges, up to MOST_DEPTH levels; a node on its own path ends it."""
    scope = st.scope()
    if a.get("field"):  # a plain grouping: the field's values below those of by
        child, parent = a["field"], (a["by"] or [None])[0]
        if parent is None:
            raise QueryError("tree needs parent= and child=, or a field and by")
    else:
        child, parent = a.get("child"), a.get("parent")
        if not child or not parent:
            raise QueryError("tree needs parent= and child=")
    text = lambda n: F.when(~fold(scope.column(n).string()).isin(*PLACEHOLDERS), scope.column(n).string())
    label = scope.column(a["label"]).string() if a.get("label") else text(child)
    detail = scope.column(a["detail"]).string() if a.get("detail") else F.lit(None).cast("string")
    rows = st.df.select(text(child).alias("c"), text(parent).alias("p"), label.alias("l"), detail.alias("d")).filter("c is not null")
    rows = rows.withColumn("p", F.when(F.col("p") != F.col("c"), F.col("p")))
    edges = rows.groupBy("c", "p").agg(F.min("l").alias("l"), F.min("d").alias("d"), F.count("*").alias("n"))
    # Roots: ids without a parent, and parents that are no one's child.
    nodes = edges.groupBy("c").agg(F.min("l").alias("l"), F.min("d").alias("d"), F.sum("n").alias("n"), F.max("p").alias("p"))
    orphan = nodes.filter("p is null").select("c", "l", "d", "n")
    missing = edges.filter("p is not null").select(F.col("p").alias("c")).distinct().join(nodes.select("c"), "c", "left_anti")
    missing = missing.select("c", F.col("c").alias("l"), F.lit(None).cast("string").alias("d"), F.lit(0).cast("long").alias("n"))
    roots = orphan.unionByName(missing)
    if a.get("root"):
        roots = nodes.select("c", "l", "d", "n").unionByName(missing).filter(matches(F.col("c"), a["root"]) | matches(F.col("l"), a["root"]))
    level = roots.select(F.col("c").alias("node"), F.lit(None).cast("string").alias("parent"), F.lit(0).alias("depth"), F.array("c").alias("path"), F.col("l").alias("label"), F.col("d").alias("detail"), F.col("n").alias("count"))
    out = level
    wanted = min(int(a["depth"]), MOST_DEPTH) if a.get("depth") else None
    for depth in range(1, (wanted or MOST_DEPTH + 1) + 1):
        below = level.select(F.col("node").alias("p"), "path").join(edges.filter("p is not null"), "p").filter(~F.array_contains("path", F.col("c")))
        level = below.select(F.col("c").alias("node"), F.col("p").alias("parent"), F.lit(depth).alias("depth"), F.array_append("path", F.col("c")).alias("path"), F.col("l").alias("label"), F.col("d").alias("detail"), F.col("n").alias("count"))
        level = st.engine.cut(level)
        if level.isEmpty():
            break
        if depth > MOST_DEPTH:
            raise QueryError(f"the tree has more than {MOST_DEPTH} levels; depth= takes the first of them")
        out = out.unionByName(level)
    out = out.withColumn("path", F.array_join("path", " > "))
    return st.rows(out, order=(("path", False),))


def lateral(st: State, a: dict) -> State:
    """Hops from host to host (or of a user), each one later than the one that led to its source."""
    hops = min(int(a.get("maxhops", 5)), MOST_HOPS)
    entity, seed = a.get("entity") or a.get("value"), (a.get("seed") or "auto").lower()
    names = {n: (q(n).cast("string") if n in st.df.columns else F.lit(None).cast("string")) for n in ("user", "src_host", "dest_host", "src_ip", "dest_ip", "src_port", "dest_port", "process_name", "auth_type", "auth_result", "source_type", "log_source")}
    if "src_host" not in st.df.columns and "src_ip" not in st.df.columns:
        raise QueryError("lateral needs src_host and dest_host, or src_ip and dest_ip")
    source = F.coalesce(names["src_host"], names["src_ip"])
    target = F.coalesce(names["dest_host"], names["dest_ip"])
    method = F.when(names["auth_type"].isNotNull(), "auth").when(names["process_name"].isNotNull(), "process").otherwise("network")
    moves = st.df.select(q(st.time).alias("timestamp"), *[c.alias(n) for n, c in names.items()], fold(source).alias("__from"), fold(target).alias("__to"), method.alias("method"))
    moves = moves.withColumn("method_detail", F.coalesce("auth_type", "process_name", F.concat(F.lit("port "), F.col("dest_port")))).filter("__from is not null and __to is not null and __from <> __to")
    if a.get("methods"):
        moves = moves.filter(F.col("method").isin(*[m.strip() for m in a["methods"].split(",")]))
    first = moves
    if entity:
        by_user, by_host = matches(F.col("user"), entity), matches(F.col("__from"), entity)
        first = moves.filter(by_user if seed == "user" else by_host if seed == "host" else F.coalesce(by_user, F.lit(False)) | by_host)
    level = st.engine.cut(first.withColumn("hop_number", F.lit(1)))
    out = level
    for hop in range(2, hops + 1):
        reached = level.groupBy(F.col("__to").alias("__host")).agg(F.min("timestamp").alias("__since"))
        level = moves.join(reached, (F.col("__from") == F.col("__host")) & (F.col("timestamp") > F.col("__since"))).drop("__host", "__since").withColumn("hop_number", F.lit(hop))
        level = st.engine.cut(level.join(out.select("timestamp", "__from", "__to").distinct(), ["timestamp", "__from", "__to"], "left_anti"))
        if level.isEmpty():
            break
        out = out.unionByName(level)
    return st.rows(out.drop("__from", "__to"), order=(("timestamp", False),))


#: Dimensions that a baseline compares, where the dataset has them.
DIMENSIONS = ("process_name", "dest_host", "dest_ip", "dest_port", "user", "action", "event_type", "url", "domain")
MOST_CURRENT, MOST_WINDOW, ENOUGH_DAYS, ENOUGH_EVENTS = 7, 90, 3, 50


#: The dimension under which the events of an entity and day are counted, whatever their values.
EVENTS_OF_DAY = "*"


def first_seen(df, entity: Column, dims: list[str], time: str, whole: bool = False):
    """entity, dim, val, day, first_seen, event_count: one pass over the events for all dimensions. whole: with a row of
    all events of an entity and day, under EVENTS_OF_DAY."""
    pairs = F.array(*[F.struct(F.lit(d).alias("dim"), q(d).cast("string").alias("val")) for d in dims], *([F.struct(F.lit(EVENTS_OF_DAY).alias("dim"), F.lit(EVENTS_OF_DAY).alias("val"))] if whole else []))
    each = df.select(entity.cast("string").alias("entity"), q(time).cast("timestamp").alias("t"), F.explode(pairs).alias("x"))
    each = each.select("entity", "t", "x.dim", "x.val").filter("entity is not null and val is not null and val <> ''")
    return each.groupBy("entity", "dim", "val", F.to_date("t").alias("day")).agg(F.min("t").alias("first_seen"), F.count("*").alias("event_count"))


def baseline(st: State, a: dict) -> State:
    """Values of the current window that are new to the entity against the time before it."""
    kind = next((k for k in ("host", "user", "ip") if k in a), None)
    columns = {"host": ("src_host", "host"), "user": ("user",), "ip": ("src_ip", "ip")}
    name = next((c for c in columns.get(kind, ()) if c in st.df.columns or st.profile.aliases.get(c) in st.df.columns), None)
    if not kind or not name:
        raise QueryError("baseline needs host=, user= or ip=, and a dataset with it")
    scope = st.scope()
    entity = scope.column(name).string()
    first, last = st.engine.time_range(st)
    first = max(first, last - timedelta(days=MOST_CURRENT))
    window = min(times.seconds(a.get("window", "7d")), MOST_WINDOW * times.DAY)
    dims = [d for d in (a["dims"].split(",") if a.get("dims") else DIMENSIONS) if d in st.df.columns and d != name]
    if not dims:
        raise QueryError("there is no dimension to compare")
    source = st.engine.source(st)
    s2 = st.to(source)
    known = s2.scope().column(name).string()
    start = first - timedelta(seconds=window)
    now = st.df.filter((q(st.time) >= F.lit(first)) & matches(entity, a[kind]))
    new = first_seen(now, entity, dims, st.time).groupBy("entity", "dim", "val").agg(F.min("first_seen").alias("first_seen"), F.sum("event_count").alias("event_count"))
    told = st.engine.first_seen.get(st.profile.name)
    if told and kind in told.entities and set(dims) <= set(told.dims) and told.entities[kind] in source.columns:
        # Complete days are read from the ledger, the rest of the window from the events.
        rows = told.between(source, kind, start, first).filter(matches(F.col("entity"), a[kind]))
        old = rows.filter(F.col("dim").isin(dims))
        facts = rows.filter(F.col("dim") == EVENTS_OF_DAY).agg(F.count_distinct("day").alias("d"), F.coalesce(F.sum("event_count"), F.lit(0)).alias("n"))
    else:
        before = source.filter((q(st.time) >= F.lit(start)) & (q(st.time) < F.lit(first)) & matches(known, a[kind]))
        old = first_seen(before, known, dims, st.time)
        facts = before.agg(F.count_distinct(F.to_date(q(st.time))).alias("d"), F.count("*").alias("n"))
    coverage = F.when(F.col("n") == 0, "no_history").when((F.col("d") >= ENOUGH_DAYS) & (F.col("n") >= ENOUGH_EVENTS), "sufficient").otherwise("thin")
    out = new.join(old.select("entity", "dim", "val").distinct(), ["entity", "dim", "val"], "left_anti")
    out = out.crossJoin(F.broadcast(facts.select(coverage.alias("coverage"))))  # one row
    return st.rows(out, order=(("first_seen", False),))


def retro(st: State, a: dict) -> State:
    """Matches of indicators, summed by indicator, asset or user."""
    axis = (a.get("by") or "indicator").lower()
    columns = {"indicator": ("ioc_value", "ioc", "indicator"), "asset": ("src_host", "host", "src_ip"), "user": ("user", "user_id")}
    if axis not in columns:
        raise QueryError("retro is by indicator, asset or user")
    name = next((c for c in columns[axis] if c in st.df.columns), None)
    if name is None:
        raise QueryError(f"there is no field for retro by {axis}")
    hosts = next((c for c in columns["asset"] if c in st.df.columns), None)
    users = next((c for c in columns["user"] if c in st.df.columns), None)
    more = [F.count_distinct(q(c)).alias(n) for n, c in (("assets", hosts), ("users", users)) if c and c != name]
    out = st.df.filter(q(name).isNotNull()).groupBy(q(name).cast("string").alias(axis)).agg(F.count("*").alias("matches"), *more, F.min(q(st.time)).alias("first_seen"), F.max(q(st.time)).alias("last_seen"))
    return st.rows(out, order=(("matches", True),))


def _dossier(st: State, name: str, value: str | None, dims: tuple[str, ...]) -> State:
    """entity, section, value, count, first_seen, last_seen over the last six hours of the range."""
    scope = st.scope()
    entity = scope.column(name).string()
    _, last = st.engine.time_range(st)
    df = st.df.filter(q(st.time) >= F.lit(last - timedelta(hours=6)))
    if value:
        df = df.filter(matches(entity, value))
    sections = [d for d in dims if d in df.columns and d != name]
    pairs = [F.struct(F.lit("all").alias("section"), F.lit("").alias("value"))] + [F.struct(F.lit(d).alias("section"), q(d).cast("string").alias("value")) for d in sections]
    each = df.select(entity.alias("entity"), q(st.time).alias("t"), F.explode(F.array(*pairs)).alias("x")).select("entity", "t", "x.*").filter("entity is not null and value is not null")
    out = each.groupBy("entity", "section", "value").agg(F.count("*").alias("count"), F.min("t").alias("first_seen"), F.max("t").alias("last_seen"))
    return st.rows(out, order=(("entity", False), ("section", False), ("count", True)))


def asset(st: State, a: dict) -> State:
    name = a.get("field") or next((c for c in ("src_host", "host", "src_ip", "user", "user_id") if c in st.df.columns), None)
    if name is None:
        raise QueryError("asset needs field=")
    return _dossier(st, name, a.get("value"), DIMENSIONS)


def cloud(st: State, a: dict) -> State:
    pairs = {"principal": ("user", "principal"), "account": ("cloud_account", "account"), "provider": ("cloud_provider", "provider")}
    df = st.df
    for key, names in pairs.items():
        if key in a:
            name = next((n for n in names if n in df.columns), None)
            if name is None:
                raise QueryError(f"there is no field for {key}=")
            df = df.filter(matches(q(name).cast("string"), a[key]))
    name = next((n for n in (*pairs["principal"], *pairs["account"]) if n in df.columns), None)
    if name is None:
        raise QueryError("cloud needs a principal or an account")
    return _dossier(st.to(df), name, a.get("value"), ("action", "event_type", "region", "cloud_region", "src_ip", "cloud_account", "cloud_provider", "user_agent"))


# -- observability --------------------------------------------------------------------------------------------
def red(df, keys: list[Column]):
    """requests, errors, error_rate and quantiles of the duration in milliseconds."""
    ms = F.col("duration_ns") / 1e6
    error = F.upper("status_code").isin("ERROR", "STATUS_CODE_ERROR", "2")
    return df.groupBy(*keys).agg(
        F.count("*").alias("requests"),
        F.count_if(error).alias("errors"),
        (F.count_if(error) / F.count("*")).alias("error_rate"),
        *[F.percentile(ms, F.lit(p)).alias(f"p{round(p * 100)}_ms") for p in (0.5, 0.95, 0.99)],
    )


def services(st: State, a: dict) -> State:
    if st.profile.name == "spans_red":
        from rivulet.streaming.rollups import red_view

        return st.rows(red_view(st.df), order=(("requests", True),))
    return st.rows(red(st.df, [F.col("service_name")]), order=(("requests", True),))


def service(st: State, a: dict) -> State:
    if not a.get("value"):
        raise QueryError("service needs a name")
    return st.rows(red(st.df.filter(fold(F.col("service_name")) == folded(a["value"])), [F.col("service_name"), F.col("span_name")]), order=(("requests", True),))


def trace(st: State, a: dict) -> State:
    if not a.get("value"):
        raise QueryError("trace needs an id")
    df = st.df
    if (index := st.engine.trace_index) is not None:
        # One row: where in time the trace lies, so that the scan of spans skips the rest.
        at = (index() if callable(index) else index).filter(F.col("trace_id") == a["value"]).agg(F.min("start").alias("lo"), F.max("end").alias("hi")).first()
        if at["lo"] is not None:
            df = st.engine.within(df, st.profile, at["lo"], at["hi"] + timedelta(microseconds=1))
    return st.to(df.filter(F.col("trace_id") == a["value"]), order=(("start_time", False),))


def trace_times(df):
    """trace_id, start, end: partial rows of a trace index, which merge by the least and the greatest."""
    return df.filter("trace_id IS NOT NULL").groupBy("trace_id").agg(F.min("start_time").alias("start"), F.max("start_time").alias("end"))


def merged_trace_times(partials):
    return partials.groupBy("trace_id").agg(F.min("start").alias("start"), F.max("end").alias("end"))


def recent_traces(df):
    """One row for each trace: start, duration in milliseconds, spans, errors, root span."""
    error = F.upper("status_code").isin("ERROR", "STATUS_CODE_ERROR", "2")
    root = F.min_by(F.struct("service_name", "span_name"), F.struct(F.coalesce(F.col("parent_span_id"), F.lit("")), F.col("start_time")))
    out = df.groupBy("trace_id").agg(F.min("start_time").alias("start_time"), F.max("end_time").alias("end_time"), F.count("*").alias("spans"), F.count_if(error).alias("errors"), root.alias("root"))
    ms = (F.unix_micros("end_time") - F.unix_micros("start_time")) / 1e3
    return out.select("trace_id", "start_time", ms.alias("duration_ms"), "spans", "errors", F.col("root.service_name").alias("root_service"), F.col("root.span_name").alias("root_span"))


def metric(st: State, a: dict) -> State:
    """A metric's series by minute."""
    if not a.get("value"):
        raise QueryError("metric needs a name")
    df = st.df.filter(fold(F.col("metric_name")) == folded(a["value"]))
    if a.get("service"):
        df = df.filter(fold(F.col("service_name")) == folded(a["service"]))
    out = df.groupBy("metric_name", "service_name", F.date_trunc("minute", q(st.time)).alias("time_bucket")).agg(F.avg("value").alias("avg"), F.min("value").alias("min"), F.max("value").alias("max"), F.sum("value").alias("sum"), F.count("*").alias("count"))
    return st.rows(out, order=(("time_bucket", False),))


def series_rate(df, keys: list[Column], series: list[str], span: float):
    """Counter rate by series and bucket, then summed: a rise counts as it is, a fall as a start from 0; the first
    sample of a series counts for nothing, and a bucket in which no series has a step is null."""
    from pyspark.sql import Window as W

    w = W.partitionBy(*[F.col(s) for s in series]).orderBy("timestamp", "value")
    d = F.col("value") - F.lag("value").over(w)
    steps = df.withColumn("__d", F.when(d >= 0, d).when(d.isNotNull(), F.col("value"))).withColumn("time_bucket", times.bucket(F.col("timestamp"), span))
    return steps.groupBy(*keys, "time_bucket").agg((F.sum("__d") / span).alias("rate"))


def slo(df, threshold_ms: float | None = None):
    """good, total and ratio by service: spans without error, and within the threshold if one is given."""
    good = ~F.upper("status_code").isin("ERROR", "STATUS_CODE_ERROR", "2")
    if threshold_ms is not None:
        good = good & (F.col("duration_ns") <= threshold_ms * 1e6)
    return df.groupBy("service_name").agg(F.count_if(good).alias("good"), F.count("*").alias("total"), (F.count_if(good) / F.count("*")).alias("ratio"))


def tag_keys(df):
    return df.select(F.explode(F.map_keys("attributes")).alias("tag")).groupBy("tag").agg(F.count("*").alias("count"))


def tag_values(df, tag: str):
    v = F.coalesce(F.col("attributes").getItem(tag), F.col("resource_attributes").getItem(tag))
    return df.select(v.alias("value")).filter("value is not null").groupBy("value").agg(F.count("*").alias("count"))


STAGES = {"tree": tree, "lateral": lateral, "baseline": baseline, "retro": retro, "asset": asset, "cloud": cloud, "services": services, "service": service, "trace": trace, "metric": metric}
