"""Joins and enrichment: join, lookup, inputlookup, output, prevalence, resolve_identity."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rivulet.operators.rows import q
from rivulet.plans import times
from rivulet.plans.errors import QueryError
from rivulet.plans.expressions import Typed, fold, ordered
from rivulet.plans.state import State


def join(st: State, a: dict) -> State:
    """An equi-join with a subsearch. max: rows of it for a key; maxout: rows of it in all, after it was narrowed to the
    keys of this side. One column for each name: on a match the subsearch's, unless overwrite=false."""
    how = {"inner": "inner", "left": "left", "outer": "left"}.get(a.get("type", "inner").lower())
    if how is None:
        raise QueryError("type is inner, left or outer")
    sub = st.engine.compile(a["query"], st)
    names = a["fields"]
    if not names:
        raise QueryError("join needs fields")
    scope, other = st.scope(), sub.scope()
    mine = {f"__m{i}": scope.column(n).string() for i, n in enumerate(names)}
    theirs = {f"__s{i}": other.column(n).string() for i, n in enumerate(names)}
    left, right = st.df.withColumns(mine), sub.df.withColumns(theirs)
    on = reduce(lambda x, y: x & y, [q(m) == q(s) for m, s in zip(mine, theirs)])
    if (most := int(a.get("max", 1))) > 0:
        order = sub.keys() or [F.xxhash64(*[q(s) for s in theirs])]
        right = right.withColumn("__n", F.row_number().over(W.partitionBy(*map(q, theirs)).orderBy(*order))).filter(F.col("__n") <= most).drop("__n")
    if cap := int(a.get("maxout", 0)):
        # In an order, so that reruns agree.
        order = [*(sub.keys() or []), F.xxhash64(*[q(c) for c in right.columns])]
        right = right.join(left.select(*map(q, mine)).distinct(), on, "left_semi").orderBy(*order).limit(cap)
    overwrite = a.get("overwrite", "true").lower() not in ("false", "f", "0")
    keys = set(names) | {st.profile.aliases.get(n, n) for n in names}
    shared = [c for c in right.columns if c in left.columns and not c.startswith("__")]
    extra = [c for c in right.columns if c not in left.columns and not c.startswith("__") and c not in keys]
    right = right.select(*map(q, theirs), F.lit(True).alias("__hit"), *[q(c).alias(f"__sub_{c}") for c in shared], *[q(c) for c in extra])
    met = left.join(right, on, how)
    out = []
    for c in st.df.columns:
        if c in shared and c not in keys and overwrite:
            out.append(F.when(F.col("__hit"), q(f"__sub_{c}")).otherwise(q(c)).alias(c))
        else:
            out.append(q(c))
    df = met.select(*out, *[q(c) for c in extra])
    return st.to(df, created=st.created | set(extra))


#: A lookup of at most so many rows is broadcast; a larger one is joined by a shuffle.
BROADCAST_ROWS = 200_000


def lookup(st: State, a: dict) -> State:
    t = st.engine.lookup(a["table"])
    if a["key"] not in t.columns:
        raise QueryError(f"lookup {a['table']} has no column {a['key']!r}")
    scope = st.scope()
    mine, theirs = scope.column(a["field"]).string(), q(a["key"]).cast("string")
    if a["ci"]:
        mine, theirs = fold(mine), fold(theirs)
    outputs = a["outputs"] or [(c, c) for c in t.columns if c != a["key"]]
    if missing := [c for c, _ in outputs if c not in t.columns]:
        raise QueryError(f"lookup {a['table']} has no column {missing[0]!r}")
    # One row for a key: the first by its values.
    picked = t.select(theirs.alias("__key"), *[q(c).alias(f"__out{i}") for i, (c, _) in enumerate(outputs)])
    first = F.min(F.struct(*[F.col(f"__out{i}") for i in range(len(outputs))])).alias("__row")
    picked = picked.filter("__key is not null").groupBy("__key").agg(first)
    if st.engine.lookup_is_small(a["table"], BROADCAST_ROWS):
        picked = F.broadcast(picked)
    df = st.df.withColumn("__mine", mine).join(picked, F.col("__mine") == F.col("__key"), "left")
    new = {}
    for i, (_, name) in enumerate(outputs):
        c = F.col(f"__row.__out{i}")
        new[name] = F.coalesce(q(name).cast("string"), c.cast("string")) if a["new"] and name in st.df.columns else c
    df = df.withColumns(new).drop("__mine", "__key", "__row")
    return st.to(df, created=st.created | set(new))


def inputlookup(st: State, a: dict) -> State:
    """A lookup's rows as source, or joined as enrichment if key= is given."""
    if url := a.get("url"):
        t = st.engine.fetch(url, a.get("format"), int(a.get("max_rows", 0)))
    else:
        t = st.engine.lookup(a.get("table") or "")
    if key := a.get("key"):
        extra = [c for c in t.columns if c != key and c not in st.df.columns]
        right = t.select(q(key).cast("string").alias("__key"), *[q(c) for c in extra]).dropDuplicates(["__key"])
        df = st.df.withColumn("__mine", st.scope().column(key).string()).join(right, F.col("__mine") == F.col("__key"), "left").drop("__mine", "__key")
        return st.to(df, created=st.created | set(extra))
    return st.rows(t)


def output(st: State, a: dict) -> State:
    st.engine.sink(a["dest"], st.df.select([q(c) for c in st.df.columns if not c.startswith("__")]))
    return st


#: Fields whose rarity is known, by kind of artifact.
ARTIFACTS = {"hash": ("file_hash", "process_hash", "parent_hash"), "domain": ("domain", "dest_domain", "query"), "url": ("url",), "ip": ("dest_ip", "src_ip", "ip")}
RARE_HOSTS, UNKNOWN, MOST_HOSTS, COUNTED = 5, 9999, 9998, 1000


def summary(df: DataFrame, artifact: str, host: str, time: str) -> DataFrame:
    """artifact, host_count, total_occurrences, first_seen, last_seen of the artifacts on fewer than COUNTED hosts."""
    some = df.filter(q(artifact).isNotNull() & (q(artifact).cast("string") != ""))
    facts = some.groupBy(q(artifact).cast("string").alias("artifact")).agg(
        F.least(F.count_distinct(q(host)), F.lit(MOST_HOSTS)).cast("long").alias("host_count"),
        F.count("*").alias("total_occurrences"),
        F.min(q(time)).alias("first_seen"),
        F.max(q(time)).alias("last_seen"),
    )
    return facts.filter(F.col("host_count") < COUNTED)


def prevalence(st: State, a: dict) -> State:
    name = a.get("field")
    kind = next((k for k in ARTIFACTS if name in (f"{k}_prevalence",) or (name or "").startswith("prevalence_") and name.removeprefix("prevalence_") in ARTIFACTS[k]), None)
    if name and name.startswith("prevalence_"):
        name = name.removeprefix("prevalence_")
    if name is None or kind and (name.endswith("_prevalence") or name not in st.df.columns):
        kinds = [kind] if kind else list(ARTIFACTS)
        name = next((f for k in kinds for f in ARTIFACTS[k] if f in st.df.columns), None)
        if name is None:
            raise QueryError("there is no field whose prevalence is known")
    real = name if name in st.df.columns else st.profile.aliases.get(name, name)
    facts = st.engine.prevalence(st, real, times.seconds(a.get("window", "30d")))
    df = st.df.join(facts.withColumnRenamed("artifact", "__artifact"), q(real).cast("string") == F.col("__artifact"), "left").drop("__artifact")
    df = df.withColumn("host_count", F.coalesce("host_count", F.lit(UNKNOWN)))
    df = df.withColumn("is_rare", F.when(F.col("host_count") < RARE_HOSTS, 1).otherwise(0)).withColumn("prevalence_score", F.round(100.0 / F.col("host_count"), 2))
    if "op" in a:
        df = df.filter(ordered(F.col("host_count"), {"==": "="}.get(a["op"], a["op"]), F.lit(a["n"])))
    made = {"host_count", "total_occurrences", "first_seen", "last_seen", "is_rare", "prevalence_score"}
    return st.to(df, created=st.created | made)


def resolve_identity(st: State, a: dict) -> State:
    """The identity last observed for an address at or before the row's time: both sides in one order by address and
    time, the last observation carried forward."""
    facts = st.engine.identities()
    ip = st.scope().column(a["field"]).string()
    cols = [c for c in facts.columns if c not in ("ip", "observed_at")]
    ident = facts.select(F.col("ip").cast("string").alias("__ip"), F.col("observed_at").alias("__t"), F.lit(0).alias("__side"), F.struct(F.col("observed_at"), F.col("ip"), *[q(c) for c in cols]).alias("__id"), F.lit(None).cast(st.df.schema).alias("__row"))
    rows = st.df.select(ip.alias("__ip"), q(st.time).alias("__t"), F.lit(1).alias("__side"), F.lit(None).cast(ident.schema["__id"].dataType).alias("__id"), F.struct(*[q(c) for c in st.df.columns]).alias("__row"))
    w = W.partitionBy("__ip").orderBy("__t", "__side").rowsBetween(W.unboundedPreceding, 0)
    # Rows without an address have no identity, and stay where they are.
    known, unknown = (x.filter(F.col("__ip").isNotNull()) for x in (ident, rows)), rows.filter(F.col("__ip").isNull())
    both = reduce(DataFrame.unionByName, known)
    met = both.withColumn("__last", F.last("__id", ignorenulls=True).over(w)).filter("__side = 1")
    met = met.unionByName(unknown.withColumn("__last", F.col("__id")))
    out = {f"identity_{c}": F.col(f"__last.{c}") for c in ("observed_at", "ip", *cols)}
    df = met.select("__row.*", *[c.alias(n) for n, c in out.items()])
    return st.to(df, created=st.created | set(out))


STAGES = {"join": join, "lookup": lookup, "inputlookup": inputlookup, "output": output, "prevalence": prevalence, "resolve_identity": resolve_identity}
