"""Order, limits, duplicates, unions."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rivulet.operators.rows import q
from rivulet.plans.errors import QueryError, UnsupportedQuery
from rivulet.plans.state import State


def sort(st: State, a: dict) -> State:
    keys, df = [], st.df
    for name, desc in a["keys"]:
        real = name if name in df.columns else st.aliases.get(name) or st.profile.aliases.get(name, name)
        if real not in df.columns:
            df = df.withColumn(f"__sort_{len(keys)}", st.to(df).scope().column(name).col)
            real = f"__sort_{len(keys)}"
        keys.append((real, desc))
    st = st.to(df, order=tuple(keys), sorted=True)
    return st.to(st.ordered().limit(a["n"])) if a["n"] else st


def head(st: State, a: dict) -> State:
    return st.to(st.ordered().limit(a["n"]))


def tail(st: State, a: dict) -> State:
    """The end of the order, listed from the end."""
    if st.order is None:
        raise UnsupportedQuery("tail needs an order, which an earlier stage has destroyed")
    st = reverse(st, {})
    return st.to(st.ordered().limit(a["n"]))


def reverse(st: State, a: dict) -> State:
    if st.order is None:
        raise UnsupportedQuery("reverse needs an order, which an earlier stage has destroyed")
    return replace(st, order=tuple((c, not d) for c, d in st.order))


def dedup(st: State, a: dict) -> State:
    """The newest n rows of each key (the first of an explicit order), the oldest with keepfirst=false."""
    scope = st.scope()
    names = a["fields"]
    if not names:
        raise QueryError("dedup needs fields")
    keys = [scope.column(n).col for n in names]
    if a["sortby"]:
        order = tuple((st.profile.aliases.get(n, n) if n not in st.df.columns else n, d) for n, d in a["sortby"])
    else:
        order = st.order or (((st.time, True),) if st.time else ())
    flip = a.get("keepfirst", "true").lower() in ("false", "f", "0") or a.get("keeplast", "false").lower() in ("true", "t", "1")
    by = replace(st, order=order).keys(reverse=flip)
    # Ties by content, as ids may repeat.
    ties = [F.xxhash64(*[q(f.name) for f in st.df.schema if f.dataType.typeName() not in ("map", "variant")])]
    n = F.row_number().over(W.partitionBy(*keys).orderBy(*by, *ties))
    df = st.df.withColumn("__n", n).filter(F.col("__n") <= a["n"]).drop("__n")
    return replace(st.to(df), order=None) if not st.sorted else st.to(df)


def append(st: State, a: dict) -> State:
    other = st.engine.compile(a["query"], st)
    clean = [c for c in st.df.columns if not c.startswith("__")]
    theirs = [c for c in other.df.columns if not c.startswith("__")]
    left, right = st.df.select([q(c) for c in clean]), other.df.select([q(c) for c in theirs])
    kinds = {f.name: f.dataType for f in left.schema}
    # A column that both have with other types becomes text in both.
    for f in right.schema:
        if f.name in kinds and kinds[f.name] != f.dataType:
            both = {"int", "bigint", "double", "float", "smallint"} >= {kinds[f.name].simpleString(), f.dataType.simpleString()}
            kind = "double" if both and "double" in (kinds[f.name].simpleString(), f.dataType.simpleString()) else "bigint" if both else "string"
            left, right = left.withColumn(f.name, q(f.name).cast(kind)), right.withColumn(f.name, q(f.name).cast(kind))
    df = left.unionByName(right, allowMissingColumns=True)
    return replace(st.to(df, created=frozenset(df.columns)), order=None)


STAGES = {"sort": sort, "head": head, "tail": tail, "reverse": reverse, "dedup": dedup, "append": append}
