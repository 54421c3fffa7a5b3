"""Aggregate functions, and the names of their columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rivulet.plans.ast import Agg, Field
from rivulet.plans.errors import QueryError
from rivulet.plans.expressions import Scope, Typed

#: values() keeps so many distinct values of a group.
VALUES_CAP = 100
ALIASES = {"distinct_count": "dc", "mean": "avg", "stddev": "stdev"}
#: In a gap of a chart these are 0, others null.
ZERO_IN_GAPS = frozenset(("count", "sum", "dc", "estdc"))


def label(a: Agg) -> str:
    """As written: dc(user)."""
    if isinstance(a.arg, Field):
        return f"{a.func}({a.arg.name})"
    return a.func if a.arg is None else f"{a.func}(expr)"


def names(aggs: list[Agg]) -> list[str]:
    """Alias; count; values_f, list_f; else the function's name. Names that several would have become dc(a), dc(b),
    and if they still clash get _2, _3."""
    plain = []
    for a in aggs:
        field = a.arg.name if isinstance(a.arg, Field) else ""
        base = f"p{a.param:g}" if a.func == "percentile" and a.param is not None else a.func
        plain.append(a.alias or (f"{a.func}_{field}" if a.func in ("values", "list") and field else base))
    out: list[str] = []
    for a, name in zip(aggs, plain):
        if not a.alias and plain.count(name) > 1 and a.arg is not None:
            name = label(a).replace("percentile(", f"p{a.param:g}(" if a.param is not None else "percentile(")
        k, base = 1, name
        while name in out:
            k += 1
            name = f"{base}_{k}"
        out.append(name)
    return out


def reference_names(aggs: list[Agg], columns: list[str]) -> dict[str, str]:
    """Other names by which later stages may mean a column: avg_bytes, avg(bytes)."""
    out = {}
    for a, c in zip(aggs, columns):
        if isinstance(a.arg, Field):
            out.setdefault(f"{a.func}_{a.arg.name}", c)
            out.setdefault(label(a), c)
        elif a.arg is None:
            out.setdefault(f"{a.func}()", c)
    return {k: v for k, v in out.items() if k not in columns}


def present(t: Typed) -> Column:
    """The values that count as there: not null, and no empty text."""
    return F.when(t.col != "", t.col) if t.text else t.col


def build(scope: Scope, a: Agg, time: str | None) -> Column:
    func = ALIASES.get(a.func, a.func)
    held = scope.condition(a.where) if a.where is not None else None
    if func == "count":
        if a.arg is None:
            return F.count(F.lit(1)) if held is None else F.count_if(held)
        t = scope.compile(a.arg)
        return F.count(t.col if held is None else F.when(held, t.col))
    if a.arg is None:
        raise QueryError(f"{a.func} needs a field")
    t = scope.compile(a.arg)
    if held is not None:
        t = Typed(F.when(held, t.col), t.kind)
    when = F.col(f"`{time}`") if time and time in scope.df.columns else None
    if func in ("first", "last", "earliest", "latest"):
        if when is None:
            return (F.first if func in ("first", "earliest") else F.last)(t.col, ignorenulls=True)
        pick = F.min_by if func in ("first", "earliest") else F.max_by
        return pick(t.col, F.when(t.col.isNotNull(), F.struct(when, t.string())))
    if func == "dc":
        return F.count_distinct(present(t))
    if func == "estdc":
        return F.approx_count_distinct(present(t), 0.01)
    if func in ("min", "max"):
        x = t.string().try_cast("double") if t.text else t.col
        return (F.min if func == "min" else F.max)(x)
    if func == "values":
        # Sorted and distinct; the set is bounded by the group's distinct values.
        some = F.slice(F.array_sort(F.collect_set(present(t).cast("string"))), 1, VALUES_CAP)
        return F.when(F.size(some) > 0, F.array_join(some, ", "))
    if func == "list":
        if when is None:
            return F.array_join(F.collect_list(present(t).cast("string")), ", ")
        rows = F.array_sort(F.collect_list(F.when(present(t).isNotNull(), F.struct(when.alias("t"), present(t).cast("string").alias("v")))))
        return F.when(F.size(rows) > 0, F.array_join(F.transform(rows, lambda r: r["v"]), ", "))
    if func == "mode":
        return F.mode(t.col, deterministic=True)
    if func == "rate":
        if when is None:
            raise QueryError("rate needs a time column")
        rows = F.array_sort(F.collect_list(F.when(t.number().isNotNull(), F.struct(F.unix_micros(when).alias("t"), t.number().cast("double").alias("v")))))
        step = lambda acc, r: F.struct(r["v"].alias("v"), (acc["s"] + F.when(acc["v"].isNull(), 0.0).when(r["v"] >= acc["v"], r["v"] - acc["v"]).otherwise(r["v"])).alias("s"))
        total = F.aggregate(rows, F.struct(F.lit(None).cast("double").alias("v"), F.lit(0.0).alias("s")), step, lambda acc: acc["s"])
        span = (F.element_at(rows, -1)["t"] - F.element_at(rows, 1)["t"]) / 1e6
        return F.when(F.size(rows) > 1, F.try_divide(total, span))
    if func == "sparkline":
        raise QueryError("sparkline stands in stats only")
    x = t.number()
    if func == "sum":
        return F.sum(x)
    if func == "avg":
        return F.avg(x)
    if func == "range":
        return F.max(x) - F.min(x)
    if func == "stdev":
        return F.stddev_samp(x)
    if func == "var":
        return F.var_samp(x)
    if func == "median":
        return F.percentile(x, F.lit(0.5))
    if func == "percentile":
        if a.param is None or not 0 <= a.param <= 100:
            raise QueryError("a percentile is between 0 and 100")
        return F.percentile(x, F.lit(a.param / 100))
    if func == "histogram_quantile":
        return histogram_quantile(scope, t, a.param)
    raise QueryError(f"unknown aggregate {a.func}")


def histogram_quantile(scope: Scope, buckets: Typed, n: float | None) -> Column:
    """The quantile n (0 to 1, or 0 to 100) of the summed buckets, interpolated between explicit_bounds."""
    q = 0.5 if n is None else n / 100 if n > 1 else n
    # Buckets of a group are summed place by place; bounds are those of its first row.
    rows = F.collect_list(buckets.col.cast("array<double>"))
    zero = F.array().cast("array<double>")
    summed = F.aggregate(rows, zero, lambda acc, r: F.zip_with(acc, r, lambda x, y: F.coalesce(x, F.lit(0.0)) + F.coalesce(y, F.lit(0.0))))
    bounds = F.first(F.col("explicit_bounds"), ignorenulls=True)
    total = F.aggregate(summed, F.lit(0.0), lambda acc, x: acc + x)
    start = F.struct(F.lit(0).alias("i"), F.lit(0.0).alias("seen"), F.lit(None).cast("double").alias("out"))

    def step(acc, c):
        lo = F.when(acc["i"] == 0, 0.0).otherwise(F.get(bounds, acc["i"] - 1))
        hi = F.coalesce(F.get(bounds, acc["i"]), lo)
        want = total * q
        here = acc["out"].isNull() & (acc["seen"] + c >= want) & (c > 0)
        value = lo + (hi - lo) * (want - acc["seen"]) / c
        return F.struct((acc["i"] + 1).alias("i"), (acc["seen"] + c).alias("seen"), F.when(here, value).otherwise(acc["out"]).alias("out"))

    return F.aggregate(summed, start, step, lambda acc: acc["out"])
