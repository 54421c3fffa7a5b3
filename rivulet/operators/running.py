"""Running aggregates whose rows are split over tasks by time: those of all rows, and of keys that most rows share.

Rows are dealt to slices of the time, by quantiles, and each slice has its own running aggregates; what lies before a
slice is added from the slices' totals, at most SLICES for a key. Of the last n rows, each is given its number first, by
the same totals; then rows are dealt by their number to chunks, and the last ones of a chunk go to the next one too."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rivulet.operators.rows import q
from rivulet.plans.ast import Agg

#: Slices of the time are STEPS times STEPS. Rows of a chunk. A key of more than 1 / SHARE of the rows is split.
STEPS, CHUNK, SHARE = 32, 100_000, 32
SLICES = STEPS * STEPS
#: Aggregates that can be added to what lies before.
ADDED = frozenset(("count", "sum", "avg", "mean", "min", "max", "range", "first", "last", "earliest", "latest"))


def sliced(df: DataFrame, by: list[str], time: str) -> DataFrame:
    """df with __slice, in the order of the time; 0 for keys that are not worth splitting."""
    micros = F.coalesce(F.unix_micros(q(time).cast("timestamp")), F.lit(-(1 << 62)))
    marks = F.array(*[F.lit(i / SLICES) for i in range(1, SLICES)])
    bounds = df.agg(F.percentile_approx(micros, marks, F.lit(10 * SLICES)).alias("__bounds"))
    out = df.crossJoin(F.broadcast(bounds)).withColumn("__at", micros)  # one row
    below = lambda a: F.size(F.filter(a, lambda b: b <= F.col("__at")))
    coarse = F.array(*[F.get("__bounds", F.lit(STEPS * (i + 1) - 1)) for i in range(STEPS - 1)])
    out = out.withColumn("__c", below(coarse))
    out = out.withColumn("__slice", F.coalesce(F.col("__c") * STEPS + below(F.slice("__bounds", F.col("__c") * STEPS + 1, STEPS - 1)), F.lit(0)))
    if by:
        counts = df.groupBy(*[q(b) for b in by]).agg(F.count("*").alias("__n"))
        total = counts.agg(F.sum("__n").alias("__total"))
        hot = counts.crossJoin(F.broadcast(total)).filter(F.col("__n") * SHARE > F.col("__total")).select(*[q(b).alias(f"__h{i}") for i, b in enumerate(by)], F.lit(True).alias("__hot"))
        on = [q(b).eqNullSafe(F.col(f"__h{i}")) for i, b in enumerate(by)]
        out = out.join(F.broadcast(hot), on, "left").withColumn("__slice", F.when(F.col("__hot"), F.col("__slice")).otherwise(0))  # fewer than SHARE keys
        out = out.drop("__hot", *[f"__h{i}" for i in range(len(by))])
    return out.drop("__bounds", "__at", "__c")


def _before(totals: DataFrame, by: list[str], columns: list[tuple[str, Column]]) -> DataFrame:
    """by, __slice and the columns over all slices of a key before it; slices that begin a key are left out."""
    w = W.partitionBy(*[q(b) for b in by]).orderBy("__slice").rowsBetween(W.unboundedPreceding, -1)
    out = totals.select(*[q(b).alias(f"__k{i}") for i, b in enumerate(by)], F.col("__slice").alias("__s"), F.count("*").over(w).alias("__i"), *[c.over(w).alias(n) for n, c in columns])
    return out.filter("__i > 0").drop("__i")


def _joined(df: DataFrame, before: DataFrame, by: list[str]) -> DataFrame:
    on = [F.col("__slice") == F.col("__s"), *[q(b).eqNullSafe(F.col(f"__k{i}")) for i, b in enumerate(by)]]
    return df.join(F.broadcast(before), on, "left").drop("__s", *[f"__k{i}" for i in range(len(by))])  # at most SLICES * SHARE rows


def _value(scope, a: Agg) -> Column:
    """What an aggregate is made of."""
    if a.func == "count" and a.arg is None:
        x = F.lit(1)
    else:
        t = scope.compile(a.arg)
        if a.func in ("sum", "avg", "mean", "range"):
            x = t.number()
        elif a.func in ("min", "max"):
            x = t.string().try_cast("double") if t.text else t.col
        else:
            x = t.col
    return x if a.where is None else F.when(scope.condition(a.where), x)


def added(df: DataFrame, scope, aggs: list[Agg], names: list[str], by: list[str], time: str, order: list[Column], last: int) -> DataFrame:
    """Running aggregates from the first row on, of ADDED. last: 0 with the row itself, -1 without."""
    rows = sliced(df, by, time).withColumns({f"__x{i}": _value(scope, a) for i, a in enumerate(aggs)})
    keys = [*[q(b) for b in by], F.col("__slice")]
    w = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, last)
    local, totals, columns, out = {}, [], [], {}
    for i, (a, name) in enumerate(zip(aggs, names)):
        x = F.col(f"__x{i}")
        if a.func in ("first", "earliest", "last", "latest"):
            first = a.func in ("first", "earliest")
            pick, over, edge = (F.first, F.first, F.min_by) if first else (F.last, F.last, F.max_by)
            rank = F.struct(*[F.col(f"__o{k}") for k in range(len(order))])
            local[f"__l{i}"] = pick(F.struct(x.alias("v"))).over(w)
            totals.append(edge(F.struct(x.alias("v")), rank).alias(f"__t{i}"))
            columns.append((f"__b{i}", over(f"__t{i}", ignorenulls=True)))
            both = (f"__b{i}", f"__l{i}") if first else (f"__l{i}", f"__b{i}")
            out[name] = F.coalesce(*both)["v"]
            continue
        parts = {"count": ("n",), "sum": ("s", "n"), "avg": ("s", "n"), "mean": ("s", "n"), "min": ("lo",), "max": ("hi",), "range": ("lo", "hi")}[a.func]
        for p in parts:
            how, again = {"n": (F.count, F.sum), "s": (F.sum, F.sum), "lo": (F.min, F.min), "hi": (F.max, F.max)}[p]
            local[f"__l{p}{i}"] = how(x).over(w)
            totals.append(how(x).alias(f"__t{p}{i}"))
            columns.append((f"__b{p}{i}", again(f"__t{p}{i}")))
        n = F.coalesce(F.col(f"__bn{i}"), F.lit(0)) + F.col(f"__ln{i}") if "n" in parts else None
        s = F.when(n > 0, F.coalesce(F.col(f"__bs{i}"), F.lit(0)) + F.coalesce(F.col(f"__ls{i}"), F.lit(0))) if "s" in parts else None
        lo = F.least(F.col(f"__blo{i}"), F.col(f"__llo{i}")) if "lo" in parts else None
        hi = F.greatest(F.col(f"__bhi{i}"), F.col(f"__lhi{i}")) if "hi" in parts else None
        out[name] = {"count": lambda: n, "sum": lambda: s, "avg": lambda: s / n, "mean": lambda: s / n, "min": lambda: lo, "max": lambda: hi, "range": lambda: hi - lo}[a.func]()
    ranked = rows.withColumns({f"__o{k}": c for k, c in enumerate(_plain(order))})
    before = _before(ranked.groupBy(*keys).agg(*totals), by, columns)
    made = _joined(rows.withColumns(local), before, by).withColumns(out)
    return made.select(*[q(c) for c in df.columns if c not in names], *[q(n) for n in names])


def _plain(order: list[Column]) -> list[Column]:
    """The columns of an order whose first is ascending, nulls first, as values that compare likewise."""
    first, *ties = order
    return [F.coalesce(F.unix_micros(first.cast("timestamp")), F.lit(-(1 << 62))), *ties]


def last_rows(df: DataFrame, make, by: list[str], time: str, order: list[Column], n: int, last: int) -> DataFrame:
    """make(rows, window) over windows of n rows that end with the row itself (last 0) or before it (-1)."""
    rows = sliced(df, by, time)
    keys = [*[q(b) for b in by], F.col("__slice")]
    numbered = rows.withColumn("__r", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    before = _before(rows.groupBy(*keys).agg(F.count("*").alias("__t")), by, [("__b", F.sum("__t"))])
    placed = _joined(numbered, before, by).withColumn("__pos", F.coalesce("__b", F.lit(0)) + F.col("__r") - 1).drop("__b", "__r", "__slice")
    size = max(n + 1, CHUNK)
    chunk = F.call_function("div", F.col("__pos"), F.lit(size))
    own = F.struct(chunk.alias("chunk"), F.lit(False).alias("more"))
    more = F.struct((chunk + 1).alias("chunk"), F.lit(True).alias("more"))
    copies = F.when(F.col("__pos") % size >= size - n - 1, F.array(own, more)).otherwise(F.array(own))
    dealt = placed.withColumn("__d", F.explode(copies)).withColumns({"__chunk": F.col("__d.chunk"), "__more": F.col("__d.more")}).drop("__d")
    w = W.partitionBy(*[q(b) for b in by], "__chunk").orderBy("__pos").rowsBetween(last - n + 1, last)
    return make(dealt, w).filter(~F.col("__more")).drop("__chunk", "__more", "__pos")


def can_add(aggs: list[Agg]) -> bool:
    return all(a.func in ADDED and (a.arg is not None or a.func == "count") for a in aggs)

