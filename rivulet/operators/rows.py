"""Stages that work row by row."""

from __future__ import annotations

import fnmatch
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rivulet.plans import times
from rivulet.plans.ast import Field, In, Op
from rivulet.plans.errors import QueryError
from rivulet.plans.expressions import Typed, fold, java_regex
from rivulet.plans.state import State


def q(name: str):
    return F.col(f"`{name}`")


# -- filters --------------------------------------------------------------------------------------------------
def split_subsearches(x) -> tuple[list, list[In]]:
    """The conjuncts of x without, and those that are, IN [subsearch]; anywhere else these are refused."""
    parts = list(x.args) if isinstance(x, Op) and x.op == "and" else [x]
    plain, subs = [], []
    for p in parts:
        if isinstance(p, In) and p.query is not None:
            subs.append(p)
        elif isinstance(p, Op) and p.op == "not" and isinstance(p.args[0], In) and p.args[0].query is not None:
            i = p.args[0]
            subs.append(In(i.value, query=i.query, negated=not i.negated))
        elif isinstance(p, Op) and p.op == "and":
            a, b = split_subsearches(p)
            plain += a
            subs += b
        else:
            plain.append(p)
    return plain, subs


def filtered(st: State, x, search: bool) -> State:
    if x is None:
        return st
    plain, subs = split_subsearches(x)
    df = st.df
    scope = st.scope()
    if plain:
        tree = plain[0] if len(plain) == 1 else Op("and", tuple(plain))
        df = df.filter(scope.search(tree) if search else scope.condition(tree))
    for s in subs:
        df = semi(st.to(df), s)
    return st.to(df)


def semi(st: State, x: In) -> DataFrame:
    """Rows whose value is, or is not, in the one column of a subsearch: a semi or anti join on the folded text."""
    sub = st.engine.compile(x.query, st)
    names = [c for c in sub.df.columns if not c.startswith("__")]
    if len(names) != 1:
        raise QueryError(f"a subsearch of IN returns one column, not {len(names)}")
    values = sub.df.select(fold(q(names[0]).cast("string")).alias("__in")).filter("__in is not null")
    left = st.df.withColumn("__key", fold(st.scope().compile(x.value).string()))
    if x.negated:  # a null is neither in nor not in
        return left.filter("__key is not null").join(values, F.col("__key") == F.col("__in"), "left_anti").drop("__key")
    return left.join(values, F.col("__key") == F.col("__in"), "left_semi").drop("__key")


def where(st: State, a: dict) -> State:
    return filtered(st, a["where"], search=False)


def search(st: State, a: dict) -> State:
    return filtered(st, a["search"], search=True)


def regex(st: State, a: dict) -> State:
    scope = st.scope()
    if a["field"]:
        c = scope.column(a["field"]).string()
    else:
        body = [n for n in st.profile.body if n in st.df.columns]
        if not body:
            raise QueryError("regex needs a field here")
        c = q(body[0]).cast("string")
    hit = c.rlike(java_regex(a["pattern"], "s"))
    return st.to(st.df.filter(~hit if a["negated"] else hit))


# -- columns --------------------------------------------------------------------------------------------------
def put(df: DataFrame, name: str, c) -> DataFrame:
    return df.withColumn(name, c)


def evaluate(st: State, a: dict) -> State:
    for name, x in a["assign"]:
        t = st.scope().compile(x)
        st = st.to(put(st.df, name, t.col), created=st.created | {name})
    return st


def rename(st: State, a: dict) -> State:
    for old, new in a["pairs"]:
        scope = st.scope()
        if "*" in old:
            pattern = re.compile("^" + re.escape(old).replace(r"\*", "(.*)") + "$")
            pairs = [(c, new.replace("*", m[1], 1)) for c in st.df.columns if (m := pattern.match(c))]
        else:
            pairs = [(old, new)]
        for x, y in pairs:
            real = x if x in st.df.columns else st.aliases.get(x) or st.profile.aliases.get(x, x)
            if real not in st.df.columns:
                df = put(st.df, y, scope.column(x).col)
            else:
                cols = [q(c).alias(y) if c == real else q(c) for c in st.df.columns if c != y or c == real]
                df = st.df.select(cols)
            order = tuple((y if c == real else c, d) for c, d in st.order) if st.order else st.order
            st = st.to(df, created=st.created | {y}, order=order)
    return st


def expand(st: State, names: list[str]) -> list[str]:
    out = []
    for n in names:
        if "*" in n or "?" in n:
            out += [c for c in st.df.columns if fnmatch.fnmatchcase(c, n)]
        else:
            out.append(n)
    return list(dict.fromkeys(out))


def table(st: State, a: dict) -> State:
    scope, cols, names = st.scope(), [], []
    for name, alias in a["fields"]:
        for n in expand(st, [name]):
            out = alias or n
            if out not in names:
                names.append(out)
                cols.append(scope.column(n).col.alias(out))
    # The order stays, so what it is by goes along and is dropped behind the sort.
    order = st.order
    if order and not all(c in st.df.columns for c, _ in order):
        order = None
    keep = [(c, d) for c, d in order or () if c not in names]
    df = st.df.select(*cols, *[q(c).alias(f"__order_{c}") for c, _ in keep])
    new = tuple((f"__order_{c}" if (c, d) in keep else c, d) for c, d in order or ())
    return st.to(df, order=new or None, created=frozenset(names), reshaped=True)


def fields(st: State, a: dict) -> State:
    if a["drop"]:
        drop = set(expand(st, a["fields"])) | {st.profile.aliases.get(n, n) for n in a["fields"]}
        hidden = [(c, d) for c, d in st.order or () if c in drop]
        df = st.df.select([q(c) for c in st.df.columns if c not in drop] + [q(c).alias(f"__order_{c}") for c, _ in hidden if c in st.df.columns])
        order = tuple((f"__order_{c}" if (c, d) in hidden else c, d) for c, d in st.order or ())
        return st.to(df, order=order or None)
    return table(st, {"fields": [(n, None) for n in a["fields"]]})


def fillnull(st: State, a: dict) -> State:
    names = [st.profile.aliases.get(n, n) if n not in st.df.columns else n for n in a["fields"]] or [c for c in st.df.columns if not c.startswith("__")]
    df = st.df
    kinds = {f.name: f.dataType for f in df.schema}
    for n in names:
        if n not in kinds:
            df = put(df, n, F.lit(a["value"]))
        elif not isinstance(kinds[n], (T.ArrayType, T.MapType, T.StructType)):
            c = q(n).cast("string")
            if st.profile.empty_is_absent:
                c = F.when(c != "", c)
            df = put(df, n, F.coalesce(c, F.lit(a["value"])))
    return st.to(df, created=st.created | set(names))


def body_of(st: State) -> str:
    for n in (*st.profile.body, "message"):
        if n in st.df.columns:
            return n
    raise QueryError("a field is needed here")


def rex(st: State, a: dict) -> State:
    scope = st.scope()
    name = a.get("field") or ("message" if "message" in st.df.columns else body_of(st))
    c = F.coalesce(scope.column(name).string(), F.lit(""))
    pattern = a["pattern"].replace("(?P<", "(?<")
    if a.get("mode") == "sed":
        m = re.fullmatch(r"s(.)(.*?)(?<!\\)\1(.*?)(?<!\\)\1([gi]*)", pattern, re.S)
        if not m:
            raise QueryError("mode=sed takes s/pattern/replacement/flags")
        p = java_regex(m[2].replace("\\" + m[1], m[1]), "si" if "i" in m[4] else "s")
        by = re.sub(r"\\(\d)", r"$\1", m[3].replace("\\" + m[1], m[1]))
        if "g" in m[4]:
            new = F.regexp_replace(c, p, by)
        else:  # the first match only: what stands before it is kept as a group
            shifted = re.sub(r"\$(\d)", lambda g: f"${int(g[1]) + 1}", by)
            new = F.regexp_replace(c, r"(?s)\A(.*?)" + p, "$1" + shifted)
        return st.to(put(st.df, st.profile.aliases.get(name, name), new))
    named = re.findall(r"\(\?<([A-Za-z]\w*)>", pattern)
    # Java's groups have no underscores in their names: they are taken by number.
    plain = re.sub(r"\(\?<[A-Za-z]\w*>", "(", pattern)
    p = java_regex(plain, "s")
    if not named:
        group = 1 if re.compile(plain).groups else 0
        return st.to(put(st.df, "rex_matches", F.regexp_extract_all(c, F.lit(p), F.lit(group))), created=st.created | {"rex_matches"})
    df, most = st.df, int(a.get("max_match", 1))
    numbers, k = {}, 0
    for m in re.finditer(r"\\.|\[(?:\\.|[^\]])*\]|\((\?<([A-Za-z]\w*)>|\?)?", pattern):
        if m[0].startswith("(") and m[1] != "?":
            k += 1
            if m[2]:
                numbers[m[2]] = k
    for n in named:
        if most == 1:
            df = put(df, n, F.regexp_extract(c, p, numbers[n]))
        else:
            every = F.regexp_extract_all(c, F.lit(p), F.lit(numbers[n]))
            df = put(df, n, every if most == 0 else F.slice(every, 1, most))
    return st.to(df, created=st.created | set(named))


def spath(st: State, a: dict) -> State:
    path = a.get("path")
    if not path:
        raise QueryError("spath needs a path")
    source = a.get("input") or next((j for j in st.profile.json if j in st.df.columns), None) or body_of(st)
    out = a.get("output") or path
    c = F.get_json_object(st.scope().column(source).string(), "$." + path.replace("{}", "[*]"))
    return st.to(put(st.df, out, c), created=st.created | {out})


def bin_(st: State, a: dict) -> State:
    scope = st.scope()
    name = a.get("field") or st.profile.time
    t = scope.column(name)
    out = a.get("as") or (st.profile.aliases.get(name, name) if a.get("field") else "time_bucket")
    span = a.get("span")
    if span is None and a.get("bins"):
        if not t.time:
            raise QueryError("bins= is for time fields; give span= for numbers")
        first, last = st.engine.time_range(st)
        seconds = times.ladder_span(first, last, int(a["bins"]))
    elif span is None:
        raise QueryError("bin needs span= or bins=")
    elif re.fullmatch(r"\d+(\.\d+)?", span):
        if t.time:
            seconds = float(span)
        else:
            n = float(span)
            if n <= 0:
                raise QueryError("a span is positive")
            return st.to(put(st.df, out, F.floor(t.number() / n) * (int(n) if n.is_integer() else n)), created=st.created | {out})
    else:
        seconds = times.seconds(span)
    if seconds <= 0:
        raise QueryError("a span is positive")
    c = t.col.cast("timestamp")
    if a.get("type") == "sliding":
        end = F.timestamp_micros(F.unix_micros(c) + int(seconds * 1e6))
        return st.to(put(put(st.df, out + "_end", end), out, c), created=st.created | {out, out + "_end"})
    if a.get("hop"):
        # Each row in every window that holds it.
        hop = times.seconds(a["hop"])
        w = F.window(c, f"{int(seconds * 1e6)} microseconds", f"{int(hop * 1e6)} microseconds")
        df = st.df.withColumn("__w", w)
        df = df.withColumns({out: F.col("__w.start"), out + "_end": F.col("__w.end")}).drop("__w")
        return st.to(df, created=st.created | {out, out + "_end"}, order=st.order)
    return st.to(put(st.df, out, times.bucket(c, seconds)), created=st.created | {out})


#: Rows that mvexpand makes at most without a limit of its own.
MVEXPAND = 100_000


def mvexpand(st: State, a: dict) -> State:
    name = st.profile.aliases.get(a["field"], a["field"]) if a["field"] not in st.df.columns else a["field"]
    t = st.scope().column(name)
    df = put(st.df, name, F.explode_outer(t.col)) if t.array else st.df
    return st.to(df.limit(int(a.get("limit") or MVEXPAND)))


def risk(st: State, a: dict) -> State:
    scope = st.scope()
    score = scope.compile(a["score"]).number() if "score" in a else F.lit(0)
    weight = scope.compile(a["weight"]).number() if "weight" in a else F.lit(1)
    raw = F.coalesce(score * weight, F.lit(0)).cast("double")
    if "raw_risk_score" in st.df.columns:
        raw = raw + q("raw_risk_score")
    entity = a.get("entity")
    e = scope.compile(entity).string() if entity is not None else F.coalesce(*[q(n).cast("string") for n in st.profile.entity if n in st.df.columns], F.lit(None).cast("string"))
    factor = a.get("factor")
    f = F.lit(None).cast("string") if factor is None else scope.compile(factor).string() if not isinstance(factor, Field) or factor.name in st.df.columns else F.lit(factor.name)
    factors = F.filter(F.array(f), lambda x: x.isNotNull())
    if "risk_factors" in st.df.columns:
        factors = F.concat(q("risk_factors"), factors)
    made = {
        "raw_risk_score": raw,
        "risk_score": F.least(F.greatest(F.round(raw), F.lit(0)), F.lit(100)).cast("int"),
        "risk_entity": F.coalesce(F.when(e != "", e), F.lit("unknown")),
        "risk_factors": factors,
    }
    return st.to(st.df.withColumns(made), created=st.created | set(made))


def format_(st: State, a: dict) -> State:
    """All rows as one search: (f="v" AND …) OR (…), in their order."""
    sep, row_sep = a.get("sep", " AND "), a.get("row_sep", " OR ")
    names = [c for c in st.df.columns if not c.startswith("__")]
    one = F.concat(F.lit("("), F.concat_ws(sep, *[F.when(q(c).isNotNull(), F.concat(F.lit(f'{c}="'), q(c).cast("string"), F.lit('"'))) for c in names]), F.lit(")"))
    keys = [F.col(f"`{c}`") for c, _ in st.order or ()]
    desc = bool(st.order) and st.order[0][1]
    rows = F.array_sort(F.collect_list(F.struct(*keys, one.alias("__one"))))
    rows = F.reverse(rows) if desc else rows
    df = st.df.agg(F.array_join(F.transform(rows, lambda r: r["__one"]), row_sep).alias("search"))
    return st.rows(df)


def return_(st: State, a: dict) -> State:
    df = st.ordered().limit(a["n"] or 10)
    scope = st.to(df).scope()
    names = a["fields"] or [c for c in df.columns if not c.startswith("__")][:1]
    return st.rows(df.select([scope.column(n).col.alias(n) for n in names]))


def sample(st: State, a: dict) -> State:
    """n rows by a hash of their content, so that reruns agree."""
    flat = [q(f.name) for f in st.df.schema if not isinstance(f.dataType, T.MapType)]
    return st.to(st.df.orderBy(F.xxhash64(*flat), *[q(f.name) for f in st.df.schema if f.name == "id"]).limit(a["n"]))


def ai(st: State, a: dict) -> State:
    """Verdicts of a function that the engine was given; without one the stage is refused."""
    judge = st.engine.ai
    if judge is None:
        raise QueryError("no verdict function is registered for ai")
    rows = min(int(a.get("max_rows", 100)), 500)
    df = judge(st.ordered().limit(rows), a.get("prompt", ""))
    return st.to(df, created=st.created | {"ai_verdict", "ai_confidence", "ai_reasoning"})


STAGES = {"where": where, "search": search, "regex": regex, "eval": evaluate, "rename": rename, "table": table, "fields": fields, "fillnull": fillnull, "rex": rex, "spath": spath, "bin": bin_, "mvexpand": mvexpand, "risk": risk, "format": format_, "return": return_, "sample": sample, "ai": ai}
