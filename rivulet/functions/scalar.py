"""The scalar functions of the language: name to arity and a builder of a column."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import functions as F
from pyspark.sql import types as T

from rivulet.functions import ip as ips
from rivulet.plans import times
from rivulet.plans.ast import Call, Field, In, Lit
from rivulet.plans.errors import QueryError
from rivulet.plans.expressions import Scope, Typed, balanced, fold, folded, java_regex, like_regex

MANY = 99
REGISTRY: dict[str, tuple[int, int, Callable]] = {}


def function(names: str, least: int, most: int | None = None):
    def register(f: Callable) -> Callable:
        for n in names.split():
            REGISTRY[n] = least, least if most is None else most, f
        return f

    return register


def call(scope: Scope, x: Call) -> Typed:
    if x.name not in REGISTRY:
        import difflib

        near = difflib.get_close_matches(x.name, REGISTRY, 1)
        raise QueryError(f"there is no function {x.name!r}" + (f"; did you mean {near[0]!r}?" if near else ""))
    least, most, f = REGISTRY[x.name]
    if not least <= len(x.args) <= most:
        raise QueryError(f"{x.name} takes {least}" + (f" to {most}" if most != least else "") + f" arguments, not {len(x.args)}")
    out = f(scope, *x.args)
    return out if isinstance(out, Typed) else scope.typed(out)


def text_of(x) -> str:
    """The text of a literal argument."""
    if isinstance(x, Lit):
        return str(x.value)
    if isinstance(x, Field):
        return x.name
    raise QueryError("a literal is needed here")


def simple(names: str, least: int, build: Callable, most: int | None = None, kind: str = "string") -> None:
    """A function whose arguments are all texts, or numbers."""
    take = (lambda t: t.string()) if kind == "string" else (lambda t: t.number())

    @function(names, least, most)
    def f(scope, *args):
        return build(*[take(scope.compile(a)) for a in args])


# -- strings --------------------------------------------------------------------------------------------------
simple("len length", 1, lambda s: F.char_length(s))
simple("lower", 1, fold)
simple("upper", 1, lambda s: F.translate(s, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"))


def _trim(side):
    def build(scope, s, chars=None):
        c = scope.compile(s).string()
        if chars is None:
            return side(c)
        inner = "[" + re.escape(text_of(chars)) + "]+"
        if side is not F.rtrim:
            c = F.regexp_replace(c, "^" + inner, "")
        return F.regexp_replace(c, inner + "$", "") if side is not F.ltrim else c

    return build


function("trim", 1, 2)(_trim(F.trim))
function("ltrim", 1, 2)(_trim(F.ltrim))
function("rtrim", 1, 2)(_trim(F.rtrim))


@function("substr substring", 2, 3)
def _substr(scope, s, start, n=None):
    c, at = scope.compile(s).string(), scope.compile(start).number().cast("int")
    at = F.when(at < 0, F.greatest(F.char_length(c) + at, F.lit(0))).otherwise(at)
    return F.substring(c, at + 1, F.char_length(c) if n is None else scope.compile(n).number().cast("int"))


@function("split", 2)
def _split(scope, s, d):
    return F.split(scope.compile(s).string(), re.escape(text_of(d)) if text_of(d) else "")


@function("replace", 3)
def _replace(scope, s, a, b):
    return F.replace(scope.compile(s).string(), scope.compile(a).string(), scope.compile(b).string())


simple("concat", 1, lambda *c: F.concat(*c), MANY)


@function("printf format", 1, MANY)
def _printf(scope, fmt, *args):
    """Each argument takes the type that its place in the format wants; a bad value is null."""
    text = text_of(fmt)
    wants = re.findall(r"%[-+ 0#]*\d*(?:\.\d+)?([a-zA-Z%])", text)
    wants = [w for w in wants if w != "%"]
    cols = [scope.compile(a) for a in args]
    if len(wants) != len(cols):
        raise QueryError("the format has another number of places than there are arguments")
    typed = [c.number().cast("long") if w in "dxXo" else c.number().cast("double") if w in "fFeEgG" else c.string() for c, w in zip(cols, wants)]
    return F.format_string(text.replace("%i", "%d"), *typed) if typed else F.lit(text.replace("%%", "%"))


@function("reverse", 1)
def _reverse(scope, s):
    t = scope.compile(s)
    return F.reverse(t.col if t.array else t.string())


# -- mathematics ----------------------------------------------------------------------------------------------
@function("round", 1, 2)
def _round(scope, x, n=None):
    return F.round(scope.compile(x).number().cast("double"), int(float(text_of(n))) if n is not None else 0)


simple("ceil ceiling", 1, lambda x: F.ceil(x), kind="number")
simple("floor", 1, lambda x: F.floor(x), kind="number")
simple("abs", 1, lambda x: F.abs(x), kind="number")
simple("pow power", 2, lambda x, y: F.pow(x, y), kind="number")
simple("sqrt", 1, lambda x: F.when(x >= 0, F.sqrt(x)), kind="number")
simple("log10", 1, lambda x: F.log10(x), kind="number")
simple("ln", 1, lambda x: F.ln(x), kind="number")
simple("log", 1, lambda x, b=None: F.ln(x) if b is None else F.ln(x) / F.ln(b), 2, kind="number")
simple("exp", 1, lambda x: F.exp(x), kind="number")
simple("min", 2, lambda *c: F.least(*[x.cast("double") for x in c]), MANY, kind="number")
simple("max", 2, lambda *c: F.greatest(*[x.cast("double") for x in c]), MANY, kind="number")


# -- conditions -----------------------------------------------------------------------------------------------
def _same(scope, args) -> list:
    """Columns of one type: numbers if all are, else the same type, else text."""
    ts = [scope.compile(a) for a in args]
    real = [t for t in ts if not (t.lit and t.lit.kind == "null")]
    if real and all(t.numeric for t in real):
        whole = all(isinstance(t.kind, (T.IntegerType, T.LongType, T.ShortType, T.ByteType)) for t in real)
        return [t.col.cast("long" if whole else "double") for t in ts]
    if real and all(t.kind == real[0].kind for t in real):
        return [t.col.cast(real[0].kind) for t in ts]
    return [t.string() for t in ts]


@function("if", 3)
def _if(scope, c, a, b):
    x, y = _same(scope, (a, b))
    return F.when(scope.condition(c), x).otherwise(y)


@function("case", 2, MANY)
def _case(scope, *args):
    values = _same(scope, [*args[1::2], *([args[-1]] if len(args) % 2 else [])])
    out = None
    for c, v in zip(args[0 : len(args) - len(args) % 2 : 2], values):
        out = F.when(scope.condition(c), v) if out is None else out.when(scope.condition(c), v)
    return out.otherwise(values[-1]) if len(args) % 2 else out


def _present(scope, t: Typed):
    return F.when(t.col != "", t.col) if scope.profile.empty_is_absent and t.text else t.col


@function("coalesce", 1, MANY)
def _coalesce(scope, *args):
    cols = _same(scope, args)
    if scope.profile.empty_is_absent:
        cols = [F.when(c.cast("string") != "", c) for c in cols]
    return F.coalesce(*cols)


@function("null", 0)
def _null(scope):
    return F.lit(None).cast("string")


@function("nullif", 2)
def _nullif(scope, a, b):
    x, y = _same(scope, (a, b))
    return F.nullif(x, y)


@function("isnull", 1)
def _isnull(scope, a):
    return _present(scope, scope.compile(a)).isNull()


@function("isnotnull", 1)
def _isnotnull(scope, a):
    return _present(scope, scope.compile(a)).isNotNull()


@function("typeof", 1)
def _typeof(scope, a):
    t = scope.compile(a)
    name = "Number" if t.numeric else "Boolean" if isinstance(t.kind, T.BooleanType) else "Array" if t.array else "Timestamp" if t.time else "String"
    return F.when(t.col.isNull(), "Null").otherwise(name)


@function("isnum", 1)
def _isnum(scope, a):
    return F.coalesce(scope.compile(a).string().try_cast("double").isNotNull(), F.lit(False))


@function("isint", 1)
def _isint(scope, a):
    return F.coalesce(scope.compile(a).string().rlike(r"^-?\d+$"), F.lit(False))


@function("isstr", 1)
def _isstr(scope, a):
    t = scope.compile(a)
    return t.col.isNotNull() & F.lit(t.text)


@function("isbool", 1)
def _isbool(scope, a):
    t = scope.compile(a)
    return t.col.isNotNull() & F.lit(isinstance(t.kind, T.BooleanType))


# -- conversion -----------------------------------------------------------------------------------------------
@function("tonumber", 1)
def _tonumber(scope, a):
    return scope.compile(a).string().try_cast("double")


@function("toint tolong", 1)
def _toint(scope, a):
    t = scope.compile(a)
    return t.col.cast("long") if t.numeric else F.floor(t.string().try_cast("double")).cast("long")


@function("tostring", 1, 2)
def _tostring(scope, a, fmt=None):
    t = scope.compile(a)
    if fmt is None:
        return t.string()
    kind = text_of(fmt).lower()
    if kind == "hex":
        return F.concat(F.lit("0x"), F.lower(F.hex(t.number().cast("long"))))
    if kind == "commas":
        return F.format_number(t.number(), 0)
    if kind == "duration":
        n = t.number().cast("long")
        return F.format_string("%02d:%02d:%02d", F.floor(n / 3600), F.floor(n / 60) % 60, n % 60)
    if t.time:
        return F.date_format(t.col, strftime(kind if kind.startswith("%") else text_of(fmt)))
    raise QueryError(f"tostring knows hex, commas and duration, not {kind!r}")


# -- dates and times ------------------------------------------------------------------------------------------
#: Strftime letters and the date patterns of Java.
STRFTIME = {"Y": "yyyy", "y": "yy", "m": "MM", "d": "dd", "e": "d", "H": "HH", "I": "hh", "M": "mm", "S": "ss", "p": "a", "b": "MMM", "B": "MMMM", "a": "EEE", "A": "EEEE", "j": "DDD", "f": "SSSSSS", "z": "xx", "Z": "z", "F": "yyyy-MM-dd", "T": "HH:mm:ss", "3N": "SSS", "6N": "SSSSSS"}


def strftime(fmt: str) -> str:
    out, i = [], 0
    while i < len(fmt):
        if fmt[i] == "%":
            key = fmt[i + 1 : i + 3] if fmt[i + 1 : i + 3] in STRFTIME else fmt[i + 1 : i + 2]
            if key == "%":
                out.append("%")
            elif key in STRFTIME:
                out.append(STRFTIME[key])
            else:
                raise QueryError(f"unknown time format %{key}")
            i += 1 + len(key)
        else:
            j = i
            while j < len(fmt) and fmt[j] != "%":
                j += 1
            part = fmt[i:j]
            out.append("".join(f"'{run}'" if run[0].isalpha() else run.replace("'", "''") for run in re.findall(r"[A-Za-z]+|[^A-Za-z]+", part)))
            i = j
    return "".join(out)


def moment(t: Typed):
    """A timestamp of a time, of epoch seconds or of text."""
    if t.time:
        return t.col.cast("timestamp")
    if t.numeric:
        return F.timestamp_micros((t.number() * 1e6).cast("long"))
    return F.coalesce(t.string().try_cast("timestamp"), F.timestamp_micros((t.string().try_cast("double") * 1e6).cast("long")))


def _now(scope):
    return F.lit(scope.now).cast("timestamp") if scope.now is not None else F.current_timestamp()


@function("now", 0)
def _now_f(scope):
    return _now(scope)


@function("today", 0)
def _today(scope):
    return F.to_date(_now(scope))


@function("yesterday", 0)
def _yesterday(scope):
    return F.date_sub(F.to_date(_now(scope)), 1)


@function("relative_time", 2)
def _relative(scope, t, mod):
    c = moment(scope.compile(t))
    m = re.fullmatch(r"((?:[+-]\d+[A-Za-z]+)*)(?:@([A-Za-z]+)([0-7])?)?", text_of(mod))
    if not m:
        raise QueryError(f"not a time modifier: {text_of(mod)}")
    shift = sum((1 if s == "+" else -1) * times.seconds(n + u) for s, n, u in re.findall(r"([+-])(\d+)([A-Za-z]+)", m[1]))
    c = F.timestamp_micros(F.unix_micros(c) + F.lit(int(shift * 1e6)))
    if not m[2]:
        return c
    unit = times.NAMES.get(m[2], m[2])
    if unit == "w":
        day = F.date_trunc("day", c)
        back = F.pmod(F.dayofweek(day) - 1 - int(m[3] or 0), F.lit(7))
        return F.timestamp_micros(F.unix_micros(day) - back.cast("long") * 86_400_000_000)
    return F.date_trunc({"s": "second", "m": "minute", "h": "hour", "d": "day", "M": "month", "y": "year"}[unit], c)


@function("strftime", 2)
def _strftime(scope, t, fmt):
    if text_of(fmt) == "%s":
        return F.unix_timestamp(moment(scope.compile(t))).cast("string")
    return F.date_format(moment(scope.compile(t)), strftime(text_of(fmt)))


@function("strptime", 2)
def _strptime(scope, s, fmt):
    return F.try_to_timestamp(scope.compile(s).string(), F.lit(strftime(text_of(fmt))))


@function("epoch", 1)
def _epoch(scope, t):
    return F.unix_timestamp(moment(scope.compile(t)))


@function("from_epoch", 1)
def _from_epoch(scope, n):
    return F.timestamp_micros((scope.compile(n).number() * 1e6).cast("long"))


def _unit(x) -> str:
    u = text_of(x).lower().rstrip("s") if len(text_of(x)) > 2 else text_of(x)
    return {"s": "second", "m": "minute", "h": "hour", "d": "day", "w": "week", "M": "month", "y": "year", "mo": "month"}.get(u, u)


def _shifted(scope, t, n, unit, sign):
    """date_add(t, n, unit) or date_add(t, unit, n); days without a unit."""
    if isinstance(n, (Lit, Field)) and not (isinstance(n, Lit) and n.kind == "number"):
        n, unit = unit, n
    u = _unit(unit) if unit is not None else "day"
    k = scope.compile(n).number().cast("int") * sign
    c = moment(scope.compile(t))
    if u in ("month", "year", "quarter"):
        months = k * {"month": 1, "quarter": 3, "year": 12}[u]
        return c + F.make_ym_interval(F.lit(0), months)
    return F.timestamp_micros(F.unix_micros(c) + k.cast("long") * int({"second": 1, "minute": 60, "hour": 3600, "day": 86400, "week": 604800}[u] * 1e6))


@function("date_add", 2, 3)
def _date_add(scope, t, n, unit=None):
    return _shifted(scope, t, n, unit, 1)


@function("date_sub", 2, 3)
def _date_sub(scope, t, n, unit=None):
    return _shifted(scope, t, n, unit, -1)


@function("date_diff", 2, 3)
def _date_diff(scope, *args):
    """date_diff(unit, a, b) or date_diff(a, b): whole units from a to b, seconds without a unit."""
    unit, a, b = args if len(args) == 3 else (Lit("second"), *args)
    micros = F.unix_micros(moment(scope.compile(b))) - F.unix_micros(moment(scope.compile(a)))
    u = _unit(unit)
    if u in ("month", "year", "quarter"):
        whole = F.months_between(moment(scope.compile(b)), moment(scope.compile(a)))
        return F.expr("bigint(0)") + (whole / {"month": 1, "quarter": 3, "year": 12}[u]).cast("long")
    return (micros / (1e6 * {"second": 1, "minute": 60, "hour": 3600, "day": 86400, "week": 604800}[u])).cast("long")


@function("time_diff", 2)
def _time_diff(scope, a, b):
    """Seconds from b to a."""
    return F.unix_timestamp(moment(scope.compile(a))) - F.unix_timestamp(moment(scope.compile(b)))


@function("date_trunc", 2)
def _date_trunc(scope, unit, t):
    return F.date_trunc(_unit(unit), moment(scope.compile(t)))


@function("date_part", 2)
def _date_part(scope, unit, t):
    return PARTS[_unit(unit)](moment(scope.compile(t)))


PARTS = {
    "year": F.year, "month": F.month, "day": F.dayofmonth, "hour": F.hour, "minute": F.minute, "second": F.second,
    "dayofweek": lambda t: F.weekday(t) + 1, "dow": lambda t: F.weekday(t) + 1, "week": F.weekofyear, "quarter": F.quarter, "dayofyear": F.dayofyear,
}
for _name, _build in PARTS.items():
    if _name != "dow":
        function(_name, 1)(lambda scope, t, build=_build: build(moment(scope.compile(t))))


@function("timezone", 2)
def _timezone(scope, t, zone):
    return F.from_utc_timestamp(moment(scope.compile(t)), text_of(zone))


@function("to_timestamp", 1, 2)
def _to_timestamp(scope, s, fmt=None):
    return moment(scope.compile(s)) if fmt is None else _strptime(scope, s, fmt)


@function("to_date", 1)
def _to_date(scope, s):
    return F.to_date(moment(scope.compile(s)))


def _ints(scope, args):
    return [scope.compile(a).number().cast("int") for a in args]


@function("make_date", 3)
def _make_date(scope, *args):
    y, m, d = _ints(scope, args)
    return F.format_string("%04d-%02d-%02d", y, m, d).try_cast("date")


@function("make_time", 3)
def _make_time(scope, *args):
    h, m, s = _ints(scope, args)
    return F.when(h.between(0, 23) & m.between(0, 59) & s.between(0, 59), F.format_string("%02d:%02d:%02d", h, m, s))


@function("make_timestamp", 6)
def _make_timestamp(scope, *args):
    return F.format_string("%04d-%02d-%02d %02d:%02d:%02d", *_ints(scope, args)).try_cast("timestamp")


# -- arrays ---------------------------------------------------------------------------------------------------
def _array(scope, x):
    t = scope.compile(x)
    return t.col if t.array else F.when(t.col.isNotNull(), F.array(t.string()))


@function("mvcount array_length", 1)
def _mvcount(scope, a):
    return F.size(F.coalesce(_array(scope, a), F.array().cast(scope.kind_of(_array(scope, a)))))


@function("mvindex", 2, 3)
def _mvindex(scope, a, i, j=None):
    c, k = _array(scope, a), scope.compile(i).number().cast("int")
    at = lambda n: F.when(n < 0, F.size(c) + n).otherwise(n)
    if j is None:
        return F.get(c, at(k))
    m = at(scope.compile(j).number().cast("int"))
    return F.slice(c, at(k) + 1, F.greatest(m - at(k) + 1, F.lit(0)))


@function("mvfilter", 1, 2)
def _mvfilter(scope, a, b=None):
    """mvfilter(array, condition) or mvfilter(condition): the elements for which the condition on its field holds."""
    cond, arr = (b, a) if b is not None else (a, None)
    names = _fields_in(cond)
    if arr is None:
        arr = Field(names[0])
    c = arr_column = _array(scope, arr)
    inner = scope.kind_of(c).elementType

    def keep(e):
        class Element(Scope):
            def column(self, name):
                return Typed(e, inner)

            def kind_of(self, c):
                # The element as a column of its name, where the expression has a type outside the filter too.
                first = F.element_at(arr_column, 1).alias(e._jc.toString())
                return scope.df.select(first).select(c.alias("x")).schema[0].dataType

        s = Element(scope.df, scope.profile, scope.created, scope.engine)
        return s.condition(cond)

    return F.filter(c, keep)


def _fields_in(x) -> list[str]:
    if isinstance(x, Field):
        return [x.name]
    parts = list(getattr(x, "args", ())) + ([x.value] if isinstance(x, In) else [])
    return [n for p in parts for n in _fields_in(p)]


@function("mvjoin array_join", 2)
def _mvjoin(scope, a, d):
    return F.array_join(_array(scope, a).cast("array<string>"), text_of(d))


@function("mvsort", 1)
def _mvsort(scope, a):
    return F.array_sort(_array(scope, a))


@function("mvdedup", 1)
def _mvdedup(scope, a):
    return F.array_distinct(_array(scope, a))


@function("array_contains", 2)
def _array_contains(scope, a, v):
    want = fold(scope.compile(v).string())
    return F.exists(_array(scope, a).cast("array<string>"), lambda e: fold(e) == want)


@function("has", 2)
def _has(scope, a, v):
    """Whether an element contains the text, in any case."""
    want = fold(scope.compile(v).string())
    return F.coalesce(F.exists(_array(scope, a).cast("array<string>"), lambda e: fold(e).contains(want)), F.lit(False))


# -- addresses ------------------------------------------------------------------------------------------------
@function("cidrmatch cidr_match", 2, MANY)
def _cidrmatch(scope, *args):
    """The networks are the literal arguments with a slash; the address is the other one."""
    nets = [str(a.value) for a in args if isinstance(a, Lit) and "/" in str(a.value)]
    rest = [a for a in args if not (isinstance(a, Lit) and "/" in str(a.value))]
    if len(rest) != 1 or not nets:
        raise QueryError("cidrmatch takes literal networks and one address")
    c = scope.compile(rest[0]).string()
    return balanced([ips.in_cidr(c, n) for n in nets], "or")


simple("is_private_ip", 1, ips.is_private)
simple("is_public_ip", 1, ips.is_public)
simple("is_loopback", 1, ips.is_loopback)
simple("ipv4_to_int", 1, ips.to_long)
simple("int_to_ipv4", 1, ips.from_long, kind="number")


# -- URLs and domains -----------------------------------------------------------------------------------------
def url_host(u):
    return F.lower(F.regexp_extract(u, r"^(?:[A-Za-z][A-Za-z0-9+.-]*://)?(?:[^/?#@]*@)?([^/?#:]*)", 1))


def _labels(u):
    return F.split(url_host(u), r"\.")


simple("extract_domain", 1, url_host)
simple("extract_tld", 1, lambda u: F.element_at(_labels(u), -1))
simple("extract_path", 1, lambda u: F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1))
simple("extract_root_domain", 1, lambda u: F.array_join(F.slice(_labels(u), F.greatest(F.size(_labels(u)) - 1, F.lit(1)), F.lit(2)), "."))
simple("extract_subdomain", 1, lambda u: F.array_join(F.slice(_labels(u), F.lit(1), F.greatest(F.size(_labels(u)) - 2, F.lit(0))), "."))
simple("domain_depth", 1, lambda u: F.size(_labels(u)))
simple("defang", 1, lambda s: F.regexp_replace(F.replace(s, F.lit("."), F.lit("[.]")), "(?i)^http", "hxxp"))
simple("refang", 1, lambda s: F.regexp_replace(F.replace(s, F.lit("[.]"), F.lit(".")), "(?i)^hxxp", "http"))

# -- encodings and hashes -------------------------------------------------------------------------------------
_decoded = lambda s, how: F.make_valid_utf8(F.try_to_binary(s, F.lit(how)).cast("string"))
simple("base64_encode", 1, lambda s: F.base64(F.encode(s, "UTF-8")))
simple("base64_decode", 1, lambda s: _decoded(s, "base64"))
simple("hex_encode", 1, lambda s: F.lower(F.hex(s)))
simple("hex_decode fromhex", 1, lambda s: _decoded(s, "hex"))
simple("url_encode", 1, lambda s: F.url_encode(s))
simple("url_decode urldecode", 1, lambda s: F.try_url_decode(s))
simple("md5", 1, lambda s: F.md5(s))
simple("sha1", 1, lambda s: F.sha1(s))
simple("sha256", 1, lambda s: F.sha2(s, 256))
simple("sha512", 1, lambda s: F.sha2(s, 512))


# -- matching -------------------------------------------------------------------------------------------------
@function("like", 2)
def _like(scope, s, pattern):
    return fold(scope.compile(s).string()).rlike(like_regex(folded(text_of(pattern))))


@function("match regex_match", 2)
def _match(scope, s, pattern):
    return scope.compile(s).string().rlike(java_regex(text_of(pattern), "s"))


@function("exact", 2)
def _exact(scope, a, b):
    return scope.compile(a).string() == scope.compile(b).string()


@function("in", 2, MANY)
def _in(scope, value, *items):
    return scope.membership(In(value, tuple(i if isinstance(i, Lit) else Lit(text_of(i)) for i in items)))


@function("searchmatch", 1)
def _searchmatch(scope, text):
    from rivulet.plans.parser import parse

    q = parse(text_of(text))
    if q.stages or q.dataset:
        raise QueryError("searchmatch takes search terms only")
    return scope.search(q.search)


@function("regex_extract", 2, 3)
def _regex_extract(scope, s, pattern, group=None):
    p = text_of(pattern)
    n = int(text_of(group)) if group is not None else (1 if re.compile(p.replace("(?<", "(?P<")).groups else 0)
    return F.regexp_extract(scope.compile(s).string(), java_regex(p, "s"), n)


@function("regex_replace", 3)
def _regex_replace(scope, s, pattern, by):
    return F.regexp_replace(scope.compile(s).string(), java_regex(text_of(pattern), "s"), re.sub(r"\\(\d)", r"$\1", text_of(by)))


# -- security -------------------------------------------------------------------------------------------------
@function("entropy", 1)
def _entropy(scope, s):
    c = scope.compile(s).string()
    n = F.char_length(c).cast("double")
    each = F.transform(F.array_distinct(F.filter(F.split(c, ""), lambda e: e != "")), lambda e: (n - F.char_length(F.replace(c, e, F.lit("")))) / n)
    return F.when(c.isNotNull(), F.aggregate(each, F.lit(0.0), lambda acc, p: acc - p * F.log2(p)))


#: Beyond so many characters the edit distance is null.
LEVENSHTEIN = 1000


def _levenshtein(a, b):
    return F.when((F.char_length(a) <= LEVENSHTEIN) & (F.char_length(b) <= LEVENSHTEIN), F.levenshtein(a, b))


simple("levenshtein", 2, _levenshtein)
simple("levenshtein_normalized", 2, lambda a, b: _levenshtein(a, b) / F.nullif(F.greatest(F.char_length(a), F.char_length(b)), F.lit(0)))


def _bigrams(s):
    at = F.sequence(F.lit(1), F.greatest(F.char_length(s) - 1, F.lit(1)))
    return F.array_distinct(F.transform(at, lambda i: F.substring(s, i, F.lit(2))))


simple("ngram_distance", 2, lambda a, b: 1 - 2 * F.size(F.array_intersect(_bigrams(a), _bigrams(b))) / (F.size(_bigrams(a)) + F.size(_bigrams(b))))


@function("spath", 2)
def _spath(scope, s, path):
    return F.get_json_object(scope.compile(s).string(), "$." + text_of(path))
