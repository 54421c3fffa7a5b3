"""Expressions and search terms to Spark columns."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rivulet.functions import ip as ips
from rivulet.plans.ast import Call, Field, In, Ioc, Keyword, Lit, Op, Term
from rivulet.plans.errors import QueryError
from rivulet.plans.profile import Profile

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def fold(c: Column) -> Column:
    """Lower case of ASCII letters only."""
    return F.translate(c, UPPER, LOWER)


def folded(text: str) -> str:
    return text.translate(str.maketrans(UPPER, LOWER))


@dataclass
class Typed:
    """A column, its type, and the literal it stands for, if any."""

    col: Column
    kind: T.DataType
    lit: Lit | None = None

    @property
    def numeric(self) -> bool:
        return isinstance(self.kind, NUMERIC)

    @property
    def text(self) -> bool:
        return isinstance(self.kind, T.StringType)

    @property
    def array(self) -> bool:
        return isinstance(self.kind, T.ArrayType)

    @property
    def time(self) -> bool:
        return isinstance(self.kind, (T.TimestampType, T.TimestampNTZType, T.DateType))

    def string(self) -> Column:
        return self.col if self.text else self.col.cast("string")

    def number(self) -> Column:
        if self.numeric:
            return self.col.cast("double") if isinstance(self.kind, T.DecimalType) else self.col
        if self.time:
            return F.unix_micros(self.col.cast("timestamp")) / 1e6
        if isinstance(self.kind, T.BooleanType):
            return self.col.cast("int")
        return self.string().try_cast("double")


@dataclass
class Scope:
    """Where names are looked up: a frame, its profile, and what stages created."""

    df: DataFrame
    profile: Profile
    created: frozenset[str] = frozenset()
    engine: object = None
    reshaped: bool = False
    aliases: dict[str, str] = field(default_factory=dict)
    now: object = None

    def kind_of(self, c: Column) -> T.DataType:
        return self.df.select(c.alias("x")).schema[0].dataType

    def typed(self, c: Column, kind: T.DataType | None = None, lit: Lit | None = None) -> Typed:
        return Typed(c, kind or self.kind_of(c), lit)

    def column(self, name: str) -> Typed:
        found = self.profile.resolve(name, self.df.schema, self.created)
        if found is None and name in self.aliases:
            found = self.profile.resolve(self.aliases[name], self.df.schema, self.created)
        if found is None:
            import difflib

            near = difflib.get_close_matches(name, [*self.df.columns, *self.profile.aliases], 1)
            raise QueryError(f"there is no field {name!r}" + (f"; did you mean {near[0]!r}?" if near else ""))
        return Typed(*found)

    def is_field(self, name: str) -> bool:
        return name in self.df.columns or name in self.aliases or self.profile.aliases.get(name) in self.df.columns

    # -- expressions ------------------------------------------------------------------------------------------
    def compile(self, x) -> Typed:
        if isinstance(x, Lit):
            return literal(x)
        if isinstance(x, Field):
            return self.column(x.name)
        if isinstance(x, Call):
            from rivulet.functions.scalar import call

            return call(self, x)
        if isinstance(x, In):
            return Typed(self.membership(x), T.BooleanType())
        if isinstance(x, Op):
            return self.operation(x)
        return Typed(self.search(x), T.BooleanType())

    def condition(self, x) -> Column:
        """x as a predicate of where."""
        t = self.compile(x)
        if isinstance(t.kind, T.BooleanType):
            return t.col
        if t.numeric:
            return t.col != 0
        return fold(t.string()) == "true"

    def operation(self, x: Op) -> Typed:
        if x.op in ("and", "or"):
            return Typed(balanced([self.condition(a) for a in x.args], x.op), T.BooleanType())
        if x.op == "not":
            return Typed(~self.condition(x.args[0]), T.BooleanType())
        a, b = x.args
        if isinstance(b, Field) and x.op in ("=", "!=", "like", "contains", "startswith", "endswith") and not self.is_field(b.name):
            b = Lit(b.name)  # a bare word
        if x.op in ("=", "!=", "<", ">", "<=", ">=", "=~", "!~", "like", "contains", "startswith", "endswith"):
            return Typed(self.compare(self.compile(a), x.op, b if isinstance(b, Lit) else None, None if isinstance(b, Lit) else self.compile(b), globs=False, name=a.name if isinstance(a, Field) else ""), T.BooleanType())
        left, right = self.compile(a), self.compile(b)
        if x.op == ".":
            return Typed(F.concat(left.string(), right.string()), T.StringType())
        if x.op == "+" and (left.text or right.text) and not (left.lit and left.lit.kind == "number" and right.lit and right.lit.kind == "number"):
            return Typed(F.concat(left.string(), right.string()), T.StringType())
        if x.op == "-" and left.time and right.time:
            return Typed(F.unix_timestamp(left.col.cast("timestamp")) - F.unix_timestamp(right.col.cast("timestamp")), T.LongType())
        if x.op in "+-" and left.time and right.numeric:
            micros = (right.number() * 1e6).cast("long")
            return Typed(F.timestamp_micros(F.unix_micros(left.col) + (micros if x.op == "+" else -micros)), T.TimestampType())
        p, q = left.number(), right.number()
        col = {"+": p + q, "-": p - q, "*": p * q, "/": F.try_divide(p.cast("double"), q.cast("double")), "%": F.try_mod(p, q)}[x.op]
        return self.typed(col)

    # -- comparison -------------------------------------------------------------------------------------------
    def compare(self, left: Typed, op: str, lit: Lit | None, right: Typed | None, globs: bool, name: str = "") -> Column:
        op = {"=~": "=", "!~": "!="}.get(op, op) if lit is not None and lit.kind == "regex" else op
        if op in ("=~", "!~"):
            lit, op = Lit(lit.value, "regex"), "=" if op == "=~" else "!="
        if left.array and op in ("=", "!=", "like", "contains", "startswith", "endswith"):
            inner = left.kind.elementType
            one = lambda e: self.compare(Typed(e, inner), "=" if op == "!=" else op, lit, right, globs)
            found = F.coalesce(F.exists(left.col, lambda e: F.coalesce(one(e), F.lit(False))), F.lit(False))
            return ~found if op == "!=" else found
        if name and lit is not None and (enum := self.profile.enums.get(self.profile.aliases.get(name, name))) and lit.kind == "string":
            if folded(str(lit.value)) not in enum:
                raise QueryError(f"{lit.value!r} is none of {', '.join(enum)}")
            lit = Lit(str(enum[folded(str(lit.value))]), "number")
        if lit is not None:
            value = str(lit.value)
            if lit.kind == "null":
                return left.col.isNull() if op == "=" else left.col.isNotNull()
            if lit.kind == "regex":
                hit = left.string().rlike(java_regex(value))
                return hit if op == "=" else ~hit
            if lit.kind == "cidr" and op in ("=", "!="):
                hit = ips.in_cidr(left.string(), value)
                return hit if op == "=" else ~hit
            if lit.kind == "bool" and isinstance(left.kind, T.BooleanType):
                return left.col == F.lit(lit.value) if op == "=" else left.col != F.lit(lit.value)
            if op in ("contains", "startswith", "endswith", "like"):
                hay, needle = fold(left.string()), folded(value)
                return {"contains": lambda: hay.contains(needle), "startswith": lambda: hay.startswith(needle), "endswith": lambda: hay.endswith(needle), "like": lambda: hay.rlike(like_regex(needle))}[op]()
            if globs and op in ("=", "!=") and lit.kind == "string" and not (lit.quoted and not re.search(r"[*?]", value)) and re.search(r"[*?]", value):
                if set(value) == {"*"}:  # existence
                    there = left.col.isNotNull() & (left.string() != "") if not left.numeric else left.col.isNotNull()
                    return there if op == "=" else ~there
                hit = fold(left.string()).rlike("(?s)^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in folded(value)) + "$")
                return hit if op == "=" else ~hit
            number = as_number(value) if lit.kind in ("number", "string") else None
            if op in ("=", "!="):
                if left.numeric and number is not None:
                    c = left.col == F.lit(number)
                elif left.time:
                    c = left.col == F.lit(value).try_cast("timestamp")
                else:
                    c = fold(left.string()) == F.lit(folded(value))
                return c if op == "=" else ~c
            if left.time:
                other = F.lit(value).try_cast("timestamp") if number is None else F.timestamp_micros(F.lit(int(number * 1e6)))
                return ordered(left.col, op, other)
            if number is not None and (left.numeric or lit.kind == "number" or not lit.quoted):
                return ordered(left.number(), op, F.lit(number))
            return ordered(fold(left.string()), op, F.lit(folded(value)))
        if op in ("contains", "startswith", "endswith", "like"):
            hay, needle = fold(left.string()), fold(right.string())
            return {"contains": hay.contains, "startswith": hay.startswith, "endswith": hay.endswith, "like": hay.like}[op](needle)
        if left.time and right.time:
            return ordered(left.col, op, right.col)
        if left.numeric or right.numeric:
            if op in ("=", "!=") and (left.text or right.text):
                return ordered(fold(left.string()), op, fold(right.string()))
            return ordered(left.number(), op, right.number())
        if left.text and right.text:
            return ordered(fold(left.col), op, fold(right.col))
        return ordered(left.col, op, right.col)

    def membership(self, x: In) -> Column:
        if x.query is not None:
            raise QueryError("IN [subsearch] stands as a term of its own in a search or where")
        t = self.compile(x.value)
        hits = [self.compare(t, "=", i, None, globs=False, name=x.value.name if isinstance(x.value, Field) else "") for i in x.items if i.kind == "cidr" or t.array or t.numeric]
        if not t.array and not t.numeric and (exact := [folded(str(i.value)) for i in x.items if i.kind != "cidr"]):
            hits.append(fold(t.string()).isin(exact))
        hit = balanced(hits, "or") if hits else F.lit(False)
        return ~hit if x.negated else hit

    # -- search -----------------------------------------------------------------------------------------------
    def search(self, x) -> Column:
        if x is None:
            return F.lit(True)
        if isinstance(x, Keyword):
            return self.keyword(x.text)
        if isinstance(x, Term):
            return self.compare(self.column(x.field), x.op, x.value, None, globs=True, name=x.field)
        if isinstance(x, Ioc):
            return self.observables(x)
        if isinstance(x, Op) and x.op in ("and", "or"):
            return balanced([self.search(a) for a in x.args], x.op)
        if isinstance(x, Op) and x.op == "not":
            return ~self.search(x.args[0])
        if isinstance(x, Op) and isinstance(x.args[0], Lit):  # two literals
            a, b = str(x.args[0].value), str(x.args[1].value)
            same = folded(a) == folded(b)
            return F.lit(same if x.op == "=" else not same)
        return self.condition(x)

    def keyword(self, text: str) -> Column:
        if set(text) == {"*"}:
            return F.lit(True)
        names = [n for n in self.profile.body if n in self.df.columns] or [f.name for f in self.df.schema if isinstance(f.dataType, T.StringType)]
        if not names:
            raise UnboundBody("there is no text for a keyword to search")
        return balanced([F.coalesce(keyword_in(fold(F.col(f"`{n}`")), folded(text)), F.lit(False)) for n in names], "or")

    def observables(self, x: Ioc) -> Column:
        columns = [c for c in self.profile.observables if c in self.df.columns] or [f.name for f in self.df.schema if isinstance(f.dataType, T.StringType)]
        values = [folded(str(i.value)) for i in x.items]
        if x.source:
            values = self.engine.ioc_values(x)
        return balanced([F.coalesce(fold(F.col(f"`{c}`")).isin(values), F.lit(False)) for c in columns], "or")


class UnboundBody(QueryError):
    pass


def balanced(cs: list[Column], op: str) -> Column:
    """A flat tree of bounded depth, whatever the number of terms."""
    while len(cs) > 1:
        cs = [reduce(lambda a, b: a & b if op == "and" else a | b, cs[i : i + 2]) for i in range(0, len(cs), 2)]
    return cs[0]


def ordered(a: Column, op: str, b: Column) -> Column:
    return {"=": a == b, "!=": a != b, "<": a < b, ">": a > b, "<=": a <= b, ">=": a >= b}[op]


def literal(x: Lit) -> Typed:
    if x.kind == "number":
        n = as_number(x.value)
        n = int(n) if float(n).is_integer() and re.fullmatch(r"-?\d+", str(x.value)) else n
        return Typed(F.lit(n), T.LongType() if isinstance(n, int) and abs(n) > 2**31 - 1 else T.IntegerType() if isinstance(n, int) else T.DoubleType(), x)
    if x.kind == "bool":
        return Typed(F.lit(x.value), T.BooleanType(), x)
    if x.kind == "null":
        return Typed(F.lit(None).cast("string"), T.StringType(), x)
    return Typed(F.lit(str(x.value)), T.StringType(), x)


def as_number(text) -> float | None:
    try:
        n = float(text)
        return int(n) if n.is_integer() and re.fullmatch(r"-?\d+", str(text)) else n
    except (TypeError, ValueError):
        return None


def java_regex(pattern: str, flags: str = "is") -> str:
    """For Java: dot matches all, any case; look-around and back references, which a linear matcher lacks, are refused."""
    if re.search(r"\(\?(?:[=!]|<[=!])|\\[1-9]", pattern):
        raise QueryError(f"look-around and back references are not supported: {pattern}")
    try:
        re.compile(pattern.replace("(?<", "(?P<"))
    except re.error as e:
        raise QueryError(f"bad pattern {pattern!r}: {e}") from None
    return f"(?{flags})" + pattern.replace("(?P<", "(?<") if flags else pattern.replace("(?P<", "(?<")


def like_regex(pattern: str) -> str:
    return "(?s)^" + "".join(".*" if c == "%" else "." if c == "_" else re.escape(c) for c in pattern) + "$"


def keyword_in(body: Column, text: str) -> Column:
    """body and text are folded. Tokens are runs of ASCII letters, digits and anything beyond ASCII."""
    if text.startswith("*") and text.endswith("*") and len(text) > 2 and not re.search(r"[*?]", text[1:-1]):
        return body.contains(text[1:-1])
    if re.search(r"[*?]", text):
        inside = "".join(r"\S*" if c == "*" else "[a-z0-9]" if c == "?" else re.escape(c) for c in text)
        return body.rlike(f"(?:^|[^a-z0-9]){inside}(?:$|[^a-z0-9])")
    tokens = [t for t in re.split(r"[^a-z0-9\u0080-\U0010ffff]+", text) if t]
    if not tokens:
        return body.contains(text)
    edge = r"[^a-z0-9\x{80}-\x{10ffff}]"
    # The plain substring test first: it is cheap and decides for most rows.
    return balanced([body.contains(t) & body.rlike(f"(?:^|{edge}){re.escape(t)}(?:$|{edge})") for t in tokens], "and")
