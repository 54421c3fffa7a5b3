"""Text of a query to its tree. Scannerless recursive descent, as words mean other things in a search than in an
expression. In a search OR binds before AND, which juxtaposition implies; in where and eval it is the other way."""

from __future__ import annotations

import re
import sys

from rivulet.plans.ast import Agg, Call, Field, In, Ioc, Keyword, Lit, Op, Query, Stage, Term
from rivulet.plans.complexity import check
from rivulet.plans.errors import QueryError

#: Bounds that keep a query's plan in reason.
MAX_DEPTH, MAX_NODES, MAX_STAGES = 200, 400_000, 256

NAME = re.compile(r"[A-Za-z_][\w]*(?:\.[A-Za-z_][\w]*)*")
NUMBER = re.compile(r"\d+(?:\.\d+)?(?:[eE][+-]?\d+)?(?![\w.:])")
CIDR = re.compile(r"(?:\d{1,3}(?:\.\d{1,3}){3}|[0-9A-Fa-f:]*:[0-9A-Fa-f:.]*)/\d{1,3}(?![\w./])")
WORD = re.compile(r"""[^\s"'()\[\]|,=!<>]+""")
COMPARE = re.compile(r"==|!=|>=|<=|=~|!~|=|>|<")
SPAN = re.compile(r"\d+(?:\.\d+)?[A-Za-z]+\b")
AGGREGATES = frozenset("count dc distinct_count estdc sum avg mean min max values list first last earliest latest range stdev stddev var median mode sparkline rate histogram_quantile percentile".split())
#: Stage names, aliases first resolved.
ALIASES = {"uniq": "dedup", "bucket": "bin", "extract": "rex", "filter": "where"}
STAGES = frozenset("where search regex eval rename table fields fillnull rex spath bin mvexpand risk format return sample ai stats chart timechart top rare eventstats streamstats anomaly transaction sequence funnel sort head tail reverse dedup append join lookup inputlookup output prevalence resolve_identity tree lateral baseline retro asset cloud services service trace metric".split())


def parse(text: str) -> Query:
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 50 * MAX_DEPTH))  # MAX_DEPTH is what bounds a query
    p = Parser(strip_comments(text))
    q = p.query()
    p.ws()
    if p.at < len(p.s):
        p.fail("unexpected text")
    return check(q)


def strip_comments(text: str) -> str:
    """Without // and # comments at the start of a line and /* */ anywhere outside quotes; a URL is no comment."""
    out, i, quote = [], 0, ""
    while i < len(text):
        c = text[i]
        if quote:
            out.append(c)
            if c == "\\" and i + 1 < len(text) and text[i + 1] in "\\" + quote:
                out.append(text[i + 1])
                i += 1
            elif c == quote:
                quote = ""
        elif c in "\"'":
            quote = c
            out.append(c)
        elif text.startswith("/*", i) and (not i or text[i - 1].isspace()):
            end = text.find("*/", i)
            if end < 0:
                raise QueryError("a comment isn't closed")
            i = end + 1
        elif (text.startswith("//", i) or c == "#") and (not i or text[i - 1] == "\n"):
            end = text.find("\n", i)
            i = (len(text) if end < 0 else end) - 1
        else:
            out.append(c)
        i += 1
    return "".join(out)


class Parser:
    def __init__(self, s: str):
        self.s, self.at, self.depth, self.nodes = s, 0, 0, 0

    # -- text -------------------------------------------------------------------------------------------------
    def fail(self, what: str):
        raise QueryError(f"{what} at {self.at}: {self.s[self.at : self.at + 30]!r}")

    def ws(self) -> None:
        while self.at < len(self.s) and self.s[self.at].isspace():
            self.at += 1

    def peek(self, text: str) -> bool:
        self.ws()
        return self.s.startswith(text, self.at)

    def take(self, text: str) -> bool:
        if self.peek(text):
            self.at += len(text)
            return True
        return False

    def expect(self, text: str) -> None:
        if not self.take(text):
            self.fail(f"{text!r} expected")

    def match(self, pattern: re.Pattern) -> str | None:
        self.ws()
        if m := pattern.match(self.s, self.at):
            self.at = m.end()
            return m[0]
        return None

    def word(self, *words: str) -> str | None:
        """One of the words, in any case, as a whole."""
        self.ws()
        for w in words:
            end = self.at + len(w)
            if self.s[self.at : end].lower() == w and not re.match(r"\w", self.s[end : end + 1] or " "):
                self.at = end
                return w
        return None

    def peek_word(self, *words: str) -> bool:
        at = self.at
        found = self.word(*words)
        self.at = at
        return bool(found)

    def end_of_stage(self) -> bool:
        self.ws()
        return self.at >= len(self.s) or self.s[self.at] in "|]"

    def quoted(self) -> str | None:
        self.ws()
        if self.at < len(self.s) and (quote := self.s[self.at]) in "\"'":
            out, i = [], self.at + 1
            while i < len(self.s) and self.s[i] != quote:
                if self.s.startswith("\\\\", i):
                    i += 1
                out.append(self.s[i])
                i += 1
            if i >= len(self.s):
                self.fail("a quote isn't closed")
            self.at = i + 1
            return "".join(out)
        return None

    def regex(self) -> Lit | None:
        self.ws()
        if self.s.startswith("/", self.at):
            i = self.at + 1
            while i < len(self.s) and self.s[i] != "/":
                i += 2 if self.s[i] == "\\" else 1
            if i < len(self.s):
                body = self.s[self.at + 1 : i].replace("\\/", "/")
                self.at = i + 1
                if m := re.compile("[ims]+").match(self.s, self.at):
                    self.at = m.end()
                return Lit(body, "regex")
        return None

    def deeper(self):
        self.depth += 1
        self.nodes += 1
        if self.depth > MAX_DEPTH or self.nodes > MAX_NODES:
            raise QueryError("the query is too deep or too large")

    # -- queries ----------------------------------------------------------------------------------------------
    def query(self) -> Query:
        self.deeper()
        out = Query(None, [])
        self.ws()
        first = True
        if self.word("search"):
            pass
        if not self.peek("|") and not self.leading_stage():
            out.search = self.search(out)
        else:
            first = self.peek("|")
            if not first:
                out.stages.append(self.stage())
        while self.take("|"):
            out.stages.append(self.stage())
            if len(out.stages) > MAX_STAGES:
                raise QueryError(f"more than {MAX_STAGES} stages")
        self.depth -= 1
        return out

    def leading_stage(self) -> bool:
        """Whether a stage stands where a search could."""
        at = self.at
        name = self.match(NAME)
        self.ws()
        nxt = self.s[self.at : self.at + 1]
        name = ALIASES.get((name or "").lower(), (name or "").lower())
        known = name in STAGES and name not in ("search", "where") and not COMPARE.match(self.s, self.at) and nxt != "("
        if known and name in ("top", "rare", "head", "tail", "service", "services", "trace", "metric", "asset", "cloud", "risk", "sample", "format", "return", "regex", "table", "fields", "sequence", "transaction", "tree", "baseline", "lookup", "output", "retro", "join", "sort", "rename", "reverse", "append", "bin", "ai", "chart", "lateral"):
            # Common words too: a stage only if something of its own kind follows.
            known = bool(nxt) and nxt != "|" or name in ("services", "retro", "reverse")
        self.at = at
        return known

    def subquery(self) -> Query:
        self.expect("[")
        q = self.query()
        self.expect("]")
        return q

    # -- search -----------------------------------------------------------------------------------------------
    def search(self, q: Query):
        terms = []
        while not self.end_of_stage() and not self.peek(")"):
            if self.word("and"):
                continue
            t = self.search_or(q)
            if t is not None:
                terms.append(t)
        return None if not terms else terms[0] if len(terms) == 1 else Op("and", tuple(terms))

    def search_or(self, q: Query):
        out = [self.search_not(q)]
        while self.word("or"):
            out.append(self.search_not(q))
        out = [x for x in out if x is not None]
        return None if not out else out[0] if len(out) == 1 else Op("or", tuple(out))

    def search_not(self, q: Query):
        if self.word("not") or self.peek("!") and not self.peek("!=") and self.take("!"):
            self.deeper()
            x = self.search_not(q)
            self.depth -= 1
            return Op("not", (x,))
        if self.take("("):
            self.deeper()
            x = self.search(q)
            self.expect(")")
            self.depth -= 1
            return x if x is not None else Lit(True, "bool")
        return self.search_term(q)

    def search_term(self, q: Query):
        self.ws()
        self.nodes += 1
        at = self.at
        if (text := self.quoted()) is not None:
            if op := self.match(COMPARE):  # "$user" = "*": of two literals
                right = self.value(op)
                return Op("=" if op == "==" else op, (Lit(text, quoted=True), right))
            return Keyword(text, True)
        name = self.match(NAME)
        if name:
            low = name.lower()
            if low == "ioc" and (self.peek("=") or self.peek_word("in")):
                return self.ioc()
            if op := self.match(COMPARE):
                if low == "dataset":
                    q.dataset = str(self.value("=").value)
                    return None
                if low in ("earliest", "latest"):
                    v = self.value("=")
                    setattr(q, low, str(v.value))
                    return None
                if self.arithmetic_follows():
                    self.at = at
                    return self.compared()
                op = "=" if op == "==" else op
                return Term(name, op, self.value(op))
            if self.peek("(") and self.s[self.at - 1 : self.at] != " ":
                self.at = at
                return self.compared()
            negated = bool(self.word("not"))
            if self.word("in"):
                return self.in_list(Field(name), negated)
            if op := self.word("contains", "startswith", "endswith", "like"):
                x = Term(name, op, self.value(op))
                return Op("not", (x,)) if negated else x
            if negated:
                self.at = at + len(name)
            self.ws()
            if re.match(r"[+\-*/%]\s", self.s[self.at : self.at + 2]) or False:
                here = self.at
                self.at = at
                try:
                    return self.compared()
                except QueryError:
                    self.at = here
            self.at = at
        w = self.match(WORD)
        if w is None:
            self.fail("a search term is expected")
        return Keyword(w)

    def arithmetic_follows(self) -> bool:
        """Whether the right side of a comparison is a call or arithmetic rather than a value."""
        at = self.at
        found = False
        if not self.peek('"') and not self.peek("'") and not self.peek("/"):
            if m := NAME.match(self.s, (self.ws(), self.at)[1]):
                found = self.s[m.end() : m.end() + 1] == "(" or bool(re.match(r"\s+[+\-*/%]\s+[\w(]", self.s[m.end() :]))
            elif m := NUMBER.match(self.s, self.at):
                found = bool(re.match(r"\s+[+\-*/%]\s+[\w(]", self.s[m.end() :]))
        self.at = at
        return found

    def compared(self):
        return self.comparison()

    def value(self, op: str) -> Lit:
        """The right side of a search comparison."""
        if (text := self.quoted()) is not None:
            return Lit(text, quoted=True)
        if op in ("=", "==", "!=", "=~", "!~") and (r := self.regex()) is not None:
            return r
        if c := self.match(CIDR):
            return Lit(c, "cidr")
        self.ws()
        if m := re.compile(r"-?\d+(?:\.\d+)?(?=[\s)|\],]|$)").match(self.s, self.at):
            self.at = m.end()
            return Lit(m[0], "number")
        w = self.match(re.compile(r"""[^\s"'()\[\]|,]+"""))
        if w is None:
            self.fail("a value is expected")
        low = w.lower()
        return Lit(low == "true", "bool") if low in ("true", "false") else Lit(w)

    def in_list(self, value, negated: bool) -> In:
        if self.peek("["):
            return In(value, query=self.subquery(), negated=negated)
        self.expect("(")
        items = []
        while not self.take(")"):
            if (text := self.quoted()) is not None:
                items.append(Lit(text, quoted=True))
            elif c := self.match(CIDR):
                items.append(Lit(c, "cidr"))
            else:
                w = self.match(re.compile(r"[^\s,()]+"))
                if w is None:
                    self.fail("an item is expected")
                items.append(Lit(w, "number" if re.fullmatch(r"-?\d+(\.\d+)?", w) else "string"))
            self.take(",")
        return In(value, tuple(items), negated=negated)

    def ioc(self) -> Ioc:
        if self.take("="):
            return Ioc((self.value("="),))
        self.word("in")
        if self.peek("[") and re.match(r"\[\s*\|?\s*inputlookup\s", self.s[self.at :]):
            q = self.subquery()
            return Ioc(source="lookup", name=q.stages[0].get("table"))
        if self.take("[") or self.take("("):
            items = []
            while not (self.take("]") or self.take(")")):
                t = self.quoted()
                items.append(Lit(t if t is not None else self.match(re.compile(r"[^\s,\])]+")) or self.fail("an item is expected")))
                self.take(",")
            return Ioc(tuple(items))
        source = self.word("feed", "threatfox", "lookup")
        if not source:
            self.fail("ioc in needs a list, feed, threatfox or lookup")
        self.expect("(")
        name = self.quoted()
        column = self.quoted() if self.take(",") else None
        self.expect(")")
        return Ioc(source=source, name=name, column=column)

    # -- expressions ------------------------------------------------------------------------------------------
    def expression(self):
        self.deeper()
        out = [self.expr_and()]
        while self.word("or") or self.take("||"):
            out.append(self.expr_and())
        self.depth -= 1
        return out[0] if len(out) == 1 else Op("or", tuple(out))

    def expr_and(self):
        out = [self.expr_not()]
        while self.word("and") or self.take("&&"):
            out.append(self.expr_not())
        return out[0] if len(out) == 1 else Op("and", tuple(out))

    def expr_not(self):
        if self.word("not") or self.peek("!") and not self.peek("!=") and not self.peek("!~") and self.take("!"):
            self.deeper()
            x = self.expr_not()
            self.depth -= 1
            return Op("not", (x,))
        return self.comparison()

    def comparison(self):
        left = self.additive()
        if op := self.match(COMPARE):
            op = "=" if op == "==" else op
            if op in ("=", "!=", "=~", "!~") and (r := self.regex()) is not None:
                return Op(op, (left, r))
            if c := self.match(CIDR):
                return Op(op, (left, Lit(c, "cidr")))
            return Op(op, (left, self.additive(loose=isinstance(left, Field))))
        negated = bool(self.word("not"))
        if self.word("in"):
            return self.in_list(left, negated)
        if op := self.word("contains", "startswith", "endswith", "like"):
            x = Op(op, (left, self.additive()))
            return Op("not", (x,)) if negated else x
        if negated:
            self.fail("IN, LIKE or CONTAINS is expected after NOT")
        return left

    def additive(self, loose: bool = False):
        out = self.multiplicative(loose)
        while True:
            self.ws()
            c = self.s[self.at : self.at + 1]
            if c and c in "+-" and not self.s.startswith("->", self.at):
                self.at += 1
                out = Op(c, (out, self.multiplicative()))
            else:
                return out

    def multiplicative(self, loose: bool = False):
        out = self.concatenated(loose)
        while True:
            self.ws()
            c = self.s[self.at : self.at + 1]
            if c and c in "*/%":
                self.at += 1
                out = Op(c, (out, self.concatenated()))
            else:
                return out

    def concatenated(self, loose: bool = False):
        out = self.primary(loose)
        while self.peek(".") and not re.match(r"\.\d", self.s[self.at : self.at + 2]):
            self.at += 1
            out = Op(".", (out, self.primary()))
        return out

    def primary(self, loose: bool = False):
        self.nodes += 1
        if self.take("("):
            x = self.expression()
            self.expect(")")
            return x
        if self.take("-"):
            return Op("-", (Lit("0", "number"), self.primary()))
        if (text := self.quoted()) is not None:
            return Lit(text, quoted=True)
        if c := self.match(CIDR):
            return Lit(c, "cidr")
        if n := self.match(NUMBER):
            return Lit(n, "number")
        if self.take("$"):
            pass
        name = self.match(NAME)
        if name is None:
            # An IP address or another bare value on the right of a comparison.
            w = self.match(re.compile(r"""[^\s"'()\[\]|,=!<>]+""")) if loose else None
            if w is None:
                self.fail("a value is expected")
            return Lit(w)
        low = name.lower()
        if self.s[self.at : self.at + 1] == "(" or low in ("if", "case", "in") and self.peek("("):
            self.expect("(")
            args = []
            while not self.take(")"):
                if (r := self.regex()) is not None:
                    args.append(r)
                elif m := self.match(re.compile(rf"(?:{CIDR.pattern})")):
                    args.append(Lit(m, "cidr"))
                else:
                    args.append(self.expression())
                if not self.take(",") and not self.peek(")"):
                    self.fail("',' or ')' is expected")
            return Call(low, tuple(args))
        if low in ("true", "false"):
            return Lit(low == "true", "bool")
        if low == "null":
            return Lit(None, "null")
        return Field(name)

    # -- stages -----------------------------------------------------------------------------------------------
    def stage(self) -> Stage:
        name = self.match(re.compile(r"[A-Za-z_]+"))
        low = ALIASES.get((name or "").lower(), (name or "").lower())
        if low not in STAGES:
            self.fail(f"{name!r} is not a stage")
        from rivulet.plans.stages import PARSE

        out = Stage(low, PARSE[low](self))
        if not self.end_of_stage():
            self.fail(f"unexpected text in {low}")
        return out

    def name(self) -> str:
        """A field name, perhaps quoted or with globs."""
        if (t := self.quoted()) is not None:
            return t
        w = self.match(re.compile(r"[A-Za-z_*?$][\w.*?@:-]*"))
        if w is None:
            self.fail("a name is expected")
        return w.lstrip("$")

    def names(self) -> list[str]:
        out = []
        while not self.end_of_stage() and not self.peek("["):
            out.append(self.name())
            self.take(",")
        return out

    def option(self, *keys: str) -> tuple[str, str] | None:
        """key=value of one of the keys."""
        self.ws()
        m = re.compile(r"([A-Za-z_]+)\s*=(?!=)\s*").match(self.s, self.at)
        if not m or m[1].lower() not in keys:
            return None
        self.at = m.end()
        v = self.quoted()
        if v is None:
            v = self.match(re.compile(r"[^\s,|\]\)]+"))
        if v is None:
            self.fail("a value is expected")
        return m[1].lower(), v

    def options(self, *keys: str) -> dict[str, str]:
        out = {}
        while o := self.option(*keys):
            out[o[0]] = o[1]
            self.take(",")
        return out

    def aggregate(self) -> Agg:
        name = self.match(re.compile(r"[A-Za-z_]+\d*(?:\.\d+)?"))
        low = (name or "").lower()
        param = None
        if m := re.fullmatch(r"(?:perc|p)(\d+(?:\.\d+)?)", low):
            low, param = "percentile", float(m[1])
        if low not in AGGREGATES:
            self.fail(f"{name!r} is not an aggregate")
        arg = where = None
        if self.take("("):
            if not self.peek(")") and not self.take("*"):
                if self.word("eval"):
                    self.expect("(")
                    arg = self.expression()
                    self.expect(")")
                    if low == "count":
                        arg, where = None, arg
                    if self.take(","):
                        where = self.expression()
                else:
                    arg = self.expression()
            if self.take(","):
                extra = self.expression()
                if isinstance(extra, Lit) and extra.kind == "number":
                    param = float(extra.value)
                elif isinstance(extra, Call) and extra.name == "eval":
                    where = extra.args[0]
                else:
                    where = extra
            self.expect(")")
        elif low != "count":
            self.fail("'(' is expected")
        alias = self.name() if self.word("as") else None
        return Agg(low, arg, alias, param, where)

    def aggregates(self) -> list[Agg]:
        out = [self.aggregate()]
        while True:
            comma = self.take(",")
            at = self.at
            m = self.match(re.compile(r"[A-Za-z_]+\d*"))
            self.at = at
            low = (m or "").lower()
            if m and (low in AGGREGATES or re.fullmatch(r"(perc|p)\d+", low)) and (comma or not self.peek_word("by", "over")):
                out.append(self.aggregate())
            elif comma:
                self.fail("an aggregate is expected")
            else:
                return out
