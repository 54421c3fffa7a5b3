"""Arguments of each stage."""

from __future__ import annotations

import re

from rivulet.plans.ast import Query
from rivulet.plans.errors import QueryError
from rivulet.plans.parser import Parser


def _condition(p: Parser) -> dict:
    return {"where": p.expression()}


def _search(p: Parser) -> dict:
    return {"search": p.search(Query(None, []))}


def _regex(p: Parser) -> dict:
    m = re.compile(r"([\w.]+)\s*(!=|=)\s*").match(p.s, (p.ws(), p.at)[1])
    field, negated = None, False
    if m:
        field, negated, p.at = m[1], m[2] == "!=", m.end()
    pattern = p.quoted()
    if pattern is None:
        r = p.regex()
        pattern = r.value if r else p.fail("a pattern is expected")
    return {"field": field, "pattern": pattern, "negated": negated}


def _eval(p: Parser) -> dict:
    out = []
    while True:
        name = p.name()
        p.expect("=")
        out.append((name, p.expression()))
        if not p.take(","):
            return {"assign": out}


def _rename(p: Parser) -> dict:
    out = []
    while not p.end_of_stage():
        a = p.name()
        if not p.word("as"):
            p.fail("AS is expected")
        out.append((a, p.name()))
        p.take(",")
    return {"pairs": out}


def _table(p: Parser) -> dict:
    out = []
    while not p.end_of_stage():
        a = p.name()
        out.append((a, p.name() if p.word("as") else None))
        p.take(",")
    return {"fields": out}


def _fields(p: Parser) -> dict:
    drop = p.take("-")
    if not drop:
        p.take("+")
    return {"drop": drop, "fields": p.names()}


def _fillnull(p: Parser) -> dict:
    o = p.options("value")
    fields = p.names()
    return {"value": (o | p.options("value")).get("value", "0"), "fields": fields}


def _rex(p: Parser) -> dict:
    o = p.options("field", "mode", "max_match")
    pattern = p.quoted()
    if pattern is None:
        p.fail("a quoted pattern is expected")
    return o | {"pattern": pattern} | p.options("field", "mode", "max_match")


def _spath(p: Parser) -> dict:
    o = p.options("input", "path", "output")
    if not p.end_of_stage() and "path" not in o:
        o["path"] = p.name()
    return o | p.options("input", "path", "output")


def _bin(p: Parser) -> dict:
    keys = ("span", "bins", "hop", "window", "type")
    o = p.options(*keys)
    field = None
    if not p.end_of_stage() and not p.peek_word("as"):
        if p.word("sliding"):
            o["type"] = "sliding"
        else:
            field = p.name()
    o |= p.options(*keys)
    if p.word("sliding"):
        o["type"] = "sliding"
    alias = p.name() if p.word("as") else None
    o |= p.options(*keys)
    if o.get("bins") == "0" or o.get("hop", "1").startswith("0"):
        raise QueryError("bins and hop must be positive")
    return o | {"field": field, "as": alias}


def _mvexpand(p: Parser) -> dict:
    return {"field": p.name()} | p.options("limit")


def _risk(p: Parser) -> dict:
    out = {}
    while not p.end_of_stage():
        m = re.compile(r"(score|entity|factor|weight)\s*=\s*").match(p.s, (p.ws(), p.at)[1])
        if not m:
            p.fail("score=, entity=, factor= or weight= is expected")
        p.at = m.end()
        out[m[1]] = p.additive()
        p.take(",")
    return out


def _format(p: Parser) -> dict:
    return p.options("sep", "row_sep")


def _count(p: Parser) -> int | None:
    m = p.match(re.compile(r"\d+(?![\w.])"))
    return int(m) if m else None


def _return(p: Parser) -> dict:
    return {"n": _count(p), "fields": p.names()}


def _sample(p: Parser) -> dict:
    return {"n": _count(p) or 100}


def _ai(p: Parser) -> dict:
    o = p.options("prompt", "max_rows")
    if (t := p.quoted()) is not None:
        o["prompt"] = t
    return o | p.options("prompt", "max_rows")


def _by(p: Parser, *stop: str) -> list[str]:
    if not p.word("by"):
        return []
    out = [p.name()]
    while True:
        comma = p.take(",")
        p.ws()
        if p.end_of_stage() or p.peek("[") or re.compile(r"[A-Za-z_]+\s*=(?!=)").match(p.s, p.at) or p.peek_word(*stop) if stop else p.end_of_stage() or p.peek("[") or re.compile(r"[A-Za-z_]+\s*=(?!=)").match(p.s, p.at):
            return out
        if not comma and not re.compile(r"[A-Za-z_$\"']").match(p.s, p.at):
            return out
        out.append(p.name())


def _stats(p: Parser) -> dict:
    return {"aggs": p.aggregates(), "by": _by(p)}


def _chart(p: Parser) -> dict:
    aggs = p.aggregates()
    over = [p.name()] if p.word("over") else []
    return {"aggs": aggs, "over": over, "by": _by(p)}


_TIMECHART = ("span", "limit", "useother", "cont", "bins", "usenull")


def _timechart(p: Parser) -> dict:
    o = p.options(*_TIMECHART)
    aggs = p.aggregates()
    o |= p.options(*_TIMECHART)
    by = _by(p)
    return o | p.options(*_TIMECHART) | {"aggs": aggs, "by": by}


_TOP = ("limit", "showcount", "showperc", "_bounds", "countfield", "percentfield")


def _top(p: Parser) -> dict:
    n = _count(p)
    o = p.options(*_TOP)
    fields = []
    while not p.end_of_stage() and not p.peek_word("by") and not re.compile(r"[A-Za-z_]+\s*=").match(p.s, (p.ws(), p.at)[1]):
        fields.append(p.name())
        p.take(",")
    o |= p.options(*_TOP)
    by = _by(p)
    o |= p.options(*_TOP)
    return o | {"n": n or int(o.get("limit", 10)), "fields": fields, "by": by}


def _streamstats(p: Parser) -> dict:
    keys = ("window", "current")
    o = p.options(*keys)
    aggs = p.aggregates()
    o |= p.options(*keys)
    by = _by(p)
    return o | p.options(*keys) | {"aggs": aggs, "by": by}


def _anomaly(p: Parser) -> dict:
    keys = ("field", "span", "method", "threshold", "by")
    o = p.options(*keys)
    agg = None
    if not p.end_of_stage() and not p.peek_word("by"):
        agg = p.aggregate()
    by = _by(p)
    o |= p.options(*keys)
    by = by or _by(p)
    return o | {"agg": agg, "by": by}


def _group_until(p: Parser) -> list[str]:
    out = []
    while not p.end_of_stage() and not p.peek("[") and not re.compile(r"[A-Za-z_0-9]+\s*=|fields\s*\(", re.I).match(p.s, (p.ws(), p.at)[1]):
        out.append(p.name())
        p.take(",")
    return out


def _bracketed(p: Parser):
    """A condition in brackets: terms of a search, with the precedence of where (AND before OR)."""
    p.expect("[")
    out = _alternatives(p)
    p.expect("]")
    return out


def _alternatives(p: Parser):
    from rivulet.plans.ast import Op

    q, ors = Query(None, []), []
    while True:
        ands = []
        while not p.end_of_stage() and not p.peek(")") and not p.peek_word("or"):
            if not p.word("and"):
                if p.take("("):
                    ands.append(_alternatives(p))
                    p.expect(")")
                else:
                    ands.append(p.search_not(q))
        ors.append(ands[0] if len(ands) == 1 else Op("and", tuple(ands)))
        if not p.word("or"):
            return ors[0] if len(ors) == 1 else Op("or", tuple(ors))


def _transaction(p: Parser) -> dict:
    keys = ("maxspan", "maxevents", "maxpause")
    out: dict = {"by": []}
    while not p.end_of_stage():
        m = re.compile(r"(startswith|endswith)\s*=\s*", re.I).match(p.s, (p.ws(), p.at)[1])
        if m:
            p.at = m.end()
            if p.peek("["):
                cond = _bracketed(p)
            elif p.word("eval"):
                p.expect("(")
                cond = p.expression()
                p.expect(")")
            elif p.take("("):
                cond = p.search(Query(None, []))
                p.expect(")")
            else:
                cond = p.search_term(Query(None, []))
            out[m[1].lower()] = cond
        elif o := p.option(*keys):
            out[o[0]] = o[1]
        else:
            out["by"].append(p.name())
        p.take(",")
    return out


def _steps(p: Parser) -> dict:
    """sequence and funnel."""
    keys = ("maxspan", "maxgap", "window")
    out: dict = {"by": [], "steps": [], "names": [], "fields": []}
    if p.word("by"):
        out["by"] = _group_until(p)
    while not p.end_of_stage():
        if p.peek("["):
            out["steps"].append(_bracketed(p))
            out["names"].append(None)
        elif o := p.option(*keys):
            out[o[0]] = o[1]
        elif p.word("fields"):
            p.expect("(")
            while not p.take(")"):
                out["fields"].append(p.name())
                p.take(",")
        elif p.word("by"):
            out["by"] = _group_until(p)
        elif m := re.compile(r"([A-Za-z_]\w*)\s*=\s*").match(p.s, (p.ws(), p.at)[1]):
            p.at = m.end()
            if p.peek("["):
                out["steps"].append(_bracketed(p))
            else:
                p.expect("(")
                out["steps"].append(p.search(Query(None, [])))
                p.expect(")")
            out["names"].append(m[1])
        else:
            p.fail("a step in brackets is expected")
    if not out["by"] or not out["steps"]:
        p.fail("by and steps are needed")
    return out


def _sort(p: Parser) -> dict:
    n, keys = _count(p), []
    while not p.end_of_stage():
        sign = "-" if p.take("-") else "+" if p.take("+") else ""
        m = re.compile(r"[\w.]+\([^)]*\)").match(p.s, (p.ws(), p.at)[1])  # sort -sum(x)
        if m:
            p.at, name = m.end(), m[0]
        else:
            name = p.name()
        if p.word("desc"):
            sign = "-"
        elif p.word("asc"):
            sign = "+"
        keys.append((name, sign == "-"))
        p.take(",")
    return {"n": n, "keys": keys}


def _head(p: Parser) -> dict:
    n = _count(p)
    o = p.options("limit", "n")
    return {"n": n if n is not None else int(o.get("limit", o.get("n", 10)))}


def _dedup(p: Parser) -> dict:
    keys = ("keepfirst", "keeplast", "limit")
    n, o, fields, sort = _count(p), {}, [], None
    while not p.end_of_stage():
        if x := p.option(*keys):
            o[x[0]] = x[1]
        elif p.word("sortby"):
            sort = _sort(p)["keys"]
        else:
            fields.append(p.name())
        p.take(",")
    return o | {"n": n or 1, "fields": fields, "sortby": sort}


def _append(p: Parser) -> dict:
    return {"query": p.subquery()}


def _join(p: Parser) -> dict:
    keys = ("type", "max", "maxout", "overwrite")
    o = p.options(*keys)
    fields = []
    while not p.peek("["):
        if p.end_of_stage():
            p.fail("a subsearch is expected")
        if x := p.option(*keys):
            o[x[0]] = x[1]
        else:
            p.word("on")
            fields.append(p.name())
        p.take(",")
    q = p.subquery()
    return o | p.options(*keys) | {"fields": fields, "query": q}


def _lookup(p: Parser) -> dict:
    out: dict = {"table": p.name(), "outputs": [], "new": False, "ci": False}
    key = p.name()
    out["field"] = p.name() if p.word("as") else key
    out["key"] = key
    while not p.end_of_stage():
        if w := p.word("output", "outputnew"):
            out["new"] = w == "outputnew"
            while not p.end_of_stage() and not p.peek_word("case_insensitive"):
                a = p.name()
                out["outputs"].append((a, p.name() if p.word("as") else a))
                p.take(",")
        elif p.word("case_insensitive"):
            out["ci"] = True
        else:
            p.fail("OUTPUT is expected")
    return out


def _inputlookup(p: Parser) -> dict:
    keys = ("url", "format", "key", "timeout", "max_rows", "cache_ttl")
    o = p.options(*keys)
    if not p.end_of_stage():
        o["table"] = p.name()
    return o | p.options(*keys)


def _output(p: Parser) -> dict:
    return {"dest": p.name()}


def _prevalence(p: Parser) -> dict:
    o: dict = p.options("enrich", "window")
    if not p.end_of_stage():
        o["field"] = p.name()
        m = p.match(re.compile(r"<=|>=|<|>|==|=|!="))
        if m:
            o["op"], o["n"] = m, float(p.match(re.compile(r"\d+(\.\d+)?")) or p.fail("a number is expected"))
    return o | p.options("enrich", "window")


def _one(p: Parser) -> dict:
    return {"field": p.name()}


def _tree(p: Parser) -> dict:
    keys = ("parent", "child", "label", "detail", "root", "depth")
    o = p.options(*keys)
    if not p.end_of_stage() and not p.peek_word("by"):
        o["field"] = p.name()
    by = _by(p)
    return o | p.options(*keys) | {"by": by}


def _keys(*keys: str):
    def parse(p: Parser) -> dict:
        o: dict = p.options(*keys)
        if not p.end_of_stage():
            if p.word("by"):
                o["by"] = p.name()
            else:
                t = p.quoted()
                o["value"] = t if t is not None else p.match(re.compile(r"[^\s|\]]+"))
        return o | p.options(*keys)

    return parse


def _nothing(p: Parser) -> dict:
    return {}


PARSE = {
    "where": _condition, "search": _search, "regex": _regex, "eval": _eval, "rename": _rename, "table": _table, "fields": _fields,
    "fillnull": _fillnull, "rex": _rex, "spath": _spath, "bin": _bin, "mvexpand": _mvexpand, "risk": _risk, "format": _format,
    "return": _return, "sample": _sample, "ai": _ai, "stats": _stats, "eventstats": _stats, "chart": _chart, "timechart": _timechart,
    "top": _top, "rare": _top, "streamstats": _streamstats, "anomaly": _anomaly, "transaction": _transaction, "sequence": _steps,
    "funnel": _steps, "sort": _sort, "head": _head, "tail": _head, "reverse": _nothing, "dedup": _dedup, "append": _append,
    "join": _join, "lookup": _lookup, "inputlookup": _inputlookup, "output": _output, "prevalence": _prevalence,
    "resolve_identity": _one, "tree": _tree, "lateral": _keys("seed", "entity", "methods", "maxhops"),
    "baseline": _keys("host", "user", "ip", "window", "dims"), "retro": _keys("by"), "asset": _keys("field"),
    "cloud": _keys("principal", "account", "provider"), "services": _nothing, "service": _keys(), "trace": _keys(), "metric": _keys("service"),
}
