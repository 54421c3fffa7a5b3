from datetime import datetime, timedelta

import pytest
from rivulet.engine import Engine
from rivulet.plans import times
from rivulet.plans.ast import Keyword, Op
from rivulet.plans.errors import QueryError
from rivulet.plans.parser import STAGES, parse
from rivulet.plans.profile import Profile
from rivulet.plans.stages import PARSE

NOW = datetime(2026, 10, 7, 13, 45, 30)


@pytest.mark.parametrize("text,want", [("now", NOW), ("-7d", datetime(2026, 9, 30, 13, 45, 30)), ("-1d@d", datetime(2026, 10, 6)), ("@h", datetime(2026, 10, 7, 13)), ("@w0", datetime(2026, 10, 4)), ("@w1", datetime(2026, 10, 5)), ("-1h@m", datetime(2026, 10, 7, 12, 45)), ("@mon", datetime(2026, 10, 1)), ("@y", datetime(2026, 1, 1)), ("2026-01-02", datetime(2026, 1, 2))])
def test_time_modifiers(text, want):
    assert times.resolve(text, NOW) == want


@pytest.mark.parametrize("text", ["garbage", "-7x", "@q", ""])
def test_bad_time_modifiers(text):
    with pytest.raises(QueryError):
        times.resolve(text, NOW)


def test_precedence():
    q = parse("a OR b c").search
    assert q.op == "and" and q.args[0].op == "or"
    w = parse("* | where a=1 OR b=2 AND c=3").stages[0].get("where")
    assert w.op == "or" and w.args[1].op == "and"


def test_leading_stage_and_quotes():
    assert parse("stats count by x").search is None and parse("| stats count").stages[0].name == "stats"
    assert isinstance(parse("top").search, Keyword) and parse('x="a\\\\b"').search.value.value == "a\\b"
    assert parse("x=http://h/y // no comment").search is not None
    assert parse("x=2605:d580::1").search.value.kind == "string"


def test_every_stage_has_a_parser_and_an_operator():
    from rivulet.engine import STAGES as OPERATORS

    assert STAGES == set(PARSE) == set(OPERATORS) | set() and len(STAGES) == 50


@pytest.mark.parametrize("text", ["* |", "* | nostage", "x=\"open", "(a", "* | stats count by", "* | eval x", "* | sort 5 | | head"])
def test_refused(text):
    with pytest.raises(QueryError):
        parse(text)


def test_ladder():
    a, b = datetime(2026, 1, 1), datetime(2026, 1, 2)
    assert times.ladder_span(a, b, 24) == 7200.0 and times.ladder_span(a, b, 25) == 3600.0


def test_many_terms_parse_flat():
    q = parse(" OR ".join(f"u=x{i}" for i in range(500))).search
    assert isinstance(q, Op) and len(q.args) == 500


def test_span_ladder():
    """The fixed spans, and whole days beyond a month."""
    a = datetime(2024, 1, 1)
    assert [times.ladder_span(a, a + timedelta(seconds=s), 1) for s in (1.5, 12, 100)] == [2.0, 15.0, 120.0]
    assert times.ladder_span(a, a + timedelta(days=400), 10) == 41 * 86400.0 or times.ladder_span(a, a + timedelta(days=400), 10) % 86400 == 0


def test_days_newest_first(spark):
    e = Engine(spark, {"logs": (spark.createDataFrame([(datetime(2024, 1, d, 5), d) for d in range(1, 6)], "ts timestamp, n int"), Profile("logs", "ts"))})
    got = [(day.day, [r.n for r in rows.collect()]) for day, rows in e.days("n>1 | eval m=n*2 | table n m", datetime(2024, 1, 1, 12), datetime(2024, 1, 5, 6))]
    assert got == [(5, [5]), (4, [4]), (3, [3]), (2, [2]), (1, [])]
    with pytest.raises(QueryError):
        next(e.days("n>1 | stats count", datetime(2024, 1, 1), datetime(2024, 1, 5)))
    assert e.total("n>1 | table n") == 4


def test_indicator_lists_are_refused_beyond_their_bound(spark, monkeypatch):
    from rivulet import engine

    monkeypatch.setattr(engine, "IOC_CAP", 3)
    rows = spark.createDataFrame([(f"v{i}",) for i in range(4)], "v string")
    logs = spark.createDataFrame([("v1",), ("x",)], "url string")
    run = lambda t: Engine(spark, {"logs": (logs, Profile("logs", "ts", ("url",)))}, {"few": rows.limit(3), "many": rows}).run(t)
    assert run('ioc in lookup("few") | stats count as n').first().n <= 1
    with pytest.raises(QueryError):
        run('ioc in lookup("many") | stats count as n')


def test_large_subsearches_lose_nothing(spark):
    """More values than any list could hold, with IN and NOT IN."""
    logs = spark.range(30_000).selectExpr("id", "cast(id as string) as k")
    run = lambda t: Engine(spark, {"logs": (logs, Profile("logs", "ts"))}).run(t).first().n
    assert run("id IN [search id<20001 | fields id] | stats count as n") == 20_001
    assert run("id NOT IN [search id<20001 | fields id] | stats count as n") == 9_999


def test_budgets_after_names_are_replaced(spark):
    """A chain that doubles is refused before it is planned; as many plain stages as are allowed pass."""
    from rivulet.plans.parser import parse

    doubling = "* | eval a0=value" + "".join(f" | eval a{i + 1}=a{i}+a{i}" for i in range(20))
    with pytest.raises(QueryError, match="names are replaced"):
        parse(doubling)
    parse("* | eval a0=value" + "".join(f" | eval a{i + 1}=a{i}+1" for i in range(20)))
    parse("*" + " | where value>1" * 256)
    for bad in (
        "*" + " | where value>1" * 257,
        "*" + " | where value>1" * 200 + " | append [search *" + " | where value>1" * 60 + "]",
        "* | eval h=value" + " | eval h=" + "abs(" * 20 + "h" + ")" * 20 + (" | eval h=" + "abs(" * 20 + "h" + ")" * 20) * 3,
        "* | eval a=1+1+1+1" + "".join(f" | eval a=a+a" for _ in range(13)) + "".join(f" | where a>{i}" for i in range(20)),
    ):
        with pytest.raises(QueryError):
            parse(bad)
    # What a stats gives stands for itself; a renamed name for what it was.
    parse("* | eval a0=value" + "".join(f" | eval a{i + 1}=a{i}+a{i}" for i in range(14)) + " | stats max(a14) as a0" + "".join(f" | eval a{i + 1}=a{i}+a{i}" for i in range(14)))
    with pytest.raises(QueryError):
        parse("* | eval a=value" + " | eval b=a+a | rename b as a" * 20)
