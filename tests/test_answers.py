"""Answers over a fixture of six events, in a flat and in a nested profile."""

from datetime import datetime, timedelta

import pytest
from rivulet.engine import Engine
from rivulet.plans.errors import QueryError, UnsupportedQuery
from rivulet.plans.profile import LOGS, Profile

T0 = datetime(2026, 10, 1)
WINDOW = (T0, T0 + timedelta(hours=1))
ROWS = [
    (0, "erin", "10.9.9.9", "10.0.0.7", 22, "200", 50, [], "window start", "ws-5"),
    (10, "Alice", "10.1.2.3", "10.0.0.5", 443, "404", 900, ["SeDebugPrivilege", "T1110"], "GET https://host/x", "ws-1"),
    (20, "bob", "8.8.8.8", "203.0.113.9", 80, "7", 200, ["T1110"], "C:\\Windows\\System32\\cmd.exe", "ws-2"),
    (30, "carol", "192.168.1.1", "172.16.5.5", 443, "4000", 300, [], "plain", "ws-1"),
    (40, "bob", "8.8.4.4", "198.51.100.1", 53, "500", 100, ["SeImpersonatePrivilege"], "dns", "ws-2"),
    (60, "dave", "10.5.5.5", "10.0.0.9", 443, "200", 1000, [], "window end", "ws-9"),
]
FLAT = dict(user="user", src_ip="src_ip", dest_ip="dest_ip", dest_port="dest_port", status="status", bytes_in="bytes_in", tags="tags", message="message", host="src_host")
NESTED = dict(user="actor.user.name", src_ip="src_endpoint.ip", dest_ip="dst_endpoint.ip", dest_port="dst_endpoint.port", status="status", bytes_in="traffic.bytes_in", tags="resources.type", message="message", host="device.hostname")


@pytest.fixture(scope="module", params=["flat", "nested"])
def ask(spark, request):
    names = FLAT if request.param == "flat" else NESTED
    columns = ", ".join(f"`{names[k]}` {t}" for k, t in zip(FLAT, ("string", "string", "string", "int", "string", "long", "array<string>", "string", "string")))
    df = spark.createDataFrame([(T0 + timedelta(minutes=r[0]), *r[1:]) for r in ROWS], f"timestamp timestamp, {columns}")
    profile = LOGS if request.param == "flat" else Profile("nested", "timestamp", ("message",), {"_time": "timestamp"}, empty_is_absent=True)
    owners = spark.createDataFrame([("ws-1", "Ann", 1), ("ws-2", "Ben", None)], "hostname string, owner string, level int")
    kept = []
    engine = Engine(spark, {"logs": (df.repartition(3), profile)}, {"owners": owners}, sinks={"kept": lambda x: kept.append(x.count())}, now=T0 + timedelta(days=1))

    def run(text, column=None):
        for k, v in names.items():
            text = text.replace("{" + k + "}", v)
        rows = engine.run(text, *WINDOW).collect()
        return [str(r[names.get(column, column)]) for r in rows] if column else rows

    run.kept = kept
    return run


COUNTS = [
    ("* | stats count", 5), ("{user}=BOB | stats count", 2), ("{status}=7 | stats count", 1), ("{status}>400 | stats count", 3), ("* | where {dest_port} > 100 | stats count", 2),
    ("{dest_ip} IN (10.0.0.0/8, 172.16.0.0/12) | stats count", 3), ("{dest_ip} NOT IN (10.0.0.0/8, 172.16.0.0/12) | stats count", 2), ("{dest_ip} IN (10.0.0.0/8, 203.0.113.9) | stats count", 3),
    ("* | where {dest_ip} IN (10.0.0.0/8) | stats count", 2), ("* | where {dest_ip}!=10.0.0.0/8 | stats count", 3), ("{dest_ip}=10.0.0.0/8 | stats count", 2),
    ("{tags}=\"t1110\" | stats count", 2), ("* | where {tags}!=\"t1110\" | stats count", 3), ("{message}=*https://host/x | stats count", 1), ("* | where {user}==\"bob\" | stats count", 2),
    ("{user}=al* OR {user}=carol {bytes_in}>500 | stats count", 1), ("* | where {user}=\"al*\" | stats count", 0), ("{user}=~\"^b\" | stats count", 2), ("{message}=/HTTPS?:/ | stats count", 1),
    ("cmd | stats count", 1), ("system32 exe | stats count", 1), ("wind* | stats count", 2), ("*indow* | stats count", 2), ("ndow | stats count", 0), ("NOT {user}=bob | stats count", 3),
    ("* | where match({user}, \"^Al\") | stats count", 1), ("* | where has({tags}, \"debug\") | stats count", 1), ("* | where is_private_ip({src_ip}) | stats count", 3),
    ("* | where cidrmatch(\"8.8.0.0/16\", {src_ip}) | stats count", 2), ("{user} IN [search {dest_port}=443 | fields {user}] | stats count", 2), ("{user} NOT IN [search {dest_port}=443 | table {user}] | stats count", 3),
]


@pytest.mark.parametrize("text,want", COUNTS)
def test_counts(ask, text, want):
    assert ask(text, "count") == [str(want)]


def test_order_and_ends(ask):
    assert ask("* | head 2 | table {user}", "user") == ["bob", "carol"]
    assert ask("* | tail 2 | table {user}", "user") == ["erin", "Alice"]
    assert ask("* | sort {bytes_in} | head 2 | table {user}", "user") == ["erin", "bob"]
    assert ask("* | sort -{bytes_in} | table {user} | tail 1", "user") == ["erin"]
    assert ask("* | reverse | table {user} | head 1", "user") == ["erin"]
    with pytest.raises(UnsupportedQuery):
        ask("* | dedup {host} | tail 1")


def test_first_last_and_names(ask):
    r = ask("* | stats earliest({user}) as e, latest({user}) as l by {host} | where {host}=\"ws-1\"")[0]
    assert (r["e"], r["l"]) == ("Alice", "carol")
    assert ask("* | dedup {host} | where {host}=\"ws-1\" | table {user}", "user") == ["carol"]
    assert ask("* | dedup {host} keepfirst=false | where {host}=\"ws-1\" | table {user}", "user") == ["Alice"]
    assert ask("* | stats count by {tags} | sort -count | head 1", "tags") == ["T1110"]


def test_plus_and_differences(ask):
    for x, want in (('{user}+"_s"', "bob_s"), ('"a"+"b"', "ab"), ('"port "+{dest_port}', "port 53"), ("{dest_port}+1", "54"), ("time_diff(_time, _time)", "0"), ("substr({user}, 1, 2)", "ob"), ("1/0", "None")):
        assert ask(f"* | eval x={x} | table x | head 1", "x") == [want]


def test_empty_stats(ask):
    r = ask("{user}=nobody | stats count, dc({user}) as d, max({bytes_in}) as m, values({user}) as v, earliest({user}) as e")[0]
    assert (r["count"], r["d"], r["m"], r["v"], r["e"]) == (0, 0, None, None, None)
    assert ask("{user}=nobody | stats count by {host}") == []


def test_joins(ask):
    assert ask("{user}=carol | join type=left maxout=1 {user} [search * | stats count as n by {user}] | table {user}, n", "n") == ["1"]
    assert ask("{user}=carol OR {user}=erin | join type=left {user} [search {user}=erin | stats count as n by {user}] | sort {user} | table {user}, n", "n") == ["None", "1"]
    assert ask("* | lookup owners hostname AS {host} OUTPUT owner | dedup owner | sort owner | table owner", "owner") == ["None", "Ann", "Ben"]
    assert ask("* | lookup owners hostname AS {host} OUTPUTNEW owner AS {user} | where {user}=ann | stats count", "count") == ["0"]
    ask("* | head 3 | output kept")
    assert ask.kept[-1] == 3


def test_long_chains_and_limits(ask):
    terms = " ".join(f"NOT {{user}}=x{i}" for i in range(400))
    assert ask(terms + " | stats count", "count") == ["5"]
    with pytest.raises(QueryError):
        ask("* | eval x=" + "(" * 300 + "1" + ")" * 300)


@pytest.mark.parametrize("text", ["* | eval x=nofunction(1)", "* | eval x=len()", "* | bin bins=0", "* | stats", "* | where cidrmatch(\"10.0.0.0/99\", {src_ip})", "{user}=/(/", "* | stats count | where nothing=1", "* | tree", "* | join {user}", "earliest=garbage", "* | lookup none x", "{user} IN [search * | table {user} {host}]"])
def test_errors(ask, text):
    with pytest.raises(QueryError):
        ask(text)


def test_sequence_of_steps(ask):
    r = ask("* | sequence by {host} maxspan=30m fields({user}, {bytes_in}) [{bytes_in}>500] [{user}=carol]")
    assert len(r) == 1 and r[0]["sequence_duration_seconds"] == 1200 and r[0]["step1_" + ("user" if "step1_user" in r[0].__fields__ else "actor_user_name")] == "Alice"
    assert ask("* | sequence by {host} maxspan=10m [{bytes_in}>500] [{user}=carol]") == []
    assert [x["eventcount"] for x in ask("* | transaction {host} maxspan=5m | sort transaction_start")] == [1] * 5
    assert ask("* | funnel by {host} [{bytes_in}>150] [{user}=carol] | table count", "count") == ["2", "1"]


def test_rates_and_nulls(spark):
    from rivulet.plans.profile import METRICS

    rows = [("m", T0 + timedelta(seconds=10 * i), v) for i, v in enumerate((100.0, 150.0, 5.0, 20.0))]
    df = spark.createDataFrame(rows, "metric_name string, timestamp timestamp, value double")
    e = Engine(spark, {"logs": (df, METRICS)})
    assert abs(e.run("m | stats rate(value) as r").first()["r"] - 70 / 30) < 1e-9
    three = spark.createDataFrame([(1, True, None, "a"), (2, None, False, None), (3, False, True, "b")], "i int, a boolean, b boolean, s string")
    e = Engine(spark, {"logs": (three, Profile("t", "none", ("s",)))})
    got = lambda p: sorted(r["i"] for r in e.run(f"* | where {p} | table i").collect())
    assert got("a=true OR b=true") == [1, 3] and got('NOT s="a"') == [3] and got("isnull(s)") == [2] and got('s!="a"') == [3]
