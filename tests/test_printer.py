import pytest
from rivulet.plans.errors import QueryError
from rivulet.plans.parser import parse
from rivulet.plans.printer import query
from rivulet.sources.convert import convert

TEXTS = [
    "error OR warn a=1 NOT (b=2 c=3)", "dataset=spans earliest=-1d x>5 | stats count", "a=/x\\/y/ b=\"q r\" | where a=1 OR b=\"x\" AND NOT c>2 | eval x=-y+2*3, z=if(a=\"b\", 1, case(c, 2, 3))",
    "x IN (1, \"a b\", 10.0.0.0/8) | where y NOT IN (3) | search u=v*", "u IN [search e=1 | dedup 2 u keepfirst=false sortby -t | return 5 u]", "* | rex field=m \"(?<a>\\d+)\" | rex mode=sed \"s/a/b/\" | regex f!=\"^x\"",
    "* | bin t span=5m as b | bin bins=10 | stats count(eval(a>1)) as c, perc95(x) as p, dc(u), avg(x*2) by k, l | sort 5 -c, k", "* | chart count over a by b | timechart span=1h limit=5 sum(v) by s | top 3 a, b by c showperc=false _bounds=true",
    "* | eventstats avg(x) by k | streamstats window=5 current=false last(x) as p by k | anomaly sum(x) by k method=mad threshold=2 | anomaly field=x", "* | transaction a b maxspan=5m startswith=(x=1) | sequence by k maxspan=5m fields(a, b) [x=1 OR y=2 z=3] [w!=4] | funnel by k go=[a=1] [b=2]",
    "* | join type=left max=2 a, b [search c=1 | stats count by a] | append [search d=2] | lookup t k as f OUTPUTNEW a as b, c CASE_INSENSITIVE | inputlookup t", "* | tree parent=p child=c root=\"x*\" | lateral seed=user entity=bob | baseline host=h window=3d | retro by user | asset field=h x | cloud principal=p | services | service s | trace t | metric m service=s",
    "* | table a as b, c* | fields - x, y | fields a | rename a as b | fillnull value=0 a | spath input=a path=b.c output=d | mvexpand a limit=5 | risk score=x*2 entity=u factor=\"f\" | format sep=\",\" | sample 5 | ai prompt=\"p\" | head 3 | tail 2 | reverse | output d | prevalence hash_prevalence < 5 | resolve_identity ip | rare a",
    "ioc in lookup(\"t\", \"c\") OR ioc in [\"a\", \"b\"] | where searchmatch(\"a b\") AND cidrmatch(\"10.0.0.0/8\", ip)",
]


@pytest.mark.parametrize("text", TEXTS)
def test_round_trip(text):
    q = parse(text)
    assert parse(query(q)) == q, query(q)


def test_conversion(spark):
    from datetime import datetime

    from rivulet.engine import Engine
    from rivulet.plans.profile import LOGS

    rows = [(datetime(2026, 1, 1, i), "ab"[i % 2], float(i)) for i in range(10)]
    df = spark.createDataFrame(rows, "timestamp timestamp, user string, v double")
    df.createOrReplaceTempView("logs")
    e = Engine(spark, {"logs": (df, LOGS)})
    for sql in ("SELECT user, count(*) AS n, sum(v) AS s FROM logs WHERE v > 2 AND user <> 'z' GROUP BY user HAVING count(*) > 1 ORDER BY user", "SELECT v FROM logs WHERE user = 'a' ORDER BY v DESC LIMIT 2", "SELECT max(v) AS m FROM logs", "SELECT user AS u, v FROM logs WHERE v IS NOT NULL ORDER BY v"):
        assert [tuple(r) for r in e.run(convert(sql)).collect()] == [tuple(r) for r in spark.sql(sql).collect()], convert(sql)
    for sql in ("SELECT * FROM a JOIN b", "SELECT v FROM logs LIMIT 3", "SELECT v, count(*) FROM logs GROUP BY user", "SELECT a FROM t WHERE b LIKE 'x%'", "SELECT a FROM (SELECT 1)"):
        with pytest.raises(QueryError):
            convert(sql)
