"""Registered queries against their SQL, on small events of a kind that the driver's small tables lack."""

import duckdb
import pytest
from rivulet import queries_ingest, queries_more, queries_rest  # noqa: F401  register their queries
from rivulet.engine import Engine
from rivulet.plans.profile import Profile
from rivulet.queries import ORACLE, QUERIES

#: Name to the events on which the query is run. Six thousand errors of a week: more than a bounded run of a rule keeps.
_ERRORS = "SELECT i AS event_id, TIMESTAMP '2024-01-24 01:00:00' + i * INTERVAL 95 SECOND AS ts, i * i % 41 AS user_id, 'error' AS event_type, 60.0 AS value, '{}' AS props FROM range(6000) t(i)"
#: Five thousand purchases of two days, and an entity whose alert of the second day falls within the hour of the first's.
_PURCHASES = "SELECT i AS event_id, TIMESTAMP '2024-01-19' + i * INTERVAL 34 SECOND AS ts, i * i % 41 AS user_id, 'purchase' AS event_type, 61.0 AS value, '{}' AS props FROM range(5000) t(i)"
_PURCHASES += " UNION ALL SELECT -i, TIMESTAMP '2024-01-19 23:45:00' + i * INTERVAL 10 MINUTE, 50, 'purchase', 61.0, '{}' FROM range(1, 3) t(i)"
CASES = {
    "risk_dataset": _ERRORS,
    "signals_dataset": f"{_ERRORS} UNION ALL SELECT -i, TIMESTAMP '2024-01-20' + i * INTERVAL 1 MINUTE, i % 3, 'purchase', 160.0, '{{}}' FROM range(1, 9) t(i)",
    "rule_alerts": _PURCHASES,
    # One kind on 999 hosts, one on 1,000, one on three.
    "prevalence_stage": "SELECT i AS event_id, TIMESTAMP '2024-01-02' + i * INTERVAL 1 MINUTE AS ts, i // 3 AS user_id, ['view', 'click', 'error'][1 + i % 3] AS event_type, 1.0 AS value, '{}' AS props FROM range(3000) t(i) WHERE i <> 3 AND (i % 3 < 2 OR i < 9)",
    # Users of 256 and more have no address, and so are in no network.
    "eval_names_more": "SELECT i AS event_id, TIMESTAMP '2024-01-02' + i * INTERVAL 1 MINUTE AS ts, [5, 10, 127, 255, 256, 266, 383, 90000][1 + i % 8]::BIGINT AS user_id, ['view', 'click'][1 + i % 2] AS event_type, 1.0 AS value, '{\"k\": 3}' AS props FROM range(16) t(i)",
    # Events whose numbers reach into the second byte of an address, and beyond it.
    "eval_ip": "SELECT e AS event_id, TIMESTAMP '2024-01-02' AS ts, u AS user_id, 'view' AS event_type, 1.0 AS value, '{}' AS props FROM (SELECT unnest([0, 9, 10, 127, 169, 172, 192, 223, 224, 255, 256, 300]::BIGINT[]) AS u), (SELECT unnest([0, 1048575, 1048576, 1500000, 2097152, 11010048, 16711679, 16777215, 16777216, 40000000]::BIGINT[]) AS e)",
}


@pytest.mark.parametrize("name,events", [*CASES.items(), ("signals_dataset", _ERRORS), ("signals_dataset", f"{_ERRORS} LIMIT 0")])
def test_query_agrees_with_its_sql(spark, tmp_path, name, events):
    con = duckdb.connect()
    con.execute(f"COPY ({events}) TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    want = con.execute(ORACLE[name])
    names = [c[0] for c in want.description]
    got = QUERIES[name](spark, str(tmp_path)).select(*names).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want.fetchall()))


def test_private_and_public_addresses(spark):
    """The networks that are not public, at their ends."""
    inside = ["10.0.0.0", "10.255.255.255", "172.16.0.0", "172.31.255.255", "192.168.0.0", "192.168.255.255"]
    reserved = ["127.0.0.1", "169.254.0.0", "169.254.255.255", "0.1.2.3", "224.0.0.0", "255.255.255.255"]
    public = ["9.255.255.255", "11.0.0.0", "172.15.255.255", "172.32.0.0", "192.167.255.255", "192.169.0.0", "169.253.255.255", "169.255.0.0", "223.255.255.255"]
    df = spark.createDataFrame([(a,) for a in inside + reserved + public], "ip string")
    rows = Engine(spark, {"logs": (df, Profile("t", "none", ("ip",)))}).run("* | eval p=is_private_ip(ip), q=is_public_ip(ip) | table ip p q").collect()
    assert {r.ip: (r.p, r.q) for r in rows} == {a: (True, False) for a in inside} | {a: (False, False) for a in reserved} | {a: (False, True) for a in public}
