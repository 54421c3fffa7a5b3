"""Longest networks against ipaddress, whatever the share of an address; indicators by value."""

import ipaddress
import random

import pytest
from pyspark.sql import functions as F

from rivulet.operators import enrich, hot


def nets(spark, rows, **more):
    df = spark.createDataFrame(rows, "network string, country string, updated int, deleted boolean")
    return enrich.network_table(df, facts=("country",), updated="updated", deleted="deleted", **more)


def plain(address, rows):
    """The country of the longest network by looking at all of them."""
    try:
        a = ipaddress.ip_address(address)
    except (ValueError, TypeError):
        return None
    a = int(a) if a.version == 6 else int(a) + (0xFFFF << 32)
    newest = {}
    for network, country, updated, deleted in rows:
        try:
            n = ipaddress.ip_network(network, strict=False)
        except (ValueError, TypeError):
            continue
        length = n.prefixlen + (96 if n.version == 4 else 0)
        first = int(n.network_address) + (0xFFFF << 32 if n.version == 4 else 0)
        key = (length, first)
        if key not in newest or updated > newest[key][0]:
            newest[key] = (updated, None if deleted else country, bool(deleted))
    best = None
    for (length, first), (_, country, gone) in newest.items():
        if not gone and a >> 128 - length == first >> 128 - length if length else not gone:
            best = max(best or (-1, None), (length, country), key=lambda x: x[0])
    return best and best[1]


@pytest.mark.parametrize("small", [True, False])
def test_longest_of_nested_networks(spark, monkeypatch, small):
    monkeypatch.setattr(enrich, "SMALL", 200_000 if small else 0)
    rng = random.Random(8)
    rows = [("0.0.0.0/0", "any4", 1, False), ("::/0", "any", 1, False), ("2001:db8::/32", "doc", 1, False), ("2001:db8:1::/48", "doc1", 1, None), ("2001:db8:1::8000/113", "doc2", 1, False)]
    rows += [("bad", "x", 1, False), ("10.0.0.0/33", "x", 1, False), ("10.0.0.0/8/1", "x", 1, False), (None, "x", 1, False), ("10.0.0.1", "host", 1, False), ("fe80::1", "link", 1, False)]
    for _ in range(200):
        base = ".".join(str(rng.choice((10, 10, 11, rng.randrange(4)))) for _ in range(4))
        rows.append((f"{base}/{rng.randrange(6, 33)}", rng.choice("abcdef"), rng.randrange(10**6), rng.random() < 0.1))
    addresses = [".".join(str(rng.choice((10, 10, 11, rng.randrange(5)))) for _ in range(4)) for _ in range(300)]
    addresses += ["2001:db8::1", "2001:DB8:1::ffff", "2001:db8:1::1", "fe80::1", "fe80::2", "ffff:ffff:ffff:ffff:ffff:ffff:ffff:ffff", "::", "", "10.0.0", "10.0.0.256", None, "x"]
    addresses += ["10.11.12.13"] * 2000  # most of the events
    df = spark.createDataFrame([(i, a) for i, a in enumerate(addresses)], "id int, src_ip string").repartition(4)
    e = enrich.Enricher(nets(spark, rows), facts=("country",))
    got = {r.id: r.enriched_src_country for r in e.enrich(df).collect()}
    known = {a: plain(a, rows) for a in set(addresses)}
    assert got == {i: known[a] for i, a in enumerate(addresses)}


def test_no_networks_and_clashing_names(spark):
    df = spark.createDataFrame([("1.2.3.4", 7, 8, "mine")], "src_ip string, hi int, lo int, enriched_src_country string")
    out = enrich.Enricher(nets(spark, []), facts=("country",)).enrich(df).collect()
    assert [r.asDict() for r in out] == [{"src_ip": "1.2.3.4", "hi": 7, "lo": 8, "enriched_src_country": None}]
    with_net = enrich.Enricher(nets(spark, [("1.2.0.0/16", "here", 1, False)]), facts=("country",)).enrich(df).collect()
    assert [r.asDict() for r in with_net] == [{"src_ip": "1.2.3.4", "hi": 7, "lo": 8, "enriched_src_country": "here"}]
    assert enrich.Enricher(nets(spark, []), facts=("country",)).enrich(df.limit(0)).collect() == []


@pytest.mark.parametrize("small", [True, False])
def test_indicators(spark, monkeypatch, small):
    monkeypatch.setattr(enrich, "SMALL", 200_000 if small else 0)
    facts = spark.createDataFrame([("EVIL.example", "c2", "bot", 90, 1, False), ("evil.example", "c2", "bot2", 10, 2, False), ("1.2.3.4", "scan", None, 40, 1, False), ("gone.example", "c2", "bot", 99, 1, True), (None, "c2", "x", 1, 1, False), (" ", "c2", "x", 1, 1, False)], "indicator string, threat_type string, malware string, confidence int, updated int, deleted boolean")
    df = spark.createDataFrame([(1, "1.2.3.4", "Evil.Example"), (2, None, "gone.example"), (3, "5.6.7.8", None), (4, "1.2.3.4", "")], "id int, src_ip string, domain string")
    out = enrich.Enricher(indicators=enrich.indicator_table(facts, updated="updated", deleted="deleted")).enrich(df).orderBy("id").collect()
    assert [(r.ioc_matched, r.ioc_confidence, r.ioc_src_ip_threat_type, r.ioc_domain_malware) for r in out] == [(True, 40, "scan", "bot2"), (False, None, None, None), (False, None, None, None), (True, 40, "scan", None)]
    assert "ioc_dest_ip_malware" not in out[0]


def test_frequent_keys_stay_where_they_are(spark):
    """A key of most rows is in no shuffle by key, and neither are null ones."""
    rows = spark.range(10_000).select("id", F.when(F.col("id") % 5 == 0, None).when(F.col("id") % 2 == 0, 7).otherwise(F.col("id")).alias("k"))
    facts = spark.range(0, 10_000, 3).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v")).unionByName(spark.createDataFrame([(7, 1)], "k long, v long"))
    out = hot.join_facts(rows, facts, ["k"])
    want = {r.id: (None if r.k is None else 1 if r.k == 7 else r.k * 2 if r.k % 3 == 0 else None) for r in rows.collect()}
    assert {r.id: r.v for r in out.collect()} == want
    assert out.count() == 10_000


def test_events_are_read_a_few_times(spark, monkeypatch, tmp_path):
    """Scans of the events grow with the number of fields, not as its power."""
    monkeypatch.setattr(enrich, "SMALL", 0)
    path = str(tmp_path / "ev")
    spark.range(100).selectExpr("id", "concat('10.0.0.', id % 7) AS src_ip", "concat('10.0.1.', id % 9) AS dest_ip", "concat('d', id % 5) AS domain", "concat('h', id) AS file_hash").write.parquet(path)
    threats = spark.createDataFrame([("d1", "c2", "bot", 9), ("10.0.0.3", "scan", "x", 5)], "indicator string, threat_type string, malware string, confidence int")
    e = enrich.Enricher(nets(spark, [("10.0.0.0/24", "a", 1, False), ("10.0.1.4/30", "b", 1, False)]), enrich.indicator_table(threats), facts=("country",))
    out = e.enrich(spark.read.parquet(path))
    rows = out.collect()
    assert sum(r.enriched_src_country == "a" for r in rows) == 100 and sum(r.enriched_dest_country == "b" for r in rows) == sum(4 <= i % 9 < 8 for i in range(100))
    assert sum(r.ioc_matched for r in rows) == sum(i % 5 == 1 or i % 7 == 3 for i in range(100))
    scans = out._jdf.queryExecution().optimizedPlan().toString().count("parquet")
    assert scans <= 30
