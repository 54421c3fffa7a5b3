"""Exact groups against a dictionary of normalised texts, and names against the blocks that they stand for."""

import hashlib
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from rivulet.llm import naming
from rivulet.llm.queries import QUERIES


def plain(rows):
    norm = [(i, re.sub(r"[\x20\x09-\x0D]+", " ", t or "")) for i, t in rows]
    sizes = Counter(t for _, t in norm)
    least = {}
    for i, t in norm:
        least[t] = min([x for x in (least.get(t), i) if x is not None], default=None)
    return sorted(((i, least[t], sizes[t], hashlib.sha256(t.encode()).hexdigest()) for i, t in norm), key=str)


def found(spark, rows, schema="doc_id long, text string", **more):
    got = naming.groups(spark.createDataFrame(rows, schema), **more).collect()
    for t in {r.text_sha256 for r in got}:
        kept = [r for r in got if r.text_sha256 == t and r.kept]
        assert len(kept) == 1 and kept[0].doc_id == kept[0].keep_id
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str)


def test_lengths_about_blocks(spark, monkeypatch):
    """Texts that differ in one byte, at ends of blocks and beyond them, of 1 to 70 blocks."""
    monkeypatch.setattr(naming, "BLOCK", 4)
    rng = random.Random(5)
    texts = ["", " ", "\t\n ", None]
    for n in (1, 3, 4, 5, 7, 8, 9, 12, 16, 17, 63, 64, 65, 279, 280):
        t = "".join(rng.choice("ab") for _ in range(n))
        texts += [t, t, t[:-1] + "c", "c" + t[1:], t + "a", t + " ", " " + t, t.replace("a", "\u00e9")]
    texts += ["aaaa" * k for k in range(1, 20)]
    rows = list(enumerate(texts, 1))
    rng.shuffle(rows)
    assert found(spark, rows) == plain(rows)


def test_hot_groups(spark):
    """Copies that are most of the table, of several blocks, beside texts that share their blocks in part."""
    long = "word " * 700
    rows = [(i, long + (" tail" if i % 3 == 1 else "")) for i in range(600)] + [(1000 + i, f"{long}{i}") for i in range(200)] + [(5000, ""), (5001, "")]
    assert found(spark, rows) == plain(rows)


def test_odd_rows(spark):
    rows = [(3, "a  b"), (3, "a\u000bb"), (None, "a b"), (None, None), (7, ""), (2, "x" * 300_000), (9, "x" * 300_000), (9, "x" * 300_000), (1, "\u00a0"), (4, "\x1c")]
    assert found(spark, rows) == plain(rows)
    clash = spark.createDataFrame([(1, "a", "z", 3), (2, "a", "z", 3)], "row long, t string, name string, level int")
    got = naming.groups(clash, doc_id="row", text="t").collect()
    assert sorted((r.doc_id, r.keep_id, r.kept) for r in got) == [(1, 1, True), (2, 1, False)]
    assert found(spark, []) == []


def test_names_are_equal_where_keys_are(spark, monkeypatch):
    """Buckets of many keys, hot keys among them."""
    monkeypatch.setattr(naming, "LEAST_BUCKETS", 3)
    df = spark.range(5000).select("id", (F.col("id") % 7 * (F.col("id") % 100)).alias("x"), F.when(F.col("id") % 2 == 0, "a").otherwise(F.col("id").cast("string")).alias("y"))
    for key in (["x"], ["y"], ["x", "y"]):
        got = naming.name(df.select("id", *key), key, 5000).join(df, "id").collect()
        assert len({(r.name, *(r[k] for k in key)) for r in got}) == len({r.name for r in got}) == len({tuple(r[k] for k in key) for r in got})
        assert len(got) == 5000


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = QUERIES["op12_naming"](spark, sf).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == plain(rows)
    assert all(r.kept == (r.doc_id == r.keep_id) for r in got)
