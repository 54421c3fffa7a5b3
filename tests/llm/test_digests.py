import hashlib
import random

from pyspark.sql import functions as F
from rivulet.llm import digests


def brute(rows):
    """doc_id, n_chars, sha of the edited text in the order of ids; ids are distinct."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    out = {}
    for i, (d, t) in enumerate(rows):
        t, nxt = t or "", rows[(i + 1) % len(rows)][1] or ""
        half = len(t) // 2
        out[d] = (len(t), hashlib.sha256((t[: len(t) - half] + nxt[:half]).encode()).hexdigest())
    return out


def check(spark, rows):
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, fingerprint string").repartition(3)
    got = {r.doc_id: r for r in digests.compare(df).collect()}
    assert {d: (r.n_chars, r.edited_sha256) for d, r in got.items()} == brute(rows)
    return got


def test_as_brute_force(spark):
    rng = random.Random(5)
    ids = rng.sample(range(10**6), 2500) + [10**17, None]
    check(spark, [(d, "".join(rng.choice("ab é🙂\n") for _ in range(rng.randrange(12)))) for d in ids])


def test_likeness_and_folding(spark):
    got = check(spark, [(1, "Straße  ﬁne x"), (2, "STRASSE fine x "), (3, None), (4, ""), (5, "éA"), (6, "Éa"), (7, "aaaa")])
    assert got[1].fingerprint == got[2].fingerprint and got[1].near_next == 1.0
    assert got[3].fingerprint == got[4].fingerprint and got[3].near_next == got[3].near_edited == 1.0
    assert got[5].fingerprint == got[6].fingerprint != got[7].fingerprint and got[2].near_next == 0.0


def test_single_empty_and_repeated_rows(spark):
    assert check(spark, [(9, "abcd")])[9].near_next == 1.0
    df = spark.createDataFrame([(1, "x y"), (1, "x y"), (1, "z"), (2, "w" * 100000)], "doc_id long, text string")
    assert len(digests.compare(df).collect()) == 4 and digests.compare(df.limit(0)).collect() == []


def test_bytes_decide_within_a_fingerprint(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(digests, "wide", lambda c: (F.lit(1).cast("long") + F.char_length(c) * 0, F.lit(2).cast("long") + F.char_length(c) * 0))
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "B"), (4, "c")], "doc_id long, text string")
    got = {r.doc_id: r for r in digests.compare(df).collect()}
    assert len({got[i].fingerprint for i in (1, 2, 4)}) == 3 and got[2].fingerprint == got[3].fingerprint
    assert got[2].near_next == 1.0 and got[1].near_next == 0.0


def test_edited_texts_share_the_numbers(spark, monkeypatch):
    """An edited text equal to a document's has its fingerprint, where all hashes are equal, and no other's."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(digests, "wide", lambda c: (F.lit(1).cast("long") + F.char_length(c) * 0, F.lit(2).cast("long") + F.char_length(c) * 0))
    df = spark.createDataFrame([(1, "ab"), (2, "cd"), (3, "ac"), (4, "xy")], "doc_id long, text string")
    got = {r.doc_id: r for r in digests.compare(df).collect()}
    assert got[1].edited_fingerprint == got[3].fingerprint  # "a" and "c"
    assert len({got[i].fingerprint for i in got}) == 4
    texts = {"ab", "cd", "ac", "xy", "ca", "ax", "xa"}
    assert {r.fingerprint for r in got.values()} | {r.edited_fingerprint for r in got.values()} == {"0" * 15 + "1" + "0" * 15 + "2" + (f"-{i}" if i > 1 else "") for i in range(1, len(texts) + 1)}


def test_hot_ids_and_repeats(spark, monkeypatch):
    """A third of the rows have one id, some of these equal in text too, another third has none."""
    monkeypatch.setattr(digests, "ROWS", 20)
    monkeypatch.setattr(digests, "COARSE", 8)
    monkeypatch.setattr(digests, "HOT", 8)
    rng = random.Random(8)
    rows = [(7, f"t{rng.randrange(10**6)}") for _ in range(300)] + [(7, "same text")] * 300 + [(None, f"n{i}") for i in range(300)] + [(None, None)] * 200
    rows += [(i, f"text {i}") for i in rng.sample(range(10**9), 400)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = digests.compare(df).collect()
    keyed = df.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()
    order = sorted(keyed, key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.h))
    want = []
    for i, r in enumerate(order):
        t, nxt = r.text or "", order[(i + 1) % len(order)].text or ""
        half = len(t) // 2
        want.append((r.doc_id or -1, len(t), hashlib.sha256((t[: len(t) - half] + nxt[:half]).encode()).hexdigest()))
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_chars, r.edited_sha256) for r in got) == sorted(want)
