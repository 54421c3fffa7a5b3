"""Runs against a plain search over all starts and periods."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from rivulet.llm import runs
from rivulet.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_runs(w):
    """All runs by looking at every period and every maximal stretch of equal words that it keeps apart."""
    found = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(12, 2 * q):
                found.setdefault((i, j + q), q)  # smaller periods come first
            i = j
    return sorted((s, e - s, q) for (s, e), q in found.items())


def plain(doc_id, text):
    w = WORD.findall(text or "")
    n, h = len(w), zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = plain_runs(w)
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (
        doc_id, len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
        sha("".join(f"{s},{length},{q}\n" for s, length, q in found)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)),
    )


def random_text(rng):
    """Words of a small alphabet, with stretches that repeat, in part inside each other."""
    w = [rng.choice("abc") for _ in range(rng.randrange(0, 60))]
    for _ in range(rng.randrange(4)):
        at, n, times = rng.randrange(len(w) + 1), rng.randrange(1, 9), rng.randrange(2, 9)
        part = [rng.choice("abcdefgh") for _ in range(n)]
        w[at:at] = (part * times)[: n * times - rng.randrange(n)]
    return w


def test_runs_of_small_alphabets():
    rng = random.Random(3)
    for _ in range(60):
        texts = [random_text(rng) for _ in range(20)]
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        flat = np.array([ord(x) for t in texts for x in t], np.int64)
        start, end, period = runs.runs(flat, offsets)
        for i, t in enumerate(texts):
            mine = (start >= offsets[i]) & (start < offsets[i + 1])
            got = list(zip((start[mine] - offsets[i]).tolist(), (end - start)[mine].tolist(), period[mine].tolist()))
            assert got == plain_runs(t), " ".join(t)


def test_words_are_those_of_the_contract():
    texts = ["", None, " a\x0bb\x0c\x1fc\x1c \x85d e f\r\n", "\t", "x" * 5, "a\x00b c"]
    dictionary, words, offsets = runs.words_of(pa.array(texts))
    got = [[dictionary[int(i)].as_py() for i in words[a:b]] for a, b in zip(offsets, offsets[1:])]
    assert got == [WORD.findall(t or "") for t in texts]


def test_extremes():
    one = np.zeros(5000, np.int64)
    assert [x.tolist() for x in runs.runs(one, np.array([0, 5000]))] == [[0], [5000], [1]]
    fib = ["a", "ab"]
    while len(fib[-1]) < 900:
        fib.append(fib[-1] + fib[-2])
    w = np.array([ord(x) for x in fib[-1]], np.int64)
    start, end, period = runs.runs(w, np.array([0, len(w)]))
    assert list(zip(start.tolist(), (end - start).tolist(), period.tolist())) == plain_runs(fib[-1])
    assert not len(runs.runs(np.arange(100), np.array([0, 100]))[0])
    assert not len(runs.runs(np.zeros(0, np.int64), np.array([0, 0]))[0])


def test_query_against_plain(spark):
    sf = "/root/testdata/sf0.001"
    got = {tuple(r) for r in QUERIES["op11_runs"](spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert got == {plain(*r) for r in docs}
    assert any(r[1] for r in got)


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Nulls, empties, a very long text, repeated rows, a column named like a result."""
    at = tmp_path_factory.mktemp("odd")
    rows = [(1, None, 1), (2, "", 2), (None, "a b " * 10, 3), (4, "  \t\n", 4), (5, "la " * 60000, 5), (5, "la " * 60000, 5), (10, "x y z w " * 4 + "end", None)]
    spark.createDataFrame(rows, "doc_id long, text string, n_runs int").write.parquet(f"{at}/documents.parquet")
    return str(at), rows


def test_odd_rows(spark, odd):
    at, rows = odd
    want = [plain(i, t) for i, t, _ in rows if i and len(t or "") < 1000]
    got = [tuple(r) for r in QUERIES["op11_runs"](spark, at).collect()]
    assert len(got) == len(rows)
    assert all(w in got for w in want)
    null = next(r for r in got if r[0] is None)
    assert null[1:5] == (1, 0, 20, 2)  # a null id changes nothing
    assert [r[1:5] for r in got if r[0] == 5] == [(1, 0, 60000, 1)] * 2
    listed = runs.collapse(spark.read.parquet(f"{at}/documents.parquet").drop("n_runs"), ["doc_id"])
    assert {r.collapsed for r in listed.filter("doc_id = 10").collect()} == {"x y z w end"}


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert runs.summary(empty, ["doc_id"]).collect() == []
    assert runs.collapse(empty, ["doc_id"]).collect() == []
