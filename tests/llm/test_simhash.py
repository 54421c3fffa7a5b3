import random
from dataclasses import replace

import numpy as np
import xxhash
from rivulet.llm import graph, simhash
from rivulet.llm.simhash import EXACT, Ring


def brute_fp(text, k):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    parts = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    h = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, fps, near):
    parent = list(range(len(ids)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= near:
                parent[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        least[find(i)] = min(least.get(find(i), d), d)
    return {d: least[find(i)] for i, d in enumerate(ids)}


def test_fingerprint_as_brute_force():
    rng = random.Random(1)
    for n in (0, 1, 3, 4, 5, 50, 700):
        t = " ".join(rng.choice(["Ab", "é", "cd", "x1", "\n"]) + str(rng.randrange(40)) for _ in range(n))
        assert simhash.lanes_of(t, EXACT)[0] & (1 << 64) - 1 == brute_fp(t, 4)
    assert simhash.lanes_of(None, EXACT) == [0] and simhash.lanes_of(" \n", EXACT) == [0]


def test_components_as_brute_force(spark, monkeypatch):
    """Random fingerprints about a few centres, with crowded buckets cut into blocks."""
    monkeypatch.setattr(simhash, "BLOCK", 64)
    rng = random.Random(2)
    fps = random_prints(rng)
    fps += fps[:30]
    ids = rng.sample(range(10_000), len(fps))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(d, [f]) for d, f in zip(ids, signed)], "doc_id long, fp array<long>")
    got = {r.doc_id: r.component_id for r in simhash.classes(df, EXACT).collect()}
    assert got == brute_components(ids, fps, 4)


def test_odd_rows(spark):
    df = spark.createDataFrame([(5, None, "x"), (4, "", "y"), (7, "a b", "z"), (7, "a b", "z"), (None, "q", "w")], "doc_id long, text string, fp string")
    prints = simhash.fingerprints(df, ["doc_id"], EXACT)
    got = simhash.classes(prints, EXACT).collect()
    assert sorted((r.doc_id, r.component_id) for r in got if r.doc_id) == [(4, 4), (5, 4), (7, 7), (7, 7)] and len(got) == 5
    assert simhash.classes(simhash.fingerprints(df.limit(0), ["doc_id"], EXACT), EXACT).collect() == []


def test_graph(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(7, 3), (3, 7), (9, 9), (5, 200), (200, 130)]
    got = {r.id: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 5 for i in [*range(100, 141), 200]}, 7: 3}


def random_prints(rng):
    fps = [rng.getrandbits(64) for _ in range(200)]
    for centre in [rng.getrandbits(64) for _ in range(6)] + [0]:
        for _ in range(80):
            f = centre
            for _ in range(rng.randrange(7)):
                f ^= 1 << rng.randrange(64)
            fps.append(f)
    return fps


def test_longer_keys_find_the_same(spark, monkeypatch):
    """Chains of two segments in the key, as in tables of millions."""
    monkeypatch.setattr(simhash, "LONGER", 10)
    rng = random.Random(5)
    fps = random_prints(rng)
    df = spark.createDataFrame([(d, [f - (1 << 64) if f >> 63 else f]) for d, f in enumerate(fps)], "doc_id long, fp array<long>")
    got = {r.doc_id: r.component_id for r in simhash.classes(df, EXACT).collect()}
    assert got == brute_components(range(len(fps)), fps, 4)


def test_pairs_for_each_fingerprint_stay_few(monkeypatch):
    """Pairs that are looked at for each of n random fingerprints, n from 1e5 to 1e7, as their expected number: rows
    that meet in a bucket of the key's bits."""
    for n in (10**5, 10**6, 10**7):
        ring = replace(EXACT, keys=1 if n <= simhash.LONGER else 2)
        rows = len(ring.widths) * (1 if ring.keys == 1 else 1 + ring.widths[0])
        assert rows * n / 2 ** min(ring.widths[i] + (ring.widths[i - 1] if ring.keys == 2 else 0) for i in range(5)) < 1300


def test_rows_and_chains():
    """Rows carry the ring from their segment on, and the chains' budgets are those of brute force over bits."""
    rng = random.Random(6)
    for ring in (EXACT, replace(EXACT, keys=2), Ring(lanes=4, bits=40, widths=(11,) * 23, words=2)):
        total = sum(ring.widths)
        fps = [[rng.getrandbits(64) for _ in range(ring.lanes)] for _ in range(40)]
        fps += [[x ^ (1 << rng.randrange(64)) for x in f] for f in fps]
        bits = [[f[b // 64] >> b % 64 & 1 for b in range(total)] for f in fps]
        rows = simhash.rows_of(np.array(fps, np.uint64), ring)
        linker, starts = simhash.Linker(ring), np.cumsum((0, *ring.widths))
        for place, bucket, carried, probe in rows:
            segment = int(bucket[0]) >> ring.shift()
            for r, k in enumerate(place.tolist()):
                ring_bits = [bits[k][(starts[segment] + i) % total] for i in range(64 * ring.words)]
                assert [int(carried[r][i // 64]) >> i % 64 & 1 for i in range(64 * ring.words)] == ring_bits
                key = ring.widths[segment] + (ring.widths[(segment + 1) % len(ring.widths)] if ring.keys == 2 else 0)
                differ = sum(int(bucket[r]) >> i & 1 != ring_bits[i] for i in range(key))
                assert differ == probe
            i, j = map(np.ravel, np.meshgrid(np.arange(len(fps)), np.arange(len(fps))))
            a, b, _ = linker.near(carried, np.full(len(fps), segment), i, j)

            def passes(x, y):
                d, at = 0, starts[segment]
                for c, w in enumerate(ring.widths[segment:] + ring.widths[:segment], 1):
                    d += sum(bits[x][(at + k) % total] != bits[y][(at + k) % total] for k in range(w))
                    at += w
                    if at - starts[segment] > 64 * ring.words:
                        return True
                    if c in lengths and d > ring.bits * c // len(ring.widths):
                        return False
                return True

            lengths = {2, 3, 4, 5, 6, 8, 10} | {len(ring.widths)}
            if not probe:
                assert set(zip(a.tolist(), b.tolist())) == {(x, y) for x in range(len(fps)) for y in range(len(fps)) if passes(x, y)}


def test_forest_spans_with_the_closest():
    rng = np.random.default_rng(7)
    a, b = rng.integers(0, 60, 300), rng.integers(0, 60, 300)
    d = rng.integers(0, 5, 300)
    pick = simhash.forest(a, b, d, 60)
    parent, weight, n = list(range(60)), 0, 0

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k in sorted(range(300), key=lambda k: d[k]):
        x, y = find(a[k]), find(b[k])
        if x != y:
            parent[x], weight, n = y, weight + d[k], n + 1
    assert len(pick) == n and d[pick].sum() == weight


def test_whole_and_equal_texts(spark):
    """A text of 200,000 words counts to its end; thousands of equal fingerprints are one node."""
    long = " ".join(str(i) for i in range(200_000))
    rows = [(1, long), (2, long + " tail"), (3, long + " tail" * 150_000)] + [(10 + i, "same words for all of them") for i in range(5000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in simhash.classes(simhash.fingerprints(df, ["doc_id"], EXACT), EXACT).collect()}
    assert simhash.lanes_of(rows[2][1], EXACT)[0] & (1 << 64) - 1 == brute_fp(rows[2][1], 4) and got[3].component_id == 3
    assert {got[10 + i].component_id for i in range(5000)} == {10} and len(got) == len(rows)
