from collections import Counter

import numpy as np
from pyspark.sql import functions as F
from rivulet.llm import mixing


def taken(df):
    from rivulet.llm.queries import QUERIES  # noqa: F401  the query adds these columns up in the same way

    mix = mixing.mix(df, {"doc_id": F.col("doc_id")})
    words = F.coalesce(F.col("hi") - F.col("lo"), F.lit(0))
    rows = mix.spans("doc_id").groupBy("doc_id", "sid", "start", "size").agg(F.sum(words).alias("taken")).collect()
    return rows, mix


def test_targets_fill_up():
    sizes, weights = [10, 1000, 50, 0], [5, 2, 1, 5]
    got = mixing.targets(sizes, weights, 1.5 * sum(sizes))
    assert got[0] == 20 and got[3] == 0 and abs(sum(got) - 1590) < 1e-9 and all(t <= 2 * s + 1e-9 for t, s in zip(got, sizes))
    assert mixing.targets([], [], 0) == []


def test_permutations():
    for n in (1, 2, 3, 100, 1023):
        for key in (0, 5, 12345):
            assert sorted(mixing.permutation(np.arange(n), n, key).tolist()) == list(range(n))


def test_shards_share_totals_exactly():
    totals = np.array([5000, 123, 0, 20000])
    shards = -(-totals.sum() // mixing.SHARD)
    last = totals.sum() - (shards - 1) * mixing.SHARD
    each = [mixing.shard_counts(totals, i, int(shards), int(last)) for i in range(shards)]
    assert (sum(h for _, h in each) == totals).all() and [int(h.sum()) for _, h in each[:-1]] == [mixing.SHARD] * (shards - 1)
    assert all((b == sum((h for _, h in each[:i]), np.zeros(4, int))).all() for i, (b, _) in enumerate(each))


def test_words_come_near_targets_and_reruns_agree(spark):
    rows = [(i, "w " * (i % 90), f"s{i % 4}" if i % 5 else None, "x") for i in range(2000)] + [(5000, "v " * 60_000, "s1", "y"), (None, "u " * 10, "s2", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, taken string").repartition(5)
    got, mix = taken(df)
    by = Counter()
    for r in got:
        assert 0 <= r.taken <= 2 * r.size
        by[r.sid] += r.taken
    for i, s in enumerate(mix.sources):
        assert abs(by[i] - s.target) <= 1, (i, by[i], s)
    assert mix.sources[-1].name is None and sum(s.size for s in mix.sources) == sum(len((r[1] or "").split()) for r in rows)
    again, _ = taken(df.repartition(3))
    key = lambda x: sorted((r.doc_id or -1, r.start, r.taken) for r in x)
    assert key(got) == key(again)


def test_query_has_a_row_for_each_document(spark, tmp_path):
    from rivulet.llm.queries import QUERIES

    rows = [(i // 2, "w " * (i % 3) if i % 4 else None, "ab"[i % 2]) for i in range(400)] + [(None, "", None)] * 3
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    got = QUERIES["op1_mixing"](spark, str(tmp_path)).collect()
    assert sorted((r.doc_id or -1, r.size) for r in got) == sorted((d or -1, len((t or "").split())) for d, t, _ in rows)
    assert all(0 <= r.taken <= 2 * r.size for r in got)


def test_odd_tables(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (3, " \n", None)], "doc_id long, text string, source string")
    got, _ = taken(df)
    assert sum(r.taken for r in got) == 0
    assert taken(df.limit(0))[0] == []
    got, mix = taken(spark.createDataFrame([(1, "one two three", "a"), (1, "one two three", "a")], "doc_id long, text string, source string"))
    assert sum(r.taken for r in got) == 9 == round(mix.sources[0].target)


def test_inverse_permutation():
    for n in (1, 2, 100, 1023, 70_000):
        k = np.arange(n)
        assert (mixing.permutation(mixing.permutation(k, n, 9), n, 9, back=True) == k).all()


def plain_plan(size, target, sid):
    """Slots one by one, pass by pass, until the target's words are reached: how many, and the words of the last."""
    blocks, want, k = -(-size // mixing.BLOCK), round(target), 0
    while want > 0:
        place = int(mixing.permutation(np.array([k % blocks]), blocks, mixing.key_of(sid, k // blocks))[0])
        words = size - place * mixing.BLOCK if place == blocks - 1 else mixing.BLOCK
        k, last, want = k + 1, min(words, want), want - words
    return (k, last) if k else (0, None)


def test_plan_as_plain_slots():
    rng = np.random.default_rng(3)
    for sid in range(300):
        size = int(rng.integers(1, 3000))
        target = float(rng.uniform(0, 2 * size)) if sid % 3 else float(size * (1 + sid % 2))
        s = mixing.Source("x", size, target)
        s.plan(sid)
        slots, last = plain_plan(size, target, sid)
        assert s.slots == slots and (not slots or s.last_words == last), (sid, size, target)


def test_plan_of_large_sources_costs_nothing():
    import time
    import tracemalloc

    tracemalloc.start()
    at = time.time()
    s = mixing.Source("x", 10**13 + 7, 1.37 * 10**13)
    s.plan(5)
    assert time.time() - at < 1 and tracemalloc.get_traced_memory()[1] < 5e6
    tracemalloc.stop()
    assert 0 < s.last_words <= mixing.BLOCK and abs(s.slots * mixing.BLOCK - s.target) < 3 * mixing.BLOCK


def test_draws_beyond_the_generator(monkeypatch):
    """Mean and variance of the hypergeometric distribution, with the generator's end put at 50 items and at its own."""
    for most, counts, n in ((50, (300, 200), 150), (10**9, (3 * 10**12, 5 * 10**12), 10**12)):
        monkeypatch.setattr(mixing, "MOST", most)
        rng, total = np.random.default_rng(1), sum(counts)
        got = np.array([mixing.draw(np.array(counts), n, rng) for _ in range(3000)])
        assert (got.sum(1) == n).all() and (got <= counts).all()
        share = counts[0] / total
        variance = n * share * (1 - share) * (total - n) / (total - 1)
        assert abs(got[:, 0].mean() - n * share) < 5 * (variance / 3000) ** 0.5 and 0.85 < got[:, 0].var() / variance < 1.15
