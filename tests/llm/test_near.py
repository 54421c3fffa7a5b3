import random

from rivulet.llm import near, stages

SCHEMA = "doc_id long, text string"


def words(rng, n):
    return ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n)]


def left(spark, rows):
    return sorted(((r.doc_id, r.text) for r in stages.one_of_near(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)


def test_null_and_repeated_ids_lose_no_text(spark):
    rng = random.Random(1)
    a, b, c, d, e, f = (" ".join(words(rng, 100)) for _ in range(6))
    rows = [(None, a), (None, b), (None, b + " more"), (None, c), (3, c), (7, d), (7, e), (8, d), (9, e), (9, f), (None, f)]
    got = left(spark, rows)
    assert [t for i, t in got if i is None].count(a) == 1 and sum(t.startswith(b) for _, t in got) == 1
    assert [(i, t) for i, t in got if i is not None] == sorted([(3, c), (7, d), (7, e), (9, f)], key=str) and len(got) == 6


def test_pairs_at_the_bound(spark):
    """All pairs at 0.8 and little above are found, those below it and those with one repeated line are not."""
    rng = random.Random(2)
    rows, apart = [], set()
    for i in range(150):
        w = words(rng, 300)
        other = list(w)
        for at in rng.sample(range(0, 300, 10), rng.choice((6, 6, 7, 7, 8, 9))):
            other[at] = "zz" + str(at)
        s = near.similarity(near.shingles(" ".join(w)), near.shingles(" ".join(other)))
        sets = [set(zip(*[x[k:] for k in range(5)])) for x in (w, other)]
        assert s == len(sets[0] & sets[1]) / len(sets[0] | sets[1])
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(other))]
        if s < 0.8:
            apart.add(2 * i + 1)
    assert 20 < len(apart) < 130
    line = words(rng, 5) * 16
    rows += [(1000 + i, " ".join(words(rng, 120) + line)) for i in range(20)]
    assert {i for i, _ in left(spark, rows)} == {*range(0, 300, 2)} | apart | {*range(1000, 1020)}


def test_chains_without_a_centre(spark):
    """Each text is near the next one only; a star about any of them does not reach all."""
    rng = random.Random(3)
    w, rows = words(rng, 330), []
    for i in range(9):
        rows.append((50 - i, " ".join(w[10 * i : 10 * i + 200])))
    assert [i for i, _ in left(spark, rows)] == [42]
