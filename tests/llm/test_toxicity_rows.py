"""op2 learns from every labelled row: counts, model and thresholds, where rows are more than training starts with."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from rivulet.llm import toxicity

WORDS = ["river", "stone", "window", "garden", "letter", "morning", "paper", "bridge", "silver", "winter", "summer", "market"]


@pytest.fixture
def few(monkeypatch):
    for name, value in {"TRAIN": 24, "STEPS": 40, "PART_BYTES": 20_000, "CHUNK": 50_000}.items():
        monkeypatch.setattr(toxicity, name, value)


def corpus(spark, n=900):
    """Documents and labels; rows that training starts with know vile for label 1, all others grim."""
    rng = random.Random(3)
    labels = [(i, int(i % 3 == 0)) for i in range(n)]
    ids = spark.createDataFrame(labels, "doc_id long, label int")
    rank = {y: ids.filter(F.col("label") == y).orderBy(F.xxhash64("doc_id")).limit(toxicity.TRAIN).collect() for y in (0, 1)}
    first = {r.doc_id for rows in rank.values() for r in rows}

    def doc(i, y):
        words = [rng.choice(WORDS) for _ in range(20 + i % 17)]
        if y:
            words[rng.randrange(20)] = "vile" if i in first else "grim"
        return i, " ".join(words)

    return spark.createDataFrame([doc(*x) for x in labels], "doc_id long, text string"), ids, first


def test_rows_behind_the_first_are_learned(spark, few):
    docs, labels, first = corpus(spark)
    assert len(toxicity.sample(docs, labels, "doc_id", "text", "label")) == len(first) == 48
    model = toxicity.learn(docs, labels)
    rng = random.Random(4)
    plain = [[rng.choice(WORDS) for _ in range(30)] for _ in range(200)]
    scores = model.scores([" ".join(w) for w in plain] + [" ".join(w[:9] + ["grim"] + w[10:]) for w in plain])
    assert np.mean((scores >= toxicity.CUT) == ([False] * 200 + [True] * 200)) > 0.95
    again = toxicity.learn(docs.repartition(7), labels.repartition(3))
    assert all((a == b).all() for a, b in ((model.table, again.table), (model.out, again.out), (model.shift, again.shift)))


def test_counts_odds_and_changes_are_of_all_rows(spark, few):
    docs, labels, _ = corpus(spark, 300)
    one = toxicity.rows_of(docs.unionAll(docs), labels.unionAll(labels), "doc_id", "text", "label")
    rows = [(toxicity.words_of(r.t), r.y, r.fold) for r in one.orderBy("h").collect()]
    assert len(rows) == 300 and {k for *_, k in rows} == set(range(toxicity.FOLDS))
    usual = toxicity._usual(one)
    for k in range(toxicity.FOLDS + 1):
        counts = np.zeros(1 << toxicity.BITS, int)
        for words, _, fold in rows:
            if fold != k:
                counts[list({i for w in words for i in toxicity.ids_of(w)})] += 1
        assert ((counts >= toxicity.LEAST) == usual[k]).all()
    y, fold = np.array([y for _, y, _ in rows]), np.array([k for *_, k in rows])
    starts = toxicity._starts([w for w, _, _ in rows], y, fold)
    odds, _, label, n = toxicity._all_odds(one, [s.model(0.5) for s in starts[:-1]], 0.5)
    assert n.sum() == 300 and n[label == 1].sum() == 100
    plain = [float(starts[k].model(0.5).logits([w])[0]) for w, _, k in rows]
    assert np.abs(np.sort(np.repeat(odds, n.astype(int))) - np.sort(plain)).max() < 1 / toxicity.GRID
    # One part: the steps of all its rows, by their hashes, one after another.
    alone = [s.copy() for s in starts]
    codes = toxicity.Codes()
    seqs = codes.of([w for w, _, _ in rows])
    for k, learner in enumerate(alone):
        rest = np.flatnonzero(fold != k)
        assert len(rest) == 300 - (fold == k).sum() <= 512
        for i in range(0, len(rest), toxicity.BATCH):
            at = rest[i : i + toxicity.BATCH]
            learner.step([seqs[j] for j in at], codes.ids, y[at])
    before = [s.copy() for s in starts]
    after = toxicity._descend(one, "doc_id", starts, 1)
    for a, b, c in zip(after, alone, before):
        assert all(np.allclose(p, q, atol=1e-4) for p, q in zip(a.values, b.values)) and not np.allclose(a.values[0], c.values[0], atol=1e-3)


def test_gradients_against_differences():
    rng = random.Random(5)
    texts = [[rng.choice(WORDS).encode() for _ in range(n)] for n in (1, 2, 9, 30, 0)]
    codes, y = toxicity.Codes(), np.array([1, 0, 1, 0, 1])
    seqs = codes.of(texts)
    learner = toxicity.Learner.start(np.ones(1 << toxicity.BITS, bool), 0.4, np.random.default_rng(1))
    learner.values[2][:] = 0.05  # else an empty text lies on the bend
    at, table, *dense = learner.gradients(seqs, codes.ids, y)

    def loss():
        odds = learner.model(0.4).logits(texts)
        return float(np.mean(np.logaddexp(0, odds) - y * odds))

    spots = [(learner.values[0], (int(at[j]), j % toxicity.WIDTH), table[j, j % toxicity.WIDTH]) for j in range(0, len(at), 7)]
    for p, g in zip(learner.values[1:], dense):
        where = np.unravel_index(np.abs(g).argsort(axis=None)[-3:], g.shape)
        spots += [(p, w, g[w]) for w in zip(*where)]
    for p, w, g in spots:
        old, losses = p[w], []
        for e in (3e-4, -3e-4):
            p[w] = old + e
            losses.append(loss())
        p[w] = old
        assert abs((losses[0] - losses[1]) / 6e-4 - g) < 2e-3 + 0.05 * abs(g)


def test_thresholds_count_equal_odds_together():
    """Rows of equal odds fall on one side, and a row that stands for n counts as n rows."""
    odds, labels = np.array([2.0, 2.0, 1.0, 1.0, -1.0]), np.array([1, 0, 1, 0, 0])
    n = np.array([20.0, 10.0, 30.0, 15.0, 400.0])
    short, full = (toxicity.Model(0.5, shift=np.zeros(len(toxicity.ts.LANGUAGES) + 1)) for _ in range(2))
    toxicity._calibrate(short, odds, np.full(5, -1), labels, n)
    each = np.repeat(np.arange(5), n.astype(int))
    toxicity._calibrate(full, odds[each], np.full(len(each), -1), labels[each], np.ones(len(each)))
    assert np.allclose(short.shift, full.shift) and np.isclose(short.shift[-1], np.log(toxicity.CUT / (1 - toxicity.CUT)))


def test_places_of_many_words_as_of_one():
    rng = random.Random(6)
    letters = "abcXYZ09.,'é中😀\ud800ß(\0"
    words = ["".join(rng.choice(letters) for _ in range(rng.choice((1, 2, 3, 4, 5, 8, 9, 13, 16, 40, 70)))) for _ in range(3000)] + ["...", "a" * 48, "a" * 49]
    words = [w for t in words for w in toxicity.words_of(t)]
    assert toxicity.all_ids(words).tolist() == [toxicity.ids_of(w) for w in words] and toxicity.all_ids([]).shape == (0, toxicity.EACH)
