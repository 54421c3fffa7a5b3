import random

import numpy as np
from pyspark.sql import functions as F
from rivulet.llm import langid, qda, rules, toxicity, urls
from rivulet.llm import textstats as ts

EN = "the of and to in is that it was with not this are from house river mountain stone".split()
DE = "der die und in den von zu das mit sich auf nicht haus fluss berg stein über".split()


def prose(rng, words, n):
    return ". ".join(" ".join(rng.choice(words) for _ in range(12)) for _ in range(n // 12 + 1))


def test_base_counts_by_brute_force(spark):
    import re

    rng = random.Random(4)
    texts = [None, "", " \n ", "a b c a b c", "x\nx\n\n \nx y", "é#*$ %&|<>\x1c b\x85c", "l " * 20_000] + ["".join(rng.choice("ab #\n\t") for _ in range(200)) for _ in range(40)]
    df = spark.createDataFrame([(i, t, "en", 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, kept int")
    got = {r.doc_id: r for r in rules.judge(df, ["doc_id"], rules.references(df)).collect()}
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        windows = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        seen = {x for x in windows if windows.count(x) > 1} if len(windows) < 1000 else set(windows)
        covered = {j for k, x in enumerate(windows) if x in seen for j in range(k, k + 3)}
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")))
        assert (r.n_dup_lines, r.n_repeat_words) == (len(lines) - len(set(lines)), len(covered))
        assert r.base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w)) and not (r.kept and r.base_failed)
    assert rules.judge(df.limit(0), ["doc_id"], {}).collect() == [] and rules.references(df.limit(0)) == {}


def test_distance_rejects_junk_and_keeps_prose(spark):
    rng = random.Random(5)
    good = [prose(rng, EN + [f"w{rng.randrange(10**6)}x" for _ in range(300)], 200) for _ in range(30)]
    junk = ["".join(rng.choice("#*$%&|<>XYZ ") for _ in range(1500)) for _ in range(5)]
    df = spark.createDataFrame([(i, t, "en") for i, t in enumerate(good + junk)], "doc_id long, text string, lang string")
    kept = {r.doc_id for r in rules.judge(df, ["doc_id"], rules.references(df)).filter("kept").collect()}
    assert kept == set(range(30))
    assert rules.distance(np.array([1.0, 0]), np.array([0, 1.0])) == 1.0 and rules.distance(np.array([2.0, 2]), np.array([1, 1])) == 0.0


def test_quadratic_discriminant(spark):
    rng = random.Random(6)
    rows = [(i, prose(rng, EN, 80 + i % 50), 1) for i in range(120)] + [(200 + i, "##|$ " * (20 + i) + "A1!! " * 30, 0) for i in range(60)]
    df = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, label int, score double").repartition(3)
    stats = qda.features(df, ["doc_id", "label"]).cache()
    model = qda.fit(stats, F.col("x"), F.col("label"))
    x = np.array([qda.statistics(t) for _, t, y in rows])
    direct = qda.solve({k: (len(p := x[[r[2] == k for r in rows]]), p.sum(0), p.T @ p) for k in (0, 1)})
    assert np.allclose(model.score(x), direct.score(x), atol=1e-6)
    got = qda.score(stats, ["doc_id", "label"], model).collect()
    assert sum(r.predicted == r.label for r in got) >= 178 and all(0 <= r.score <= 1 for r in got)
    odd = spark.createDataFrame([(1, None), (2, ""), (2, ""), (3, "x" * 200_000)], "doc_id long, text string")
    assert len(qda.score(qda.features(odd, ["doc_id"]), ["doc_id"], model).collect()) == 4
    empty = qda.fit(stats.limit(0), F.col("x"), F.col("label"))
    assert empty.prior == 0.5 and qda.score(qda.features(odd.limit(0), ["doc_id"]), ["doc_id"], empty).collect() == []


def test_language_of_texts(spark):
    rng = random.Random(7)
    rows = [(i, prose(rng, EN if i % 2 else DE, 60), "en" if i % 2 else "de") for i in range(240)]
    model = langid.train([(t[: langid.SAMPLE * 2], lang) for _, t, lang in rows[:160]])
    held = [(t, lang) for _, t, lang in rows[160:]]
    assert np.mean([got[0] == lang for got, (_, lang) in zip(model.label([t for t, _ in held]), held)]) > 0.95
    odd = [(1, None, "x"), (2, "", "x"), (3, "12 34 !!", "x"), (4, rows[1][1] * 200, "x"), (4, rows[1][1] * 200, "x"), (5, "a", None)]
    df = spark.createDataFrame(odd, "doc_id long, text string, lang_pred string")
    got = langid.label(df, ["doc_id"], model).collect()
    assert [r.lang_pred for r in got if r.doc_id in (1, 2, 3)] == ["und"] * 3 and [r.lang_pred for r in got if r.doc_id == 4] == ["en"] * 2
    none = langid.learn(df.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in langid.label(df, ["doc_id"], none).collect()} == {"und"}


def test_gradient_through_time():
    """The way back against differences, where no clip is at its edge."""
    rng = np.random.default_rng(0)
    h = 3
    d = langid.Direction(rng.normal(0.4, 0.05, (256, 3 * h)), rng.normal(0, 0.1, (h, 2 * h)), rng.normal(0, 0.1, (h, h)))
    d.x[:, 2 * h :] -= 0.4
    codes = rng.integers(0, 5, (6, 4)).astype(np.uint8)
    weight = rng.normal(0, 1, (6, 4, h))
    f = langid.Direction(*[p.astype(np.float32) for p in (d.x, d.gates, d.candidate)])
    _, kept = langid.forward(f, codes, True)
    grad = langid.backward(f, codes, kept, weight.astype(np.float32))
    for name in ("x", "gates", "candidate"):
        p = getattr(f, name)
        at = (int(codes[0, 0]), 1) if name == "x" else (0, 1)
        old, eps = p[at], 1e-2
        losses = []
        for s in (eps, -eps):
            p[at] = old + s
            losses.append(float((langid.forward(f, codes) * weight).sum()))
        p[at] = old
        assert abs((losses[0] - losses[1]) / (2 * eps) - getattr(grad, name)[at]) < 0.02 + 0.05 * abs(getattr(grad, name)[at])


def test_toxicity_learns_words_and_beginnings(spark):
    rng = random.Random(8)
    words = EN + ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(400)]

    def doc(y):
        t = [rng.choice(words) for _ in range(80)]
        for _ in range(3 if y else 0):
            t[rng.randrange(80)] = "lowei" + rng.choice(("lo", "sp", "au", "er"))
        return " ".join(t)

    rows = [(doc(i % 4 == 0), int(i % 4 == 0)) for i in range(500)]
    rng.shuffle(rows)
    model = toxicity.train(rows[:400])
    s = model.scores([t for t, _ in rows[400:]])
    y = np.array([y for _, y in rows[400:]])
    assert ((s >= 0.7) == (y == 1)).mean() > 0.95
    odd = spark.createDataFrame([(1, None), (2, ""), (2, ""), (3, "lowei " * 50_000)], "doc_id long, text string")
    got = toxicity.score(odd, ["doc_id"], model).collect()
    assert len(got) == 4 and all(0 <= r.score <= 1 for r in got) and len({r.score for r in got if r.doc_id < 3}) == 1
    labels = spark.createDataFrame([(1, 1), (9, None)], "doc_id long, label int")
    assert toxicity.learn(odd, labels.limit(0)).scores(["x"]).tolist() == [0.0]
    assert toxicity.score(odd.limit(0), ["doc_id"], model).collect() == []


def test_urls(spark):
    rows = [
        (1, "http://A.example.com/en/1", "example.com/en/", "block"), (2, "https://www.example.com/en/x?q", "www.example.com/en/", "allow"), (3, "x://b.net/es/", "net/es/", "block"),
        (4, "http://b.com", None, None), (5, "http://b.com/", "com/", "allow"), (6, None, None, None), (7, "no scheme.com/", None, None), (8, "a://h.org/p#f?x", None, None), (9, "", None, None),
    ]
    df = spark.createDataFrame([(i, u, "h") for i, u, _, _ in rows], "page_id long, url string, host string")
    ratio = urls.learn(df)
    got = {r.page_id: r for r in urls.judge(df, ["page_id"], ratio).collect()}
    for i, _, rule, verdict in rows:
        assert got[i].rule == rule and (verdict is None or got[i].verdict == verdict) and got[i].verdict in ("allow", "block")
    assert (got[1].host, got[1].path, got[4].path, got[6].host, got[7].path, got[8].host, got[8].path) == ("a.example.com", "/en/1", "", "", "", "h.org", "/p")
    good, bad = [f"http://site{i}.org/news/{i}" for i in range(200)], [f"http://casino{i}.org/win/{i}" for i in range(200)]
    r = urls.Ratio(good, bad)
    assert r.accepts("http://site999.org/news/7") and not r.accepts("http://casino777.org/win/3") and urls.Ratio([], []).accepts("x")
    p = urls.Markov(good).p
    assert abs(sum(p("//" + c) for c in map(chr, range(32, 127))) - 1) < 0.2
    assert urls.judge(df.limit(0), ["page_id"], ratio).collect() == []


def test_text_statistics():
    assert ts.class_counts("aB1 .#é".encode()).tolist() == [1, 1, 1, 1, 1, 1, 0, 1]


def test_toxicity_logits_by_a_plain_loop():
    """A batch against one text at a time: every filter at every place, its maximum, the logistic unit."""
    rng = random.Random(9)
    rows = [(prose(rng, EN + (["vile"] if i % 3 == 0 else []), 20 + i % 40), int(i % 3 == 0)) for i in range(90)]
    model = toxicity.train(rows)

    def plain(text):
        marks = [model.table[toxicity.ids_of(w)].sum(0) for w in toxicity.words_of(text)] or [np.zeros(toxicity.WIDTH)]
        marks += [np.zeros(toxicity.WIDTH)] * 2
        pooled, column = [], 0
        for width in toxicity.WIDTHS:
            columns = [model.filters[:, column + j * toxicity.FILTERS : column + (j + 1) * toxicity.FILTERS] for j in range(width)]
            pooled += list(np.max([sum(marks[i + j] @ columns[j] for j in range(width)) for i in range(len(marks) - 2)], axis=0))
            column += width * toxicity.FILTERS
        hidden = np.array(pooled) + model.bias
        hidden = np.where(hidden > 0, hidden, toxicity.LEAK * hidden)
        return hidden @ model.out[:-1] + model.out[-1]

    texts = [t for t, _ in rows[:40]] + ["", "one", "a b", rows[0][0] * 30]
    batch = model.logits([toxicity.words_of(t) for t in texts])
    assert np.allclose(batch, [plain(t) for t in texts], atol=1e-3)
    assert np.mean((model.scores([t for t, _ in rows]) >= toxicity.CUT) == [y == 1 for _, y in rows]) > 0.9


def test_toxicity_sample_holds_distinct_texts(spark, monkeypatch):
    """A labelled id that most rows share is one training row; bytes are bounded, with a text of each label at least."""
    docs = spark.range(20_000).selectExpr("IF(id < 19980, 5L, id - 19980) AS doc_id", "concat('text ', IF(id < 19980, 5L, id - 19980)) AS text")
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)] * 2, "doc_id long, label int")
    got = toxicity.sample(docs, labels, "doc_id", "text", "label")
    assert sorted((t, y) for _, t, y in got) == sorted((f"text {i}", i % 2) for i in range(20))
    monkeypatch.setattr(toxicity, "MOST_BYTES", 60)
    few = toxicity.sample(docs, labels, "doc_id", "text", "label")
    assert {y for _, _, y in few} == {0, 1} and sum(len(t) for _, t, _ in few) <= 60 and set(few) <= set(got)
    monkeypatch.setattr(toxicity, "MOST_BYTES", 1)
    assert len(toxicity.sample(docs, labels, "doc_id", "text", "label")) == 2
    assert toxicity.sample(docs.limit(0), labels, "doc_id", "text", "label") == []


def test_url_windows_that_are_in_most_urls(spark, monkeypatch):
    """The same scores whether frequent windows go to all tasks or none do; a very long URL, and other columns of such names."""
    rows = [(i, f"https://a{i % 7}.com/{'x' * (i % 9)}/{i}", "w", 0) for i in range(60)] + [(100 + i, f"https://b{i % 5}.net/es/{i * 37}", "w", 0) for i in range(60)]
    rows += [(200 + i, f"https://c{i}.org/{'y/' * (i % 4)}", "w", 0) for i in range(40)] + [(300, "https://long.org/" + "z" * 30_000, "w", 0), (301, None, "w", 0)]
    df = spark.createDataFrame(rows, "page_id long, url string, w string, n int")
    got = []
    for often in (1024, 3, 0):
        monkeypatch.setattr(urls, "OFTEN", often)
        got.append({r.page_id: (r.verdict, r.score) for r in urls.judge(df, ["page_id"], urls.learn(df)).collect()})
    assert got[0] == got[1] == got[2] and len(got[0]) == 162 and len({s for _, s in got[0].values()}) > 20
