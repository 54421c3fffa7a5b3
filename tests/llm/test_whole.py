import random

from pyspark.sql import functions as F
from rivulet.llm import langid, rules, stages, toxicity, urls


def test_urls_learn_from_all_distinct_urls(spark):
    """Counts as those of the list models; copies of a few URLs change no score, whatever their number."""
    rng = random.Random(1)
    good = [f"http://site{i}.com/news/{rng.random()}" for i in range(40)]
    bad = [f"http://casino{i}.net/es/{rng.random()}" for i in range(40)]
    asked = [f"http://casino{i}.org/es/{i}" for i in range(5)] + [f"http://site{i}.org/news/{i}" for i in range(5)]
    df = spark.createDataFrame([(u,) for u in good + bad + asked], "url string")
    many = df.unionAll(df.filter("url like '%casino1%'").withColumn("url", F.explode(F.array_repeat("url", 3000))))
    rows = {}
    for name, pages in (("once", df), ("many", many)):
        rows[name] = {r.url: (r.verdict, r.score) for r in urls.judge(pages, ["url"], urls.learn(pages)).collect()}
    assert rows["once"] == rows["many"]
    ratio = urls.Ratio([], [])
    ratio.models = urls.Markov(good), urls.Markov(bad)
    assert all(abs(rows["once"][u][1] - ratio.score(u)) < 1e-8 for u in asked)
    assert [rows["once"][u][0] for u in asked] == ["block"] * 5 + ["allow"] * 5


def test_language_sample_is_of_distinct_texts(spark, monkeypatch):
    texts = [("aa", f"text {i % 3} of aa", 2000) for i in range(3)] + [(f"l{i}", f"language {i}", 1) for i in range(300)]
    df = spark.createDataFrame(texts, "lang string, text string, n int").withColumn("text", F.explode(F.expr("array_repeat(text, n)")))
    monkeypatch.setattr(langid, "train", lambda rows: rows)
    rows = langid.learn(df)
    assert len([1 for _, lang in rows if lang == "aa"]) == 3 and len({lang for _, lang in rows}) == 301


def test_toxicity_reads_whole_texts(spark, monkeypatch):
    assert toxicity.language_of(b"der die und".split() + [b"x"] * 400 + b"the of and to in is".split() * 9) == toxicity.ts.LANGUAGES.index("en")
    assert toxicity.language_of([b"x"] * 500 + [b"the"]) == toxicity.ts.LANGUAGES.index("en")
    docs = spark.createDataFrame([(i, "word " * (10 if i % 2 else 2000)) for i in range(40)], "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 4 < 2).cast("int").alias("label"))
    monkeypatch.setattr(toxicity, "train", lambda rows, weight: rows)
    assert len([1 for t, _ in toxicity.learn(docs, labels) if len(t) > 4000]) == 20


def test_rules_judge_each_language_by_itself(spark):
    """Clean Greek stays, with and without a language; letters at random go, whatever their number."""
    rng = random.Random(2)
    letters = lambda a, n: "".join(rng.choice(a) for _ in range(n))
    rows = []
    for lang, a in (("en", "abcdefghijklmno"), ("el", "αβγδεζηθικλμνξο")):
        usual, rare = [letters(a, 3) for _ in range(20)], [letters(a, 6) for _ in range(3000)]
        text = lambda: ". ".join(" ".join(rng.choice(usual if rng.random() < 0.45 else rare) for _ in range(12)) for _ in range(20))
        rows += [(lang, text(), True) for _ in range(60)]
        rows += [(None, text(), True)]
    rows += [("en", " ".join(letters("abcdefghijklmno", 7) for _ in range(n)), False) for n in (300, 3000)]
    df = spark.createDataFrame(rows, "lang string, text string, good boolean")
    assert all(r.kept == r.good for r in rules.judge(df, ["good"], rules.references(df)).collect())
    assert stages.keep_quality(df).count() == 122


def test_slices_keep_rows_and_bound_bytes():
    import pyarrow as pa
    from rivulet.llm.common import slices

    texts = ["a" * n for n in (10, 0, 500, 3, 3, 3, 90, 2000)] + [None, "b"]
    got = list(slices([pa.array(texts), pa.array(range(10))], 4, 100))
    assert [x for at, n in got for x in texts[at : at + n]] == texts
    for at, n in got:
        assert 1 <= n <= 4 and (n == 1 or sum(len(t or "") for t in texts[at : at + n]) <= 100)
