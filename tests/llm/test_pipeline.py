import random

import corpus_pipeline
from rivulet.llm import stages

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string"


def corpus(spark):
    rng = random.Random(9)
    words = "the of and to in is that it was with".split() + ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(2000)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base = [text(120) for _ in range(40)]
    near = [" ".join([*b.split()[:60], "changed", *b.split()[61:]]) for b in base[:10]]
    rows = [(i, t, "en", f"s{i % 3}", len(t), "k") for i, t in enumerate(base + near + base[:5])]
    rows += [(900, None, "en", None, 0, "k"), (901, "", None, "s1", 0, "k"), (902, "short", "en", "s1", 5, "k"), (903, "#" * 4000, "en", "s1", 4000, "k"), (904, base[20] + " token=abcdef123456", "en", "s2", 9, "k"), (904, base[20] + " token=abcdef123456", "en", "s2", 9, "k")]
    return spark.createDataFrame(rows, SCHEMA), base


def test_stages_on_odd_rows(spark):
    docs, base = corpus(spark)
    good = stages.keep_quality(docs)
    assert good.columns == docs.columns and {r.doc_id for r in good.collect()} == {*range(55), 904}
    one = stages.one_of_near(good)
    left = [r.doc_id for r in one.collect()]
    assert sorted(left) == [*range(40)] and one.columns == docs.columns  # 904 is near document 20
    clean = stages.without_secrets(good)
    secret = [r for r in clean.collect() if r.doc_id == 904]
    assert len(secret) == 2 and all(r.text.endswith(" [REDACTED]") and r.n_chars == len(r.text) for r in secret) and clean.columns == docs.columns
    mixed = stages.mixed(good)
    assert mixed.columns == docs.columns
    whole = {r.doc_id: r.text.split() for r in good.collect()}
    for r in mixed.collect():
        assert set(r.text.split()) <= set(whole[r.doc_id]) and r.n_chars == len(r.text)
    total = sum(len(w.text.split()) for w in mixed.collect())
    assert abs(total - 1.5 * sum(len(r.text.split()) for r in good.collect())) <= 3
    out = stages.encoded(mixed).collect()
    assert all(r.n_tokens == len(r.token_ids) > 0 for r in out)
    for stage in (stages.keep_quality, stages.one_of_near, stages.without_secrets, stages.mixed, stages.encoded):
        assert stage(docs.limit(0)).collect() == []


def test_pipeline_runs(spark, tmp_path):
    docs, _ = corpus(spark)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert out and {r.doc_id for r in out} <= set(range(40)) and len(corpus_pipeline.STAGES) == 5


def test_clashing_names_and_null_ids(spark):
    """Columns named as those that the operators use within come back unchanged."""
    odd = ["size", "start", "turn", "sid", "cuts", "__h", "__n", "doc", "hash", "rank", "component", "id", "fp", "bucket", "kept", "n_words", "spans", "base"]
    docs, base = corpus(spark)
    from pyspark.sql import functions as F

    wide = docs.drop("kept").withColumns({c: F.lit(f"own {c}") for c in odd})
    twice = wide.withColumn("doc_id", F.when(F.col("doc_id") % 2 == 0, F.col("doc_id")))
    for stage in (stages.keep_quality, stages.one_of_near, stages.without_secrets, stages.mixed):
        got = stage(twice)
        rows = got.collect()
        assert got.columns == wide.columns and rows and all(r[c] == f"own {c}" for r in rows for c in odd)
        if stage is stages.one_of_near:
            kept = stage(stages.keep_quality(twice)).collect()
            assert len(kept) == 40
    same = docs.filter("doc_id = 3").unionAll(docs.filter("doc_id = 3")).unionAll(docs.filter("doc_id = 4"))
    mixed = stages.mixed(same).collect()
    assert sum(len(r.text.split()) for r in mixed) == round(1.5 * 360)
