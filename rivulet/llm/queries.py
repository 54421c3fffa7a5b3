"""The queries of this subpackage, one for each operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.llm import bpe, digests, langid, mixing, naming, qda, rules, runs, secrets, simhash, toxicity, turns, urls
from rivulet.llm.common import fold, materialise, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
#: DuckDB SQL for the same rows, where SQL can express the operator.
ORACLE: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every whole text, and what they decode to, as digests."""
    return bpe.digest(table(spark, sf_dir, "documents", "doc_id", "text"))


@query
def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of every document, learned from labelled rows outside the held-out fold."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    stats = materialise(qda.features(docs, ["doc_id"]))
    train = stats.filter(fold(F.col("doc_id"), 4) != 2).join(labels, "doc_id")
    model = qda.fit(train, F.col("x"), F.col("label"))
    scored = qda.score(stats, ["doc_id"], model)
    return scored.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "score", "predicted")


@query
def op10_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and the verdict of the quality rules on every document."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    return rules.judge(docs, ["doc_id"], rules.references(docs))


@query
def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    prints = materialise(simhash.fingerprints(docs, ["doc_id"], simhash.EXACT))
    found = simhash.classes(prints, simhash.EXACT)
    return found.select("doc_id", simhash.hexadecimal(F.col("fp")).alias("fingerprint"), "component_id")


@query
def op5_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, fitting rule and verdict of every page's URL."""
    pages = table(spark, sf_dir, "pages", "page_id", "url")
    return urls.judge(pages, ["page_id"], urls.learn(pages))


@query
def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "source")
    mix = mixing.mix(docs, {"doc_id": F.col("doc_id")})
    words = F.coalesce(F.col("hi") - F.col("lo"), F.lit(0))
    taken = mix.spans("doc_id").groupBy("doc_id", "sid", "start", "size").agg(F.sum(words).alias("taken"), F.count("*").alias("n"))
    # Documents without words share their place with others, and so may be several in a group.
    each = taken.withColumn("n", F.explode(F.sequence(F.lit(1), F.when(F.col("size") == 0, F.col("n")).otherwise(1))))
    return each.join(mix.table(), "sid").select("doc_id", "size", "source_size", "target", "taken")


@query
def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets in every document."""
    found = secrets.scan(table(spark, sf_dir, "documents", "doc_id", "text"), ["doc_id"])
    base = F.col("base")
    return found.select(
        "doc_id",
        *[secrets.count(base, kind).alias(f"n_{kind}") for kind in secrets.KINDS[:3]],
        F.sha2(secrets.listed(base), 256).alias("base_sha256"),
        secrets.listed(F.col("spans")).alias("spans"),
    )


@query
def op4_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and its edited text, and their likeness."""
    return digests.compare(table(spark, sf_dir, "documents", "doc_id", "text"))


@query
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of every document, learned from labelled rows outside the held-out fold."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label"))
    model = toxicity.learn(docs, labels.filter(fold(F.col("doc_id"), 3) != 1))
    scored = toxicity.score(docs, ["doc_id"], model)
    return scored.select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "score", "predicted")


@query
def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from the languages given outside the held-out fold."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    model = langid.learn(docs.filter(fold(F.col("doc_id"), 4) != 2))
    labelled = langid.label(docs, ["doc_id"], model)
    return labelled.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")


@query
def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of every document, some of which repeat themselves by their id, and the texts without repeats."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return runs.summary(docs, ["doc_id"], code=F.crc32(F.col("doc_id").cast("string")))


@query
def op12_naming(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The row that stays of the equals of every document."""
    return naming.groups(table(spark, sf_dir, "documents", "doc_id", "text"))


ORACLE["op12_naming"] = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
k AS (SELECT doc_id, sha256(t) AS text_sha256, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM k
"""


@query
def op13_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults of every conversation, once damaged, and its cheapest repair."""
    return turns.repairs(turns.damaged(table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")))
