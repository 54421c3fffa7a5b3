"""Exact deduplication by deterministic block naming, with DataFrame functions only.

A text is cut into blocks of BLOCK bytes. All blocks of the table are dealt into buckets and sorted there; a block's
name is the integer that its rank and its bucket make, so that two blocks have one name exactly if they are equal. Then
adjacent names of a document are paired, and pairs get names in the same way, level by level, until one name is left of
each document. Documents are equal exactly if they have as many blocks and the same name: nothing is hashed but to deal
blocks to buckets.

Contents travel once, with the first level; further levels move eight bytes for a block, a half for each level.
Blocks and pairs that more than a HOTth of all rows share, at most HOT, are found by counts, named first and sent to all
tasks: their rows are spread over the buckets, not sorted. Identities that so many documents share are joined alike.

Null texts count as empty ones. Rows with equal id and text count one by one; the row that stays of a group has the
smallest id, null last, and of several such rows one is taken. Texts of any length are read whole. An empty table gives
an empty one. Other columns are left out, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rivulet.llm.common import materialise

#: Bytes of a block. HOT: a key of more than 1/HOT of the rows is hot. ROWS: blocks of a bucket, on the average.
BLOCK, HOT, ROWS = 1024, 256, 20_000
#: Buckets, whatever the size of the table.
LEAST_BUCKETS = 8192


def normalised(text: Column) -> Column:
    """Runs of ASCII white space as one space; null as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def blocks(text: Column) -> Column:
    """The blocks of a text, one of them at least."""
    raw = text.cast("binary")
    n = F.greatest(F.lit(1), F.ceil(F.octet_length(raw) / BLOCK)).cast("int")
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(raw, i * BLOCK + 1, F.lit(BLOCK)))


def name(df: DataFrame, key: list[str], rows: int, out: str = "name") -> DataFrame:
    """df with an integer for each of its rows, the same exactly where the columns key (not null) are; key is dropped.

    df is read three times: for the counts of keys (by their hashes), for the contents of hot ones, for all rows."""
    buckets = max(LEAST_BUCKETS, rows // ROWS)
    rest = [c for c in df.columns if c not in key]
    spread = df.withColumn("__h", F.xxhash64(*key))
    often = spread.groupBy("__h").agg(F.count("*").alias("__n")).filter(F.col("__n") > max(rows // HOT, 100)).select("__h")
    bucket = F.pmod(F.col("__h"), F.lit(buckets))
    ranked = F.dense_rank().over(W.partitionBy("__b").orderBy(*key)).cast("long") - 1
    # A hot key is one row here. Negative names are those of hot keys.
    hot = spread.join(F.broadcast(often), "__h", "left_semi").groupBy(*key).agg(F.first("__h").alias("__h")).withColumn("__b", bucket)
    hot = hot.select(*key, (-1 - (ranked * buckets + F.col("__b"))).alias("__hot"))
    found = spread.join(F.broadcast(hot), key, "left")
    free = F.col("__hot").isNotNull()
    emptied = found.select(
        *rest,
        "__hot",
        # Rows of hot keys go anywhere, without their content.
        F.when(free, F.pmod(F.xxhash64(*rest), F.lit(buckets))).otherwise(bucket).alias("__b"),
        *[F.when(~free, F.col(c)).alias(c) for c in key],
    )
    named = emptied.withColumn(out, F.coalesce("__hot", ranked * buckets + F.col("__b")))
    return named.drop(*key, "__hot", "__b")


def _by_row(named: DataFrame, *more: Column) -> DataFrame:
    """One row for each document: its names in order."""
    parts = F.sort_array(F.collect_list(F.struct("pos", "name")))
    return named.groupBy("row").agg(F.transform(parts, lambda x: x["name"]).alias("names"), *more)


def _pairs(named: DataFrame) -> DataFrame:
    """row, pos, x, y, two: adjacent names of each document; the last of an odd number is alone, and two is false."""
    pair = lambda i: F.struct(
        F.get("names", 2 * i).alias("x"), F.coalesce(F.get("names", 2 * i + 1), F.lit(0)).alias("y"), F.get("names", 2 * i + 1).isNotNull().alias("two")
    )
    halves = F.transform(F.sequence(F.lit(0), F.ceil(F.size("names") / 2).cast("int") - 1), pair)
    return named.select("row", F.posexplode(halves).alias("pos", "pair")).select("row", "pos", "pair.*")


def identities(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """row (a number for each row), the columns keep, text_sha256 of the normalised text, level and name, which are the
    same for two rows exactly if their normalised texts are equal."""
    size = F.octet_length(F.coalesce(F.col(text), F.lit("")))
    rows = docs.agg(F.sum(F.greatest(F.lit(1), F.ceil(size / BLOCK)))).first()[0] or 0
    each = docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*keep).alias("kept"), normalised(F.col(text)).alias("t"))
    # What is kept of a document travels with its first block.
    info = F.struct("kept", F.sha2("t", 256).alias("text_sha256"))
    cut = each.select("row", info.alias("info"), F.posexplode(blocks(F.col("t"))).alias("pos", "block"))
    cut = cut.withColumn("info", F.when(F.col("pos") == 0, F.col("info")))
    base = materialise(_by_row(name(cut, ["block"], rows), F.max("info").alias("info")))
    now, level, found = base.select("row", "names"), 0, []
    while True:
        found.append(now.filter(F.size("names") == 1).select("row", F.lit(level).alias("level"), F.col("names")[0].alias("name")))
        now = now.filter(F.size("names") > 1)
        rows = now.agg(F.sum(F.ceil(F.size("names") / 2))).first()[0]
        if not rows:
            break
        now, level = materialise(_by_row(name(_pairs(now), ["x", "y", "two"], rows))), level + 1
    named = reduce(DataFrame.unionByName, found)
    return base.select("row", "info.kept.*", "info.text_sha256").join(named, "row")


def groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """For each row: doc_id, keep_id (id of the row that stays of its equals), group_size, kept, text_sha256."""
    each = materialise(identities(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), ["doc_id"]))
    key = ["level", "name"]
    first = F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("row")))
    found = each.groupBy(*key).agg(F.count("*").alias("group_size"), first.alias("first"))
    found = materialise(found.select(*key, "group_size", F.col("first.doc_id").alias("keep_id"), F.col("first.row").alias("stays")))
    large = F.col("group_size") > max(each.count() // HOT, 100)
    hot = F.broadcast(found.filter(large))
    common = each.join(hot, key)
    rest = each.join(hot, key, "left_anti").join(found.filter(~large), key)
    out = common.unionByName(rest)
    return out.select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("stays")).alias("kept"), "text_sha256")
