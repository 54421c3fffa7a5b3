"""Document fingerprints by canonical exact digest, with DataFrame functions only.

The canonical text is in Unicode's NFKC, case-folded and so normalised once more, its white space folded to single
spaces and trimmed. Its fingerprint is two XXH64 hashes with different seeds, 128 bits. Texts are grouped by it, and
within a group of two or more the canonical bytes are compared: if one fingerprint stands for different texts, all but
the first of these in byte order, documents' and edited ones' alike, get a suffix. Likeness of two fingerprints is 1 if the hashes and the
canonical bytes are equal, else 0.

A null text counts as empty; a text of any length is read whole. Documents follow each other by doc_id, null first,
then by a hash of their text; rows may repeat, and then follow each other. A single document follows itself; an empty
table gives an empty one. Other columns are left out, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rivulet.llm.common import materialise

#: Documents in a range of ids whose order one task makes; coarse ranges cut by quantiles, evenly cut within.
ROWS, COARSE = 1000, 256
#: An id that is a quantile itself may have so many times the rows of a fine range, and is cut by the texts' hashes.
FINER = 32
#: Rows equal in id and text that are more than this share of the table are one while texts are moved.
HOT = 4096


def canonical(text: Column) -> Column:
    nfkc = lambda x: F.java_method(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), x, F.lit(True))
    folded = nfkc(F.java_method(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), nfkc(text), F.lit(True)))
    ascii_only = F.octet_length(text) == F.char_length(text)
    spaces = r"[\s\p{Z}\x{85}\x{1c}-\x{1f}]+"
    return F.trim(F.regexp_replace(F.when(ascii_only, F.lower(text)).otherwise(folded), spaces, " "))


def wide(canon: Column) -> tuple[Column, Column]:
    return F.xxhash64(canon), F.xxhash64(F.lit("second"), canon)


def printed(h1: Column, h2: Column) -> Column:
    return F.lower(F.concat(F.lpad(F.hex(h1), 16, "0"), F.lpad(F.hex(h2), 16, "0")))


def repeated(texts: DataFrame) -> DataFrame:
    """texts: h1, h2, canon. The rows whose fingerprint another row has too; only numbers are grouped."""
    many = texts.groupBy("h1", "h2").agg(F.count("*").alias("n")).filter("n > 1").select("h1", "h2")
    return texts.join(materialise(many), ["h1", "h2"], "left_semi")


def crowded(texts: DataFrame) -> DataFrame:
    """Those fingerprints that stand for more than one text, by their bytes."""
    ends = repeated(texts).groupBy("h1", "h2").agg(F.min("canon").alias("lo"), F.max("canon").alias("hi"))
    return ends.filter("lo < hi").select("h1", "h2")


def numbered(texts: DataFrame) -> DataFrame:
    """h1, h2, canon, place: each text of a fingerprint that stands for more than one, numbered from 1."""
    each = texts.join(crowded(texts), ["h1", "h2"], "left_semi").groupBy("h1", "h2", "canon").agg(F.lit(1).alias("_"))
    return each.select("h1", "h2", "canon", F.row_number().over(W.partitionBy("h1", "h2").orderBy("canon")).alias("place"))


def _cells(df: DataFrame, n: int, cuts: list[int]) -> DataFrame:
    """df with __r, the number of the range that its row (__k, __h) is in; ranges follow the order of rows. cuts: the
    coarse ranges' first ids. An id that is a cut has ranges of its own, by __h."""
    at = F.array(*[F.lit(c) for c in cuts])
    fine = max(1, -(-n // (ROWS * COARSE)))
    c = F.greatest(F.size(F.filter(at, lambda x: x <= F.col("__k"))), F.lit(1)) - 1
    lo, hi = F.get(at, F.col("__c")), F.get(at, F.col("__c") + 1)
    even = F.floor((F.col("__k").cast("double") - lo) / (hi.cast("double") - lo) * fine)
    own = F.floor((F.col("__h").cast("double") / 2.0**64 + 0.5) * fine * FINER)
    within = lambda x, most: F.least(F.greatest(F.coalesce(x, F.lit(0)), F.lit(0)), F.lit(most - 1))
    at_cut = F.col("__k") <= lo
    cell = F.when(at_cut, 2 * F.col("__c") * F.lit(fine * FINER) + within(own, fine * FINER)).otherwise((2 * F.col("__c") + 1) * F.lit(fine * FINER) + within(even, fine))
    return df.withColumn("__c", c.cast("long")).withColumn("__r", cell).drop("__c")


def following(df: DataFrame, doc_id: str, columns: list[str]) -> DataFrame:
    """df's doc_id and columns, which include __h to order rows of one id, and next, a struct of the columns of the
    row that follows; the first row follows the last.

    Rows are dealt by ranges, each range with the first row of the next one as a guest. Rows equal in id and __h
    follow each other: the few such groups that are a large share of the table go as one row with their number."""
    key = F.coalesce(F.col(doc_id).cast("long"), F.lit(-(1 << 63)))
    ids = df.select(key.alias("__k"), "__h")
    facts = ids.agg(F.count("*").alias("n"), F.percentile_approx("__k", [i / COARSE for i in range(COARSE + 1)], 10_000).alias("cuts"), F.min("__k").alias("least")).first()
    n = facts["n"]
    if not n:
        return df.select(doc_id, *columns, F.struct(*columns).alias("next"))
    cuts = sorted({facts["least"], *facts["cuts"]})
    hot = ids.groupBy("__k", "__h").agg(F.count("*").alias("__n")).filter(F.col("__n") > max(ROWS, n // HOT))
    hot = materialise(hot)  # at most HOT rows of three numbers
    rows, none_hot = df.select(doc_id, *columns, key.alias("__k")), hot.isEmpty()
    if none_hot:
        rows = rows.withColumn("__n", F.lit(1).cast("long"))
    else:
        there = rows.join(F.broadcast(hot), ["__k", "__h"], "left")
        one = there.filter("__n is not null").groupBy("__k", "__h", "__n").agg(F.first(F.struct(doc_id, *[c for c in columns if c != "__h"])).alias("row"))
        names = [doc_id, *columns, "__k"]
        one = one.select(*[F.col(c if c in ("__k", "__h") else f"row.{c}") for c in names], "__n")
        rows = there.filter("__n is null").select(*names, F.lit(1).cast("long").alias("__n")).unionAll(one)
    # The first row of each range, by (__k, __h), and the range before it: within the coarse range, else the last of the one before.
    firsts = _cells(ids, n, cuts).groupBy("__r").agg(F.min(F.struct("__k", "__h")).alias("first"))
    span = 2 * max(1, -(-n // (ROWS * COARSE))) * FINER
    firsts = materialise(firsts.withColumn("__c", F.floor(F.col("__r") / span)))
    lasts = firsts.groupBy("__c").agg(F.max("__r").alias("__last"))  # at most COARSE + 1 rows
    lasts = lasts.select("__c", F.coalesce(F.lag("__last").over(W.orderBy("__c")), F.max("__last").over(W.partitionBy(F.lit(1)))).alias("__before"))
    before = firsts.join(F.broadcast(lasts), "__c")
    before = before.select("first.__k", "first.__h", F.coalesce(F.lag("__r").over(W.partitionBy("__c").orderBy("__r")), "__before").alias("__guest_of"))
    rows = _cells(rows.join(before, ["__k", "__h"], "left"), n, cuts)
    rows = rows.withColumn("__own", F.explode(F.when(F.col("__guest_of").isNull(), F.array(F.lit(True))).otherwise(F.array(F.lit(True), F.lit(False)))))
    rows = rows.withColumn("__at", F.when(F.col("__own"), F.col("__r")).otherwise(F.col("__guest_of"))).drop("__r", "__guest_of")
    order = W.partitionBy("__at").orderBy(F.desc("__own"), "__k", "__h")
    rows = rows.withColumn("next", F.lead(F.struct(*columns)).over(order)).filter("__own")
    if none_hot:
        return rows.select(doc_id, *columns, "next")
    own = F.struct(*columns)
    # Of a group that went as one, all rows but the last are followed by their like.
    nexts = F.when(F.col("__n") == 1, F.array("next")).otherwise(F.concat(F.array_repeat(own, (F.col("__n") - 1).cast("int")), F.array("next")))
    return rows.select(doc_id, *columns, "__n", "next").withColumn("next", F.explode(nexts)).select(doc_id, *columns, "next")


def _edited(docs: DataFrame) -> DataFrame:
    """Of docs (doc_id, text, h1, h2, __h) those that follow, the edited texts, their canonical texts and hashes."""
    met = following(docs, "doc_id", ["text", "h1", "h2", "__h"])
    half = F.floor(F.char_length("text") / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.char_length("text") - half), F.substring(F.col("next.text"), F.lit(1), half))
    met = met.select("*", edited.alias("edited")).withColumn("__ce", canonical(F.col("edited")))
    e1, e2 = wide(F.col("__ce"))
    return met.withColumns({"e1": e1, "e2": e2})


def compare(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for each row."""
    docs = df.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    h1, h2 = wide(F.col("canon"))
    canon = docs.withColumn("canon", canonical(F.col("text"))).select("doc_id", "text", h1.alias("h1"), h2.alias("h2"), "canon")
    met = _edited(canon.select("doc_id", "text", "h1", "h2", F.xxhash64("text").alias("__h")))
    one = lambda same: F.when(same, 1.0).otherwise(0.0)
    like_edited = F.when((F.col("h1") == F.col("e1")) & (F.col("h2") == F.col("e2")), one(canonical(F.col("text")) == F.col("__ce"))).otherwise(0.0)
    like_next = F.when((F.col("h1") == F.col("next.h1")) & (F.col("h2") == F.col("next.h2")), one(canonical(F.col("text")) == canonical(F.col("next.text")))).otherwise(0.0)
    short = ["h1", "h2", "e1", "e2"]
    third = lambda x: F.xxhash64(F.lit("third"), x, F.octet_length(x))
    light = met.select(
        "doc_id",
        F.char_length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        *short,
        third(F.col("__ce")).alias("e3"),
        like_edited.alias("near_edited"),
        like_next.alias("near_next"),
    )
    light = materialise(light)  # no texts
    out = lambda x, own, new: x.select("doc_id", "n_chars", "edited_sha256", own.alias("fingerprint"), new.alias("edited_fingerprint"), "near_edited", "near_next")
    # Documents' texts are compared by bytes; an edited one with these and each other by a third hash and its length.
    clash = not crowded(canon.select("h1", "h2", "canon")).isEmpty()
    if not clash:
        own = canon.select("h1", "h2", third(F.col("canon")).alias("h3"))
        both = light.select(F.col("e1").alias("h1"), F.col("e2").alias("h2"), F.col("e3").alias("h3")).unionAll(own)
        clash = not both.groupBy("h1", "h2").agg(F.min("h3").alias("lo"), F.max("h3").alias("hi")).filter("lo < hi").isEmpty()
    if not clash:
        return out(light, printed(F.col("h1"), F.col("h2")), printed(F.col("e1"), F.col("e2")))
    # Some fingerprint stands for several texts: all texts of such ones are numbered, and rows find theirs by its bytes.
    whole = materialise(met.select("doc_id", *short, "edited", "text", F.col("__ce"), canonical(F.col("text")).alias("__c0"), like_edited.alias("near_edited"), like_next.alias("near_next")))
    texts = whole.select("h1", "h2", F.col("__c0").alias("canon")).unionAll(whole.select(F.col("e1").alias("h1"), F.col("e2").alias("h2"), F.col("__ce").alias("canon")))
    places = materialise(numbered(texts))
    suffix = lambda c: F.when(F.col(c) > 1, F.concat(F.lit("-"), F.col(c).cast("string"))).otherwise("")
    marked = whole.join(places.toDF("h1", "h2", "__c0", "p0"), ["h1", "h2", "__c0"], "left").join(places.toDF("e1", "e2", "__ce", "pe"), ["e1", "e2", "__ce"], "left")
    marked = marked.withColumns({"n_chars": F.char_length("text").cast("long"), "edited_sha256": F.sha2("edited", 256)})
    return out(marked, F.concat(printed(F.col("h1"), F.col("h2")), suffix("p0")), F.concat(printed(F.col("e1"), F.col("e2")), suffix("pe")))
