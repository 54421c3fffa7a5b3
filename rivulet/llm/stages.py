"""Operators as stages that filter or rewrite documents. Each takes and returns the columns of its documents."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rivulet.llm import bpe, mixing, near, rules, secrets
from rivulet.llm.common import map_batches, materialise


def _apart(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs with its columns renamed, clear of the names that operators use, and by column the new name."""
    names = {c: f"__col{i}" for i, c in enumerate(docs.columns)}
    return docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()]), names


def keep_quality(docs: DataFrame) -> DataFrame:
    """Documents that the quality rules keep. Null and empty texts go, as they have fewer than 50 words. Each row is
    judged by itself, repeats alike; columns of any name are kept as they are."""
    refs = rules.references(docs)
    plain, names = _apart(docs)
    judged = rules.judge(plain, plain.columns, refs, names["text"], names["lang"])
    return judged.filter("kept").select([F.col(n).alias(c) for c, n in names.items()])


def one_of_near(docs: DataFrame) -> DataFrame:
    """One document of each group of near copies, by SimHash and a Jaccard similarity of 0.8 over five-word shingles:
    the one with the smallest doc_id, of rows with that id the one with the smallest hash of its text. A null id is
    behind all others; of a group of null ids alone one row stays. Of rows equal in id and text one stays, that with
    the smallest hash of all its columns. Null and empty texts are copies of each other. Any other columns are kept."""
    plain, names = _apart(docs)
    doc_id, text = names["doc_id"], names["text"]
    known = F.coalesce(F.concat(F.lit("i"), F.col(doc_id).cast("string")), F.lit(""))
    keyed = plain.withColumns({"__id": known, "__h": F.xxhash64(text)})
    named = materialise(near.groups(keyed.select(F.col("__h").alias("id"), F.col(text).alias("text"))))
    own = keyed.select(doc_id, "__id", "__h").join(named.withColumnRenamed("id", "__h"), "__h", "left")
    least = F.min(F.struct(F.col(doc_id).isNull().alias("none"), F.col(doc_id).alias("id"), F.col("__h").alias("hash"), F.col("__id").alias("key")))
    chosen = own.groupBy(F.coalesce("component", "__h").alias("component")).agg(least.alias("c")).select(F.col("c.key").alias("__id"), F.col("c.hash").alias("__h"))
    # Rows that repeat a document are one before they are moved.
    once = keyed.groupBy("__id", "__h").agg(F.min_by(F.struct(*names.values()), F.xxhash64(*names.values())).alias("row"))
    kept = once.join(materialise(chosen), ["__id", "__h"], "left_semi")
    return kept.select(*[F.col(f"row.{n}").alias(c) for c, n in names.items()])


def without_secrets(docs: DataFrame) -> DataFrame:
    """All documents, with secrets replaced in text, and n_chars counted again where there is such a column. Null and
    empty texts stay as they are, rows may repeat, and columns of any name are kept."""
    plain, names = _apart(docs)
    found = secrets.scan(plain, list(names.values()), names["text"])
    clean = found.select(*names.values(), secrets.redact(F.col(names["text"]), F.col("spans")).alias("clean"))
    out = {c: F.col(n) for c, n in names.items()} | {"text": F.col("clean")}
    if "n_chars" in names:
        out["n_chars"] = F.when(F.col("clean") == F.col(names["text"]), F.col(names["n_chars"])).otherwise(F.char_length("clean").cast(docs.schema["n_chars"].dataType))
    return clean.select(*[x.alias(c) for c, x in out.items()])


_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def mixed(docs: DataFrame) -> DataFrame:
    """The mix of the sources: for each pass in which words of a document are taken, a row with these words as its
    text (the whole text as it is where all words are taken), and n_chars counted again. So a document comes as
    often as the mix repeats it, at most twice, and not at all if no word of it is taken: null and empty texts never
    are. Equal rows take their turns one by one; columns of any name are kept."""
    plain, names = _apart(docs)
    doc_id, text, source = names["doc_id"], names["text"], names["source"]
    whole = F.xxhash64(*names.values())
    mix = mixing.mix(plain, {"doc": F.col(doc_id), "hash": whole}, doc_id, text, source)
    spans = mix.spans("doc", "hash").filter("hi > lo")
    # Equal rows share their turns; each of them stands at its own start.
    turns = spans.groupBy("doc", "hash", "sid", "start", "size", "turn").agg(F.sort_array(F.collect_list(F.struct("lo", "hi"))).alias("cuts"))
    # Equal rows are one before their text is moved.
    once = plain.groupBy(doc_id, whole.alias("__h")).agg(F.first(F.struct(*names.values())).alias("row"))
    met = once.join(turns, F.col(doc_id).eqNullSafe(F.col("doc")) & (F.col("__h") == F.col("hash")))
    met = met.select(*[F.col(f"row.{n}").alias(n) for n in names.values()], "cuts", "size")
    keep = [n for c, n in names.items() if c not in ("text", "n_chars")]

    def make(texts, cuts, sizes):
        out = []
        for text, spans, size in zip(texts.to_pylist(), cuts.to_pylist(), sizes.to_pylist()):
            if sum(s["hi"] - s["lo"] for s in spans) < size:
                at = [m.span() for m in _WORD.finditer(text)]
                text = "\n".join(text[at[s["lo"]][0] : at[s["hi"] - 1][1]] for s in _joined(spans))
            out.append(text)
        return [out, [len(t) for t in out]]

    made = map_batches(met, keep, [F.col(text), F.col("cuts"), F.col("size")], "__text string, __n_chars long", make)
    own = {"text": F.col("__text"), "n_chars": F.col("__n_chars")}
    return made.select(*[own.get(c, F.col(n)).cast(docs.schema[c].dataType).alias(c) for c, n in names.items()])


def _joined(spans: list[dict]) -> list[dict]:
    """Spans in order, those that touch made one."""
    out: list[dict] = []
    for s in spans:
        if out and out[-1]["hi"] == s["lo"]:
            out[-1] = {"lo": out[-1]["lo"], "hi": s["hi"]}
        else:
            out.append(s)
    return out


def encoded(docs: DataFrame) -> DataFrame:
    """doc_id, source where there is one, token_ids and n_tokens of each text."""
    keep = [c for c in ("doc_id", "source") if c in docs.columns]
    out = bpe.encode(docs, keep=tuple(keep))
    return out.select(*keep, "token_ids", F.size("token_ids").cast("long").alias("n_tokens"))
