"""Groups of near copies: texts whose sets of five-word shingles have a Jaccard similarity of SIMILAR or more, and
what such links reach.

Candidates are found by SimHash and pigeonring (simhash.py) over a long fingerprint of the set, repeats left out. Of two
sets of similarity 0.8 the vectors have a cosine of 2 * 0.8 / 1.8 or more, so that a bit differs with a chance of FLIP;
so many bits on average differ that no segment is sure to be equal. So chains begin at as many segments as a
recall asks for, at all sizes alike: with segments of w bits, one of m is equal with a chance of 1 - (1 - (1 - FLIP) ** w) ** m, which is RECALL
at similarity 0.8 and far nearer to 1 above (0.85: 0.9999). w grows with the logarithm of the number of texts, so that
the texts that meet by chance stay about as many for each text; m and the length of the fingerprint grow with it, as
its power of 0.24. The whole fingerprint is held against its bits' share of FLIP and MARGIN standard deviations more; before it
each chain of segments, behind the first, which is equal, against its own share and CHAIN deviations: a pair has several chains, and
needs one that keeps all of these. Of 1,500 pairs of similarity 0.80 to 0.87 one was lost (of 917 below 0.82). Each link is then decided by the sets themselves, so that nothing is linked by chance.

Equal texts are one node (by 64 bits of XXH64). The first round checks a spanning forest of the closest candidates; where a bucket
then still holds several components, its other candidates are checked in one task, the closest first, until none is left
between components that are apart; so none is lost, and links stay fewer than nodes. Texts
without words are copies of each other; a null text is like an empty one; a table without rows has no groups.
"""

from __future__ import annotations

from functools import lru_cache
from math import ceil, log, log2

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rivulet.llm import simhash
from rivulet.llm.common import map_batches, materialise
from rivulet.llm.graph import components

SHINGLE, SIMILAR, RECALL, FLIP, MARGIN, CHAIN = 5, 0.8, 0.998, 0.1515, 3.5, 2.0
#: Bits of a fingerprint at least; texts of a bucket on average, as a power of two; shortest segment.
LEAST, CROWD, NARROW = 1024, 3, 8


def ring_for(n: int) -> simhash.Ring:
    """The ring for a table of n texts."""
    w = max(NARROW, ceil(log2(max(n, 2))) - CROWD)
    dealt = ceil(log(1 / (1 - RECALL)) / (1 - FLIP) ** w)
    lanes = ceil(max(dealt * w, LEAST) / 64)
    m, total = lanes * 64 // w, lanes * 64
    bits = int(total * (FLIP + MARGIN * (FLIP * (1 - FLIP) / total) ** 0.5))
    return simhash.Ring(shingle=SHINGLE, lanes=lanes, bits=bits, widths=(w,) * m, words=2, repeats=False, dealt=dealt, flip=FLIP, margin=CHAIN)


def shingles(text: str | None) -> np.ndarray:
    return np.unique(simhash.hashes(text, SHINGLE))


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sets, each sorted; 1 if both are empty."""
    if not len(a) and not len(b):
        return 1.0
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    shared = int((both[1:] == both[:-1]).sum())
    return shared / (len(both) - shared)


def _ordered(pairs: DataFrame) -> DataFrame:
    """Pairs a < b, each once."""
    return pairs.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.lit(1).alias("_")).select("a", "b")


def _verified(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Those of the pairs that are similar. docs: id, text."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.lit(1).alias("_")).select("id")
    # Written first, so that Spark knows its size and moves no text where it is small.
    own = docs.select("id", "text").join(materialise(ids), "id", "left_semi").groupBy("id").agg(F.first("text").alias("text"))
    texts = materialise(own)
    both = pairs.join(texts.toDF("a", "ta"), "a").join(texts.toDF("b", "tb"), "b")

    def make(ta, tb):
        held = lru_cache(64)(shingles)
        return [[similarity(held(x), held(y)) >= SIMILAR for x, y in zip(ta.to_pylist(), tb.to_pylist())]]

    return materialise(map_batches(both, ["a", "b"], [F.col("ta"), F.col("tb")], "near boolean", make).filter("near").select("a", "b"))


def _within(pairs: DataFrame, nodes: DataFrame, ring: simhash.Ring) -> DataFrame:
    """Those of the pairs whose fingerprints differ in no more bits than the ring's, and whose sets' sizes allow the similarity."""
    half = lambda x: nodes.select(F.col("id").alias(x), F.col("fp").alias(f"f{x}"), F.col("size").alias(f"s{x}"))
    met = pairs.join(half("a"), "a").join(half("b"), "b")
    differ = F.aggregate(F.zip_with("fa", "fb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda x, y: x + y)
    fits = F.least("sa", "sb") >= SIMILAR * F.greatest("sa", "sb")
    return met.filter(fits & (differ <= ring.bits)).select("a", "b")


def _between(rows: DataFrame, ring: simhash.Ring) -> DataFrame:
    """rows: bucket, id, component, fp, hashes. Links a, b between nodes of a bucket and different components, each of
    which joins components that were apart. Pairs near in full are held against each other by their sets, the closest
    first, until none is left whose components are apart; so a bucket gives fewer links than it has components."""
    crowded = materialise(rows.groupBy("bucket").agg(F.count("*").alias("n")).filter(F.col("n") > simhash.BLOCK))
    rows = simhash.blocks_of(rows, crowded, ["bucket"])
    lanes, bits = ring.lanes, ring.bits

    def joined(ids, component, fp, sets, failed):
        """Links among the rows of a bucket."""
        names, label = np.unique(component, return_inverse=True)
        up, out = list(range(len(names))), []

        def find(x):
            while up[x] != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        size = np.fromiter(map(len, sets), np.int64, len(sets))
        for at in range(0, len(ids), 64):
            mine = np.array([find(x) for x in label.tolist()])  # as joined so far
            i, j = np.nonzero((np.arange(at, min(at + 64, len(ids)))[:, None] < np.arange(len(ids))) & (mine[at : at + 64, None] != mine))
            i += at
            fits = np.minimum(size[i], size[j]) >= SIMILAR * np.maximum(size[i], size[j])
            i, j = i[fits], j[fits]
            d = np.bitwise_count(fp[i] ^ fp[j]).sum(1, dtype=np.int64)
            order = np.argsort(d, kind="stable")[: int((d <= bits).sum())]
            for x, y in zip(i[order].tolist(), j[order].tolist()):
                a, b = find(label[x]), find(label[y])
                pair = (ids[x], ids[y]) if ids[x] < ids[y] else (ids[y], ids[x])
                if a == b or pair in failed:
                    continue
                if similarity(sets[x], sets[y]) >= SIMILAR:
                    up[a] = b
                    out.append(pair)
                elif len(failed) < 1_000_000:  # only spares the same comparison in another bucket
                    failed.add(pair)
        return out

    def run(batches):
        import pyarrow as pa

        key, held, failed = None, [], set()

        def out():
            ids, component = (np.array([r[k] for r in held], np.int64) for k in (0, 1))
            fp = np.stack([r[2] for r in held])
            found = joined(ids, component, fp, [r[3] for r in held], failed)
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

        for batch in batches:
            plain = [batch.column(k).to_pylist() for k in range(5)]
            fps = batch.column(5).flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, lanes)
            for r, (bucket, lo, hi, i, component) in enumerate(zip(*plain)):
                if (bucket, lo, hi) != key:
                    if len(held) > 1:
                        yield out()
                    key, held = (bucket, lo, hi), []
                held.append((i, component, fps[r], np.frombuffer(batch.column(6)[r].as_py(), np.uint64)))
        if len(held) > 1:
            yield out()

    dealt = rows.select("bucket", "lo", "hi", "id", "component", "fp", "hashes").repartition("bucket", "lo", "hi").sortWithinPartitions("bucket", "lo", "hi")
    return dealt.mapInArrow(run, "a long, b long")


def groups(docs: DataFrame) -> DataFrame:
    """docs: id (long, equal for equal texts only) and text, repeats allowed. id and component of each id that is
    linked to another; a component is named by its smallest id."""
    ring = ring_for(docs.count())

    def make(texts):
        sets = [shingles(t) for t in texts.to_pylist()]
        return [[len(h) for h in sets], [simhash.lanes_of_hashes(h, ring.lanes).view(np.int64) for h in sets]]

    prints = map_batches(docs, ["id"], [F.col("text")], "size long, fp array<long>", make)
    nodes = materialise(prints.groupBy("id").agg(F.first("size").alias("size"), F.first("fp").alias("fp")))
    found = materialise(simhash.links(nodes, ring))
    pairs = _ordered(found.filter("b is not null"))
    likely = materialise(_within(pairs, nodes, ring))
    sure = _verified(likely, docs)
    first = materialise(components(sure))

    family = found.filter("b is null").select("bucket", F.col("a").alias("id")).groupBy("bucket", "id").agg(F.lit(1).alias("_"))
    named = materialise(family.select("bucket", "id").join(first, "id", "left").withColumn("component", F.coalesce("component", "id")))
    split = named.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi").select("bucket")
    open_ = materialise(named.join(split, "bucket").select("bucket", "id", "component"))
    if open_.isEmpty():
        return first
    ids = materialise(open_.groupBy("id").agg(F.lit(1).alias("_")).select("id"))
    texts = docs.select("id", "text").join(ids, "id", "left_semi").groupBy("id").agg(F.first("text").alias("text"))
    sets = materialise(map_batches(texts, ["id"], [F.col("text")], "hashes binary", lambda texts: [[shingles(t).tobytes() for t in texts.to_pylist()]]))
    members = materialise(sets.join(nodes.select("id", "fp"), "id"))
    more = materialise(_between(open_.join(members, "id"), ring))
    return first if more.isEmpty() else components(sure.unionAll(more))
