"""Mixing sources to target weights.

Method: the words of a source, document behind document, are packed into blocks of BLOCK words. Targets say how many
words of each source the mix takes, and so how many slots of a block each it fills. Slots are dealt over output
shards of SHARD slots: a shard's counts of the sources are a multinomial draw given the totals, made by halving the
shards again and again (each half's counts are a multivariate hypergeometric draw of any size, seeded by the half's place), so
that each shard finds its counts alone and the totals are exact. A source's k-th slot takes block
permutation(k mod blocks) of pass k div blocks, each pass by a pseudorandom permutation of its own, and slots meet
the blocks by a join on source and index. The last slot of a source is cut to the words that are still wanted.

Sources by code point, null last, weigh WEIGHTS in turn and share RATE times all words; no target goes beyond LIMIT
times its source's words, the excess being shared by weight among the others. So a document is taken LIMIT times at
most. Null and empty texts have no words and are never taken; rows may repeat, each being a document; an empty table
gives an empty mix; a very long text lies in as many blocks as it fills; other columns are left out, whatever their names. The order of a source's documents is by a hash of doc_id, then doc_id and a hash of the text, so
that reruns agree. One row for each source reaches the driver; more than MAX_SOURCES raise an error.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rivulet.llm.common import WORD, materialise

BLOCK, SHARD, SEED = 256, 4096, 17
WEIGHTS, RATE, LIMIT = (5, 2, 1), 1.5, 2
MAX_SOURCES = 1_000_000
#: numpy's hypergeometric generator takes fewer items than this.
MOST = 1_000_000_000
#: Documents in a group whose running total one task makes, as far as MOST_GROUPS for a source allow.
GROUP, MOST_GROUPS = 250, 65_536


def targets(sizes: list[int], weights: list[int], total: float, limit: int = LIMIT) -> list[float]:
    """Shares of total by weight, none above limit times its size: the least of that and of one rate for all."""
    out, left, free = [0.0] * len(sizes), total, sum(weights)
    for i in sorted(range(len(sizes)), key=lambda i: (limit * sizes[i] / weights[i], i)):
        out[i] = min(float(limit * sizes[i]), max(0.0, left) * weights[i] / free)
        left -= out[i]
        free -= weights[i]
    return out


def _half(n: int) -> int:
    return max(1, (max(n - 1, 1).bit_length() + 1) // 2)


def _round(x: np.ndarray, key: int, r: int) -> np.ndarray:
    x = x + np.uint64((key * 4 + r) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    x = (x ^ x >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(29)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(32)


def permutation(k: np.ndarray, n: int, key: int, back: bool = False) -> np.ndarray:
    """Pseudorandom permutation of 0 .. n - 1 at k, or its inverse: four Feistel rounds, walked until below n."""
    half = _half(n)
    mask = np.uint64((1 << half) - 1)
    out = k.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> np.uint64(half), out[todo] & mask
        for r in range(3, -1, -1) if back else range(4):
            if back:
                left, right = right ^ _round(left, key, r) & mask, left
            else:
                left, right = right, left ^ _round(right, key, r) & mask
        out[todo] = left << np.uint64(half) | right
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


@dataclass
class Source:
    name: str | None
    size: int
    target: float
    blocks: int = 0
    slots: int = 0
    last_words: int = 0  # of the last slot

    def plan(self, sid: int) -> None:
        """Slots until the target's words are reached; only a source's last block has fewer than BLOCK words."""
        self.blocks = -(-self.size // BLOCK)
        want, short = round(self.target), self.blocks * BLOCK - self.size
        whole, rest = divmod(want, self.size) if self.size else (0, 0)
        self.slots, self.last_words = whole * self.blocks, BLOCK
        if not rest:
            if whole:  # the last slot may be the short block
                at = permutation(np.array([self.blocks - 1]), self.blocks, key_of(sid, whole - 1))[0]
                self.last_words = BLOCK - short if at == self.blocks - 1 else BLOCK
            return
        n = -(-rest // BLOCK)
        # When the short block comes in this pass; no other place of the pass need be known.
        short_at = int(permutation(np.array([self.blocks - 1]), self.blocks, key_of(sid, whole), back=True)[0])
        if short and short_at < n and n * BLOCK - short < rest:
            n += 1
        self.slots += n
        self.last_words = rest - ((n - 1) * BLOCK - (short if short_at < n - 1 else 0))


def key_of(sid: int, turn: int) -> int:
    return (SEED * 1_000_003 + sid) * 8 + turn


def hypergeometric(good: int, bad: int, n: int, rng: np.random.Generator) -> int:
    """How many of n draws without replacement are among the good ones. Beyond MOST, where numpy's generator ends, each
    item is drawn by itself with chance n / all, which leaves a sample of nearly n items; those that lack are drawn
    from the items left, those too many from the sample, by the same rule. Both are uniform, so the draw is exact."""
    if good + bad < MOST:
        return int(rng.hypergeometric(good, bad, n))
    if n <= 64:
        hits = 0
        for k in range(n):
            hits += int(rng.integers(0, good + bad - k)) < good - hits
        return hits
    a, b = int(rng.binomial(good, n / (good + bad))), int(rng.binomial(bad, n / (good + bad)))
    if a + b <= n:
        return a + hypergeometric(good - a, bad - b, n - a - b, rng)
    return a - hypergeometric(a, b, a + b - n, rng)


def draw(counts: np.ndarray, n: int, rng: np.random.Generator) -> np.ndarray:
    """How many of n draws without replacement are of each kind."""
    out, left = np.zeros_like(counts), int(counts.sum())
    for i in np.flatnonzero(counts).tolist():
        left -= int(counts[i])
        out[i] = hypergeometric(int(counts[i]), left, n, rng)
        n -= int(out[i])
    return out


def shard_counts(totals: np.ndarray, shard: int, shards: int, last: int) -> tuple[np.ndarray, np.ndarray]:
    """Slots of each source before this shard and in it. All shards but the last have SHARD slots, the last has last."""
    lo, hi, before, here = 0, shards, np.zeros_like(totals), totals
    slots = lambda a, b: (b - a) * SHARD - (SHARD - last if b == shards else 0)
    while hi - lo > 1:
        mid = (lo + hi) // 2
        n = slots(lo, mid)
        left = draw(here, n, np.random.default_rng([SEED, lo, hi]))
        if shard < mid:
            hi, here = mid, left
        else:
            lo, before, here = mid, before + left, here - left
    return before, here


@dataclass
class Mix:
    """docs: the columns named, sid, size and start (its first word's place in its source). slots: shard, slot, sid,
    turn (the pass over the source), block and words (taken from the block's start). sources: by sid."""

    docs: DataFrame
    slots: DataFrame
    sources: list[Source]

    def table(self) -> DataFrame:
        """sid, source_size and target."""
        rows = [(i, s.size, s.target) for i, s in enumerate(self.sources)]
        return self.docs.sparkSession.createDataFrame(rows, "sid int, source_size long, target double")

    def spans(self, *columns: str) -> DataFrame:
        """columns, sid, start, size, and for each slot that takes words of the document: turn, lo and hi, the words'
        places in the document. A document that no slot takes has one row with a null turn."""
        blocks = F.sequence(F.floor(F.col("start") / BLOCK), F.floor((F.col("start") + F.greatest("size", F.lit(1)) - 1) / BLOCK))
        # A document without words is in no block; below zero there is none, and many such documents are spread.
        none = F.array(-1 - F.pmod(F.xxhash64(*columns, "start"), F.lit(4096)))
        blocks = F.when(F.col("size") == 0, none).otherwise(blocks)
        cut = self.docs.select(*columns, "sid", "start", "size", F.explode(blocks).alias("block"))
        # The planner takes the slots for as few as the shards they are made from; their number grows with the table.
        slots = self.slots.select("sid", "block", "turn", "words").hint("merge")
        met = cut.join(slots, ["sid", "block"], "left")
        lo = F.greatest(F.col("block") * BLOCK - F.col("start"), F.lit(0))
        hi = F.greatest(lo, F.least(F.col("block") * BLOCK + F.col("words") - F.col("start"), F.col("size")))
        taken = F.col("turn").isNotNull()
        return met.select(*columns, "sid", "start", "size", "turn", F.when(taken, lo).alias("lo"), F.when(taken, hi).alias("hi"))


def mix(df: DataFrame, columns: dict[str, Column], doc_id: str = "doc_id", text: str = "text", source: str = "source") -> Mix:
    """The mix of df's rows. columns: what docs shall hold, by name."""
    spark = df.sparkSession
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    narrow = materialise(df.select(*[c.alias(n) for n, c in columns.items()], F.col(doc_id).alias("__id"), F.xxhash64(F.col(text)).alias("__h"), F.col(source).alias("__source"), size.alias("size")))
    found = narrow.groupBy("__source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(found) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    found.sort(key=lambda r: (r["__source"] is None, r["__source"] or ""))  # Python's order is by code point
    sizes = [r["size"] for r in found]
    goal = targets(sizes, [WEIGHTS[i % len(WEIGHTS)] for i in range(len(found))], RATE * sum(sizes))
    sources = [Source(r["__source"], r["size"], t) for r, t in zip(found, goal)]
    for i, s in enumerate(sources):
        s.plan(i)
    ids = spark.createDataFrame([(s.name, i) for i, s in enumerate(sources)], "__name string, sid int")
    groups = max(1, min(MOST_GROUPS, -(-sum(r["n"] for r in found) // GROUP)))
    known = narrow.join(F.broadcast(ids) if len(sources) <= 10_000 else ids, F.col("__source").eqNullSafe(F.col("__name"))).withColumn("__g", F.pmod(F.xxhash64("__id", "__h"), F.lit(groups)))
    sums = known.groupBy("sid", "__g").agg(F.sum("size").alias("n"))
    before = sums.withColumn("before", F.sum("n").over(W.partitionBy("sid").orderBy("__g")) - F.col("n")).select("sid", "__g", "before")
    own = F.sum("size").over(W.partitionBy("sid", "__g").orderBy("__id", "__h", "size").rowsBetween(W.unboundedPreceding, 0)) - F.col("size")
    docs = known.withColumn("__own", own).join(before, ["sid", "__g"]).withColumn("start", F.col("before") + F.col("__own"))
    return Mix(docs.select(*columns, "sid", "size", "start"), _slots(spark, sources), sources)


def _slots(spark, sources: list[Source]) -> DataFrame:
    totals = np.array([s.slots for s in sources], np.int64)
    shards = max(1, -(-int(totals.sum()) // SHARD)) if len(sources) else 0
    last = int(totals.sum()) - (shards - 1) * SHARD if shards else 0
    facts = spark.sparkContext.broadcast((totals, [s.blocks for s in sources], [s.last_words for s in sources]))

    def run(batches):
        import pyarrow as pa

        totals, blocks, last_words = facts.value
        for batch in batches:
            for shard in batch.column(0).to_pylist():
                before, here = shard_counts(totals, shard, shards, last)
                out: list[list[np.ndarray]] = [[], [], [], []]
                for sid in np.flatnonzero(here).tolist():
                    k = np.arange(before[sid], before[sid] + here[sid])
                    turn, at, place = k // blocks[sid], k % blocks[sid], np.zeros(len(k), np.int64)
                    for t in np.unique(turn).tolist():
                        place[turn == t] = permutation(at[turn == t], blocks[sid], key_of(sid, t))
                    for x, y in zip(out, (np.full(len(k), sid), turn, place, np.where(k == totals[sid] - 1, last_words[sid], BLOCK))):
                        x.append(y)
                if out[0]:
                    sid, turn, place, words = map(np.concatenate, out)
                    order = np.random.default_rng([SEED, shard, shards]).permutation(len(sid))  # within the shard
                    cols = [np.full(len(sid), shard), np.arange(len(sid)).astype(np.int32), sid[order].astype(np.int32), turn[order].astype(np.int32), place[order], words[order]]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["shard", "slot", "sid", "turn", "block", "words"])

    parts = max(1, min(shards, spark.sparkContext.defaultParallelism * 4, 100_000))
    return spark.range(0, shards, 1, parts).mapInArrow(run, "shard long, slot int, sid int, turn int, block long, words long")
