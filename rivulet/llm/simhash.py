"""SimHash fingerprints of word shingles and the links between near ones.

A bit of a fingerprint is 1 if it is set in over half of the hashes (XXH64, seed 42) of the text's shingles. A
fingerprint is one or more lanes of 64 bits; the lanes behind the first are of hashes mixed once more. The exact
search (EXACT) counts repeats of a shingle, that of near copies (near.py) does not.

Method: pigeonring. The bits are dealt into a ring of segments. If two fingerprints differ in at most `bits` bits,
then from some segment on every chain of c consecutive segments differs in at most c * bits / segments bits, in
whole numbers. With more segments than bits, the chain's first segment is then equal: fingerprints meet in a bucket
for each segment's value, and a pair there is held against the budgets of longer and longer chains that begin at that
segment before the full check. So the search is exact. In large tables the key is a chain of two segments, the first
equal and the second within its budget of one bit, for which one side is also dealt to all values a bit away: the same
pairs pass, and far fewer meet by chance. With at least as many bits as segments an equal first segment is likely but
not sure; such a search has a recall (near.py).

Null and empty texts have the fingerprint zero and are linked like others; texts of any length are read whole; repeated
rows and equal fingerprints are one node, so that copies are never expanded; an empty table gives an empty one. Names
of other columns are the caller's affair but for `fp`; `__key` is used within. Buckets beyond BLOCK nodes are cut into
blocks, each pair of blocks being a task's work of bounded size, so that no pair is lost. The pairs that pass in a
task are written as a spanning forest of the closest ones, so that links stay in proportion to nodes.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivulet.llm.common import map_batches, materialise

SEED = 42
#: Nodes of a block of a crowded bucket; pairs that are looked at together; nodes from which on the key is a longer chain.
BLOCK, TOGETHER, LONGER = 1024, 1 << 20, 1 << 20
_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


@dataclass(frozen=True)
class Ring:
    """shingle: words in a shingle. lanes: of 64 bits. bits: most differing bits of a link, used for budgets. widths: of
    the segments, which make up the ring. words: of 64 bits that a row carries, from its segment on. keys: segments in
    a key, 1 or 2. repeats: whether repeats of a shingle count. dealt: chains begin at so many segments, or at all. flip and
    margin: a chain gets, for the bits behind its first segment, the share flip and so many standard deviations more, instead
    of its share of bits."""

    shingle: int = 4
    lanes: int = 1
    bits: int = 4
    widths: tuple[int, ...] = (13, 13, 13, 13, 12)
    words: int = 1
    keys: int = 1
    repeats: bool = True
    dealt: int | None = None
    flip: float | None = None
    margin: float = 0

    def budget(self, c: int) -> int:
        if self.flip is None:
            return self.bits * c // len(self.widths)
        n = max(self.widths) * (c - 1)  # the first segment is equal
        return int(n * self.flip + self.margin * (n * self.flip * (1 - self.flip)) ** 0.5)

    def shift(self) -> int:
        """Bits of a key; above them stands its first segment."""
        return max(self.widths) * self.keys

    def chains(self) -> list[tuple[int, np.ndarray]]:
        """For chains of 2, 3, 4, 6, 8 ... segments, as far as a row carries them: the budget, and by first segment the bits."""
        m, w = len(self.widths), np.array(self.widths)
        ends = np.cumsum(np.stack([np.roll(w, -i) for i in range(m)]), 1)  # first segment, length
        lengths = [c for c in sorted({2, 3, 4, 5, *(2 * k for k in range(3, m)), m}) if c <= m and ends[:, c - 1].max() <= 64 * self.words]
        return [(self.budget(c), ends[:, c - 1]) for c in lengths]


#: Four words and four bits: exact.
EXACT = Ring()


def hashes(text: str | None, shingle: int) -> np.ndarray:
    """The hashes of the shingles; none for a text without words."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()
    if not words:
        return np.zeros(0, np.uint64)
    joined, f = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return np.array([f(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = len(words) - shingle + 1
    return np.array([f(joined[x:y], SEED) for x, y in zip(starts[:n].tolist(), ends[shingle - 1 :].tolist())], np.uint64)


def _mixed(h: np.ndarray, lanes: int) -> np.ndarray:
    """A row for each lane, the first as it is."""
    with np.errstate(over="ignore"):
        out = h[None, :] + (np.arange(lanes, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[:, None]
        out = (out ^ out >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        out = (out ^ out >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    out ^= out >> np.uint64(31)
    out[0] = h
    return out


_BIT = np.arange(8, dtype=np.uint64)[:, None, None]
_EVERY = np.uint64(0x0101010101010101)
#: Shingles whose bits are counted together.
_PART = 255 * 16


def lanes_of_hashes(h: np.ndarray, lanes: int) -> np.ndarray:
    """uint64 for each lane: the bits set in over half of the lane's hashes. Bits are counted in the eight bytes of a
    word at once, in runs of at most 255."""
    if not len(h):
        return np.zeros(lanes, np.uint64)
    counts = np.zeros((8, lanes, 8), np.int64)  # bit of the byte, lane, byte
    for at in range(0, len(h), _PART):
        part = _mixed(h[at : at + _PART], lanes)
        runs = -(-part.shape[1] // 255)
        if runs > 1:
            padded = np.zeros((lanes, runs * 255), np.uint64)
            padded[:, : part.shape[1]] = part
            part = padded
        sums = (part[None] >> _BIT & _EVERY).reshape(8, lanes, runs, -1).sum(3)  # each byte at most 255
        counts += sums.astype("<u8").view(np.uint8).reshape(8, lanes, runs, 8).sum(2, dtype=np.int64)
    set_ = (counts * 2 > len(h)).transpose(1, 2, 0)  # lane, byte, bit
    return np.packbits(set_, axis=2, bitorder="little").reshape(lanes, 8).view("<u8").ravel()


def lanes_of(text: str | None, ring: Ring) -> list[int]:
    """The lanes as signed 64-bit numbers; all zero for a text without words."""
    h = hashes(text, ring.shingle)
    return lanes_of_hashes(h if ring.repeats else np.unique(h), ring.lanes).view(np.int64).tolist()


def fingerprints(df: DataFrame, keep: list[str], ring: Ring, text: str = "text") -> DataFrame:
    """keep and fp, the lanes of each whole text."""
    return map_batches(df, keep, [F.col(text)], "fp array<long>", lambda texts: [[lanes_of(t, ring) for t in texts.to_pylist()]])


def rows_of(fp: np.ndarray, ring: Ring) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """Of fingerprints (a row of uint64 lanes each), for each segment and each value it is dealt to: their places, the
    buckets, the carried words, and whether they are there (0) or probe only those that are (1)."""
    m, total, n = len(ring.widths), sum(ring.widths), len(fp)
    bits = np.unpackbits(np.ascontiguousarray(fp.astype("<u8")).view(np.uint8).reshape(n, -1), axis=1, bitorder="little")[:, :total]
    at, out, every = 0, [], np.arange(n)
    for i, w in enumerate(ring.widths[: ring.dealt]):
        ahead = bits[:, (at + np.arange(64 * ring.words)) % total]
        carried = np.ascontiguousarray(np.packbits(ahead, axis=1, bitorder="little")).view("<u8")
        first = carried[:, 0] & np.uint64((1 << w) - 1)
        if ring.keys == 1:
            out.append((every, (first | np.uint64(i << ring.shift())).astype(np.int64), carried, 0))
        else:
            nxt = ring.widths[(i + 1) % m]
            both = carried[:, 0] & np.uint64((1 << w + nxt) - 1)
            for flip in range(-1, nxt):
                key = both if flip < 0 else both ^ np.uint64(1 << w + flip)
                out.append((every, (key | np.uint64(i << ring.shift())).astype(np.int64), carried, int(flip >= 0)))
        at += w
    return out


def forest(a: np.ndarray, b: np.ndarray, d: np.ndarray, n: int) -> np.ndarray:
    """Places of those of the links a, b (nodes below n) that make a spanning forest of the smallest d."""
    label, left, picked = np.arange(n), np.arange(len(a)), []
    while True:
        left = left[label[a[left]] != label[b[left]]]
        if not len(left):
            return np.concatenate(picked) if picked else left
        key = d[left].astype(np.int64) << 32 | left  # no two are equal, so that no circle can close
        best = np.full(n, np.iinfo(np.int64).max)
        np.minimum.at(best, label[a[left]], key)
        np.minimum.at(best, label[b[left]], key)
        pick = np.unique(best[best < np.iinfo(np.int64).max] & (1 << 32) - 1)
        picked.append(pick)
        x, y = label[a[pick]], label[b[pick]]
        up = np.arange(n)
        while True:
            lo, hi = np.minimum(up[x], up[y]), np.maximum(up[x], up[y])
            if (lo == hi).all():
                break
            np.minimum.at(up, hi, lo)
            while (up[up] != up).any():
                up = up[up]
        label = up[label]


class Linker:
    """Passing pairs among the rows of buckets; numpy only."""

    def __init__(self, ring: Ring):
        self.ring, self.m = ring, len(ring.widths)
        self.steps = []
        for budget, ends in ring.chains():
            masks = np.zeros((ring.words, self.m), np.uint64)
            for k in range(ring.words):
                masks[k] = [(1 << max(0, min(64, int(e) - 64 * k))) - 1 for e in ends]
            self.steps.append((budget, masks))

    def near(self, c: np.ndarray, segment: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Those of the pairs i, j whose chains from the segment on keep their budgets, and in how many bits they differ."""
        x = c[i] ^ c[j]
        s, d = segment[i], np.zeros(len(i), np.int64)
        for budget, masks in self.steps:
            d = np.zeros(len(i), np.int64)
            for k in range(self.ring.words):
                d += np.bitwise_count(x[:, k] & masks[k][s])
            ok = d <= budget
            i, j, s, x, d = i[ok], j[ok], s[ok], x[ok], d[ok]
        return i, j, d

    def links(self, bucket: np.ndarray, segment: np.ndarray, probe: np.ndarray, ids: np.ndarray, c: np.ndarray):
        """Links among the rows, which are sorted by bucket and, in it, by probe: ids a and b of a forest; and the rows
        that are part of a passing pair which the forest lacks."""
        n = len(bucket)
        starts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        own = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, n)))
        there = np.add.reduceat(1 - probe.astype(np.int64), starts)
        end = (starts + there)[own]
        first = np.where(probe == 0, np.arange(n) + 1, starts[own])  # its partners are first .. end
        many = np.maximum(end - first, 0)
        nodes, node = np.unique(ids, return_inverse=True)
        kept, flagged = [np.zeros(0, np.int64)] * 3, np.zeros(n, bool)
        todo = np.flatnonzero(many)
        cuts = np.searchsorted(np.cumsum(many[todo]), np.arange(TOGETHER, int(many.sum()) + TOGETHER, TOGETHER)) if len(todo) else []
        at = 0
        for cut in [*cuts, len(todo)]:
            part, at = todo[at : cut + 1], max(at, cut + 1)
            if not len(part):
                continue
            k = many[part]
            i = np.repeat(part, k)
            j = np.repeat(first[part] - np.cumsum(k) + k, k) + np.arange(int(k.sum()))
            i, j, d = self.near(c, segment, i, j)
            differ = node[i] != node[j]
            i, j, d = (np.concatenate(p) for p in zip(kept, (i[differ], j[differ], d[differ])))
            # A pair that meets in several buckets counts once.
            a, b = np.minimum(node[i], node[j]), np.maximum(node[i], node[j])
            once = np.unique(a * len(nodes) + b, return_index=True)[1]
            i, j, d, a, b = i[once], j[once], d[once], a[once], b[once]
            pick = forest(a, b, d, len(nodes))
            lost = np.ones(len(i), bool)
            lost[pick] = False
            flagged[i[lost]] = flagged[j[lost]] = True
            kept = [i[pick], j[pick], d[pick]]
        return ids[kept[0]], ids[kept[1]], np.flatnonzero(flagged)


def blocks_of(rows: DataFrame, crowded: DataFrame, key: list[str], by: str = "id") -> DataFrame:
    """rows, each as often as its bucket (key) has pairs of blocks that it is part of, with lo and hi, the blocks.
    crowded: the buckets with more than BLOCK rows, and n, their number."""
    none = F.lit(0).cast("long")
    if crowded.isEmpty():
        return rows.withColumns({"lo": none, "hi": none})
    blocks = F.ceil(F.coalesce("n", F.lit(1)) / BLOCK)
    rows = rows.join(crowded, key, "left").withColumn("own", F.pmod(F.xxhash64(by), blocks)).withColumn("other", F.explode(F.sequence(none, blocks - 1)))
    return rows.withColumns({"lo": F.least("own", "other"), "hi": F.greatest("own", "other")}).drop("n", "own", "other")


def links(nodes: DataFrame, ring: Ring) -> DataFrame:
    """a, b: links among nodes (id long, fp array<long>; ids and fps distinct), repeats possible; and with a null b and
    not null bucket: a, a node that in this bucket has a passing pair which is not among the links."""
    lanes, words = ring.lanes, ring.words
    carried = [f"c{k}" for k in range(words)]

    def deal(batches):
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                ids = part.column(0).to_numpy(zero_copy_only=False)
                fp = part.column(1).flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, lanes)
                for place, bucket, c, probe in rows_of(fp, ring):
                    cols = [bucket, ids[place], np.full(len(place), probe, np.int8), *c.view(np.int64).T]
                    yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x)) for x in cols], names=["bucket", "id", "probe", *carried])

    rows = nodes.select("id", "fp").mapInArrow(deal, "bucket long, id long, probe byte, " + ", ".join(f"{c} long" for c in carried))
    crowded = materialise(rows.groupBy("bucket").agg(F.count("*").alias("n")).filter(F.col("n") > BLOCK))
    rows = blocks_of(rows, crowded, ["bucket"])
    shift = ring.shift()

    def run(batches):
        import pyarrow as pa

        linker, held = Linker(ring), None

        def out(raw, lo, hi, ids, probe, *c):
            change = np.concatenate([[True], (raw[1:] != raw[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])])
            a, b, open_ = linker.links(np.cumsum(change), raw >> shift, probe, ids, np.stack(c, 1).view(np.uint64))
            none = np.zeros(len(a) + len(open_), bool)
            none[len(a) :] = True
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([a, ids[open_]])), pa.array(np.concatenate([b, ids[open_]]), mask=none), pa.array(np.concatenate([a, raw[open_]]), mask=~none)],
                names=["a", "b", "bucket"],
            )

        for batch in batches:
            if not batch.num_rows:
                continue
            got = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(batch.num_columns)]
            if held:
                got = [np.concatenate(x) for x in zip(held, got)]
            same = (got[0] == got[0][-1]) & (got[1] == got[1][-1]) & (got[2] == got[2][-1])
            last = int(np.argmax(same))  # the last bucket may go on in the next batch
            held = [x[last:] for x in got]
            if last:
                yield from out(*[x[:last] for x in got])
        if held:
            yield from out(*held)

    dealt = rows.select("bucket", "lo", "hi", "id", "probe", *carried).repartition("bucket", "lo", "hi")
    return dealt.sortWithinPartitions("bucket", "lo", "hi", "probe").mapInArrow(run, "a long, b long, bucket long")


def classes(prints: DataFrame, ring: Ring = EXACT, doc_id: str = "doc_id") -> DataFrame:
    """The columns of prints (doc_id, fp, any others) and component_id: the smallest id that links reach, its own
    included. Rows of a null id are nodes as others, but give no component its name: a component of such rows
    alone has a null component_id. ring: of one lane, with more segments than bits, so that the search is exact."""
    from dataclasses import replace

    from rivulet.llm.graph import components

    # A node for each fingerprint, which is its key; its id is the smallest of its documents.
    keyed = prints.withColumn("__key", F.col("fp")[0])
    nodes = materialise(keyed.groupBy("__key").agg(F.min(doc_id).alias("least")))
    ring = replace(ring, keys=1 if nodes.count() <= LONGER else 2)  # the same links, at other costs
    found = links(nodes.select(F.col("__key").alias("id"), F.array("__key").alias("fp")), ring).filter("b is not null")
    joined = materialise(components(found))
    label = nodes.join(joined.withColumnRenamed("id", "__key"), "__key", "left").withColumn("component", F.coalesce("component", "__key"))
    names = label.groupBy("component").agg(F.min("least").alias("component_id"))
    named = label.join(names, "component").select("__key", "component_id")
    return keyed.join(named, "__key").drop("__key")


def hexadecimal(fp: Column) -> Column:
    """The first lane as 16 lower-case digits."""
    return F.lpad(F.lower(F.hex(fp[0])), 16, "0")
