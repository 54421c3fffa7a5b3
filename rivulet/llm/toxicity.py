"""Toxicity by a convolutional text classifier.

A word's vector is the sum of hashed embeddings of the word and of its beginnings (PREFIXES). Filters of widths 1, 2
and 3 run over the words of the whole text; the maximum of each filter over all places, flattened below zero,
goes into a logistic unit. Trained in numpy with Adagrad; max pooling sends each filter's gradient to one place. Thresholds are
calibrated by language by cross-fitting over the training rows: the language is taken from the text's own common
words, and each language's logits are shifted so that its threshold is a score of CUT.

All labelled rows train. Descent starts on the driver with at most TRAIN rows of each label, those with the smallest hashes
of id, as far as MOST_BYTES go. If there are more rows, Spark goes on from there over every one of them: counts of marks are sums over
all rows, each part of some PART_BYTES takes its own steps, and the parts' changes are averaged; thresholds come from the
odds of all rows, counted in steps of 1 / GRID. Of an id with several texts one counts.
Scoring reads whole texts of any length. An empty table gives an empty
one, and other columns are left out, whatever their names. Null
and empty texts get the score of a text without words. Without training rows of both labels every score is the share
of label 1 among them, 0 without any. Repeated rows are scored alike.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rivulet.llm import textstats as ts
from rivulet.llm.common import map_batches, materialise, slices

BITS, WIDTH, FILTERS, WIDTHS = 16, 12, 8, (1, 2, 3)
PREFIXES = (3, 4, 5, 6, 7, 8)
EACH = 1 + len(PREFIXES)
CUT = 0.7
#: Slope below zero: a filter that is quiet in a language's texts must still learn from them.
LEAK = 0.25
#: Training texts that must have a mark for it to be learned.
LEAST = 4
#: Bytes of training texts that the driver holds at most for the start, beside a single text of each label.
MOST_BYTES = 128 << 20
TRAIN, STEPS, BATCH, RATE, SEED, FOLDS = 1600, 1100, 24, 0.1, 11, 4
#: Bytes of training texts between two averages of the parts, about; a part sends some 17 MB for all models.
PART_BYTES = 32 << 20
#: Numbers of a model that are summed over the parts in one group.
CHUNK = 1 << 13
#: Steps of the odds by which thresholds are counted over all rows.
GRID = 256
#: So many words are remembered in a worker with what they add to the filters.
REMEMBER = 200_000
_COLUMNS = sum(WIDTHS) * FILTERS  # a filter of width k has k groups of columns, one for each place


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "surrogatepass").split()


def ids_of(word: bytes) -> list[int]:
    """Places in the embedding: the word's, and those of its beginnings; a beginning that isn't shorter repeats it."""
    word = word.strip(b".,;:!?\"'()") or word
    whole, last = zlib.crc32(word, _WORD) & (1 << BITS) - 1, (1 << BITS) - 1
    if word.isascii():
        n = len(word)
        return [whole] + [zlib.crc32(word[:k], _BEGINNING) & last if n > k else whole for k in PREFIXES]
    text = word.decode("utf-8", "surrogatepass")
    return [whole] + [zlib.crc32(text[:k].encode("utf-8", "surrogatepass"), _BEGINNING) & last if len(text) > k else whole for k in PREFIXES]


_WORD, _BEGINNING = zlib.crc32(b"w"), zlib.crc32(b"p")
#: CRC-32 of a byte that follows the low byte of a state.
_CRC = np.array([zlib.crc32(bytes([i]), 0xFFFFFFFF) ^ 0xFFFFFFFF for i in range(256)], np.uint32)
#: Words of more bytes are looked at one by one.
_SHORT = 48


def all_ids(words: list[bytes]) -> np.ndarray:
    """ids_of for each of many words, a byte of all of them at a time."""
    words = [w.strip(b".,;:!?\"'()") or w for w in words]
    size = np.fromiter(map(len, words), int, len(words))
    out = np.empty((len(words), EACH), np.int32)
    for i in np.flatnonzero(size > _SHORT):
        out[i] = ids_of(words[i])
    short = np.flatnonzero(size <= _SHORT)
    short = short[np.argsort(-size[short], kind="stable")]
    size = size[short]
    # From the longest to the shortest, so that those with a byte j come first.
    raw = np.array([words[i] for i in short], f"S{_SHORT}").view(np.uint8).reshape(len(short), _SHORT)
    begins = (raw & 0xC0) != 0x80
    chars = np.zeros(len(short), int)
    whole, start = (np.full(len(short), x ^ 0xFFFFFFFF, np.uint32) for x in (_WORD, _BEGINNING))
    marks = np.zeros((len(short), EACH), np.uint32)
    for j in range(int(size[0]) if len(size) else 0):
        n = int(np.searchsorted(-size, -j))  # size > j
        byte = raw[:n, j]
        if j:
            # A character begins behind the k-th: the beginning of k characters is over, and isn't all.
            for e, k in enumerate(PREFIXES):
                at = np.flatnonzero(begins[:n, j] & (chars[:n] == k))
                marks[at, 1 + e] = start[at] ^ 0xFFFFFFFF
        chars[:n] += begins[:n, j]
        whole[:n] = _CRC[(whole[:n] ^ byte) & 0xFF] ^ (whole[:n] >> 8)
        start[:n] = _CRC[(start[:n] ^ byte) & 0xFF] ^ (start[:n] >> 8)
    marks[:, 0] = whole ^ 0xFFFFFFFF
    for e, k in enumerate(PREFIXES):
        marks[:, 1 + e] = np.where(chars > k, marks[:, 1 + e], marks[:, 0])
    out[short] = marks & (1 << BITS) - 1
    return out


def language_of(words: list[bytes]) -> int:
    """The place in LANGUAGES of the language with most common words in the text; -1 without any."""
    n = [0] * len(ts.LANGUAGES)
    for w in words:
        for i in _LANGUAGES_OF.get(w, ()):
            n[i] += 1
    return n.index(max(n)) if any(n) else -1


_LANGUAGES_OF: dict[bytes, list[int]] = {}
for _i, _lang in enumerate(ts.LANGUAGES):
    for _w in ts.COMMON[_lang].split():
        _LANGUAGES_OF.setdefault(_w.encode(), []).append(_i)


def _groups():
    """Width, place in the filter, and columns of each group."""
    at = 0
    for k in WIDTHS:
        for j in range(k):
            yield k, j, slice(at, at + FILTERS)
            at += FILTERS


@dataclass
class Model:
    share: float
    table: np.ndarray | None = None
    filters: np.ndarray | None = None  # WIDTH by _COLUMNS
    bias: np.ndarray | None = None  # of filters, by width
    out: np.ndarray | None = None
    shift: np.ndarray | None = None  # by language, the last for none
    known: dict[bytes, int] = field(default_factory=dict)
    adds: np.ndarray | None = None

    def _rows(self, words: set[bytes]) -> None:
        new = list(words.difference(self.known))
        if len(self.known) + len(new) > REMEMBER or self.adds is None:
            new, self.known, self.adds = list(words), {}, np.zeros((1, _COLUMNS), np.float32)
        if not new:
            return
        ids = all_ids(new)
        adds = sum(self.table.take(ids[:, e], axis=0) for e in range(EACH)) @ self.filters
        n = len(self.known) + 1
        if n + len(new) > len(self.adds):
            self.adds = np.concatenate([self.adds, np.zeros((max(len(self.adds), n + len(new)), _COLUMNS), np.float32)])
        self.adds[n : n + len(new)] = adds
        self.known |= {w: n + i for i, w in enumerate(new)}

    def logits(self, texts: list[list[bytes]]) -> np.ndarray:
        """Row 0 of adds stands for no word; two of them end each text, so that every filter fits."""
        self._rows(set().union(*texts))
        size = np.array([max(len(t), 1) for t in texts])
        flat: list[int] = []
        for t in texts:
            flat += map(self.known.__getitem__, t) if t else (0,)
            flat += (0, 0)
        rows = np.array(flat)
        starts = np.concatenate([[0], np.cumsum(size + 2)[:-1]])
        # A text's own places, without the two behind it, in stretches that reduceat can take.
        cuts = np.stack([starts, starts + size], 1).ravel()
        pooled = []
        for k in WIDTHS:
            total = None
            for width, j, cols in _groups():
                if width == k:
                    part = self.adds[:, cols][rows[j : len(rows) - 2 + j]]
                    total = part if total is None else total + part
            total = np.concatenate([total, np.full((2, FILTERS), -np.inf, np.float32)])
            pooled.append(np.maximum.reduceat(total, cuts, axis=0)[::2])
        pooled = np.concatenate(pooled, 1) + self.bias
        return np.maximum(pooled, LEAK * pooled) @ self.out[:-1] + self.out[-1]

    def scores(self, texts: list[str | None]) -> np.ndarray:
        words = [words_of(t) for t in texts]
        if self.table is None or not texts:
            return np.full(len(texts), self.share)
        # Long texts go in parts of bounded size through the filters only together with their neighbours.
        odds = np.concatenate([self.logits(words[i : i + 32]) for i in range(0, len(words), 32)])
        odds = odds + self.shift[[language_of(w) for w in words]]
        return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


class Codes:
    """Texts as codes of their words, 0 for a text without any; ids has the places of each code's word."""

    def __init__(self):
        self.known: dict[bytes, int] = {}
        self.ids = np.zeros((1, EACH), np.int32)
        self.hit = np.zeros(1 << BITS, bool)
        self.n = 1

    def of(self, texts: list[list[bytes]]) -> list[np.ndarray]:
        words = set().union(*texts)
        new = list(words.difference(self.known))
        if self.n > 1 and self.n + len(new) > REMEMBER:
            new, self.known, self.n = list(words), {}, 1
        if self.n + len(new) > len(self.ids):
            self.ids = np.concatenate([self.ids[: self.n], np.zeros((max(self.n, len(new)), EACH), np.int32)])
        if new:
            self.ids[self.n : self.n + len(new)] = all_ids(new)
        self.known |= {w: self.n + i for i, w in enumerate(new)}
        self.n += len(new)
        return [np.array([*map(self.known.__getitem__, t)] or [0]) for t in texts]

    def places(self, seq: np.ndarray) -> np.ndarray:
        """The distinct places of a text; for one without words place 0."""
        self.hit[self.ids[seq]] = True
        out = np.flatnonzero(self.hit)
        self.hit[out] = False
        return out


@dataclass
class Learner:
    """A model's numbers in descent. seen: sums of squares for their rates. Marks that are not usual stay as they are."""

    values: list[np.ndarray]  # table, filters, bias, out
    seen: list[np.ndarray]
    usual: np.ndarray

    @classmethod
    def start(cls, usual: np.ndarray, share: float, rng: np.random.Generator) -> Learner:
        f = np.float32
        table = (rng.normal(0, 0.05, (1 << BITS, WIDTH)) * usual[:, None]).astype(f)
        filters = rng.normal(0, 0.3, (WIDTH, _COLUMNS)).astype(f)
        # A maximum finds what is there, not what is missing: all filters begin as signs of label 1.
        bias, out = np.zeros(len(WIDTHS) * FILTERS, f), np.abs(rng.normal(0, 0.3, len(WIDTHS) * FILTERS + 1)).astype(f)
        out[-1] = np.log(share / (1 - share))
        values = [table, filters, bias, out]
        return cls(values, [np.full_like(p, 1e-7) for p in values], usual)

    def copy(self) -> Learner:
        return Learner([p.copy() for p in self.values], [p.copy() for p in self.seen], self.usual)

    def model(self, share: float) -> Model:
        return Model(share, *self.values, np.zeros(len(ts.LANGUAGES) + 1))

    def gradients(self, seqs: list[np.ndarray], ids: np.ndarray, labels: np.ndarray):
        """Of the mean loss of these texts: places and gradients of the table's rows, gradients of the rest."""
        table, filters, bias, out = self.values
        size = np.array([len(s) for s in seqs])
        ends = np.cumsum(size + 2)
        starts = ends - size - 2
        code = np.zeros(ends[-1], int)  # two of no word end each text
        for s, at in zip(seqs, starts):
            code[at : at + len(s)] = s
        at = ids[code]
        x = table.take(at[:, 0], axis=0)
        for e in range(1, EACH):
            x += table.take(at[:, e], axis=0)
        x[code == 0] = 0
        adds = x @ filters
        n = len(code) - 2
        total = np.zeros((n, len(WIDTHS) * FILTERS), np.float32)
        for width, j, cols in _groups():
            w = WIDTHS.index(width) * FILTERS
            total[:, w : w + FILTERS] += adds[j : n + j, cols]
        where = np.stack([total[a : a + k].argmax(0) + a for a, k in zip(starts, size)])
        pooled = np.take_along_axis(total, where, 0) + bias
        hidden = np.maximum(pooled, LEAK * pooled)
        p = 1 / (1 + np.exp(-np.clip(hidden @ out[:-1] + out[-1], -60, 60)))
        g = ((p - labels) / len(seqs)).astype(np.float32)
        g_out = np.append(hidden.T @ g, g.sum()).astype(np.float32)
        g_pool = np.outer(g, out[:-1]) * np.where(pooled > 0, np.float32(1), np.float32(LEAK))
        g_filters = np.zeros_like(filters)
        rows_at, grads = [], []
        for width, j, cols in _groups():
            w = WIDTHS.index(width) * FILTERS
            place, gq = where[:, w : w + FILTERS] + j, g_pool[:, w : w + FILTERS]
            g_filters[:, cols] += np.einsum("nf,nfd->df", gq, x[place])
            use = (gq != 0) & (code[place] > 0)
            rows_at.append(at[place[use]])
            grads.append((gq[:, :, None] * filters[:, cols].T)[use])
        rows_at, grads = np.concatenate(rows_at), np.concatenate(grads)
        unique, inverse = np.unique(rows_at, return_inverse=True)
        inverse, each = inverse.ravel(), np.repeat(grads, EACH, axis=0)
        g_table = np.stack([np.bincount(inverse, each[:, c], len(unique)) for c in range(WIDTH)], 1).astype(np.float32)
        return unique, g_table, g_filters, g_pool.sum(0), g_out

    def step(self, seqs: list[np.ndarray], ids: np.ndarray, labels: np.ndarray) -> None:
        unique, g_table, *dense = self.gradients(seqs, ids, labels)
        table, seen = self.values[0], self.seen[0]
        seen[unique] += g_table**2
        table[unique] -= RATE * g_table / np.sqrt(seen[unique]) * self.usual[unique, None]
        for q, grad, s in zip(self.values[1:], dense, self.seen[1:]):
            s += 0.02 * (grad**2 - s)
            q -= (RATE / 10 * grad / np.sqrt(s + 1e-8)).astype(np.float32)


def _fit(seqs: list[np.ndarray], codes: Codes, labels: np.ndarray, fit: np.ndarray) -> Learner:
    """What the rows fit teach by themselves. seqs: the texts by codes."""
    rng = np.random.default_rng(SEED)
    # A mark that few training texts have says little, and stays at zero as those that none has.
    counts = np.bincount(np.concatenate([codes.places(seqs[i]) for i in fit]), minlength=1 << BITS)
    learner = Learner.start(counts >= LEAST, labels[fit].mean(), rng)
    for _ in range(min(40, -(-STEPS * BATCH // len(fit)))):
        order = rng.permutation(fit)
        order = np.concatenate([part[np.argsort([len(seqs[i]) for i in part], kind="stable")] for part in np.array_split(order, max(1, len(order) // (BATCH * 8)))])
        batches = [order[i : i + BATCH] for i in range(0, len(order), BATCH)]
        for b in rng.permutation(len(batches)):
            learner.step([seqs[i] for i in batches[b]], codes.ids, labels[batches[b]])
    return learner


def train(rows: list[tuple[str, int]], weight: float = 1.0) -> Model:
    """rows: (text, label), in an order that has nothing to do with either. weight: of a row with label 0, for the
    thresholds, as rows may hold fewer of them than there are for one with label 1.

    The model learns from all rows. Its thresholds come from cross-fitting: each row's odds by a model of the other
    folds, so that every row calibrates and none by a model that has seen it."""
    labels = np.array([y for _, y in rows])
    if len(set(labels.tolist())) < 2:
        return Model(float(labels.mean()) if len(rows) else 0.0)
    fold = np.empty(len(rows), int)
    for y in (0, 1):
        fold[labels == y] = np.arange((labels == y).sum()) % FOLDS
    texts = [words_of(t) for t, _ in rows]
    *others, whole = _starts(texts, labels, fold)
    share, at = float(labels.mean()), np.arange(len(rows))
    odds = np.full(len(rows), np.log(share / (1 - share)))
    for k, learner in enumerate(others):
        part = at[fold == k]
        if learner and len(part):
            model = learner.model(share)
            odds[part] = np.concatenate([model.logits([texts[i] for i in part[j : j + 32]]) for j in range(0, len(part), 32)])
    model = whole.model(share)
    _calibrate(model, odds, np.array([language_of(t) for t in texts]), labels, np.where(labels == 1, 1.0, weight))
    return model


def _starts(texts: list[list[bytes]], labels: np.ndarray, fold: np.ndarray) -> list[Learner | None]:
    """For each fold what the others teach, none if they lack a label; at last what all rows teach."""
    codes = Codes()
    seqs = codes.of(texts)
    rests = [np.flatnonzero(fold != k) for k in range(FOLDS)] + [np.arange(len(texts))]
    return [_fit(seqs, codes, labels, rest) if len(set(labels[rest].tolist())) == 2 else None for rest in rests]


def _calibrate(model: Model, odds: np.ndarray, langs: np.ndarray, labels: np.ndarray, n: np.ndarray) -> None:
    """Each language's shift, from the middle of the widest gap among the thresholds with the best F1 over odds, which come
    from cross-fitting; languages with fewer than ten rows of a label take that of all rows. n: rows that each one stands for."""
    logit = np.log(CUT / (1 - CUT))

    def best(use: np.ndarray) -> float:
        o, at = np.unique(-odds[use], return_inverse=True)
        o, hits, wrong = -o, *(np.cumsum(np.bincount(at, n[use] * (labels[use] == y), len(o))) for y in (1, 0))
        f1 = 2 * hits / (hits + wrong + hits[-1])
        gap = np.append(o[:-1] - o[1:], 0)
        k = max((i for i in range(len(o)) if f1[i] >= f1.max() - 1e-9), key=lambda i: gap[i])
        return float((o[k] + o[min(k + 1, len(o) - 1)]) / 2)

    for i in range(-1, len(ts.LANGUAGES)):
        use = langs == i
        enough = min(n[use & (labels == 1)].sum(), n[use & (labels == 0)].sum()) >= 10
        if not enough:
            use = np.ones(len(labels), bool)
        if len(set(labels[use].tolist())) == 2:
            model.shift[i] = logit - best(use)


def rows_of(df: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str) -> DataFrame:
    """doc_id, y, hash h of the id, fold, and text t of all training rows: one for each id and label, whatever its copies."""
    there = labels.select(doc_id, F.col(label).cast("int").alias("y")).filter("y in (0, 1)").distinct()
    there = materialise(there)  # without texts, so that its size is known for the join
    usable = df.filter(F.col(text).isNotNull()).select(doc_id, F.col(text).alias("t"))
    # One bit for a hash, eight times as many as ids, in bitmaps of 4 KB: a byte for an id, by which most other texts leave before the join.
    buckets = there.count() * 8 // (1 << 15) + 1
    slot = lambda: F.pmod(F.xxhash64(F.col(doc_id)), F.lit(buckets << 15))
    bitmaps = there.withColumn("__s", slot()).groupBy(F.bitmap_bucket_number("__s").alias("__b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("__s")).alias("__m"))
    found = usable.withColumn("__s", slot()).withColumn("__b", F.bitmap_bucket_number("__s")).join(F.broadcast(bitmaps), "__b")
    bit = F.bitmap_bit_position("__s").cast("int")
    byte = F.conv(F.hex(F.substring("__m", F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    usable = found.filter(F.getbit(byte, bit % 8) == 1).select(doc_id, "t")
    one = usable.join(there, doc_id).groupBy(doc_id, "y").agg(F.min_by("t", F.xxhash64("t")).alias("t"))
    fold = F.pmod(F.xxhash64(F.col(doc_id), F.lit(SEED)), F.lit(FOLDS)).cast("int")
    return materialise(one.select(doc_id, "y", F.xxhash64(doc_id).alias("h"), fold.alias("fold"), "t"))


def _first(one: DataFrame, doc_id: str) -> list:
    """h, t, y, fold of the rows for the start, in order: of each label at most TRAIN, those with the smallest hashes, and
    of these as many as MOST_BYTES hold, one at least."""
    inside = F.lit(False)
    for y in (0, 1):
        held, last = 0, None
        for i, key, n in one.filter(F.col("y") == y).select("h", doc_id, F.octet_length("t")).orderBy("h", doc_id).limit(TRAIN).collect():
            held += n
            if last is None or held <= MOST_BYTES // 2:
                last = i, key
        if last:
            inside = inside | (F.col("y") == y) & ((F.col("h") < last[0]) | (F.col("h") == last[0]) & (F.col(doc_id) <= F.lit(last[1])))
    return sorted(tuple(r) for r in one.filter(inside).select("h", "t", "y", "fold").collect())


def sample(df: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str) -> list[tuple[int, str, int]]:
    """Hash of id, text and label of the rows that training starts with, in order."""
    return [r[:3] for r in _first(rows_of(df, labels, doc_id, text, label), doc_id)]


def learn(df: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "label") -> Model:
    """The model of all rows of labels (doc_id, label 0 or 1), with their texts from df."""
    one = rows_of(df, labels, doc_id, text, label)
    n = {r["y"]: (r["n"], r["b"]) for r in one.groupBy("y").agg(F.count("*").alias("n"), F.sum(F.octet_length("t")).alias("b")).collect()}
    rows = _first(one, doc_id)
    total = sum(k for k, _ in n.values())
    if len(rows) == total:
        return train([(t, y) for _, t, y, _ in rows], 1.0)
    share = n[1][0] / total if 1 in n else 0.0
    if len(n) < 2:
        return Model(share)
    first = np.array([y for _, _, y, _ in rows])
    starts = _starts([words_of(t) for _, t, _, _ in rows], first, np.array([k for _, _, _, k in rows]))
    usual = _usual(one)
    for k, s in enumerate(starts):
        if s:  # as frequent as label 1 is among all rows
            s.usual = usual[k]
            s.values[3][-1] += np.log(share / (1 - share)) - np.log(first.mean() / (1 - first.mean()))
    parts = max(1, -(-sum(b for _, b in n.values()) // PART_BYTES))
    *others, model = [s and s.model(share) for s in _descend(one, doc_id, starts, parts)]
    _calibrate(model, *_all_odds(one, others, share))
    return model


def _sums(parts: DataFrame) -> dict[int, np.ndarray]:
    """By k the sum of the vectors that parts (part, k, chunk, v: 32-bit numbers) hold in pieces, in the order of part."""
    import pyarrow as pa

    def add(group: pa.Table) -> pa.Table:
        order = np.argsort(group.column("part").to_numpy(), kind="stable")
        pieces, total = group.column("v"), 0.0
        for i in order:
            total = total + np.frombuffer(pieces[int(i)].as_py(), np.float32).astype(float)
        return pa.table({"k": group.column("k")[:1], "chunk": group.column("chunk")[:1], "v": pa.array([total.astype(np.float32).tobytes()], pa.binary())})

    out: dict[int, list] = {}
    for r in parts.groupBy("k", "chunk").applyInArrow(add, "k int, chunk int, v binary").collect():
        out.setdefault(r["k"], []).append((r["chunk"], r["v"]))
    return {k: np.concatenate([np.frombuffer(v, np.float32) for _, v in sorted(pieces)]) for k, pieces in out.items()}


def _pieces(vectors: dict[int, np.ndarray]):
    """The vectors of a task as a batch for _sums."""
    import pyarrow as pa
    from pyspark import TaskContext

    cut = [(k, c, v[c * CHUNK : (c + 1) * CHUNK].astype(np.float32).tobytes()) for k, v in vectors.items() for c in range(-(-len(v) // CHUNK))]
    k, chunk, v = zip(*cut)
    part = [TaskContext.get().partitionId()] * len(cut)
    return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(k, pa.int32()), pa.array(chunk, pa.int32()), pa.array(v, pa.binary())], names=["part", "k", "chunk", "v"])


_PIECES = "part int, k int, chunk int, v binary"


def _read(batches):
    """Words, label and fold of the rows of t, y and fold, by slices."""
    for batch in batches:
        for at, n in slices(batch.columns, 512) if batch.num_rows else ():
            t, y, fold = batch.slice(at, n).columns
            yield [words_of(x) for x in t.to_pylist()], y.to_numpy(), fold.to_numpy()


def _usual(one: DataFrame) -> list[np.ndarray]:
    """For each fold, and at last for none, the marks that LEAST texts of the other rows have."""

    def run(batches):
        codes, counts = Codes(), {}
        for texts, _, fold in _read(batches):
            for seq, k in zip(codes.of(texts), fold):
                counts.setdefault(int(k), np.zeros(1 << BITS, int))[codes.places(seq)] += 1
        if counts:  # more than LEAST say no more
            yield _pieces({k: np.minimum(c, LEAST) for k, c in counts.items()})

    by_fold = _sums(one.select("t", "y", "fold").mapInArrow(run, _PIECES))
    total = sum(by_fold.values())
    return [total - by_fold.get(k, 0) >= LEAST for k in range(FOLDS)] + [total >= LEAST]


def _descend(one: DataFrame, doc_id: str, starts: list[Learner | None], parts: int) -> list[Learner | None]:
    """starts, after each part's steps over all its rows, those of the fold left out: the mean of the parts' changes, for a row
    of the table that of the parts that changed it."""
    shared = one.sparkSession.sparkContext.broadcast(starts)

    def run(batches):
        learners, ran = [s and s.copy() for s in shared.value], set()
        codes = Codes()
        for texts, labels, fold in _read(batches):
            seqs = codes.of(texts)
            for k, learner in enumerate(learners):
                rest = np.flatnonzero(fold != k) if learner else ()
                for i in range(0, len(rest), BATCH):
                    at = rest[i : i + BATCH]
                    learner.step([seqs[j] for j in at], codes.ids, labels[at])
                    ran.add(k)
        if ran:
            changes = {}
            for k in ran:
                new, old = learners[k].values, shared.value[k].values
                moved = (new[0] != old[0]).any(1)
                changes[k] = np.concatenate([[1], moved, *((a - b).ravel() for a, b in zip(new, old))])
            yield _pieces(changes)

    # Rows of a part come by their hashes, so that a task that is repeated takes the same steps.
    dealt = one.repartition(parts, "h").sortWithinPartitions("h", doc_id, "y").select("t", "y", "fold")
    changes = _sums(dealt.mapInArrow(run, _PIECES))
    shared.unpersist()
    for k, v in changes.items():
        n, moved, rest = v[0], v[1 : 1 + (1 << BITS)], v[1 + (1 << BITS) :]
        for i, p in enumerate(starts[k].values):
            change, rest = rest[: p.size].reshape(p.shape), rest[p.size :]
            p += change / (n if i else np.maximum(moved, 1)[:, None])
    return starts


def _all_odds(one: DataFrame, others: list[Model | None], share: float) -> tuple[np.ndarray, ...]:
    """Odds, language and label of all rows, and how many rows have these: each row by the model that its fold left out."""
    shared = one.sparkSession.sparkContext.broadcast(others)

    def make(t, fold):
        texts, fold = [words_of(x) for x in t.to_pylist()], fold.to_numpy()
        odds = np.full(len(texts), np.log(share / (1 - share)))
        for k, model in enumerate(shared.value):
            at = np.flatnonzero(fold == k) if model else ()
            for j in range(0, len(at), 32):
                odds[at[j : j + 32]] = model.logits([texts[i] for i in at[j : j + 32]])
        return [np.rint(np.clip(odds, -30, 30) * GRID).astype(np.int32), [language_of(w) for w in texts]]

    found = map_batches(one, ["y"], [F.col("t"), F.col("fold")], "odds int, lang int", make)
    rows = found.groupBy("odds", "lang", "y").count().orderBy("odds", "lang", "y").collect()  # 61 * GRID odds of each label and language at most
    odds, lang, y, n = np.array([tuple(r) for r in rows], float).T
    return odds / GRID, lang.astype(int), y.astype(int), n


def score(df: DataFrame, keep: list[str], model: Model, text: str = "text") -> DataFrame:
    """keep, score double and predicted int of each whole text."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # a table of fixed size, some MB

    def make(texts):
        s = shared.value.scores(texts.to_pylist())
        return [s.astype(float), (s >= CUT).astype(np.int32)]

    return map_batches(df, keep, [F.col(text)], "score double, predicted int", make, rows=256)
