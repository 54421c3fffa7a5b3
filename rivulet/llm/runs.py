"""Periodic runs of words, by Main and Lorentz's divide and conquer, and texts without the repeats.

The words of a text are numbered in their batch. A text is halved again and again; at each midpoint the Z-functions of
the right half, of the reversed left half, and of each against the other tell for every shift how far equal words reach
forwards and backwards. Where both together are at least the shift, a repetition crosses the midpoint; it is extended
over the whole text, intervals found more than once are kept once, with their smallest period. All midpoints of a depth,
of all texts of a batch, are worked on together: a Z value is found by doubling over names of blocks of 1, 2, 4, ...
words, which are equal exactly where the blocks are. Only blocks that a text holds more than once have names, so that
ordinary text costs little beyond its words.

A text of n words takes O(n log n) comparisons and four bytes a word for each power of two up to its longest repeated
stretch. Null and empty texts have no words and no runs. Repeated rows have equal results; an empty table gives an
empty one. Texts are read whole, whatever their length, and rows stay in the task that reads them.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivulet.llm.common import map_batches

#: A run has this many words, and two periods, at least.
LEAST = 12


def words_of(texts) -> tuple:
    """words (pyarrow array), their numbers, and the texts' offsets in both; texts is a pyarrow array of strings."""
    import pyarrow as pa
    import pyarrow.compute as pc

    lists = pc.ascii_split_whitespace(pc.fill_null(texts, "").cast(pa.large_string()))
    flat, offsets = lists.flatten(), np.asarray(lists.offsets, np.int64) - lists.offsets[0].as_py()
    full = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0  # white space at an end leaves an empty word
    offsets = np.concatenate([[0], np.cumsum(full)])[offsets]
    coded = flat.filter(pa.array(full)).dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), offsets


class Blocks:
    """Names of the blocks of 1, 2, 4, ... words of each text; -1 where a text holds a block once only."""

    def __init__(self, words: np.ndarray, ends: np.ndarray):
        """ends: for each word, where its text ends."""
        n = len(words)
        self.names: list[np.ndarray] = []
        keys, at, size = ends * (int(words.max(initial=0)) + 1) + words, np.arange(n), 1
        while len(at):
            _, number, count = np.unique(keys, return_inverse=True, return_counts=True)
            again = count[number] > 1
            names = np.full(n + 1, -1, np.int32)
            names[at[again]] = number[again]
            self.names.append(names)
            at = at[again]
            at = at[at + 2 * size <= ends[at]]
            at = at[names[at + size] >= 0]
            keys = names[at].astype(np.int64) * (n + 1) + names[at + size]
            size *= 2

    def same(self, k: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the blocks of 2**k words at a and at b, of one text, are equal."""
        x = self.names[k][a]
        return (x >= 0) & (x == self.names[k][b])

    def forward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words from a on equal those from b on, a < b: Z values."""
        out, n = np.zeros(len(a), np.int64), len(self.names[0]) - 1
        for k in reversed(range(len(self.names))):
            out += self.same(k, a + out, np.minimum(b + out, n)) * np.int64(1 << k)
        return out

    def backward(self, a: np.ndarray, b: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """How many words before a equal those before b, a < b, within the text that begins at starts: Z values of it reversed."""
        out = np.zeros(len(a), np.int64)
        for k in reversed(range(len(self.names))):
            x, y = a - out - (1 << k), b - out - (1 << k)
            inside = x >= starts
            out += (inside & self.same(k, np.where(inside, x, 0), np.where(inside, y, 0))) * np.int64(1 << k)
        return out


def runs(words: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """start, end and period of every run of the texts that lie between offsets, by start and period."""
    sizes = np.diff(offsets)
    start_of, end_of = np.repeat(offsets[:-1], sizes), np.repeat(offsets[1:], sizes)
    blocks = Blocks(words, end_of)
    none = np.zeros(0, np.int64)
    if len(blocks.names) < 2:
        return none, none, none
    found: list[np.ndarray] = []
    lo, hi = offsets[:-1], offsets[1:]
    pairs = blocks.names[1]
    while len(lo):
        long = hi - lo >= LEAST
        lo, hi = lo[long], hi[long]
        mid = (lo + hi) // 2
        # Six words in all are equal at a shift of the run's period, so that two are, on one side of the midpoint.
        alive = (pairs[mid] >= 0) | (pairs[np.maximum(mid - 2, 0)] >= 0)
        for left in (False, True):
            a, b = (lo[alive], mid[alive]) if left else (mid[alive] + 1, hi[alive] + 1)
            lengths = b - a
            shifted = np.repeat(a - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(lengths.sum())
            centre = np.repeat(mid[alive], lengths)
            text = start_of[centre]
            hit = (pairs[shifted] >= 0) & (pairs[shifted] == pairs[centre])
            back = np.minimum(shifted, centre) - 2 >= text
            hit |= back & (pairs[shifted - 2] >= 0) & (pairs[shifted - 2] == pairs[centre - 2])
            shifted, centre, text = shifted[hit], centre[hit], text[hit]
            first, second = (shifted, centre) if left else (centre, shifted)
            period, ahead, behind = second - first, blocks.forward(first, second), blocks.backward(first, second, text)
            length = period + ahead + behind
            good = length >= np.maximum(LEAST, 2 * period)
            found.append(np.stack([first - behind, second + ahead, period])[:, good])
        lo, hi = np.concatenate([lo, mid]), np.concatenate([mid, hi])
    start, end, period = np.concatenate(found, axis=1) if found else (none, none, none)
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    new = np.ones(len(start), bool)
    new[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    start, end, period = start[new], end[new], period[new]
    order = np.lexsort((period, start))
    return start[order], end[order], period[order]


def repeated(n: int, h: int) -> np.ndarray | None:
    """For a text of n words whose id has crc32 h: which word stands at each place once it is made to repeat itself."""
    if h < 0 or h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    at = np.arange(n)
    return np.where(at < a, at, a + (at - a) % p)


def kept(n: int, start: np.ndarray, end: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Which of n words stay: those that no run holds behind its first period."""
    cover = np.zeros(n + 1, np.int64)
    np.add.at(cover, start + period, 1)
    np.add.at(cover, end, -1)
    return np.cumsum(cover[:-1]) == 0


def _collapse(texts, codes):
    """For each text: its runs, and the collapsed text as bytes."""
    dictionary, words, offsets = words_of(texts)
    codes = np.full(len(texts), -1, np.int64) if codes is None else codes
    for i, h in enumerate(codes):
        lo, hi = offsets[i], offsets[i + 1]
        if (at := repeated(int(hi - lo), int(h))) is not None:
            words[lo:hi] = words[lo + at]
    start, end, period = runs(words, offsets)
    first = np.searchsorted(start, offsets)
    plain = None
    for i in range(len(texts)):
        lo, hi = offsets[i], offsets[i + 1]
        mine = slice(first[i], first[i + 1])
        s, e, p = start[mine] - lo, end[mine] - lo, period[mine]
        if len(s) or (codes[i] >= 0 and codes[i] % 10 == 0):
            plain = plain or [w.encode() for w in dictionary.to_pylist()]
            text = b" ".join([plain[w] for w in words[lo:hi][kept(int(hi - lo), s, e, p)].tolist()])
        else:
            text = b" ".join((texts[i].as_py() or "").encode().split())
        yield s, e, p, text


def collapse(df: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """df's columns keep and: runs (array of start, length, period, in words), collapsed (the text without repeats)."""

    def make(texts):
        spans, out = [], []
        for s, e, p, collapsed in _collapse(texts, None):
            spans.append([{"start": a, "length": b - a, "period": q} for a, b, q in zip(s.tolist(), e.tolist(), p.tolist())])
            out.append(collapsed.decode())
        return spans, out

    return map_batches(df, keep, [F.col(text)], "runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string", make)


SUMMARY = "n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs_sha256 string, collapsed_sha256 string"


def summary(df: DataFrame, keep: list[str], text: str = "text", code: Column | None = None) -> DataFrame:
    """df's columns keep and those of SUMMARY: number of runs, the longest (ties: smallest start, then period), digests
    of all runs and of the collapsed text. code, where not null, makes a text repeat itself first: see repeated()."""

    def make(texts, codes):
        rows = []
        for s, e, p, collapsed in _collapse(texts, codes.fill_null(-1).to_numpy(zero_copy_only=False)):
            length = e - s
            best = [None] * 4
            if len(s):
                k = int(np.lexsort((p, s, -length))[0])
                best = [int(s[k]), int(length[k]), int(p[k]), int(1000 * length[k] // p[k])]
            listed = "".join(f"{a},{b},{q}\n" for a, b, q in zip(s.tolist(), length.tolist(), p.tolist()))
            rows.append([len(s), *best, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(collapsed).hexdigest()])
        return [list(x) for x in zip(*rows)] if rows else [[]] * 7

    code = F.lit(None) if code is None else code
    return map_batches(df, keep, [F.col(text), code.cast("bigint")], SUMMARY, make)
