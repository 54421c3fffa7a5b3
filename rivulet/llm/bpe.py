"""Byte-pair encoding and decoding over whole documents, with the vocabulary of a public tokenizer file.

Method: contiguous rank array. A word is held as a row of parts with, beside it, a row of the ranks of adjacent
pairs; the smallest rank is sought by a scan, its right boundary is deleted, and the ranks of the two neighbours
are refreshed. Words of like length are rows of one numpy array and take these steps together. Words of more than
LONG parts go through a heap instead, as repeated scans are quadratic.

The file must be of the `tokenizers` kind with: normaliser NFC, white space to one space, lower case per code
point; the split pattern of SPLIT; byte-level alphabet; an end-of-word suffix; no decoder. Anything else raises.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterable

import numpy as np
import regex
from pyspark.sql import DataFrame

from rivulet.llm.common import map_batches

#: Fixed value: the split pattern of the supported tokenizer files.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Unicode's white space, spelled out: Python's own classes add U+001C to U+001F.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Beyond so many parts, a word is merged with a heap.
LONG = 64
#: During a task a worker remembers stretches of text between white space that take up so many bytes, by REMEMBER_EACH
#: and their characters; then it begins anew.
REMEMBER, REMEMBER_EACH = 48 << 20, 330
#: No stretch of more characters is remembered.
REMEMBER_CHARS = 64
#: Bits for an id.
BITS = 20
NONE = 1 << 60


def _byte_letters() -> dict[int, str]:
    """The printable letter of each byte: itself where it prints in Latin-1, else the next code point from 256."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {b: chr(b) for b in prints}
    letters |= {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in letters)}
    return letters


class Codec:
    """A vocabulary, with encode and decode for one text. raw: the JSON of the tokenizer file."""

    def __init__(self, raw: str):
        spec = json.loads(raw)
        model, steps = spec["model"], [x.get("type") for x in (spec["normalizer"] or {}).get("normalizers", [])]
        splits = [x.get("pattern", {}).get("Regex") for x in (spec["pre_tokenizer"] or {}).get("pretokenizers", [])]
        if model["type"] != "BPE" or steps != ["NFC", "Replace", "Lowercase"] or splits[:1] != [SPLIT] or spec["decoder"] or not model["end_of_word_suffix"]:
            raise ValueError("this kind of tokenizer file is not supported")
        self.ids: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.texts = {i: t for t, i in self.ids.items()} | {i: t for t, i in self.special.items()}
        #: Of a pair of ids as one number: its rank, and in the low bits the id that it merges to.
        self.merges: dict[int, int] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[self.ids[a] << BITS | self.ids[b]] = rank << BITS | self.ids[a + b]
        letters = _byte_letters()
        self.inner = [self.ids[letters[b]] for b in range(256)]
        self.final = [self.ids[letters[b] + self.suffix] for b in range(256)]
        self.inner_ids, self.final_ids = np.array(self.inner, np.int64), np.array(self.final, np.int64)
        self._table()
        # No letter is assigned beyond U+323AF, where the regex library's class is wrong.
        letters = r"[\p{L}--[\U000323B0-\U0010FFFF]]"
        self.words = regex.compile(SPLIT.replace(r"[\p{L}]", letters).replace(r"[^\s\p{L}\p{N}]", rf"[^{SPACE}{letters}\p{{N}}]"), regex.V1)
        self.odd, self.spaces = regex.compile("[\x1c-\x1f]"), regex.compile(f"[{SPACE}]+")
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, tuple[str, str]] = {}
        self.held = 0

    def _table(self) -> None:
        """The merges as a hash table in two numpy arrays, for look-ups of many pairs at a time."""
        self.slots = 1 << 19
        keys, values = np.full(self.slots, -1, np.int64), np.full(self.slots, NONE, np.int64)
        for key, value in self.merges.items():
            at = self._slot(key)
            while keys[at] >= 0:
                at = at + 1 & self.slots - 1
            keys[at], values[at] = key, value
        self.keys, self.values = keys, values

    def _slot(self, key):
        return (key ^ key >> 17) * 0x9E3779B1 >> 11 & self.slots - 1

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Of pairs of ids: rank << BITS | merged id, NONE where they don't merge. A negative id is no id."""
        key = a.astype(np.int64) << BITS | b
        at = self._slot(key)
        there = self.keys[at]
        out = np.where(there == key, self.values[at], NONE)
        rest = np.flatnonzero((there != key) & (there >= 0) & (a >= 0) & (b >= 0))
        while len(rest):
            at[rest] = at[rest] + 1 & self.slots - 1
            there = self.keys[at[rest]]
            out[rest] = np.where(there == key[rest], self.values[at[rest]], NONE)
            rest = rest[(there != key[rest]) & (there >= 0)]
        out[(a < 0) | (b < 0)] = NONE
        return out

    def words_ids(self, words: list[str]) -> list[list[int]]:
        """The ids of each word, that is of each match of the split pattern."""
        raws = [w.encode() for w in words]
        size = np.fromiter(map(len, raws), np.int64, len(raws))
        out: list[list[int]] = [[]] * len(raws)
        for least, most in ((0, 6), (6, 9), (9, 13), (13, 24), (24, LONG)):
            rows = np.flatnonzero((size > least) & (size <= most))
            for at in range(0, len(rows), 20_000):
                part = rows[at : at + 20_000]
                for i, ids in zip(part.tolist(), self._scan([raws[i] for i in part.tolist()], most)):
                    out[i] = ids
        for i in np.flatnonzero(size > LONG).tolist():
            out[i] = self._heap([self.inner[x] for x in raws[i][:-1]] + [self.final[raws[i][-1]]])
        return out

    def _scan(self, raws: list[bytes], width: int) -> list[list[int]]:
        """Words of 1 to width bytes, a row each: parts, then -1; ranks of adjacent pairs, then NONE."""
        n = len(raws)
        size = np.fromiter(map(len, raws), np.int64, n)
        letters = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in raws), np.uint8).reshape(n, width)
        parts = self.inner_ids[letters]
        ends = np.arange(n), size - 1
        parts[ends] = self.final_ids[letters[ends]]
        parts[np.arange(width) >= size[:, None]] = -1
        rank = np.full((n, width), NONE, np.int64)
        rank[:, :-1] = self._ranks(parts[:, :-1].ravel(), parts[:, 1:].ravel()).reshape(n, width - 1)
        done, rows, column = parts.copy(), np.arange(n), np.arange(width)
        while len(rows):
            i = rank.argmin(1)
            low = rank[np.arange(len(rows)), i]
            if (over := low == NONE).any():
                done[rows[over]] = parts[over]
                parts, rank, rows, i, low = parts[~over], rank[~over], rows[~over], i[~over], low[~over]
                if not len(rows):
                    break
            k = np.arange(len(rows))
            parts[k, i] = low & (1 << BITS) - 1
            after = np.minimum(column + (column > i[:, None]), width - 1)  # without the boundary behind part i
            parts = np.take_along_axis(parts, after, 1)
            parts[:, -1] = -1
            rank = np.take_along_axis(rank, np.minimum(column + (column >= i[:, None]), width - 1), 1)
            rank[:, -1] = NONE
            left = np.flatnonzero(i > 0)
            rank[left, i[left] - 1] = self._ranks(parts[left, i[left] - 1], parts[left, i[left]])
            right = np.flatnonzero(i < width - 1)
            rank[right, i[right]] = self._ranks(parts[right, i[right]], parts[right, i[right] + 1])
        many = (done >= 0).sum(1).tolist()
        return [row[:m] for row, m in zip(done.tolist(), many)]

    def _heap(self, parts: list[int]) -> list[int]:
        get, n = self.merges.get, len(parts)
        before, after, alive = [i - 1 for i in range(n)], [i + 1 for i in range(n)], [True] * n
        heap = [(low, i, a, b) for i, (a, b) in enumerate(zip(parts, parts[1:])) if (low := get(a << BITS | b))]
        heapq.heapify(heap)
        while heap:
            low, i, a, b = heapq.heappop(heap)
            j = after[i] if alive[i] else n
            if j >= n or parts[i] != a or parts[j] != b:
                continue
            parts[i], alive[j], after[i] = low & (1 << BITS) - 1, False, after[j]
            if after[j] < n:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (low := get(parts[x] << BITS | parts[y])):
                    heapq.heappush(heap, (low, x, parts[x], parts[y]))
        return [p for p, ok in zip(parts, alive) if ok]

    def _learn(self, stretches: set[str]) -> dict[str, tuple[str, str]]:
        """Ids and token texts, each joined by spaces, of stretches without white space; the short ones are
        remembered. Each has tokens, as the split pattern takes every other character."""
        split: dict[str, list[str]] = {}
        for s in stretches:
            if s.isalpha() and s < "\U000323B0":
                split[s] = [s]
            elif (head := s[:-1]).isalpha() and head < "\U000323B0" and s[-1] in ".,!?;:":
                split[s] = [head, s[-1]]
            else:
                split[s] = self.words.findall(s)
        words = list({w for ws in split.values() for w in ws})
        texts, joined = self.texts, {}
        for w, ids in zip(words, self.words_ids(words)):
            joined[w] = " ".join(map(str, ids)), " ".join([texts[i] for i in ids])
        out = {}
        for s, ws in split.items():
            if len(ws) == 1:
                out[s] = joined[ws[0]]
            else:
                got = [joined[w] for w in ws]
                out[s] = " ".join([x[0] for x in got]), " ".join([x[1] for x in got])
        return out

    def pieces(self, texts: list[str]) -> list[list[tuple[str, str]]]:
        """For each text, ids and token texts as strings, stretch by stretch."""
        split: list[list[list[str] | str]] = []
        for text in texts:
            split.append(one := [])
            for k, part in enumerate(self.cut.split(text) if self.cut else [text]):
                if k % 2:
                    one.append(part)
                    continue
                part = part if unicodedata.is_normalized("NFC", part) else unicodedata.normalize("NFC", part)
                # Lower case code point by code point: str.lower() alone has another form for a final sigma.
                part = part.replace("Σ", "σ").lower()
                one.append(list(filter(None, self.spaces.split(part))) if self.odd.search(part) else part.split())
        wanted = set().union(*[x for one in split for x in one if not isinstance(x, str)]).difference(self.known)
        new = self._learn(wanted)
        known, now = self.known.get, self.known
        self._remember(new)
        out = []
        for one in split:
            out.append(got := [])
            for x in one:
                if isinstance(x, str):
                    got.append((str(self.special[x]), x))
                    continue
                found = list(map(known, x))
                got += found if None not in found else [f or new.get(s) or now[s] for f, s in zip(found, x)]
        return out

    def _remember(self, new: dict[str, tuple[str, str]]) -> None:
        """Beyond the bound a new dict takes over; what pieces() still reads is its own."""
        short = {s: x for s, x in new.items() if len(s) <= REMEMBER_CHARS}
        size = sum(REMEMBER_EACH + len(s) + len(x[0]) + len(x[1]) for s, x in short.items())
        if self.held + size > REMEMBER:
            self.forget()
        if size <= REMEMBER:
            self.known |= short
            self.held += size

    def encode(self, text: str) -> list[int]:
        return [int(i) for ids, _ in self.pieces([text])[0] for i in ids.split(" ")]

    def encode_many(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text; the words of all are merged together."""
        joined = [" ".join([ids for ids, _ in got]) for got in self.pieces(texts)]
        return [np.array(ids.split(" ") if ids else [], np.int32) for ids in joined]

    def decode(self, ids: Iterable[int]) -> str:
        """Without a decoder in the file, the tokens' own texts joined by one space."""
        return " ".join(map(self.texts.__getitem__, ids))

    def digests(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """Number of tokens, and SHA-256 of the ids and of the decoded text, both joined by single spaces."""
        out = []
        for got in self.pieces(texts):
            ids = " ".join([x[0] for x in got])
            decoded = " ".join([x[1] for x in got])
            n = ids.count(" ") + 1 if ids else 0
            out.append((n, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
        return out


_codecs: dict[int, Codec] = {}


def codec_of(raw: str) -> Codec:
    """One Codec for a vocabulary in each worker process, for all its tasks."""
    key = hash(raw)
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(raw)
    return _codecs[key]


def _raw(path: str | None) -> str:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as f:
        return f.read()


def _mapped(df: DataFrame, keep: list[str], column: str, schema: str, rows, path: str | None) -> DataFrame:
    """df's columns keep, and behind them, under schema, the tuples that rows(codec, values) returns."""
    vocabulary = df.sparkSession.sparkContext.broadcast(_raw(path))  # a fixed file of a few MB

    def make(column):
        got = rows(codec_of(vocabulary.value), column.to_pylist())
        return list(zip(*got))

    def done():
        for codec in _codecs.values():
            codec.forget()

    return map_batches(df, keep, [df[column]], schema, make, rows=256, done=done)


def encode(df: DataFrame, column: str = "text", keep: tuple[str, ...] = ("doc_id",), path: str | None = None) -> DataFrame:
    """keep and token_ids array<int> for each row of df. A null or empty text has no tokens; a text of any length
    is encoded whole; rows may repeat; an empty table gives an empty one; other columns of df are left out."""
    return _mapped(df, list(keep), column, "token_ids array<int>", lambda codec, texts: [(ids,) for ids in codec.encode_many([x or "" for x in texts])], path)


def decode(df: DataFrame, column: str = "token_ids", keep: tuple[str, ...] = ("doc_id",), path: str | None = None) -> DataFrame:
    """keep and decoded string for each row of df; null and no ids give an empty string. An id that the vocabulary
    lacks is an error."""
    return _mapped(df, list(keep), column, "decoded string", lambda codec, rows: [(codec.decode(x or []),) for x in rows], path)


def digest(df: DataFrame, column: str = "text", keep: tuple[str, ...] = ("doc_id",), path: str | None = None) -> DataFrame:
    """keep, n_tokens, ids_sha256 and decoded_sha256 of encode() and decode(), in one pass over the texts."""
    return _mapped(df, list(keep), column, "n_tokens long, ids_sha256 string, decoded_sha256 string", lambda codec, texts: codec.digests([x or "" for x in texts]), path)
