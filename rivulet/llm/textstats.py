"""Counts of one text that the quality operators share, from its UTF-8 bytes."""

from __future__ import annotations

from collections import Counter

import numpy as np

#: Classes of bytes; a lead byte of UTF-8 stands for its code point, the bytes that follow it are left out.
CLASSES = ("lower", "upper", "digit", "space", "stop", "symbol", "control", "beyond")
SKIP = len(CLASSES)


def _classes() -> np.ndarray:
    out = np.full(256, CLASSES.index("control"), np.uint8)
    for b in range(256):
        c = chr(b)
        if b >= 0xC0:
            out[b] = CLASSES.index("beyond")
        elif b >= 0x80:
            out[b] = SKIP
        elif c in " \t\n\v\f\r":
            out[b] = CLASSES.index("space")
        elif c.islower():
            out[b] = CLASSES.index("lower")
        elif c.isupper():
            out[b] = CLASSES.index("upper")
        elif c.isdigit():
            out[b] = CLASSES.index("digit")
        elif c in ".,;:!?'\"()-":
            out[b] = CLASSES.index("stop")
        elif c.isprintable():
            out[b] = CLASSES.index("symbol")
    return out


CLASS_OF = _classes()
SPACES, SYMBOLS = b" \t\n\v\f\r", b"#*$%&|<>"

#: Frequent function words by language.
COMMON = {
    "en": "the of and to in a is that for it as was with be by on not he this are or his from at which but have an had they you were their one all we can her has there been if more when will would who so no",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur",
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont la avec son cette ses mais on comme ou si leur y dont tout nous sa aux être deux fait elle",
    "es": "de la que el en y a los del se las por un para con no una su al lo como más pero sus le ya o este sí porque esta entre cuando muy sin sobre también me hasta hay donde quien desde todo nos",
}
LANGUAGES = tuple(COMMON)
WORDS = sorted({w for ws in COMMON.values() for w in ws.split()})
WORD_AT = {w.encode(): i for i, w in enumerate(WORDS)}


def encode(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def class_counts(raw: bytes) -> np.ndarray:
    return np.bincount(CLASS_OF[np.frombuffer(raw, np.uint8)], minlength=SKIP + 1)[:SKIP]


def common_counts(words: list[bytes]) -> np.ndarray:
    """Counts of WORDS among the lower-cased words, and behind them that of all other words."""
    out = np.zeros(len(WORDS) + 1)
    counted = Counter(words)
    for w in counted.keys() & WORD_AT.keys():
        out[WORD_AT[w]] = counted[w]
    out[-1] = len(words) - out.sum()
    return out


def n_of(raw: bytes, which: bytes) -> int:
    return len(raw) - len(raw.translate(None, which))


def dup_lines(raw: bytes) -> tuple[int, int]:
    """Lines with a word, and those of them that equal an earlier one."""
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    return len(lines), len(lines) - len(set(lines))


def repeat_words(words: list[bytes]) -> int:
    """Words in windows of three words that the text has twice or more, the first occurrence included."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    many = Counter(windows)
    hit = np.fromiter((many[x] > 1 for x in windows), np.int8, len(windows))
    covered = np.zeros(len(words), np.int8)
    for k in range(3):
        covered[k : k + len(hit)] |= hit
    return int(covered.sum())
