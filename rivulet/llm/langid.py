"""Language identification by a bidirectional gated recurrent network over bytes.

Every byte of a text is a position. Two recurrent networks of HIDDEN units, one in either direction, read it in
windows of WINDOW bytes (a text of any length is a row of windows; each is read whole, from a zero state). From both
states each position is labelled with the languages' probabilities, and the document's are the means over all its
positions. Gates are clipped linear functions and the candidate state a clipped one, as those cost little. Trained in
numpy by backpropagation through time with Adam.

Training rows are a bounded sample: for each language, the TRAIN distinct texts with the smallest hashes, and of each its
first SAMPLE bytes and as many from its middle. A null text, or one without a letter, is `und` with score 0; so is
every text where no row has a language to learn from. Texts are judged by themselves, so rows may repeat.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rivulet.llm.common import map_batches, materialise

HIDDEN, WINDOW, ROWS = 8, 192, 2048
TRAIN, SAMPLE = 250, 192
#: Parts in which the hashes of a language are first ranked.
PARTS = 16
STEPS, BATCH, RATE, SEED = 320, 96, 0.02, 3


@dataclass
class Direction:
    """x: 256 by 3 * HIDDEN, what each byte adds to update gate, reset gate and candidate, biases included."""

    x: np.ndarray
    gates: np.ndarray  # HIDDEN by 2 * HIDDEN
    candidate: np.ndarray  # HIDDEN by HIDDEN


def forward(d: Direction, codes: np.ndarray, keep: bool = False):
    """States behind each step of codes (steps by rows); with keep also what the way back needs."""
    steps, n = codes.shape
    h = d.gates.shape[0]
    states, kept = np.empty((steps, n, h), np.float32), []
    state, x = np.zeros((n, h), np.float32), np.empty((n, 3 * h), np.float32)
    gates, cand = np.empty((n, 2 * h), np.float32), np.empty((n, h), np.float32)
    for t in range(steps):
        np.take(d.x, codes[t], axis=0, out=x, mode="clip")
        np.matmul(state, d.gates, out=gates)
        gates += x[:, : 2 * h]
        np.clip(gates, 0, 1, out=gates)
        np.matmul(gates[:, h:] * state, d.candidate, out=cand)
        cand += x[:, 2 * h :]
        np.clip(cand, -1, 1, out=cand)
        if keep:
            kept.append((state.copy(), gates.copy(), cand.copy()))
        # state + z * (cand - state)
        cand -= state
        cand *= gates[:, :h]
        np.add(state, cand, out=states[t])
        state = states[t]
    return (states, kept) if keep else states


def backward(d: Direction, codes: np.ndarray, kept: list, grad: np.ndarray) -> Direction:
    h = d.gates.shape[0]
    out = Direction(np.zeros_like(d.x), np.zeros_like(d.gates), np.zeros_like(d.candidate))
    carry = np.zeros_like(grad[0])
    for t in range(len(codes) - 1, -1, -1):
        state, gates, cand = kept[t]
        z, r = gates[:, :h], gates[:, h:]
        g = grad[t] + carry
        g_cand = g * z * (np.abs(cand) < 1)
        g_rs = g_cand @ d.candidate.T
        g_gates = np.concatenate([g * (cand - state), g_rs * state], 1) * ((gates > 0) & (gates < 1))
        out.candidate += (r * state).T @ g_cand
        out.gates += state.T @ g_gates
        np.add.at(out.x, codes[t], np.concatenate([g_gates, g_cand], 1))
        carry = g * (1 - z) + g_rs * r + g_gates @ d.gates.T
    return out


@dataclass
class Model:
    languages: list[str]
    ahead: Direction | None = None
    back: Direction | None = None
    out: np.ndarray | None = None  # 2 * HIDDEN + 1 by languages

    def sums(self, codes: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Of each row of codes (rows by WINDOW, of which size count), the sums of its positions' probabilities."""
        steps = np.ascontiguousarray(codes.T)
        # Backwards the padding comes first; its code 0 keeps the state at zero or near, as in training.
        a, b = forward(self.ahead, steps), forward(self.back, steps[::-1])[::-1]
        h = a.shape[2]
        total = np.zeros((len(size), len(self.languages)))
        for t in range(len(steps)):
            odds = a[t] @ self.out[:h]
            odds += b[t] @ self.out[h : 2 * h]
            odds += self.out[-1]
            odds -= odds.max(1, keepdims=True)
            np.exp(odds, out=odds)
            odds /= odds.sum(1, keepdims=True)
            odds[size <= t] = 0
            total += odds
        return total

    def label(self, texts: list[str | None]) -> list[tuple[str, float]]:
        used = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))] if self.ahead else []
        out = [("und", 0.0)] * len(texts)
        raws = [texts[i].encode("utf-8", "surrogatepass") for i in used]
        n_windows = [-(-len(r) // WINDOW) for r in raws]
        pooled = np.zeros((len(used), len(self.languages)))
        owner = np.repeat(np.arange(len(used)), n_windows)
        flat = np.frombuffer(b"".join(r.ljust(k * WINDOW, b"\0") for r, k in zip(raws, n_windows)), np.uint8).reshape(-1, WINDOW)
        size = np.full(len(owner), WINDOW)
        if len(used):
            ends = np.cumsum(n_windows) - 1
            size[ends] = [len(r) - (k - 1) * WINDOW for r, k in zip(raws, n_windows)]
        for at in range(0, len(owner), ROWS):
            part = slice(at, at + ROWS)
            np.add.at(pooled, owner[part], self.sums(flat[part], size[part]))
        for i, r, p in zip(used, raws, pooled):
            k = int(p.argmax())
            out[i] = self.languages[k], min(1.0, float(p[k] / len(r)))
        return out


def train(rows: list[tuple[str, str]]) -> Model:
    """rows: (text, language)."""
    languages = sorted({lang for _, lang in rows})
    if not rows:
        return Model([])
    rng = np.random.default_rng(SEED)
    codes, size, wanted = [], [], []
    for text, lang in rows:
        raw = text.encode("utf-8", "surrogatepass")
        middle = max(0, len(raw) // 2 - SAMPLE // 2)
        for piece in {raw[:SAMPLE], raw[middle : middle + SAMPLE]}:
            if piece:
                codes.append(np.frombuffer(piece.ljust(SAMPLE, b"\0"), np.uint8))
                size.append(len(piece))
                wanted.append(languages.index(lang))
    codes, size, wanted = np.array(codes), np.array(size), np.array(wanted)
    if not len(codes):
        return Model(languages)
    h, f = HIDDEN, np.float32
    x = lambda: np.concatenate([rng.normal(0, 0.15, (256, 2 * h)) + 0.4, rng.normal(0, 0.5, (256, h))], 1).astype(f)
    make = lambda: Direction(x(), rng.normal(0, 0.1, (h, 2 * h)).astype(f), rng.normal(0, 0.3, (h, h)).astype(f))
    model = Model(languages, make(), make(), (rng.normal(0, 0.3, (2 * h + 1, len(languages)))).astype(f))
    params = [p for d in (model.ahead, model.back) for p in (d.x, d.gates, d.candidate)] + [model.out]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, STEPS + 1):
        pick = rng.integers(0, len(codes), BATCH)
        steps = np.ascontiguousarray(codes[pick].T)
        a, kept_a = forward(model.ahead, steps, True)
        b, kept_b = forward(model.back, steps[::-1], True)
        both = np.concatenate([a, b[::-1], np.ones_like(a[:, :, :1])], 2)
        odds = both @ model.out
        p = np.exp(odds - odds.max(2, keepdims=True))
        p /= p.sum(2, keepdims=True)
        counts = (np.arange(len(steps))[:, None] < size[pick])[:, :, None]
        g = (p - np.eye(len(languages), dtype=f)[wanted[pick]]) * counts / counts.sum()
        g = g.astype(f)
        grad_out = np.einsum("tbi,tbj->ij", both, g, optimize=True)
        g_both = g @ model.out.T
        back_a = backward(model.ahead, steps, kept_a, g_both[:, :, :h])
        back_b = backward(model.back, steps[::-1], kept_b, g_both[::-1, :, h : 2 * h])
        grads = [q for d in (back_a, back_b) for q in (d.x, d.gates, d.candidate)] + [grad_out]
        norm = float(np.sqrt(sum((q**2).sum() for q in grads)))
        rate = RATE * min(1.0, 2 * (1 - step / (STEPS + 1)))
        for q, grad, m, v in zip(params, grads, first, second):
            grad = grad * min(1.0, 1.0 / (norm + 1e-12))
            m += 0.1 * (grad - m)
            v += 0.01 * (grad**2 - v)
            q -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)).astype(f)
    return model


def learn(df: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """The model of df's rows with a text and a language: at most TRAIN distinct texts of each language, and of each
    the sampled characters, reach the driver."""
    t = F.col(text)
    known = df.filter(F.col(lang).isNotNull() & (F.length(t) > 0))
    cut = F.concat(F.substring(t, 1, SAMPLE), F.expr(f"substring(`{text}`, greatest(1, cast(char_length(`{text}`) / 2 as int) - {SAMPLE}), {2 * SAMPLE})"))
    hashed = known.select(F.col(lang).alias("lang"), F.xxhash64(t).alias("h"), cut.alias("cut"))
    # Copies are one before the smallest hashes are taken: first those of each part of a language, then those of the
    # language among them, so that one task meets PARTS times TRAIN hashes at most, whatever the table.
    distinct = hashed.groupBy("lang", "h").agg(F.pmod("h", F.lit(PARTS)).alias("part"))
    least = distinct.withColumn("k", F.row_number().over(W.partitionBy("lang", "part").orderBy("h"))).filter(F.col("k") <= TRAIN)
    ranked = least.withColumn("k", F.row_number().over(W.partitionBy("lang").orderBy("h"))).filter(F.col("k") <= TRAIN)
    few = materialise(ranked.select("lang", "h"))
    got = hashed.join(few, ["lang", "h"]).groupBy("lang", "h").agg(F.min("cut").alias("cut")).collect()
    return train([(r["cut"], r["lang"]) for r in sorted(got, key=lambda r: (r["lang"], r["cut"]))])


def label(df: DataFrame, keep: list[str], model: Model, text: str = "text") -> DataFrame:
    """keep, lang_pred string and score double of each whole text."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # some ten thousand numbers
    return map_batches(df, keep, [F.col(text)], "lang_pred string, score double", lambda texts: list(zip(*shared.value.label(texts.to_pylist()))), rows=128)
