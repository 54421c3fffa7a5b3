"""Repairs against all edits of short conversations, by strings, and however rows are dealt over tasks."""

import hashlib
import random
import re
import zlib
from functools import cache

import pytest

from rivulet.llm import turns
from rivulet.llm.queries import QUERIES

PATTERN = re.compile(r"(s?(ua)+)?")


def faults(rows):
    """rows of (turn, role, text) in order, to their faults."""
    seen, out = set(), []
    for _, role, text in rows:
        kept = re.findall(r"[^\x20\x09-\x0D]", text)
        out.append("blank" if not kept else "duplicate" if (role, text) in seen else "truncated" if kept[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def plain(rows):
    """The cheapest edits with the least audit, by strings: all results of all edits of what is left, kept once each."""
    found = faults(rows)

    @cache
    def best(i, state, k):
        """cost, audit and turns from row i on, when the roles so far end in state ("", s, u, a), behind k insertions."""
        options = [(0, "", ())] if i == len(rows) and state in ("", "a") else []
        to = "a" if state == "u" else "u"
        name = {"u": "user", "a": "assistant"}[to]
        if k < 3 and (x := best(i, to, k + 1)):
            options.append((2 + x[0], "I" + x[1], (f"{name}:", *x[2])))
        if i < len(rows):
            _, role, text = rows[i]
            cut = found[i] == "truncated"
            if x := best(i + 1, state, 0):
                options.append((3 + x[0], "D" + x[1], x[2]))
            if found[i] not in ("blank", "duplicate"):
                if x := best(i + 1, to, 0):
                    options.append((2 + cut + x[0], "R" + x[1], (f"{name}:{text}", *x[2])))
                if (role[:1] == "s" and state == "") or role[:1] == to:
                    if x := best(i + 1, role[:1], 0):
                        options.append((cut + x[0], "K" + x[1], (f"{role}:{text}", *x[2])))
        return min(options, default=None)

    cost, audit, out = best(0, "", 0)
    known = [t for t, *_ in rows if t is not None]
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
    return (
        max(known) - min(known) + 1 - len(set(known)) if known else 0,
        found.count("blank"), found.count("duplicate"), found.count("truncated"), sum(p not in ("su", "ua", "au") for p in pairs),
        cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest(),
    )


def some_rows(rng, n):
    texts = ["a.", "b!", "c", "", " \t", "d?", "e. \n", "f \x1f"]
    return [(rng.choice([None, *range(9)]), rng.choice(["user", "assistant", "system", "user", "assistant", "tool", "", " "]), rng.choice(texts) or rng.choice(texts)) for _ in range(n)]


def by_turn(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))


def as_turns(rows):
    """Rows in order as turns, with equal neighbours as one."""
    seen, out = set(), []
    for t, role, text in rows:
        if out and out[-1][:3] == (t, role, text):
            out[-1] = (*out[-1][:3], out[-1][3] + 1, out[-1][4])
        else:
            out.append((t, role, text, 1, (role, text) not in seen))
        seen.add((role, text))
    return out


def flat(done):
    return (*(done[k] for k in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")), hashlib.sha256("\n".join(done["repaired"]).encode()).hexdigest())


def test_all_short_conversations():
    rng = random.Random(1)
    for n in range(9):
        for _ in range(150):
            rows = by_turn(some_rows(rng, n))
            done = turns.repair(as_turns(rows))
            assert flat(done) == plain(rows), rows
            assert PATTERN.fullmatch("".join(x[0] for x in done["repaired"]))


def test_edits_by_trying_all():
    """Every sequence of edits of up to three turns, with up to two insertions at each place."""
    import itertools

    rng = random.Random(4)
    for _ in range(60):
        rows = by_turn(some_rows(rng, rng.randrange(4)))
        found, tried = faults(rows), []
        for edits in itertools.product("DKR", repeat=len(rows)):
            if any(e != "D" and f in ("blank", "duplicate") for e, f in zip(edits, found)):
                continue
            for inserts in itertools.product(range(3), repeat=len(rows) + 1):
                audit = "".join("I" * k + e for k, e in zip(inserts, [*edits, ""]))
                shape, i = [], 0
                for x in audit:
                    if x in "DKR":
                        shape += [(x, rows[i][1][:1])] if x != "D" else []
                        i += 1
                    else:
                        shape.append((x, None))
                options = ["".join(r) for r in itertools.product(*[[role] if x == "K" else ["u", "a"] for x, role in shape])]
                if any(PATTERN.fullmatch(r) for r in options) and ("K", "") not in shape:
                    cost = 2 * sum(inserts) + sum({"D": 3, "K": 0, "R": 2}[e] + (f == "truncated" and e != "D") for e, f in zip(edits, found))
                    tried.append((cost, audit))
        done = turns.repair(as_turns(rows))
        assert (done["cost"], done["audit"]) == min(tried), rows


def test_stretches_compose():
    rng = random.Random(2)
    for _ in range(200):
        rows = as_turns(by_turn(some_rows(rng, 12)))
        cuts = sorted(rng.randrange(len(rows) + 1) for _ in range(3))
        parts = [rows[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)])]
        layers = []
        for p in parts:
            s = turns.Stretch()
            for t in p:
                s.add(*t)
            layers.append(turns.matrix_of(s.state()["matrix"]))
        whole = turns.compose(turns.compose(layers[0], layers[1]), turns.compose(layers[2], layers[3]))
        cost, state, ending = turns.finish(whole[turns.START])
        want = turns.repair(rows)
        assert cost == want["cost"]
        states, layer = [], turns.begin(turns.START)
        for m in layers:
            layer, origin = turns.chain(layer, m)
            states.append(origin)
        audit = ending
        for p, origin in zip(reversed(parts), reversed(states)):
            audit, state = turns.edited(p, origin[state], state)[0] + audit, origin[state]
        assert audit == want["audit"]


def damage(rows):
    """rows of (conv_id, turn, role, text), damaged as the contract says, by conversation."""
    out = {}
    for c, t, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(":".join(" " if x is None else str(x) for x in (c, t)).encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        out.setdefault(c, []).extend([(t, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1))
    return {c: by_turn(r) for c, r in out.items()}


def result(df):
    return {(r.conv_id, r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in df.collect()}


@pytest.mark.parametrize("parts", [1, 7, 200])
def test_query(spark, parts):
    """All conversations, whole in tasks or cut by them."""
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        assert result(QUERIES["op13_turns"](spark, sf)) == {(c, *plain(r)) for c, r in damage(rows).items()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize("chunk", [60, 1 << 20])
def test_hot_conversation(spark, monkeypatch, chunk):
    """One conversation of most rows lies over all tasks; turns are distinct, as ties have no order of their own."""
    monkeypatch.setattr(turns, "CHUNK", chunk)
    rng = random.Random(6)
    rows = [(7, t, *r[1:]) for t, r in enumerate(some_rows(rng, 600))] + [(None, t, *r[1:]) for t, r in enumerate(some_rows(rng, 40))]
    rows += [(c, t, *r[1:]) for c in range(10, 60) for t, r in enumerate(some_rows(rng, 4))]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = turns.repairs(turns.damaged(df))
    assert result(got) == {(c, *plain_deep(r)) for c, r in damage(rows).items()}


def plain_deep(rows):
    import sys

    sys.setrecursionlimit(20_000)
    return plain(rows)


def test_odd_rows(spark):
    """Nulls in all columns, a conversation that loses all its rows, equal rows in hundreds, columns of other names."""
    lost = next((c, t) for c in range(1000) for t in range(9) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0)
    whole = next(c for c in range(2000, 3000) if zlib.crc32(f"{c}:1".encode()) % 20 > 4)
    rows = [(*lost, "user", "gone."), (None, None, None, None), (-5, None, "user", None), (-5, None, None, "x")] + [(whole, 1, "user", "hi.")] * 400
    df = spark.createDataFrame([(*r, 0, "z") for r in rows], "conv_id long, turn long, role string, text string, kind int, d1 string")
    got = turns.repairs(turns.damaged(df))
    want = damage(rows)
    ours = {r[0]: r for r in result(got)}
    assert ours[lost[0]][1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert ours[whole][1:] == plain_deep(want[whole])
    assert ours[None][1:] == plain(want[None])
    assert len(ours) == 4
    assert result(turns.repairs(turns.damaged(df.limit(0)))) == set()
