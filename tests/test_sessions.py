"""Transactions and funnels against plain loops over random events."""

import random
from datetime import datetime, timedelta

import pytest
from rivulet.engine import Engine
from rivulet.plans.profile import LOGS

T0 = datetime(2026, 10, 1)


@pytest.fixture(scope="module")
def events():
    """(key, minute, kind), null keys too; no two events of a key at the same minute."""
    r = random.Random(5)
    return [(k, m, r.choice("abcd")) for k in ("u1", "u2", None, "only") for m in sorted(r.sample(range(600), 1 if k == "only" else 120))]


@pytest.fixture(scope="module")
def engine(spark, events):
    df = spark.createDataFrame([(T0 + timedelta(minutes=m), k, kind) for k, m, kind in events], "timestamp timestamp, user string, kind string")
    return Engine(spark, {"logs": (df.repartition(3), LOGS)}, {}, now=T0 + timedelta(days=1))


def by_key(events):
    out = {}
    for k, m, kind in events:
        out.setdefault(k, []).append((m, kind))
    return out


def transactions(events, pause=None, most=None, starts=None, ends=None, span=None):
    out = []
    for key, rows in by_key(events).items():
        now = []
        for m, kind in rows:
            if now and (pause is not None and m - now[-1] > pause or span is not None and m - now[0] > span or kind == starts):
                out.append((key, now[0], len(now), now[-1]))
                now = []
            if not now and starts and kind != starts:
                continue
            now = [*now, m]
            if kind == ends or len(now) == most:
                out.append((key, now[0], len(now), now[-1]))
                now = []
        if now:
            out.append((key, now[0], len(now), now[-1]))
    return sorted(out, key=str)


@pytest.mark.parametrize(
    "text, options",
    [
        ("maxpause=5m", dict(pause=5)),
        ("maxevents=4", dict(most=4)),
        ("maxpause=7m maxevents=3", dict(pause=7, most=3)),
        ("startswith=(kind=a)", dict(starts="a")),
        ("endswith=(kind=b)", dict(ends="b")),
        ("startswith=(kind=a) endswith=(kind=b)", dict(starts="a", ends="b")),
        ("startswith=(kind=a) endswith=(kind=b) maxevents=3 maxpause=20m", dict(starts="a", ends="b", most=3, pause=20)),
        ("maxspan=30m maxevents=5 endswith=(kind=c)", dict(span=30, most=5, ends="c")),
    ],
)
def test_transactions(engine, events, text, options):
    minute = lambda t: round((t - T0).total_seconds() / 60)
    rows = engine.run(f"* | transaction user {text}", T0, T0 + timedelta(hours=12)).collect()
    got = sorted(((r["user"], minute(r["transaction_start"]), r["eventcount"], minute(r["transaction_end"])) for r in rows), key=str)
    assert got == transactions(events, **options)
    assert all(r["duration"] == (r["transaction_end"] - r["transaction_start"]).total_seconds() for r in rows)


def longest(rows, steps, window):
    """By all choices of events: the longest prefix in order within the window, and the first time it is complete."""
    best = (0, None)
    for i, (start, kind) in enumerate(rows):
        if kind != steps[0]:
            continue
        level, at = 1, start
        for m, kind in rows[i + 1 :]:
            if window is not None and m - start > window:
                break
            if level < len(steps) and kind == steps[level]:
                level, at = level + 1, m
        if level > best[0] or level == best[0] and at < best[1]:
            best = (level, at)
    return best


@pytest.mark.parametrize("window", [None, 4, 15])
def test_funnel(engine, events, window):
    steps = ["a", "b", "c", "a"]
    text = f"* | funnel by user {'' if window is None else f'window={window}m'} " + " ".join(f"[kind={s}]" for s in steps)
    rows = engine.run(text, T0, T0 + timedelta(hours=12)).collect()
    levels = [longest(v, steps, window)[0] for v in by_key(events).values()]
    assert [r["count"] for r in rows] == [sum(x >= i + 1 for x in levels) for i in range(4)]
    assert [r["dropper_count"] for r in rows][:3] == [levels.count(i + 1) for i in range(3)]
    for i, r in enumerate(rows[:3]):
        idle = sorted((v[-1][0] - longest(v, steps, window)[1]) * 60 for v in by_key(events).values() if longest(v, steps, window)[0] == i + 1)
        n = len(idle)
        assert r["dropper_median_idle_s"] == (None if not n else (idle[n // 2] + idle[(n - 1) // 2]) / 2)


def test_funnel_droppers(spark):
    """The latest values of those who stopped, counted over all of them."""
    import json
    from collections import Counter

    r, rows = random.Random(9), []
    for k in range(1500):
        for m in sorted(r.sample(range(600), r.randrange(1, 6))):
            rows.append((T0 + timedelta(minutes=m), f"u{k}", r.choice("abx"), r.choice((None, "", "h1", "h1", "h2", "h3", f"h{k % 40}")), r.choice(("ok", "fail"))))
    df = spark.createDataFrame(rows, "timestamp timestamp, user string, kind string, src_host string, action string")
    got = Engine(spark, {"logs": (df.repartition(5), LOGS)}).run("* | funnel by user window=3h [kind=a] [kind=b] [kind=a]").collect()
    by = {}
    for t, k, kind, host, action in sorted(rows, key=lambda x: x[0]):
        e = by.setdefault(k, {"events": [], "src_host": None, "action": None})
        e["events"].append(((t - T0).total_seconds() / 60, kind))
        e["src_host"], e["action"] = host if host is not None else e["src_host"], action
    level = {k: longest(e["events"], ["a", "b", "a"], 180)[0] for k, e in by.items()}
    for i in (1, 2):
        stopped = [e for k, e in by.items() if level[k] == i]
        want = []
        for f in ("src_host", "action"):
            tally = Counter(e[f] for e in stopped if e[f])
            want += [{"field": f, "value": v, "count": n, "pct": round(100 * n / len(stopped) + 1e-9, 1)} for v, n in sorted(tally.items(), key=lambda x: (-x[1], x[0]))[:5]]
        assert json.loads(got[i - 1]["dropper_top_attrs"]) == want and want
    assert got[2]["dropper_top_attrs"] == "[]"
