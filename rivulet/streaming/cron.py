"""Schedules of rules: cron expressions, and a rule's own offset on their grid. All in UTC."""

from __future__ import annotations

import zlib
from datetime import datetime, timedelta

from rivulet.plans.errors import QueryError

#: Fields and their bounds; a schedule of five fields has no seconds and runs at second 0. 0 and 7 are Sunday.
FIELDS = (("second", 0, 59), ("minute", 0, 59), ("hour", 0, 23), ("day", 1, 31), ("month", 1, 12), ("weekday", 0, 7))
MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()
DAYS = "sun mon tue wed thu fri sat".split()
#: A rule's offset is below half its period and this many seconds.
PHASE_CAP = 300
#: No schedule's next time is farther than a leap day's.
FARTHEST = timedelta(days=366 * 8 + 3)


def _field(text: str, low: int, high: int, names: list[str], base: int) -> frozenset[int]:
    def number(x: str) -> int:
        x = x.lower()
        n = names.index(x[:3]) + base if x[:3] in names else int(x) if x.isdigit() else -1
        if not low <= n <= high:
            raise QueryError(f"not in a schedule's bounds of {low} to {high}: {x}")
        return n

    out: set[int] = set()
    for part in text.split(","):
        span, _, step = part.partition("/")
        if step and not (step.isdigit() and int(step)):
            raise QueryError(f"not a step: {part}")
        first, dash, last = span.partition("-")
        if span in ("*", "?"):
            a, b = low, high
        else:
            a = number(first)
            b = number(last) if dash else high if step else a
        if a > b:
            raise QueryError(f"a range that runs backwards: {part}")
        out.update(range(a, b + 1, int(step or 1)))
    return frozenset(out)


def fields(cron: str) -> list[frozenset[int]]:
    """The sets of seconds, minutes, hours, days, months and weekdays of five or six fields."""
    parts = cron.split()
    if len(parts) == 5:
        parts = ["0", *parts]
    if len(parts) != 6:
        raise QueryError(f"a schedule has five or six fields: {cron!r}")
    out = [_field(p, lo, hi, {"month": MONTHS, "weekday": DAYS}.get(name, []), int(name == "month")) for p, (name, lo, hi) in zip(parts, FIELDS)]
    out[5] = frozenset(d % 7 for d in out[5])
    return out


def following(cron: str, after: datetime) -> datetime:
    """The first time of a schedule behind after. Day and weekday must both fit."""
    second, minute, hour, day, month, weekday = fields(cron)
    t = after.replace(microsecond=0) + timedelta(seconds=1)
    while t - after < FARTHEST:
        if t.month not in month:
            t = (t.replace(day=1, hour=0, minute=0, second=0) + timedelta(days=32)).replace(day=1)
        elif t.day not in day or (t.weekday() + 1) % 7 not in weekday:
            t = t.replace(hour=0, minute=0, second=0) + timedelta(days=1)
        elif t.hour not in hour:
            t = t.replace(minute=0, second=0) + timedelta(hours=1)
        elif t.minute not in minute:
            t = t.replace(second=0) + timedelta(minutes=1)
        elif t.second not in second:
            t += timedelta(seconds=1)
        else:
            return t
    raise QueryError(f"a schedule that never comes: {cron!r}")


def period(cron: str, after: datetime) -> timedelta:
    """The smallest gap among the next eight times."""
    ticks = [following(cron, after)]
    while len(ticks) < 8:
        ticks.append(following(cron, ticks[-1]))
    return min(b - a for a, b in zip(ticks, ticks[1:]))


def offset(cron: str, after: datetime, name: str, cap: float = PHASE_CAP) -> timedelta:
    """A rule's own part of its period, always the same for a name, so that rules of one schedule don't run at once."""
    most = int(min(period(cron, after) / 2, timedelta(seconds=cap)) / timedelta(milliseconds=1))
    return timedelta(milliseconds=zlib.crc32(name.encode()) % most) if most > 0 else timedelta(0)


def next_run(cron: str, after: datetime, name: str, cap: float = PHASE_CAP) -> datetime:
    """The first time behind after on the schedule's grid, moved by the rule's offset."""
    by = offset(cron, after, name, cap)
    return following(cron, after - by) + by
