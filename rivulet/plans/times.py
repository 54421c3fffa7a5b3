"""Time modifiers, spans and bucket alignment. All in UTC."""

from __future__ import annotations

import re
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

from rivulet.plans.errors import QueryError

#: Fixed lengths in seconds: a month is 30 days and a year 365.
UNITS = {"us": 1e-6, "ms": 1e-3, "s": 1, "m": 60, "h": 3600, "d": 86400, "w": 604800, "M": 2592000, "y": 31536000}
NAMES = {"sec": "s", "secs": "s", "second": "s", "seconds": "s", "min": "m", "mins": "m", "minute": "m", "minutes": "m", "hr": "h", "hrs": "h", "hour": "h", "hours": "h", "day": "d", "days": "d", "week": "w", "weeks": "w", "mon": "M", "month": "M", "months": "M", "year": "y", "years": "y"}
#: Spans that bins=N may choose from, in seconds; beyond them whole days.
LADDER = (1, 2, 5, 10, 15, 30, 60, 120, 300, 600, 900, 1800, 3600, 7200, 10800, 21600, 43200, 86400, 172800, 604800, 1209600, 2592000)
DAY, WEEK, MONTH = 86400, 604800, 2592000


def seconds(text: str) -> float:
    """5m, 1h, 30s, 1mon."""
    m = re.fullmatch(r"(\d+(?:\.\d+)?)\s*([A-Za-z]+)", str(text).strip())
    unit = NAMES.get(m[2], m[2]) if m else None
    if unit not in UNITS:
        raise QueryError(f"not a span of time: {text}")
    return float(m[1]) * UNITS[unit]


def resolve(text: str, now: datetime) -> datetime:
    """now, -7d, -7d@d, @w1, an ISO date or epoch seconds."""
    text = text.strip()
    m = re.fullmatch(r"(now)?((?:[+-]\d+[A-Za-z]+)*)(?:@([A-Za-z]+)([0-7])?)?", text)
    if m and text:
        out = now
        for sign, n, unit in re.findall(r"([+-])(\d+)([A-Za-z]+)", m[2]):
            step = timedelta(seconds=seconds(n + unit))
            out = out + step if sign == "+" else out - step
        return snap(out, m[3], m[4]) if m[3] else out
    if re.fullmatch(r"\d{9,}(\.\d+)?", text):
        return datetime.fromtimestamp(float(text), timezone.utc).replace(tzinfo=None)
    try:
        t = datetime.fromisoformat(text.replace("Z", "+00:00"))
    except ValueError:
        raise QueryError(f"not a time: {text}") from None
    return t.astimezone(timezone.utc).replace(tzinfo=None) if t.tzinfo else t


def snap(t: datetime, unit: str, day: str | None = None) -> datetime:
    unit = NAMES.get(unit, unit)
    if unit == "w":
        start = snap(t, "d") - timedelta(days=(t.weekday() + 1 - int(day or 0)) % 7)
        return start
    if day:
        raise QueryError(f"not a snap: @{unit}{day}")
    parts = {"s": 0, "m": 1, "h": 2, "d": 3, "M": 4, "y": 5}
    if unit not in parts:
        raise QueryError(f"not a snap: @{unit}")
    k = parts[unit]
    return t.replace(microsecond=0, second=0 if k >= 1 else t.second, minute=0 if k >= 2 else t.minute, hour=0 if k >= 3 else t.hour, day=1 if k >= 4 else t.day, month=1 if k >= 5 else t.month)


def bucket(t: Column, span: float) -> Column:
    """Start of t's bucket: from the epoch below a day, days, weeks from Sunday, months from 30 days on."""
    if span >= MONTH and span % MONTH == 0 or span % UNITS["y"] == 0:
        months = round(span / MONTH) if span % UNITS["y"] else round(span / UNITS["y"]) * 12
        index = F.floor((F.year(t) * 12 + F.month(t) - 1) / months) * months
        return F.make_timestamp(F.floor(index / 12).cast("int"), (index % 12 + 1).cast("int"), F.lit(1), F.lit(0), F.lit(0), F.lit(0))
    if span == WEEK:
        return F.date_trunc("week", t + F.expr("INTERVAL 1 DAY")) - F.expr("INTERVAL 1 DAY")
    if span == DAY:
        return F.date_trunc("day", t)
    micros = int(round(span * 1e6))
    return F.timestamp_micros((F.floor(F.unix_micros(t) / micros) * micros).cast("long"))


def ladder_span(first: datetime, last: datetime, bins: int) -> float:
    """The smallest round span that cuts the time between into at most bins aligned buckets."""
    if bins < 1:
        raise QueryError("bins must be at least 1")
    zero = datetime(1970, 1, 1)
    a = (first - zero).total_seconds()
    b = max((last - zero).total_seconds(), a)
    least = max(1, -int(-(b - a) // bins))
    whole_days = -(-least // DAY) * DAY
    for span in (*[s for s in LADDER if s >= least], whole_days):
        shift = 4 * DAY if span == WEEK else 0  # weeks begin on Sunday, the epoch on a Thursday
        if (b + shift) // span - (a + shift) // span + 1 <= bins:
            return float(span)
    return float(whole_days)


def bucket_starts(first: datetime, last: datetime, span: float) -> list[datetime]:
    """Starts of all buckets from that of first to that of last (sub-month spans)."""
    zero = datetime(1970, 1, 1)
    offset = -4 * DAY if span == WEEK else 0  # the first Sunday before the epoch
    a = ((first - zero).total_seconds() - offset) // span * span + offset
    out = []
    while a <= (last - zero).total_seconds():
        out.append(zero + timedelta(seconds=a))
        a += span
    return out
