"""Periods from relative or absolute dates, their buckets and labels. `now` is always given."""

from __future__ import annotations

import re
from datetime import UTC, datetime, timedelta

from strandline.contract import MAX_BUCKETS, InvalidQuery, Period
from strandline.functions.times import DAY, FIRST_MONDAY, HOUR, WEEK

EPOCH = datetime(1970, 1, 1, tzinfo=UTC)
RELATIVE = re.compile(r"-(\d{1,6})([hdwmy])$")
LATEST_STEP = 100_000


def to_us(moment: datetime) -> int:
    return (moment - EPOCH) // timedelta(microseconds=1)


def to_datetime(us: int) -> datetime:
    return EPOCH + timedelta(microseconds=us)


def trunc(us: int, interval: str) -> int:
    """Start of the hour, day, ISO week or month that holds `us`."""
    if interval == "month":
        d = to_datetime(us)
        return to_us(datetime(d.year, d.month, 1, tzinfo=UTC))
    unit, origin = {"hour": (HOUR, 0), "day": (DAY, 0), "week": (WEEK, FIRST_MONDAY)}[interval]
    return us - (us - origin) % unit


def advance(us: int, interval: str, n: int = 1) -> int:
    """`us` moved by n units; a month keeps the day, or the last one the month has."""
    if interval in ("month", "year"):
        d = to_datetime(us)
        month = d.year * 12 + d.month - 1 + n * (12 if interval == "year" else 1)
        for day in range(d.day, 0, -1):
            try:
                return to_us(d.replace(year=month // 12, month=month % 12 + 1, day=day))
            except ValueError:
                continue
    return us + n * {"hour": HOUR, "day": DAY, "week": WEEK}[interval]


def buckets(period: Period) -> list[int]:
    """Bucket starts from the one that holds the period's start."""
    out, at = [], trunc(period.start, period.interval)
    while at < period.end:
        out.append(at)
        if len(out) > MAX_BUCKETS:
            raise InvalidQuery(f"more than {MAX_BUCKETS} buckets")
        at = advance(at, period.interval)
    return out


def previous(period: Period) -> Period:
    """The period of the same length just before."""
    return Period(2 * period.start - period.end, period.start, period.interval)


def label(us: int, interval: str) -> str:
    d = to_datetime(us)
    day = f"{d.day} {d:%b}"
    return {"hour": f"{day} {d:%H:%M}", "day": f"{d:%a} {day}", "week": day, "month": f"{d:%b %Y}"}[interval]


def _absolute(text: str) -> tuple[int, bool]:
    """Microseconds, and whether the text is a bare day."""
    try:
        if re.fullmatch(r"\d{4}-\d\d-\d\d", text):
            return to_us(datetime.strptime(text, "%Y-%m-%d").replace(tzinfo=UTC)), True
        moment = datetime.fromisoformat(text)
        return to_us(moment if moment.tzinfo else moment.replace(tzinfo=UTC)), False
    except ValueError:
        raise InvalidQuery(f"not a date: {text!r}") from None


def point(text: str, now: int) -> tuple[int, str]:
    """The moment a text means, and its kind: relative, calendar, day or exact."""
    if m := RELATIVE.match(text):
        if int(m[1]) > LATEST_STEP:
            raise InvalidQuery("at most 100,000 units back")
        unit = {"h": "hour", "d": "day", "w": "week", "m": "month", "y": "year"}[m[2]]
        return advance(now, unit, -int(m[1])), "relative"
    if text == "dStart":
        return trunc(now, "day"), "calendar"
    if text == "mStart":
        return trunc(now, "month"), "calendar"
    if text == "yStart":
        return to_us(datetime(to_datetime(now).year, 1, 1, tzinfo=UTC)), "calendar"
    at, bare = _absolute(text)
    return at, "day" if bare else "exact"


def resolve(date_from: str | None, date_to: str | None, interval: str, now: int, earliest: int | None = None) -> Period:
    """The period of an insight query.

    Calendar points snap to the hour (hour buckets) or day; the end's unit belongs to the period.
    Exact datetimes hold as written, and the end instant is included. Default: the last 7 days.
    'all' starts at the earliest event, or now if there is none.
    """
    unit = "hour" if interval == "hour" else "day"
    if date_to == "all":
        raise InvalidQuery("a period can't end at 'all'")
    start, kind = (now if earliest is None else earliest, "calendar") if date_from == "all" else point(date_from or "-7d", now)
    if kind != "exact":
        start = trunc(start, unit)
    end, kind = (now, "relative") if date_to is None else point(date_to, now)
    end = end + 1 if kind == "exact" else advance(trunc(end, unit), unit)
    if end <= start:
        raise InvalidQuery("the period is empty")
    return Period(start, end, interval)


def resolve_web(date_from: str | None, date_to: str | None, now: int, earliest: int | None = None) -> Period:
    """The period of a web report: it ends now exactly if no end is given; hours keep their minutes."""
    start, kind = (now if earliest is None else earliest, "exact") if date_from == "all" else point(date_from or "-7d", now)
    if kind == "relative" and not (date_from or "").endswith("h"):
        start = trunc(start, "day")
    end, kind = (now, "exact") if date_to is None else point(date_to, now)
    if kind == "day" or kind == "relative" and not (date_to or "").endswith("h"):
        end = trunc(end, "day") + DAY
    if end <= start:
        raise InvalidQuery("the period is empty")
    interval = "hour" if end - start <= 48 * HOUR else "day"
    for wider in ("week", "month"):
        if (end - start) // {"hour": HOUR, "day": DAY, "week": WEEK}[interval] > 1000:
            interval = wider
    return Period(start, end, interval)
