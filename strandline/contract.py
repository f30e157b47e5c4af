"""What a query may ask for, and the checks made before anything is read."""

from __future__ import annotations

from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark import SparkContext
from pyspark.errors import PySparkException

# Names and limits of the query contract.
MATHS = ("total", "dau", "weekly_active", "monthly_active", "unique_session", "sum", "avg", "min", "max", "median", "p90", "p95", "p99")
PROPERTY_MATHS = MATHS[5:]
OPERATORS = ("exact", "is_not", "icontains", "not_icontains", "regex", "not_regex", "gt", "gte", "lt", "lte", "is_set", "is_not_set", "is_date_before", "is_date_after")
INTERVALS = ("hour", "day", "week", "month")
OTHER, NONE = "$$_other", "$$_none"
MAX_SERIES, MAX_STEPS, MAX_EXCLUSIONS, MAX_FILTERS, MAX_BREAKDOWN = 20, 20, 10, 50, 300
MAX_FORMULA, MAX_RETENTION, MAX_PATH_STEPS, MAX_EDGES, MAX_SQL = 1000, 100, 20, 1000, 20_000
MAX_BUCKETS, MAX_KEY_BYTES, MAX_VALUE_BYTES, MAX_VALUES, MAX_WINDOW_S = 10_000, 400, 2_000, 100, 10 * 366 * 86_400


class InvalidQuery(ValueError):
    """The query itself is wrong; nothing was read."""


@dataclass(frozen=True)
class Filter:
    """One condition on a property of the event, or of the person."""

    key: str
    op: str = "exact"
    value: object = None
    scope: str = "event"


@dataclass(frozen=True)
class Series:
    """Events of one name (None: all), narrowed by filters, and what to compute of them."""

    event: str | None = None
    math: str = "total"
    prop: str | None = None
    filters: tuple[Filter, ...] = ()
    name: str | None = None


@dataclass(frozen=True)
class Breakdown:
    key: str
    scope: str = "event"
    limit: int = 25


@dataclass(frozen=True)
class Period:
    """[start, end) in microseconds, in buckets of `interval`."""

    start: int
    end: int
    interval: str = "day"


@dataclass(frozen=True)
class Exclusion:
    event: str
    from_step: int
    to_step: int


@dataclass(frozen=True)
class Funnel:
    steps: tuple[Series, ...]
    window_us: int = 14 * 86_400_000_000
    order: str = "ordered"
    exclusions: tuple[Exclusion, ...] = ()
    filters: tuple[Filter, ...] = ()
    breakdown: Breakdown | None = None


@dataclass(frozen=True)
class Paths:
    """kinds: 'pageview' (the path viewed), 'custom' (event names not starting with $)."""

    kinds: tuple[str, ...] = ("pageview",)
    start: str | None = None
    end: str | None = None
    steps: int = 5
    edges: int = 50
    filters: tuple[Filter, ...] = field(default=())


def _demand(ok: bool, message: str) -> None:
    if not ok:
        raise InvalidQuery(message)


def check_pattern(text: str) -> None:
    """A regular expression is compiled as it will be run: by Java, on the driver. Without a session
    there is nothing to run it."""
    context = SparkContext._active_spark_context
    if context is None:
        return
    try:
        context._jvm.java.util.regex.Pattern.compile(text)
    except (Py4JJavaError, PySparkException) as e:
        raise InvalidQuery(f"invalid pattern: {e}".split("\n", 1)[0]) from None


def check_filters(filters: tuple[Filter, ...]) -> None:
    _demand(len(filters) <= MAX_FILTERS, f"at most {MAX_FILTERS} filters")
    for f in filters:
        _demand(f.op in OPERATORS, f"unknown operator {f.op!r}")
        _demand(f.scope in ("event", "person"), f"unknown scope {f.scope!r}")
        _demand(0 < len(f.key.encode()) <= MAX_KEY_BYTES, "a property key must have 1 to 400 bytes")
        values = f.value if isinstance(f.value, list | tuple) else [f.value]
        if f.op in ("is_set", "is_not_set"):
            continue
        _demand(1 <= len(values) <= MAX_VALUES, "1 to 100 values")
        _demand(f.op in ("exact", "is_not") or len(values) == 1, f"{f.op} takes one value")
        _demand(all(v is not None and len(str(v).encode()) <= MAX_VALUE_BYTES for v in values), "a value must be set and have at most 2,000 bytes")
        if f.op in ("gt", "gte", "lt", "lte"):
            try:
                float(values[0])
            except (TypeError, ValueError):
                raise InvalidQuery(f"{f.op} needs a number") from None
        if f.op in ("regex", "not_regex"):
            check_pattern(str(values[0]))


def check_series(series: list[Series]) -> None:
    _demand(1 <= len(series) <= MAX_SERIES, "1 to 20 series")
    for s in series:
        _demand(s.math in MATHS, f"unknown math {s.math!r}")
        _demand((s.prop is not None) == (s.math in PROPERTY_MATHS), f"{s.math} {'needs' if s.math in PROPERTY_MATHS else 'takes no'} property")
        check_filters(s.filters)


def check_breakdown(b: Breakdown | None) -> None:
    _demand(b is None or 1 <= b.limit <= MAX_BREAKDOWN, "a breakdown shows 1 to 300 values")


def check_funnel(f: Funnel) -> None:
    _demand(2 <= len(f.steps) <= MAX_STEPS, "2 to 20 steps")
    _demand(f.order in ("ordered", "strict", "unordered"), f"unknown order {f.order!r}")
    _demand(0 < f.window_us <= MAX_WINDOW_S * 1_000_000, "the window must be positive and at most 10 years")
    _demand(len(f.exclusions) <= MAX_EXCLUSIONS, "at most 10 exclusions")
    _demand(not (f.exclusions and f.order == "unordered"), "steps in any order take no exclusions")
    for x in f.exclusions:
        _demand(0 <= x.from_step < x.to_step < len(f.steps), "an exclusion lies between two steps")
    check_filters(f.filters)
    for s in f.steps:
        check_filters(s.filters)
    check_breakdown(f.breakdown)


def check_paths(p: Paths) -> None:
    _demand(bool(p.kinds) and set(p.kinds) <= {"pageview", "custom"}, "kinds are pageview and custom")
    _demand(2 <= p.steps <= MAX_PATH_STEPS, "2 to 20 steps")
    _demand(1 <= p.edges <= MAX_EDGES, "1 to 1,000 links")
    check_filters(p.filters)
