"""Text, number and date views of properties, and the filters of the three dialects."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from strandline.contract import NONE, Filter, InvalidQuery, check_filters
from strandline.functions import dates

# Properties that have a column of their own, and the column.
PROMOTED = {
    "$session_id": "session_id",
    "$current_url": "current_url",
    "$pathname": "pathname",
    "$host": "host",
    "$referrer": "referrer",
    "$referring_domain": "referring_domain",
    "$browser": "browser",
    "$os": "os",
    "$device_type": "device_type",
    "$geoip_country_code": "country",
    "utm_source": "utm_source",
    "utm_medium": "utm_medium",
    "utm_campaign": "utm_campaign",
    "$lib": "lib",
}
NUMBER = r"^-?[0-9]+(\.[0-9]+)?([eE][-+]?[0-9]+)?$"
DATE = r"^\d{4}-\d{1,2}-\d{1,2}([T ]\d{1,2}:\d{2}(:\d{2}(\.\d{1,6})?)?\s?(Z|[+-]\d{2}(:?\d{2})?)?)?$"


def json_text(document: Column, key: str) -> Column:
    """The top-level member `key` as text: strings as they are, numbers, booleans and containers in
    JSON form, null if missing. The key is taken verbatim, whatever characters it has."""
    return F.from_json(document, "map<string,string>")[key]


def text(key: str, scope: str = "event") -> Column:
    """A property's text, of the event or (column person_properties) of its person."""
    if scope == "person":
        return json_text(F.col("person_properties"), key)
    return F.col(PROMOTED[key]) if key in PROMOTED else json_text(F.col("properties"), key)


def promoted(document: Column, key: str) -> Column:
    """What a property's own column holds: strings, numbers and booleans as text; null for empty
    strings, objects and arrays."""
    value = json_text(document, key)
    raw = F.get_json_object(document, "$['" + key + "']")
    container = raw.rlike(r"^\s*[\[{]") & F.try_parse_json(raw).isNotNull()
    return F.when(~F.coalesce(container, F.lit(False)) & (value != ""), value)


def number(value: Column) -> Column:
    """The number a text is, if it is exactly one in plain decimal notation."""
    return F.when(value.rlike(NUMBER), value.try_cast("double"))


def lenient_number(value: Column) -> Column:
    """The number a text can be cast to, blanks and all."""
    return F.trim(value).try_cast("double")


def moment(value: Column) -> Column:
    """Microseconds of a text that is a full date, with or without time and zone."""
    return F.when(value.rlike(DATE), F.unix_micros(F.try_to_timestamp(value)))


def label(value: Column) -> Column:
    """A breakdown's value: missing and empty texts are one."""
    return F.coalesce(F.nullif(value, F.lit("")), F.lit(NONE))


def _values(f: Filter) -> list[str]:
    values = f.value if isinstance(f.value, list | tuple) else [f.value]
    return [str(v).lower() if isinstance(v, bool) else str(v) for v in values]


def _positive(f: Filter, value: Column) -> tuple[Column, bool]:
    """The condition, and whether the filter asks for its opposite."""
    kind = f.op.removeprefix("not_") if f.op != "is_not" else "exact"
    negated = f.op in ("is_not", "not_icontains", "not_regex", "is_not_set")
    if f.op in ("is_set", "is_not_set"):
        return value.isNotNull(), negated
    values = _values(f)
    if kind == "exact":
        return value.isin(values), negated
    if kind == "icontains":
        return F.contains(F.lower(value), F.lit(values[0].lower())), negated
    if kind == "regex":
        return value.rlike(values[0]), negated
    if kind in ("gt", "gte", "lt", "lte"):
        n, bound = number(value), float(values[0])
        return {"gt": n > bound, "gte": n >= bound, "lt": n < bound, "lte": n <= bound}[kind], False
    at, bound = moment(value), F.lit(dates._absolute(values[0])[0])
    return at < bound if kind == "is_date_before" else at > bound, False


def condition(filters: tuple[Filter, ...] | list[Filter]) -> Column:
    """All filters of an insight query hold. Never null: what is missing fails a filter, and
    passes its opposite."""
    check_filters(tuple(filters))
    out = F.lit(True)
    for f in filters:
        holds, negated = _positive(f, text(f.key, f.scope))
        holds = F.coalesce(holds, F.lit(False))
        out = out & (~holds if negated else holds)
    return out


def explore_condition(filters: list[Filter], now: int) -> Column:
    """The filters of feed and web reports: event properties only; icontains takes several values
    (any of them); numbers are read leniently; dates may be relative."""
    if len(filters) > 20:
        raise InvalidQuery("at most 20 filters")
    out = F.lit(True)
    for f in filters:
        if f.scope != "event":
            raise InvalidQuery("only event properties can be filtered here")
        value, values = text(f.key), _values(f)
        if f.op in ("icontains", "not_icontains"):
            holds = reduce(lambda a, b: a | b, (F.contains(F.lower(value), F.lit(v.lower())) for v in values))
            negated = f.op == "not_icontains"
        elif f.op in ("gt", "gte", "lt", "lte"):
            n, bound, negated = lenient_number(value), float(values[0]), False
            holds = {"gt": n > bound, "gte": n >= bound, "lt": n < bound, "lte": n <= bound}[f.op]
        elif f.op in ("is_date_before", "is_date_after"):
            bound, negated = dates.point(values[0], now)[0], False
            holds = moment(value) < bound if f.op == "is_date_before" else moment(value) > bound
        else:
            holds, negated = _positive(f, value)
        holds = F.coalesce(holds, F.lit(False))
        out = out & (~holds if negated else holds)
    return out
