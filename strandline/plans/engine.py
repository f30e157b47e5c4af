"""One query from request to answer: checks, dates, cache, deadline, nested result."""

from __future__ import annotations

import hashlib
import threading
import time
import uuid
from collections import OrderedDict
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from strandline.contract import Breakdown, Exclusion, Filter, Funnel, InvalidQuery, Paths, Period, Series
from strandline.functions import dates
from strandline.operators import funnels, paths, retention, sql_tab, trends
from strandline.operators.relation import Source, earliest_event
from strandline.session import stored

TTL_S = 30.0


class Timeout(RuntimeError):
    """The query ran into its deadline and was stopped."""


@dataclass
class Cache:
    """Results by what they depend on, the least recently used one dropped first. Results that
    read person properties, which change without a new file, hold for 30 seconds."""

    size: int = 500
    entries: OrderedDict = field(default_factory=OrderedDict)

    def get(self, key: str, now: float) -> object | None:
        if key not in self.entries:
            return None
        value, until = self.entries[key]
        if until is not None and now >= until:
            del self.entries[key]
            return None
        self.entries.move_to_end(key)
        return value

    def put(self, key: str, value: object, volatile: bool, now: float) -> None:
        self.entries[key] = (value, now + TTL_S if volatile else None)
        self.entries.move_to_end(key)
        while len(self.entries) > self.size:
            self.entries.popitem(last=False)


def filters(raw: list[dict]) -> tuple[Filter, ...]:
    return tuple(Filter(f["key"], f.get("operator", "exact"), f.get("value"), f.get("type", "event")) for f in raw or [])


def series(raw: dict) -> Series:
    return Series(raw.get("event"), raw.get("math", "total"), raw.get("math_property"), filters(raw.get("properties")), raw.get("name"))


def breakdown(raw: dict | None) -> Breakdown | None:
    return None if raw is None else Breakdown(raw["property"], raw.get("type", "event"), raw.get("limit", 25))


def period(raw: dict, source: Source, now: int) -> Period:
    span = raw.get("date_range") or {}
    earliest = earliest_event(source.events) if span.get("date_from") == "all" else None
    return dates.resolve(span.get("date_from"), span.get("date_to"), raw.get("interval", "day"), now, earliest)


def _lines(found: DataFrame, at: Period, names: list[str]) -> list[dict]:
    """Trend rows as one entry per series and breakdown value, days in order."""
    out: dict[tuple, dict] = {}
    for r in found.orderBy("period", "series", "breakdown", "bucket").collect():
        entry = out.setdefault((r["period"], r["series"], r["breakdown"]), {"label": names[r["series"]], "compare_label": r["period"], "breakdown": r["breakdown"], "days": [], "labels": [], "data": [], "aggregated_value": 0.0})
        if r["bucket"] is None:
            entry["aggregated_value"] = r["value"]
        else:
            entry["days"].append(dates.to_datetime(r["bucket"]).isoformat())
            entry["labels"].append(dates.label(r["bucket"], at.interval))
            entry["data"].append(r["value"])
    return list(out.values())


def _funnel(raw: dict) -> Funnel:
    exclusions = tuple(Exclusion(x["event"], x["from_step"], x["to_step"]) for x in raw.get("exclusions", []))
    return Funnel(tuple(series(s) for s in raw["steps"]), int(raw.get("window_s", 14 * 86_400)) * 1_000_000, raw.get("order", "ordered"), exclusions, filters(raw.get("properties")), breakdown(raw.get("breakdown")))


def _paths(raw: dict) -> Paths:
    return Paths(tuple(raw.get("path_types", ["pageview"])), raw.get("start_point"), raw.get("end_point"), raw.get("step_limit", 5), raw.get("edge_limit", 50), filters(raw.get("properties")))


def compute(raw: dict, source: Source, now: int) -> object:
    """The result of a request of any kind, as nested values."""
    kind = raw.get("kind")
    if kind == "SqlQuery":
        return sql_tab.fetch(sql_tab.query(source, raw["query"], now))
    if kind == "RetentionQuery":
        found = retention.retention(source, series(raw["target"]), series(raw["returning"]), now, raw.get("period", "day"), raw.get("total_intervals", 8), raw.get("retention_type") == "first_time")
        rows: dict[int, list[int]] = {}
        for r in found.orderBy("cohort_start", "offset").collect():
            rows.setdefault(r["cohort_start"], []).append(r["persons"])
        return [{"date": dates.to_datetime(s).isoformat(), "size": v[0], "values": v} for s, v in rows.items()]
    at = period(raw, source, now)
    if kind == "TrendsQuery":
        asked = [series(s) for s in raw["series"]]
        names = [raw["formula"]] if raw.get("formula") else [s.name or s.event or "All events" for s in asked]
        found = trends.trends(source, asked, at, filters(raw.get("properties")), breakdown(raw.get("breakdown")), raw.get("formula"), raw.get("compare", False))
        return _lines(found, at, names)
    if kind == "FunnelsQuery":
        asked = _funnel(raw)
        with stored(funnels.outcomes(source, asked, at)) as found:
            out = {"steps": [r.asDict() for r in funnels.steps(found, len(asked.steps)).orderBy("step").collect()], "time_to_convert": [r.asDict() for r in funnels.time_to_convert(found, len(asked.steps)).orderBy("from_s").collect()]}
            if asked.breakdown:
                shown = funnels.with_shown(found, asked.breakdown.limit)
                out["breakdowns"] = [r.asDict() for r in funnels.steps(shown, len(asked.steps), True).orderBy("breakdown", "step").collect()]
            return out
    if kind == "LifecycleQuery":
        return [r.asDict() for r in retention.lifecycle(source, series(raw["series"]), at).orderBy("bucket", "status").collect()]
    if kind == "StickinessQuery":
        rows = retention.stickiness(source, [series(s) for s in raw["series"]], at).orderBy("series", "n_buckets").collect()
        return [{"label": f"{r['n_buckets']} {at.interval}{'s' if r['n_buckets'] > 1 else ''}"} | r.asDict() for r in rows]
    if kind == "PathsQuery":
        return [r.asDict() for r in paths.links(source, _paths(raw), at).collect()]
    raise InvalidQuery(f"unknown kind {kind!r}")


def actors(raw: dict, selection: dict, source: Source, now: int, limit: int = 100, offset: int = 0) -> list[str]:
    """The persons behind one number of a request's result, sorted by id, a page at a time."""
    if not 1 <= limit <= 1000 or not 0 <= offset <= 1_000_000:
        raise InvalidQuery("1 to 1,000 persons from place 0 to 1,000,000")
    kinds = {"TrendsPoint": "TrendsQuery", "FunnelStep": "FunnelsQuery", "RetentionCell": "RetentionQuery", "LifecycleCell": "LifecycleQuery", "StickinessBar": "StickinessQuery", "PathsLink": "PathsQuery"}
    what = selection.get("kind")
    if what not in kinds or kinds[what] != raw.get("kind"):
        raise InvalidQuery("the selection doesn't fit the query")
    if what == "RetentionCell":
        cells = retention.members(source, series(raw["target"]), series(raw["returning"]), now, raw.get("period", "day"), raw.get("total_intervals", 8), raw.get("retention_type") == "first_time")
        found = cells.where((cells["cohort"] == selection["cohort"]) & (cells["offset"] == selection["offset"]))
    else:
        at = period(raw, source, now)
        if what == "TrendsPoint":
            found = trends.actors(source, series(raw["series"][selection.get("series", 0)]), at, selection.get("bucket"), filters(raw.get("properties")), breakdown(raw.get("breakdown")), selection.get("breakdown"))
        elif what == "FunnelStep":
            found = funnels.actors(funnels.outcomes(source, _funnel(raw), at), selection["step"], selection.get("dropped", False))
        elif what == "LifecycleCell":
            cells = retention.lifecycle_cells(source, series(raw["series"]), at)
            found = cells.where((cells["bucket"] == selection["bucket"]) & (cells["status"] == selection["status"]))
        elif what == "StickinessBar":
            counted = retention.active_buckets(source, series(raw["series"][selection.get("series", 0)]), at)
            found = counted.where(counted["n"] == selection["n_buckets"])
        else:
            found = paths.actors(source, _paths(raw), at, selection["source"], selection["target"])
    return [r[0] for r in found.select("person_id").distinct().orderBy("person_id").offset(offset).limit(limit).collect()]


def reads_persons(raw: object) -> bool:
    """Whether any filter or breakdown of the request looks at person properties."""
    if isinstance(raw, dict):
        return raw.get("type") == "person" or any(map(reads_persons, raw.values()))
    return isinstance(raw, list) and any(map(reads_persons, raw))


def moment(raw: dict, now: int) -> tuple:
    """What of `now` a request's result depends on: the ends of its period, or the moment itself
    where a statement asks for it. A period since the first event is fixed by the files."""
    kind = raw.get("kind")
    if kind == "SqlQuery":
        return (now,) if sql_tab.uses_now(raw.get("query", "")) else ()
    if kind == "RetentionQuery":
        return (dates.trunc(now, raw.get("period", "day")),)
    span = raw.get("date_range") or {}
    at = dates.resolve(span.get("date_from"), span.get("date_to"), raw.get("interval", "day"), now, 0 if span.get("date_from") == "all" else None)
    return at.start, at.end


def run(raw: dict, source: Source, now: int, project: str = "", data_version: str = "", identity_version: str = "", cache: Cache | None = None, deadline_s: float = 30.0) -> dict:
    """The result with its metadata. Jobs that outlast the deadline are cancelled; a result is
    taken from the cache while files, identities and what it depends on of `now` are the same."""
    began = time.monotonic()
    at = moment(raw, now)
    key = hashlib.sha256(repr((project, sorted(raw.items(), key=str), data_version, identity_version, at)).encode()).hexdigest()
    result, cached = (cache.get(key, began) if cache else None), True
    if result is None:
        cached = False
        context, group = source.events.sparkSession.sparkContext, uuid.uuid4().hex
        late = threading.Event()
        timer = threading.Timer(deadline_s, lambda: (late.set(), context.cancelJobGroup(group)))
        context.setJobGroup(group, str(raw.get("kind")), True)
        timer.start()
        try:
            result = compute(raw, source, now)
        except Exception as e:
            if late.is_set():
                raise Timeout(f"stopped after {deadline_s:g} s") from e
            raise
        finally:
            timer.cancel()
            context.setLocalProperty("spark.jobGroup.id", None)
        if cache:
            cache.put(key, result, reads_persons(raw), began)
    meta = {"kind": raw.get("kind"), "elapsed_ms": round(1000 * (time.monotonic() - began)), "cached": cached, "data_version": data_version, "timezone": "UTC"}
    if len(at) == 2:
        begins, ends = (dates.to_datetime(t).isoformat() for t in at)
        meta |= {"date_from": None if (raw.get("date_range") or {}).get("date_from") == "all" else begins, "date_to": ends}
    return {"result": result, "meta": meta}
