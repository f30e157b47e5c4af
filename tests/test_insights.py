import random
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from strandline.contract import Breakdown, Exclusion, Filter, Funnel, InvalidQuery, Paths, Period, Series
from strandline.functions import dates, formula, properties
from strandline.functions.times import DAY, MINUTE, bucket
from strandline.operators import explore, funnels, paths, retention, trends, web
from strandline.operators.relation import Source
from strandline.sources.lake import EVENT_SCHEMA

NAMES = [f.name for f in EVENT_SCHEMA]


def us(text):
    return dates.to_us(datetime.fromisoformat(text).replace(tzinfo=UTC))


def make(spark, data, overrides=(), persons=()):
    """Source of (event, distinct_id, time text or µs, {column: value}) rows."""
    rows = []
    for i, (event, who, at, *more) in enumerate(data):
        extra = more[0] if more else {}
        rows.append(tuple({"uuid": extra.get("uuid", f"{i:04d}"), "event": event, "distinct_id": who, "timestamp": us(at) if isinstance(at, str) else at, "properties": extra.get("properties", "{}")}.get(n, extra.get(n)) for n in NAMES) + ("p",))
    schema = ", ".join(f"{n} {'long' if n == 'timestamp' else 'string'}" for n in NAMES) + ", project_id string"
    events = spark.createDataFrame(rows, schema).withColumn("timestamp", F.timestamp_micros("timestamp"))
    o = spark.createDataFrame([("p", *x) for x in overrides], "project_id string, distinct_id string, person_id string")
    p = spark.createDataFrame([("p", *x) for x in persons], "project_id string, id string, properties string")
    return Source(events, o, p)


def values(df, series=0):
    return [r["value"] for r in df.where(f"series = {series} AND bucket IS NOT NULL").orderBy("bucket").collect()]


# ---- dates


def test_periods():
    now = us("2026-10-04T15:30:00")
    assert len(dates.buckets(dates.resolve(None, None, "day", now))) == 8
    assert len(dates.buckets(dates.resolve("-24h", None, "hour", now))) == 25
    assert dates.to_datetime(dates.buckets(dates.resolve("-3m", None, "month", now))[0]).date().isoformat() == "2026-07-01"
    exact = dates.resolve("2026-01-01T10:00:00Z", "2026-01-01T11:00:00Z", "hour", now)
    assert exact.end - exact.start == 3_600_000_001
    assert dates.resolve_web("-7d", None, now).end == now
    assert dates.trunc(us("2026-10-04T12:00:00"), "week") == us("2026-09-28T00:00:00")
    assert dates.trunc(-1, "day") == -DAY
    for bad in (("all", "all"), ("soon", None), ("-100001d", None), ("2026-02-01", "2026-01-01")):
        with pytest.raises(InvalidQuery):
            dates.resolve(*bad, "day", now)
    with pytest.raises(InvalidQuery):
        dates.buckets(dates.resolve("-3y", None, "hour", now))
    assert dates.label(us("2026-10-04T15:00:00"), "hour") == "4 Oct 15:00"


def test_buckets_on_columns_equal_those_on_numbers(spark):
    moments = [us(t) for t in ("1969-12-31T23:59:59", "2024-02-29T12:00:00", "2026-10-04T00:00:00", "2026-01-01T00:00:00")]
    df = spark.createDataFrame([(m,) for m in moments], "at long")
    for interval in ("hour", "day", "week", "month"):
        assert [r[0] for r in df.select(bucket(F.col("at"), interval)).collect()] == [dates.trunc(m, interval) for m in moments]


# ---- formulas


def test_formulas(spark):
    numbers = [10.0, 4.0, 2.0]
    cases = {"A+B*C": 18.0, "(A+B)*c": 28.0, "A*25": 250.0, "-A+B": -6.0, "A+ +B": 14.0, "A/(B-B)": 0.0, "A/C": 5.0, "--A": 10.0, ".5*B": 2.0}
    df = spark.createDataFrame([tuple(numbers)], "a double, b double, c double")
    for text, expected in cases.items():
        assert formula.value(text, numbers) == expected
        assert df.select(formula.column(text, [F.col("a"), F.col("b"), F.col("c")])).first()[0] == expected
    for bad in ("", "A+", "D", "A B", "A^2", "(A", "A)", "1e5", "sum(A)", "(" * 200 + "A" + ")" * 200, "A+" * 600 + "A"):
        with pytest.raises(InvalidQuery):
            formula.value(bad, numbers)


# ---- property views


def test_number_and_date_views(spark):
    texts = ["1", "-1.5", "1e2", "1.5E-3", " 7", "7 ", "1_000", "NaN", "Infinity", "", "0x1", "1.", "+1", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(properties.number(F.col("t"))).collect()] == [1.0, -1.5, 100.0, 0.0015] + [None] * 10
    days = ["2026-02-20", "2026-3-1", "2026", " 2026-02-20 ", "10:00", "2026-02-20T10:00:00Z", "2026-02-20 10:00:00+02", None]
    df = spark.createDataFrame([(t,) for t in days], "t string")
    found = [r[0] for r in df.select(properties.moment(F.col("t"))).collect()]
    assert found == [us("2026-02-20"), us("2026-03-01"), None, None, None, us("2026-02-20T10:00:00"), us("2026-02-20T08:00:00"), None]


def test_keys_are_taken_verbatim_and_containers_are_not_promoted(spark):
    doc = '{"a.b":1,"a":{"b":2},"it\'s/0~k":"x","e":"","n":null,"t":true,"s":"{not json"}'
    df = spark.createDataFrame([(doc,), ("nonsense",), (None,)], "properties string")
    for key, expected in (("a.b", "1"), ("a", '{"b":2}'), ("it's/0~k", "x"), ("n", None), ("none", None)):
        assert [r[0] for r in df.select(properties.text(key)).collect()] == [expected, None, None]
    for key, expected in (("a", None), ("e", None), ("t", "true"), ("s", "{not json")):
        assert df.select(properties.promoted(F.col("properties"), key)).first()[0] == expected


def test_filters_never_give_null(spark):
    df = spark.createDataFrame([('{"k":"Team"}',), ('{"k":"9"}',), ('{"k":null}',), ("{}",), (None,)], "properties string")
    cases = {("exact", "Team"): "10000", ("is_not", "Team"): "01111", ("icontains", "EA"): "10000", ("not_icontains", "EA"): "01111", ("regex", "^T"): "10000", ("not_regex", "^T"): "01111", ("gt", 8): "01000", ("lte", 9): "01000", ("is_set", None): "11000", ("is_not_set", None): "00111", ("is_date_before", "2026-01-01"): "00000"}
    for (op, value), expected in cases.items():
        assert "".join(str(int(r[0])) for r in df.select(properties.condition([Filter("k", op, value)])).collect()) == expected
    for bad in (Filter("k", "gt", "x"), Filter("k", "regex", "("), Filter("k", "exact", []), Filter("", "exact", "x"), Filter("k", "nope", 1), Filter("k", "icontains", ["a", "b"])):
        with pytest.raises(InvalidQuery):
            properties.condition([bad])
    assert df.where(properties.explore_condition([Filter("k", "icontains", ["x", "EA"])], 0)).count() == 1
    assert df.where(properties.explore_condition([Filter("k", "gt", 8)], 0)).count() == 1


# ---- trends


def test_a_merge_changes_who_counts(spark):
    data = [("$pageview", "anon-1", "2026-03-10"), ("$pageview", "user-1", "2026-03-10"), ("$pageview", "user-1", "2026-03-11")]
    period = Period(us("2026-03-10"), us("2026-03-12"))
    assert values(trends.trends(make(spark, data), [Series("$pageview", "dau")], period)) == [2, 1]
    assert values(trends.trends(make(spark, data, [("anon-1", "user-1")]), [Series("$pageview", "dau")], period)) == [1, 1]


def test_trailing_windows(spark):
    data = [("x", "a", "2026-03-01"), ("x", "b", "2026-03-05"), ("x", "c", "2026-03-09")]
    period = Period(us("2026-03-05"), us("2026-03-10"))
    source = make(spark, data)
    found = trends.trends(source, [Series("x", "dau"), Series("x", "weekly_active"), Series("x", "monthly_active")], period)
    assert values(found, 0) == [1, 0, 0, 0, 1]
    assert values(found, 1) == [2, 2, 2, 1, 2]
    assert values(found, 2) == [2, 2, 2, 2, 3]
    assert [r["value"] for r in found.where("bucket IS NULL").orderBy("series").collect()] == [2, 2, 2]


def test_no_events(spark):
    source = make(spark, [])
    period = Period(us("2026-03-01"), us("2026-03-09"))
    assert values(trends.trends(source, [Series("x")], period)) == [0] * 8
    assert trends.trends(source, [Series("x")], period, breakdown=Breakdown("plan")).count() == 0
    found = funnels.outcomes(source, Funnel((Series("a"), Series("b"))), period)
    assert [r["count"] for r in funnels.steps(found, 2).orderBy("step").collect()] == [0, 0]
    assert funnels.time_to_convert(found, 2).count() == 0
    assert retention.retention(source, Series("a"), Series("a"), us("2026-03-04"), "day", 4).count() == 10
    assert {r["value"] for r in retention.lifecycle(source, Series("a"), period).collect()} == {0}
    assert paths.links(source, Paths(), period).count() == 0
    assert web.totals(source, period).first().asDict() == {"visitors": 0, "pageviews": 0, "sessions": 0, "bounce_rate": None, "session_duration_s": None}


def test_breakdown_values_and_the_rest(spark):
    data = [("x", f"u{i}", "2026-03-01", {"properties": p}) for i, p in enumerate(['{"k":"a"}'] * 3 + ['{"k":"b"}'] * 2 + ['{"k":""}', "{}", '{"k":"c"}'])]
    found = trends.trends(make(spark, data), [Series("x")], Period(us("2026-03-01"), us("2026-03-02")), breakdown=Breakdown("k", limit=2), compare=True)
    assert {(r["period"], r["breakdown"]): r["value"] for r in found.where("bucket IS NULL").collect()} == {("current", "a"): 3, ("current", "$$_none"): 2, ("current", "$$_other"): 3, ("previous", "a"): 0, ("previous", "$$_none"): 0, ("previous", "$$_other"): 0}


# ---- funnels


def test_a_later_attempt_may_convert(spark):
    data = [("A", "u", "2026-03-01T00:00:00"), ("A", "u", "2026-03-10T10:00:00"), ("B", "u", "2026-03-10T10:05:00")]
    found = funnels.outcomes(make(spark, data), Funnel((Series("A"), Series("B")), DAY), Period(us("2026-03-01"), us("2026-03-20")))
    second = funnels.steps(found, 2).where("step = 1").first()
    assert (second["count"], second["average_s"], second["median_s"], second["conversion_rate"]) == (1, 300.0, 300.0, 100.0)
    assert [r["n"] for r in funnels.time_to_convert(found, 2).collect()] == [1]


def brute(events, steps, window, order, exclusions):
    """Best attempt by trying every anchor and, for ordered steps, every later row in turn."""
    best = None
    for i, (t0, e0) in enumerate(events):
        times, positions = [], []
        if order == "unordered":
            covered = {}
            for t, e in events[i:]:
                if t - t0 <= window:
                    for k, s in enumerate(steps):
                        if s == e and k not in covered:
                            covered[k] = t
            if e0 not in steps:
                continue
            times = sorted(covered.values())
        else:
            if e0 != steps[0]:
                continue
            times, positions = [t0], [i]
            for j in range(i + 1, len(events)):
                t, e = events[j]
                if len(times) == len(steps) or t - t0 > window:
                    break
                if e == steps[len(times)]:
                    times.append(t)
                    positions.append(j)
                elif order == "strict":
                    break
        bad = False
        for name, a, b in exclusions:
            if len(times) > a:
                stop = positions[b] if len(times) > b else len(events)
                bad |= any(events[j][1] == name and (len(times) > b or events[j][0] - t0 <= window) for j in range(positions[a] + 1, stop))
        if not bad and times and (best is None or len(times) > len(best)):
            best = times
    return best


@pytest.mark.parametrize("order", ["ordered", "strict", "unordered", "exclusion"])
def test_funnels_equal_brute_force_with_ties(spark, order):
    random.seed(order)
    people = {f"u{p}": sorted((random.randrange(60) * MINUTE, random.choice("ABCX"), f"{i:03d}") for i in range(random.randrange(1, 14))) for p in range(60)}
    people = {p: sorted(((t, e, u) for t, e, u in rows), key=lambda r: (r[0], r[2])) for p, rows in people.items()}
    data = [(e, p, t, {"uuid": u}) for p, rows in people.items() for t, e, u in rows]
    exclusions = (Exclusion("X", 0, 1), Exclusion("X", 1, 2)) if order == "exclusion" else ()
    funnel = Funnel(tuple(map(Series, "ABA" if order != "unordered" else "ABC")), 20 * MINUTE, "ordered" if order == "exclusion" else order, exclusions)
    found = {r["person_id"]: list(r["times"]) for r in funnels.outcomes(make(spark, data), funnel, Period(0, DAY)).collect()}
    expected = {p: brute([(t, e) for t, e, _ in rows], [s.event for s in funnel.steps], funnel.window_us, funnel.order, [(x.event, x.from_step, x.to_step) for x in exclusions]) for p, rows in people.items()}
    assert found == {p: t for p, t in expected.items() if t}


def test_one_event_can_match_several_steps(spark):
    data = [("A", "u", 0), ("A", "u", 5)]
    found = lambda order: funnels.outcomes(make(spark, data), Funnel((Series("A"), Series(None)), 10, order), Period(0, DAY)).first()["times"]
    assert found("ordered") == [0, 5]
    assert found("unordered") == [0, 0]
    for bad in (Funnel((Series("A"),)), Funnel((Series("A"), Series("B")), order="unordered", exclusions=(Exclusion("x", 0, 1),)), Funnel((Series("A"), Series("B")), exclusions=(Exclusion("x", 1, 1),))):
        with pytest.raises(InvalidQuery):
            funnels.outcomes(make(spark, data), bad, Period(0, DAY))


# ---- paths


def test_paths(spark):
    view = lambda who, page, at: ("$pageview", who, at, {"pathname": page})
    data = [view("a", "/pricing", 1), view("a", "/pricing", 2), view("a", None, 3), view("a", "/signup", 4_000_001), view("b", "/pricing", 1), view("b", "/signup", 2_000_001), view("c", "/pricing", 1), view("c", "/docs", 2), view("d", "/docs", 1)]
    source, period = make(spark, data), Period(0, DAY)
    best = paths.links(source, Paths(), period).first()
    assert tuple(best) == ("1_/pricing", "2_/signup", 2, 3.0)
    assert sorted(r[0] for r in paths.actors(source, Paths(), period, "1_/pricing", "2_/signup").collect()) == ["a", "b"]
    assert paths.walks(source, Paths(start="/docs"), period).where("step = 1").count() == 2
    assert {r["person_id"] for r in paths.walks(source, Paths(end="/signup"), period).collect()} == {"a", "b"}


# ---- web


def test_web_sessions(spark):
    minute = 60_000_000
    view = lambda who, page, at, s=None, **m: ("$pageview", who, at, {"pathname": page, "session_id": s} | m)
    data = [view("u1", None, 0, "S1"), view("u1", "/a", minute, "S1", referring_domain="x.org"), ("$autocapture", "u1", 2 * minute, {"session_id": "S1"}), view("u2", "/b", 0), view("u2", "/c", 31 * minute), ("custom", "u3", 0, {"session_id": "S3"})]
    facts = {(r["start_at"], r["entry_page"]): r for r in web.session_facts(make(spark, data), Period(0, DAY)).collect()}
    assert set(facts) == {(0, "/a"), (0, "/b"), (31 * minute, "/c")}
    assert (facts[0, "/a"]["pageviews"], facts[0, "/a"]["bounced"], facts[0, "/b"]["bounced"]) == (2, False, True)
    total = web.totals(make(spark, data), Period(0, DAY)).first()
    assert (total["visitors"], total["pageviews"], total["sessions"], round(total["bounce_rate"], 3)) == (2, 4, 3, 66.667)
    assert [tuple(r) for r in web.breakdown(make(spark, data), Period(0, DAY), "referring_domain").collect()] == [("$direct", 1, 2, None), ("x.org", 1, 2, None)]
    assert web.live_visitors(make(spark, data), 31 * minute).first()[0] == 1
    with pytest.raises(InvalidQuery):
        web.breakdown(make(spark, data), Period(0, DAY), "shoe_size")


# ---- feed


def test_a_page_ends_before_rows_that_tie_with_the_next():
    assert explore.cut([9, 8, 7, 7], 3, lambda x: x) == ([9, 8], 8)
    assert explore.cut([9, 8], 3, lambda x: x) == ([9, 8], None)
    assert explore.cut([7, 7, 7], 2, lambda x: x) == ([7, 7], 7)
