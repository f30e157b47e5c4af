"""Queries of the insight operators over the captured events, with their SQL."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.contract import OTHER, Breakdown, Exclusion, Filter, Funnel, Paths, Period, Series
from strandline.functions import dates, properties
from strandline.functions.times import DAY, HOUR, MINUTE
from strandline.operators import explore, funnels, identity, paths, retention, trends, web
from strandline.operators.relation import Source, earliest_event, relation
from strandline.plans import engine
from strandline.plans.problem_queries import table
from strandline.session import local_rows

START, END = (dates._absolute(d)[0] for d in ("2018-01-08", "2018-01-22"))
NOW = dates._absolute("2018-01-28T12:00:00Z")[0]
FORTNIGHT = Period(START, END, "day")
#: All event times of the test data, with the few events that clients with a wrong clock put years back.
WHOLE = Period(*(dates._absolute(d)[0] for d in ("2012-01-01", "2018-01-29")), "day")
PURCHASE = "subscription_started"


def source(spark: SparkSession, folder: str) -> Source:
    """The captured events of all projects with their identity tables."""
    return Source(*(table(spark, folder, t) for t in ("captured_events", "person_overrides", "persons")))


def trend(spark: SparkSession, folder: str, series: list[Series], period: Period = FORTNIGHT, **more: object) -> DataFrame:
    found = trends.trends(source(spark, folder), series, period, **more)
    return found.withColumn("value", F.round("value", 6))


def filtered(spark: SparkSession, folder: str, *filters: Filter) -> DataFrame:
    """How many events pass the filters, by event."""
    person = any(f.scope == "person" for f in filters)
    events = relation(source(spark, folder), person=person, person_properties=person)
    return events.where(properties.condition(filters)).groupBy("event").agg(F.count(F.lit(1)).alias("n"))


def filtered_dates(spark: SparkSession, folder: str, op: str, value: str) -> DataFrame:
    """How many events pass a date filter on a property that says their day, or their moment in
    another zone, by event: no property of the test data holds dates."""
    events = table(spark, folder, "captured_events")
    day, moment = F.date_format("timestamp", "yyyy-MM-dd"), F.date_format(F.col("timestamp") + F.expr("INTERVAL 2 HOURS"), "yyyy-MM-dd'T'HH:mm:ss'+02:00'")
    said = F.when(F.col("session_id").isNull(), day).otherwise(moment)
    dated = events.withColumn("properties", F.to_json(F.struct(said.alias("said"))))
    return dated.where(properties.condition((Filter("said", op, value),))).groupBy("event").agg(F.count(F.lit(1)).alias("n"))


STEPS = (Series("$pageview"), Series("$autocapture"), Series("$pageleave"))


def funnel_of(**more: object) -> Funnel:
    return Funnel(**({"steps": STEPS, "window_us": DAY} | more))


def funnel_steps(spark: SparkSession, folder: str, funnel: Funnel, period: Period = FORTNIGHT) -> DataFrame:
    found = funnels.outcomes(source(spark, folder), funnel, period)
    if funnel.breakdown:
        found = funnels.with_shown(found, funnel.breakdown.limit)
    steps = funnels.steps(found, len(funnel.steps), funnel.breakdown is not None)
    return steps.withColumns({c: F.round(c, 6) for c in ("conversion_rate", "average_s", "median_s")})


def funnel_persons(spark: SparkSession, folder: str, funnel: Funnel) -> DataFrame:
    """Every person's best attempt: depth and the time of its first and last step."""
    found = funnels.outcomes(source(spark, folder), funnel, FORTNIGHT)
    return found.select("person_id", "depth", F.element_at("times", 1).alias("first_us"), F.element_at("times", -1).alias("last_us"))


def funnel_times(spark: SparkSession, folder: str) -> DataFrame:
    return funnels.time_to_convert(funnels.outcomes(source(spark, folder), funnel_of(), FORTNIGHT), len(STEPS))


def funnel_actors(spark: SparkSession, folder: str, dropped: bool) -> DataFrame:
    return funnels.actors(funnels.outcomes(source(spark, folder), funnel_of(), FORTNIGHT), 1, dropped)


def retained(spark: SparkSession, folder: str, interval: str, total: int, first_time: bool) -> DataFrame:
    return retention.retention(source(spark, folder), Series("$pageview"), Series("$autocapture"), NOW, interval, total, first_time)


def retention_actors(spark: SparkSession, folder: str) -> DataFrame:
    cells = retention.members(source(spark, folder), Series("$pageview"), Series("$autocapture"), NOW, "day", 8)
    return cells.where("cohort = 2 AND offset = 3").select("person_id")


def lifecycle(spark: SparkSession, folder: str, period: Period) -> DataFrame:
    return retention.lifecycle(source(spark, folder), Series("$pageview"), period)


def lifecycle_actors(spark: SparkSession, folder: str) -> DataFrame:
    cells = retention.lifecycle_cells(source(spark, folder), Series("$pageview"), FORTNIGHT)
    return cells.where((F.col("status") == "resurrecting") & (F.col("bucket") == START + 5 * DAY)).select("person_id")


def sticky(spark: SparkSession, folder: str, period: Period = FORTNIGHT) -> DataFrame:
    return retention.stickiness(source(spark, folder), [Series("$pageview"), Series("$autocapture")], period)


def sticky_actors(spark: SparkSession, folder: str) -> DataFrame:
    return retention.active_buckets(source(spark, folder), Series("$pageview"), FORTNIGHT).where("n = 2").select("person_id")


def walked(spark: SparkSession, folder: str, period: Period = FORTNIGHT, **more: object) -> DataFrame:
    return paths.links(source(spark, folder), Paths(**({"edges": 1000} | more)), period).withColumn("average_s", F.round("average_s", 6))


def trend_actors(spark: SparkSession, folder: str, math: str) -> DataFrame:
    return trends.actors(source(spark, folder), Series("$pageview", math), FORTNIGHT, START + 3 * DAY)


def path_actors(spark: SparkSession, folder: str) -> DataFrame:
    return paths.actors(source(spark, folder), Paths(), FORTNIGHT, "1_/", "2_/pricing")


def other_actors(spark: SparkSession, folder: str) -> DataFrame:
    """Everyone behind '$$_other' of a breakdown that shows three values."""
    return trends.actors(source(spark, folder), Series("$pageview", "dau"), FORTNIGHT, None, (), Breakdown("$browser", limit=3), OTHER)


CHROME = (Filter("$browser", "exact", "Chrome"),)


def filtered_path_actors(spark: SparkSession, folder: str) -> DataFrame:
    return paths.actors(source(spark, folder), Paths(filters=CHROME), FORTNIGHT, "1_/", "2_/pricing")


def actors_page(spark: SparkSession, folder: str) -> DataFrame:
    """The persons 21 to 70 behind a day's active users, as the engine hands them out."""
    asked = {"kind": "TrendsQuery", "series": [{"event": "$pageview", "math": "dau"}], "date_range": {"date_from": "2018-01-08", "date_to": "2018-01-21"}}
    found = engine.actors(asked, {"kind": "TrendsPoint", "bucket": START + 3 * DAY}, source(spark, folder), NOW, 50, 20)
    return local_rows(spark, list(enumerate(found)), "place int, person_id string")


def trend_of_all(spark: SparkSession, folder: str) -> DataFrame:
    """Monthly totals since the first event."""
    period = dates.resolve("all", None, "month", NOW, earliest_event(table(spark, folder, "captured_events")))
    return trend(spark, folder, [MATHS["total"]], period).where("bucket IS NOT NULL AND value > 0").select("bucket", "value")


def sessions_of_web(spark: SparkSession, folder: str) -> DataFrame:
    facts = web.session_facts(source(spark, folder), FORTNIGHT)
    return facts.select("start_at", "duration_us", "pageviews", "autocaptures", "entry_page", "exit_page", "browser", "bounced")


def web_overview(spark: SparkSession, folder: str, period: Period = FORTNIGHT) -> DataFrame:
    return web.overview(source(spark, folder), period).withColumns({c: F.round(c, 6) for c in ("bounce_rate", "session_duration_s")})


def web_over_time(spark: SparkSession, folder: str) -> DataFrame:
    return web.over_time(source(spark, folder), FORTNIGHT)


def web_breakdown(spark: SparkSession, folder: str, by: str) -> DataFrame:
    return web.breakdown(source(spark, folder), FORTNIGHT, by, 20).withColumn("bounce_rate", F.round("bounce_rate", 6))


def web_live(spark: SparkSession, folder: str) -> DataFrame:
    return web.live_visitors(source(spark, folder), NOW)


def feed_page(spark: SparkSession, folder: str) -> DataFrame:
    return explore.feed(table(spark, folder, "captured_events"), 200, END).select("uuid", "event", "distinct_id", "at")


def feed_next_page(spark: SparkSession, folder: str) -> DataFrame:
    """The second page of the feed, from the first one's cursor."""
    events = table(spark, folder, "captured_events")
    _, cursor = explore.page(events, 150, END)
    rows, _ = explore.page(events, 150, cursor)
    return local_rows(spark, [(r["uuid"], r["event"], r["at"]) for r in rows], "uuid string, event string, at long")


def feed_filtered(spark: SparkSession, folder: str) -> DataFrame:
    wanted = [Filter("plan", "icontains", ["TEAM", "ent"]), Filter("$browser", "is_set")]
    return explore.feed(table(spark, folder, "captured_events"), 100, filters=wanted, now=NOW).select("uuid", "event", "at")


def persons_list(spark: SparkSession, folder: str) -> DataFrame:
    return explore.persons(table(spark, folder, "persons"), table(spark, folder, "distinct_ids")).select("id", "created_at", "display_name")


def persons_search(spark: SparkSession, folder: str) -> DataFrame:
    return explore.persons(table(spark, folder, "persons"), table(spark, folder, "distinct_ids"), "u-1").select("id", "created_at")


def person_stats(spark: SparkSession, folder: str) -> DataFrame:
    return explore.person_stats(source(spark, folder))


def catalog_events(spark: SparkSession, folder: str) -> DataFrame:
    return explore.event_names(table(spark, folder, "captured_events"), "e")


def catalog_keys(spark: SparkSession, folder: str) -> DataFrame:
    return explore.property_keys(table(spark, folder, "captured_events"))


def catalog_person_keys(spark: SparkSession, folder: str) -> DataFrame:
    return explore.property_keys(table(spark, folder, "persons"))


def catalog_values(spark: SparkSession, folder: str) -> DataFrame:
    return explore.property_values(table(spark, folder, "captured_events"))


def project_status(spark: SparkSession, folder: str) -> DataFrame:
    return explore.project_status(table(spark, folder, "lake_files"))


def reconcile(spark: SparkSession, folder: str) -> DataFrame:
    return explore.reconcile(table(spark, folder, "captured_events"), table(spark, folder, "event_mirror"))


def feed_of_person(spark: SparkSession, folder: str) -> DataFrame:
    """The newest events of one person, over all its distinct ids: the owner of the last id that
    belongs to someone else than itself."""
    ids = table(spark, folder, "distinct_ids")
    wanted = table(spark, folder, "person_overrides").agg(F.max("distinct_id")).first()[0]
    owner = explore.find_person(table(spark, folder, "persons"), ids, wanted).select(F.col("project_id").alias("o_project"), F.col("id").alias("o_person"))
    mine = identity.latest(ids).join(owner, (F.col("project_id") == F.col("o_project")) & (F.col("person_id") == F.col("o_person")), "left_semi")
    return explore.feed(table(spark, folder, "captured_events"), 200, distinct_ids=mine).select("uuid", "event", "at")


FILTERS = {
    "exact": Filter("plan", "exact", ["free", "pro", "Team "]),
    "is_not": Filter("plan", "is_not", "free"),
    "icontains": Filter("plan", "icontains", "TE"),
    "not_icontains": Filter("$browser", "not_icontains", "FIRE"),
    "regex": Filter("app_version", "regex", r"^4\.1\d$"),
    "not_regex": Filter("app_version", "not_regex", r"^4\.1\d$"),
    "gt": Filter("amount", "gt", 20),
    "gte": Filter("amount", "gte", "100"),
    "lt": Filter("scroll_depth", "lt", 0.5),
    "lte": Filter("it's/1~key", "lte", 1),
    "is_set": Filter("ключ", "is_set"),
    "is_not_set": Filter("$session_id", "is_not_set"),
}
PERSON_FILTER = Filter("plan", "exact", "team", "person")
MATHS = {
    "total": Series("$pageview"),
    "dau": Series("$pageview", "dau"),
    "wau": Series("$pageview", "weekly_active"),
    "mau": Series("$pageview", "monthly_active"),
    "unique_session": Series("$pageview", "unique_session"),
    **{m: Series(None, m, "amount") for m in ("sum", "avg", "min", "max", "median", "p90", "p95", "p99")},
}
WEEKS = Period(START + 2 * DAY, END, "week")
MONTHS = Period(dates._absolute("2018-01-01")[0], dates._absolute("2018-02-01")[0], "month")

QUERIES = {f"trends_{name}": partial(trend, series=[s]) for name, s in MATHS.items()}
QUERIES |= {
    "trends_dau_hour": partial(trend, series=[MATHS["dau"]], period=Period(START, START + 3 * DAY, "hour")),
    "trends_wau_week": partial(trend, series=[MATHS["wau"]], period=WEEKS),
    "trends_mau_month": partial(trend, series=[MATHS["mau"]], period=MONTHS),
    "trends_breakdown_top_other": partial(trend, series=[MATHS["total"]], breakdown=Breakdown("$browser", limit=3)),
    "trends_breakdown_dau": partial(trend, series=[MATHS["dau"]], breakdown=Breakdown("$geoip_country_code", limit=5)),
    "trends_breakdown_person": partial(trend, series=[MATHS["total"]], breakdown=Breakdown("plan", "person", 4)),
    "trends_formula": partial(trend, series=[MATHS["total"], Series("$autocapture")], formula_text="B / (A + 1) * 100 - -2"),
    "trends_compare": partial(trend, series=[MATHS["total"]], compare=True),
    "trends_two_series": partial(trend, series=[MATHS["dau"], Series("$autocapture", "dau")]),
    **{f"filter_{name}": partial(lambda s, d, f: filtered(s, d, f), f=f) for name, f in FILTERS.items()},
    "filter_date_before": partial(filtered_dates, op="is_date_before", value="2018-01-10"),
    "filter_date_after": partial(filtered_dates, op="is_date_after", value="2018-01-10T06:30:00Z"),
    "filter_person": partial(lambda s, d, f: filtered(s, d, f), f=PERSON_FILTER),
    "filter_and": lambda s, d: filtered(s, d, FILTERS["exact"], FILTERS["not_icontains"]),
    "funnel_ordered": partial(funnel_steps, funnel=funnel_of()),
    "funnel_strict": partial(funnel_steps, funnel=funnel_of(order="strict", steps=STEPS[:2])),
    "funnel_unordered": partial(funnel_persons, funnel=funnel_of(order="unordered")),
    "funnel_exclusion": partial(funnel_persons, funnel=funnel_of(steps=STEPS[:2], exclusions=(Exclusion("$web_vitals", 0, 1),))),
    "funnel_best_attempt": partial(funnel_persons, funnel=funnel_of()),
    "funnel_breakdown": partial(funnel_steps, funnel=funnel_of(breakdown=Breakdown("$browser", limit=3))),
    "funnel_time_to_convert": funnel_times,
    "actors_funnel_converted": partial(funnel_actors, dropped=False),
    "actors_funnel_dropped": partial(funnel_actors, dropped=True),
    "retention_recurring_day": partial(retained, interval="day", total=8, first_time=False),
    "retention_first_time_week": partial(retained, interval="week", total=4, first_time=True),
    "actors_retention": retention_actors,
    "lifecycle_day": partial(lifecycle, period=FORTNIGHT),
    "lifecycle_week": partial(lifecycle, period=WEEKS),
    "actors_lifecycle": lifecycle_actors,
    "stickiness_day": sticky,
    "actors_stickiness": sticky_actors,
    "paths_all": walked,
    "paths_start": partial(walked, start="/pricing"),
    "paths_end": partial(walked, end="/pricing"),
    "paths_custom": partial(walked, kinds=("pageview", "custom"), steps=3),
    "paths_filtered": partial(walked, filters=CHROME),
    "actors_paths": path_actors,
    "actors_paths_filtered": filtered_path_actors,
    "actors_trends_other": other_actors,
    "actors_page": actors_page,
    "trends_all_months": trend_of_all,
    "actors_trends_dau": partial(trend_actors, math="dau"),
    "actors_trends_wau": partial(trend_actors, math="weekly_active"),
    "actors_trends_session": partial(trend_actors, math="unique_session"),
    "web_sessions": sessions_of_web,
    "web_overview": web_overview,
    "web_over_time": web_over_time,
    **{f"web_{by}": partial(web_breakdown, by=by) for by in ("page", "entry_page", "exit_page", *web.ENTRY_DIMENSIONS)},
    "web_live": web_live,
    "feed_page": feed_page,
    "feed_next_page": feed_next_page,
    "feed_filtered": feed_filtered,
    "feed_of_person": feed_of_person,
    "persons_list": persons_list,
    "persons_search": persons_search,
    "person_stats": person_stats,
    "catalog_events": catalog_events,
    "catalog_keys": catalog_keys,
    "catalog_person_keys": catalog_person_keys,
    "catalog_values": catalog_values,
    "project_status": project_status,
    "reconcile_day_event": reconcile,
    "trends_total_whole": partial(trend, series=[MATHS["total"]], period=WHOLE),
    "funnel_ordered_whole": partial(funnel_steps, funnel=funnel_of(), period=WHOLE),
    "paths_all_whole": partial(walked, period=WHOLE),
    "web_overview_whole": partial(web_overview, period=WHOLE),
    "stickiness_day_whole": partial(sticky, period=WHOLE),
}

# ---------------------------------------------------------------- the same in SQL

_EV = "ev AS (SELECT c.*, epoch_us(c.timestamp) AS us, coalesce(o.person_id, c.distinct_id) AS person FROM captured_events c LEFT JOIN person_overrides o ON c.project_id = o.project_id AND c.distinct_id = o.distinct_id)"
_RANGE = f"us >= {START} AND us < {END}"
_NUMBER = r"'-?[0-9]+(\.[0-9]+)?([eE][-+]?[0-9]+)?'"
_VALUE = f"CASE WHEN regexp_full_match(json_extract_string(properties, '/amount'), {_NUMBER}) THEN CAST(json_extract_string(properties, '/amount') AS DOUBLE) END"
_SIZES = {"hour": HOUR, "day": DAY, "week": 7 * DAY}


def _starts(period: Period) -> str:
    """The buckets of a period and the row for all of it."""
    return "starts AS (SELECT unnest([" + ", ".join(map(str, dates.buckets(period))) + ", NULL])::BIGINT AS bucket)"


def _bucket(interval: str) -> str:
    if interval == "month":
        return "epoch_us(date_trunc('month', timestamp))"
    origin = 4 * DAY if interval == "week" else 0
    return f"us - (us - {origin}) % {_SIZES[interval]}"


def _trend_sql(measure: str, where: str, period: Period = FORTNIGHT, series: int = 0, name: str = "current") -> str:
    inside = f"us >= {period.start} AND us < {period.end}"
    return f"""WITH {_EV}, {_starts(period)}, m AS (SELECT *, {_VALUE} AS v FROM ev WHERE {where} AND {inside}),
        f AS (SELECT {_bucket(period.interval)} AS bucket, {measure} AS value FROM m GROUP BY 1 UNION ALL SELECT NULL, {measure} FROM m)
        SELECT '{name}' AS period, {series} AS series, CAST(NULL AS VARCHAR) AS breakdown, s.bucket, round(CAST(coalesce(f.value, 0) AS DOUBLE), 6) AS value FROM starts s LEFT JOIN f ON s.bucket IS NOT DISTINCT FROM f.bucket"""


def _trailing_sql(n_days: int, period: Period) -> str:
    end = "epoch_us(date_trunc('month', make_timestamp(b)) + INTERVAL 1 MONTH)" if period.interval == "month" else f"b + {_SIZES[period.interval]}"
    starts = ", ".join(map(str, dates.buckets(period)))
    return f"""WITH {_EV}, w AS (SELECT b, {end} AS e FROM (SELECT unnest([{starts}])::BIGINT AS b) t), m AS (SELECT person, us FROM ev WHERE event = '$pageview' AND us < {period.end})
        SELECT 'current' AS period, 0 AS series, CAST(NULL AS VARCHAR) AS breakdown, b AS bucket, CAST(count(DISTINCT person) AS DOUBLE) AS value FROM w LEFT JOIN m ON us < e AND us >= e - {n_days * DAY} GROUP BY b
        UNION ALL SELECT 'current', 0, NULL, NULL, CAST(count(DISTINCT person) AS DOUBLE) FROM m WHERE us >= {period.start}"""


def _breakdown_sql(value: str, limit: int, measure: str, join: str = "") -> str:
    return f"""WITH {_EV}, {_starts(FORTNIGHT)}, m AS (SELECT ev.*, coalesce(nullif({value}, ''), '$$_none') AS bd FROM ev {join} WHERE event = '$pageview' AND {_RANGE}),
        r AS (SELECT bd, row_number() OVER (ORDER BY count(*) DESC, bd) AS rk FROM m GROUP BY bd), t AS (SELECT *, CASE WHEN rk <= {limit} THEN r.bd ELSE '$$_other' END AS shown FROM m JOIN r ON m.bd = r.bd),
        f AS (SELECT shown, {_bucket('day')} AS bucket, {measure} AS value FROM t GROUP BY 1, 2 UNION ALL SELECT shown, NULL, {measure} FROM t GROUP BY 1), k AS (SELECT DISTINCT shown FROM t)
        SELECT 'current' AS period, 0 AS series, k.shown AS breakdown, s.bucket, CAST(coalesce(f.value, 0) AS DOUBLE) AS value FROM k CROSS JOIN starts s LEFT JOIN f ON f.shown = k.shown AND s.bucket IS NOT DISTINCT FROM f.bucket"""


_MEASURES = {
    "total": "count(*)",
    "dau": "count(DISTINCT person)",
    "unique_session": "count(DISTINCT session_id)",
    **{m: f"{m}(v)" for m in ("sum", "avg", "min", "max")},
    **{m: f"quantile_cont(v, {q})" for m, q in (("median", 0.5), ("p90", 0.9), ("p95", 0.95), ("p99", 0.99))},
}
SQL = {f"trends_{m}": _trend_sql(x, "event = '$pageview'" if MATHS[m].event else "true") for m, x in _MEASURES.items()}


def _text(key: str) -> str:
    pointer = "/" + key.replace("~", "~0").replace("/", "~1").replace("'", "''")
    return f"json_extract_string(properties, '{pointer}')"


def _num(key: str) -> str:
    return f"CASE WHEN regexp_full_match({_text(key)}, {_NUMBER}) THEN CAST({_text(key)} AS DOUBLE) END"


_CONDITIONS = {
    "exact": f"{_text('plan')} IN ('free', 'pro', 'Team ')",
    "is_not": f"NOT coalesce({_text('plan')} IN ('free'), false)",
    "icontains": f"contains(lower({_text('plan')}), 'te')",
    "not_icontains": "NOT coalesce(contains(lower(browser), 'fire'), false)",
    "regex": rf"regexp_matches({_text('app_version')}, '^4\.1\d$')",
    "not_regex": rf"NOT coalesce(regexp_matches({_text('app_version')}, '^4\.1\d$'), false)",
    "gt": f"{_num('amount')} > 20",
    "gte": f"{_num('amount')} >= 100",
    "lt": f"{_num('scroll_depth')} < 0.5",
    "lte": f"{_num(chr(105) + 't' + chr(39) + 's/1~key')} <= 1",
    "is_set": f"{_text('ключ')} IS NOT NULL",
    "is_not_set": "session_id IS NULL",
}
SQL |= {f"filter_{k}": f"SELECT event, count(*) AS n FROM captured_events WHERE {c} GROUP BY event" for k, c in _CONDITIONS.items()}


def _chain(steps: list[str], window: int = DAY) -> str:
    """Every attempt of an ordered funnel, by joining each step's earliest row after the one before."""
    sql = f"a0 AS (SELECT person, us AS t0, uuid AS u0, us AS t, uuid AS u, browser AS bd, [us] AS times FROM ev WHERE event = '{steps[0]}' AND {_RANGE})"
    for i, s in enumerate(steps[1:], 1):
        sql += f""", n{i} AS (SELECT a.person, a.t0, a.u0, min((e.us, e.uuid)) AS nx FROM a{i - 1} a JOIN ev e ON e.person = a.person AND e.event = '{s}' AND (e.us, e.uuid) > (a.t, a.u) AND e.us <= a.t0 + {window} AND {_RANGE} WHERE len(a.times) = {i} GROUP BY 1, 2, 3),
        a{i} AS (SELECT a.person, a.t0, a.u0, coalesce(struct_extract_at(n.nx, 1), a.t) AS t, coalesce(struct_extract_at(n.nx, 2), a.u) AS u, a.bd, CASE WHEN n.person IS NULL THEN a.times ELSE list_append(a.times, struct_extract_at(n.nx, 1)) END AS times
        FROM a{i - 1} a LEFT JOIN n{i} n ON a.person = n.person AND a.t0 = n.t0 AND a.u0 = n.u0)"""
    return sql + f", best AS (SELECT person, times, len(times) AS depth, coalesce(nullif(bd, ''), '$$_none') AS bd FROM a{len(steps) - 1} QUALIFY row_number() OVER (PARTITION BY person ORDER BY len(times) DESC, t0, u0) = 1)"


_THREE = _chain(["$pageview", "$autocapture", "$pageleave"])


def _steps_sql(source_sql: str, n: int, by: bool) -> str:
    g, p = ("bd, ", "PARTITION BY bd") if by else ("", "")
    keys = "(SELECT DISTINCT bd FROM shown)" if by else "(SELECT 1)"
    return f"""WITH {_EV}, {source_sql}, g AS (SELECT {g}k AS step FROM {keys} x, range({n}) r(k)),
        c AS (SELECT {g}step, (SELECT count(*) FROM shown s WHERE s.depth > g.step {'AND s.bd = g.bd' if by else ''}) AS count,
          (SELECT round(avg((times[g.step + 1] - times[g.step]) / 1e6), 6) FROM shown s WHERE s.depth > g.step AND g.step > 0 {'AND s.bd = g.bd' if by else ''}) AS average_s,
          (SELECT round(median((times[g.step + 1] - times[g.step]) / 1e6), 6) FROM shown s WHERE s.depth > g.step AND g.step > 0 {'AND s.bd = g.bd' if by else ''}) AS median_s FROM g)
        SELECT {'bd AS breakdown, ' if by else ''}CAST(step AS INT) AS step, count, round(CASE WHEN first_value(count) OVER w > 0 THEN 100.0 * count / first_value(count) OVER w ELSE 0 END, 6) AS conversion_rate,
        coalesce(lag(count) OVER w - count, 0) AS dropped_off, average_s, median_s FROM c WINDOW w AS ({p} ORDER BY step)"""


_SESSIONIZED = f"""numbered AS (SELECT *, sum(st) OVER (PARTITION BY k, person ORDER BY us, uuid ROWS UNBOUNDED PRECEDING) AS nr FROM (
  SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY k, person ORDER BY us, uuid) <= {30 * MINUTE} THEN 0 ELSE 1 END AS st FROM (SELECT *, coalesce(session_id, '') = '' AS k FROM ev WHERE RANGE) a) b),
facts AS (SELECT count(*) FILTER (WHERE event = '$pageview') AS pageviews, count(*) FILTER (WHERE event = '$autocapture') AS autocaptures, min(us) AS start_at, max(us) - min(us) AS duration_us,
  arg_min(person, (us, uuid)) FILTER (WHERE event = '$pageview') AS person, arg_min(pathname, (us, uuid)) FILTER (WHERE event = '$pageview') AS entry_page, arg_max(pathname, (us, uuid)) FILTER (WHERE event = '$pageview') AS exit_page,
  {", ".join(f"arg_min({c}, (us, uuid)) FILTER (WHERE event = '$pageview') AS {c}" for c in web.ENTRY_DIMENSIONS)}
  FROM numbered GROUP BY CASE WHEN k THEN concat('p', person, chr(31), nr) ELSE concat('s', session_id) END HAVING pageviews > 0),
s AS (SELECT *, pageviews = 1 AND autocaptures = 0 AND duration_us < 10000000 AS bounced FROM facts)"""
_WEB = f"WITH {_EV}, {_SESSIONIZED.replace('RANGE', _RANGE)}"


def _overview_sql(period: Period, name: str) -> str:
    inside = f"us >= {period.start} AND us < {period.end}"
    return f"""(WITH {_EV}, {_SESSIONIZED.replace('RANGE', inside)} SELECT (SELECT count(DISTINCT person) FROM ev WHERE event = '$pageview' AND {inside}) AS visitors, (SELECT count(*) FROM ev WHERE event = '$pageview' AND {inside}) AS pageviews,
        count(*) AS sessions, round(100.0 * count(*) FILTER (WHERE bounced) / nullif(count(*), 0), 6) AS bounce_rate, round(avg(duration_us) / 1000000, 6) AS session_duration_s, '{name}' AS period FROM s)"""


def _entry_sql(column: str) -> str:
    missing = "$direct" if column == "referring_domain" else "$$_none"
    return f"{_WEB} SELECT coalesce(nullif({column}, ''), '{missing}') AS value, count(DISTINCT person) AS visitors, CAST(sum(pageviews) AS BIGINT) AS views, CAST(NULL AS DOUBLE) AS bounce_rate FROM s GROUP BY 1 ORDER BY visitors DESC, views DESC, value LIMIT 20"


def _paths_sql(node: str, start: str | None = None, end: str | None = None, limit: int = 5) -> str:
    begins = f"min(CASE WHEN node = '{start}' THEN n END) OVER (PARTITION BY person)" if start else "1"
    ends = f"min(CASE WHEN node = '{end}' THEN n END) OVER (PARTITION BY person)" if end else "1000000000"
    return f"""{_HOPS.format(node=node, begins=begins, ends=ends, limit=limit)}
        SELECT source, target, count(*) AS persons, round(sum(took) / count(*) / 1e6, 6) AS average_s FROM h GROUP BY 1, 2 ORDER BY persons DESC, source, target LIMIT 1000"""


_HOPS = f"""WITH {_EV}, x AS (SELECT person, us, uuid, {{node}} AS node FROM ev WHERE {_RANGE}), y AS (SELECT *, lag(node) OVER (PARTITION BY person ORDER BY us, uuid) AS b FROM x WHERE node IS NOT NULL),
z AS (SELECT *, row_number() OVER (PARTITION BY person ORDER BY us, uuid) AS n FROM y WHERE b IS NULL OR b <> node), q AS (SELECT *, {{begins}} AS s0, {{ends}} AS e0 FROM z),
p AS (SELECT *, n - s0 + 1 AS step FROM q WHERE n >= s0 AND n <= e0 AND n - s0 + 1 <= {{limit}}),
h AS (SELECT person, concat(step, '_', node) AS source, concat(step + 1, '_', lead(node) OVER w) AS target, lead(us) OVER w - us AS took FROM p WINDOW w AS (PARTITION BY person ORDER BY step) QUALIFY lead(node) OVER w IS NOT NULL)"""
_VIEWED = "CASE WHEN event = '$pageview' THEN pathname END"


def _retention_sql(interval: str, total: int, first_time: bool) -> str:
    starts = retention.periods(NOW, interval, total)
    end = dates.advance(starts[-1], interval)
    number = " ".join(f"WHEN us >= {s} AND us < {e} THEN {i}" for i, (s, e) in enumerate(zip(starts, [*starts[1:], end])))
    target = f"SELECT person, min(us) AS us FROM ev WHERE event = '$pageview' AND us < {end} GROUP BY person" if first_time else "SELECT person, us FROM ev WHERE event = '$pageview'"
    return f"""WITH {_EV}, co AS (SELECT DISTINCT person, CASE {number} END AS c FROM ({target}) t), re AS (SELECT DISTINCT person, CASE {number} END AS r FROM ev WHERE event = '$autocapture'),
        cell AS (SELECT c, 0 AS o, count(*) AS n FROM co WHERE c IS NOT NULL GROUP BY c UNION ALL SELECT c, r - c, count(*) FROM co JOIN re USING (person) WHERE r > c GROUP BY 1, 2)
        SELECT s.st AS cohort_start, CAST(g.o AS INT) AS offset, coalesce(cell.n, 0) AS persons FROM (SELECT i, [{", ".join(map(str, starts))}][i + 1] AS st FROM range({total}) r(i)) s
        JOIN range({total}) g(o) ON s.i + g.o < {total} LEFT JOIN cell ON cell.c = s.i AND cell.o = g.o"""


def _lifecycle_sql(period: Period) -> str:
    starts = dates.buckets(period)
    size = _SIZES[period.interval]
    return f"""WITH {_EV}, a AS (SELECT DISTINCT person, {_bucket(period.interval)} AS b FROM ev WHERE event = '$pageview' AND us < {period.end}), f AS (SELECT person, min(b) AS f FROM a GROUP BY person),
        x AS (SELECT a.b AS bucket, CASE WHEN a.b = f.f THEN 'new' WHEN EXISTS (SELECT 1 FROM a p WHERE p.person = a.person AND p.b = a.b - {size}) THEN 'returning' ELSE 'resurrecting' END AS status, 1 AS v, a.person FROM a JOIN f USING (person)
        UNION ALL SELECT a.b + {size}, 'dormant', -1, a.person FROM a WHERE NOT EXISTS (SELECT 1 FROM a n WHERE n.person = a.person AND n.b = a.b + {size}))
        SELECT g.bucket, k.status, CAST(coalesce((SELECT sum(v) FROM x WHERE x.bucket = g.bucket AND x.status = k.status), 0) AS BIGINT) AS value
        FROM (SELECT unnest([{", ".join(map(str, starts))}])::BIGINT AS bucket) g, (SELECT unnest(['new', 'returning', 'resurrecting', 'dormant']) AS status) k"""


_STICKY = f"st AS (SELECT event, person, count(DISTINCT us // {DAY}) AS n FROM ev WHERE {_RANGE} AND event IN ('$pageview', '$autocapture') GROUP BY 1, 2)"

SQL |= {
    "trends_wau": _trailing_sql(7, FORTNIGHT),
    "trends_mau": _trailing_sql(30, FORTNIGHT),
    "trends_wau_week": _trailing_sql(7, WEEKS),
    "trends_mau_month": _trailing_sql(30, MONTHS),
    "trends_dau_hour": _trend_sql("count(DISTINCT person)", "event = '$pageview'", Period(START, START + 3 * DAY, "hour")),
    "trends_compare": f"SELECT * FROM ({_trend_sql('count(*)', chr(101) + 'vent = ' + repr('$pageview'))}) UNION ALL SELECT * FROM ({_trend_sql('count(*)', 'event = ' + repr('$pageview'), dates.previous(FORTNIGHT), 0, 'previous')})",
    "trends_two_series": f"SELECT * FROM ({_trend_sql('count(DISTINCT person)', 'event = ' + repr('$pageview'))}) UNION ALL SELECT * FROM ({_trend_sql('count(DISTINCT person)', 'event = ' + repr('$autocapture'), series=1)})",
    "trends_formula": f"SELECT 'current' AS period, 0 AS series, CAST(NULL AS VARCHAR) AS breakdown, a.bucket, round(b.value / (a.value + 1) * 100 + 2, 6) AS value FROM ({_trend_sql('count(*)', 'event = ' + repr('$pageview'))}) a JOIN ({_trend_sql('count(*)', 'event = ' + repr('$autocapture'))}) b ON a.bucket IS NOT DISTINCT FROM b.bucket",
    "trends_breakdown_top_other": _breakdown_sql("browser", 3, "count(*)"),
    "trends_breakdown_dau": _breakdown_sql("country", 5, "count(DISTINCT person)"),
    "trends_breakdown_person": _breakdown_sql("json_extract_string(p.properties, '/plan')", 4, "count(*)", "LEFT JOIN persons p ON p.project_id = ev.project_id AND p.id = ev.person"),
    "filter_person": f"WITH {_EV} SELECT event, count(*) AS n FROM ev JOIN persons p ON p.project_id = ev.project_id AND p.id = ev.person WHERE json_extract_string(p.properties, '/plan') = 'team' GROUP BY event",
    "filter_and": f"SELECT event, count(*) AS n FROM captured_events WHERE {_CONDITIONS['exact']} AND {_CONDITIONS['not_icontains']} GROUP BY event",
    "funnel_ordered": _steps_sql(f"{_THREE}, shown AS (SELECT * FROM best)", 3, False),
    "funnel_breakdown": _steps_sql(f"{_THREE}, rk AS (SELECT bd, row_number() OVER (ORDER BY count(*) DESC, bd) AS k FROM best GROUP BY bd), shown AS (SELECT person, times, depth, CASE WHEN k <= 3 THEN bd ELSE '$$_other' END AS bd FROM best JOIN rk USING (bd))", 3, True),
    "funnel_strict": _steps_sql(
        f"""lead2 AS (SELECT person, us, uuid, event, lead(event) OVER w AS e1, lead(us) OVER w AS t1 FROM ev WHERE {_RANGE} WINDOW w AS (PARTITION BY person ORDER BY us, uuid)),
        shown AS (SELECT person, CASE WHEN e1 = '$autocapture' AND t1 - us <= {DAY} THEN [us, t1] ELSE [us] END AS times, len(times) AS depth FROM lead2 WHERE event = '$pageview' QUALIFY row_number() OVER (PARTITION BY person ORDER BY len(times) DESC, us, uuid) = 1)""",
        2,
        False,
    ),
    "funnel_unordered": f"""WITH {_EV}, r AS (SELECT DISTINCT person, us, uuid, event FROM ev WHERE {_RANGE} AND event IN ('$pageview', '$autocapture', '$pageleave')),
        c AS (SELECT a.person, a.us, a.uuid, b.event, min(b.us) AS t FROM r a JOIN r b ON a.person = b.person AND (b.us, b.uuid) >= (a.us, a.uuid) AND b.us <= a.us + {DAY} GROUP BY ALL)
        SELECT person AS person_id, CAST(depth AS INT) AS depth, first_us, last_us FROM (SELECT person, us, uuid, count(*) AS depth, min(t) AS first_us, max(t) AS last_us FROM c GROUP BY ALL) q QUALIFY row_number() OVER (PARTITION BY person ORDER BY depth DESC, us, uuid) = 1""",
    "funnel_exclusion": f"""WITH {_EV}, {_chain(['$pageview', '$autocapture'])}, ok AS (SELECT * FROM a1 a WHERE NOT EXISTS (SELECT 1 FROM ev x WHERE x.person = a.person AND x.event = '$web_vitals' AND {_RANGE} AND (x.us, x.uuid) > (a.t0, a.u0)
        AND CASE WHEN len(a.times) = 2 THEN (x.us, x.uuid) < (a.t, a.u) ELSE x.us <= a.t0 + {DAY} END))
        SELECT person AS person_id, CAST(len(times) AS INT) AS depth, times[1] AS first_us, times[-1] AS last_us FROM ok QUALIFY row_number() OVER (PARTITION BY person ORDER BY len(times) DESC, t0, u0) = 1""",
    "funnel_best_attempt": f"WITH {_EV}, {_THREE} SELECT person AS person_id, CAST(depth AS INT) AS depth, times[1] AS first_us, times[-1] AS last_us FROM best",
    "funnel_time_to_convert": f"""WITH {_EV}, {_THREE}, d AS (SELECT (times[3] - times[1]) / 1e6 AS s FROM best WHERE depth = 3), b AS (SELECT CAST(floor(min(s)) AS BIGINT) AS low, max(s) AS high FROM d),
        w AS (SELECT low, high, greatest(1, CAST(ceil(CAST(trunc(high - low + 1) AS BIGINT) / 10) AS BIGINT)) AS width FROM b)
        SELECT low + k * width AS from_s, width AS width_s, (SELECT count(*) FROM d WHERE floor((s - low) / width) = k) AS n FROM w, range(1000) r(k) WHERE k <= floor((high - low) / width)""",
    "actors_funnel_converted": f"WITH {_EV}, {_THREE} SELECT person AS person_id FROM best WHERE depth > 1",
    "actors_funnel_dropped": f"WITH {_EV}, {_THREE} SELECT person AS person_id FROM best WHERE depth = 1",
    "retention_recurring_day": _retention_sql("day", 8, False),
    "retention_first_time_week": _retention_sql("week", 4, True),
    "actors_retention": f"WITH {_EV} SELECT DISTINCT a.person AS person_id FROM ev a JOIN ev b ON a.person = b.person AND a.event = '$pageview' AND b.event = '$autocapture' AND a.us // {DAY} = {retention.periods(NOW, 'day', 8)[2] // DAY} AND b.us // {DAY} = {retention.periods(NOW, 'day', 8)[5] // DAY}",
    "lifecycle_day": _lifecycle_sql(FORTNIGHT),
    "lifecycle_week": _lifecycle_sql(WEEKS),
    "actors_lifecycle": f"""WITH {_EV}, a AS (SELECT DISTINCT person, us // {DAY} AS b FROM ev WHERE event = '$pageview' AND us < {END})
        SELECT person AS person_id FROM a WHERE b = {START // DAY + 5} AND person IN (SELECT person FROM a WHERE b < {START // DAY + 4}) AND person NOT IN (SELECT person FROM a WHERE b = {START // DAY + 4})""",
    "stickiness_day": f"WITH {_EV}, {_STICKY} SELECT CAST(i AS INT) AS series, CAST(k AS BIGINT) AS n_buckets, (SELECT count(*) FROM st WHERE n = k AND event = ['$pageview', '$autocapture'][i + 1]) AS persons FROM range(2) s(i), range(1, 15) r(k)",
    "actors_stickiness": f"WITH {_EV}, {_STICKY} SELECT person AS person_id FROM st WHERE event = '$pageview' AND n = 2",
    "paths_all": _paths_sql(_VIEWED),
    "paths_start": _paths_sql(_VIEWED, start="/pricing"),
    "paths_end": _paths_sql(_VIEWED, end="/pricing"),
    "paths_custom": _paths_sql("CASE WHEN event = '$pageview' THEN pathname WHEN event NOT LIKE '$%' THEN event END", limit=3),
    "actors_paths": f"{_HOPS.format(node=_VIEWED, begins=1, ends=10**9, limit=5)} SELECT DISTINCT person AS person_id FROM h WHERE source = '1_/' AND target = '2_/pricing'",
    "actors_trends_dau": f"WITH {_EV} SELECT DISTINCT person AS person_id FROM ev WHERE event = '$pageview' AND us // {DAY} = {START // DAY + 3}",
    "actors_trends_wau": f"WITH {_EV} SELECT DISTINCT person AS person_id FROM ev WHERE event = '$pageview' AND us // {DAY} BETWEEN {START // DAY - 3} AND {START // DAY + 3}",
    "actors_trends_session": f"WITH {_EV} SELECT DISTINCT person AS person_id FROM ev WHERE event = '$pageview' AND session_id IS NOT NULL AND us // {DAY} = {START // DAY + 3}",
    "web_sessions": f"{_WEB} SELECT start_at, duration_us, pageviews, autocaptures, entry_page, exit_page, browser, bounced FROM s",
    "web_overview": f"{_overview_sql(FORTNIGHT, 'current')} UNION ALL {_overview_sql(dates.previous(FORTNIGHT), 'previous')}",
    "web_over_time": f"WITH {_EV} SELECT us - us % {DAY} AS bucket, count(DISTINCT person) AS visitors, count(*) AS pageviews FROM ev WHERE event = '$pageview' AND {_RANGE} GROUP BY 1",
    "web_page": f"""{_WEB}, v AS (SELECT pathname AS value, count(DISTINCT person) AS visitors, count(*) AS views FROM ev WHERE event = '$pageview' AND pathname IS NOT NULL AND {_RANGE} GROUP BY 1),
        e AS (SELECT entry_page, round(100.0 * count(*) FILTER (WHERE bounced) / count(*), 6) AS bounce_rate FROM s GROUP BY 1) SELECT value, visitors, views, bounce_rate FROM v LEFT JOIN e ON entry_page = value ORDER BY visitors DESC, views DESC, value LIMIT 20""",
    **{f"web_{c}": f"{_WEB} SELECT {c} AS value, count(DISTINCT person) AS visitors, count(*) AS views, round(100.0 * count(*) FILTER (WHERE bounced) / count(*), 6) AS bounce_rate FROM s WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY visitors DESC, views DESC, value LIMIT 20" for c in ("entry_page", "exit_page")},
    **{f"web_{c}": _entry_sql(c) for c in web.ENTRY_DIMENSIONS},
    "web_live": f"WITH {_EV} SELECT count(DISTINCT person) AS visitors FROM ev WHERE event = '$pageview' AND us >= {NOW - 5 * MINUTE} AND us <= {NOW}",
    "feed_page": f"SELECT uuid, event, distinct_id, epoch_us(timestamp) AS at FROM captured_events WHERE epoch_us(timestamp) < {END} ORDER BY timestamp DESC, uuid DESC LIMIT 200",
    "feed_filtered": f"SELECT uuid, event, epoch_us(timestamp) AS at FROM captured_events WHERE (contains(lower({_text('plan')}), 'team') OR contains(lower({_text('plan')}), 'ent')) AND browser IS NOT NULL ORDER BY timestamp DESC, uuid DESC LIMIT 100",
    "feed_of_person": """WITH ids AS (SELECT project_id, distinct_id, person_id FROM distinct_ids QUALIFY row_number() OVER (PARTITION BY project_id, distinct_id ORDER BY seq DESC, person_id DESC) = 1),
        w AS (SELECT max(distinct_id) AS w FROM person_overrides), mine AS (SELECT distinct_id FROM ids, w WHERE (project_id, person_id) IN (SELECT project_id, person_id FROM ids, w WHERE distinct_id = w UNION ALL SELECT project_id, id FROM persons, w WHERE id = w))
        SELECT uuid, event, epoch_us(timestamp) AS at FROM captured_events WHERE distinct_id IN (SELECT distinct_id FROM mine) ORDER BY timestamp DESC, uuid DESC LIMIT 200""",
    "persons_list": "SELECT id, created_at, coalesce(nullif(trim(json_extract_string(properties, '/email')), ''), nullif(trim(json_extract_string(properties, '/name')), ''), id) AS display_name FROM persons ORDER BY created_at DESC, id DESC LIMIT 100",
    "persons_search": """SELECT id, created_at FROM persons p WHERE starts_with(id, 'u-1') OR EXISTS (SELECT 1 FROM distinct_ids d WHERE d.project_id = p.project_id AND d.person_id = p.id AND starts_with(d.distinct_id, 'u-1'))
        OR contains(lower(coalesce(json_extract_string(properties, '/email'), '')), 'u-1') OR contains(lower(coalesce(json_extract_string(properties, '/name'), '')), 'u-1') ORDER BY created_at DESC, id DESC LIMIT 100""",
    "person_stats": f"""WITH {_EV}, g AS (SELECT person, CASE WHEN us - lag(us) OVER (PARTITION BY person ORDER BY us, uuid) <= {30 * MINUTE} THEN 0 ELSE 1 END AS st FROM ev WHERE session_id IS NULL), r AS (SELECT person, sum(st) AS runs FROM g GROUP BY 1)
        SELECT person AS person_id, count(*) AS event_count, min(us) AS first_seen, max(us) AS last_seen, CAST(count(DISTINCT session_id) + coalesce(any_value(runs), 0) AS BIGINT) AS session_count FROM ev LEFT JOIN r USING (person) GROUP BY 1""",
    "catalog_events": "SELECT event, count(*) AS n, max(epoch_us(timestamp)) AS last_seen FROM captured_events WHERE contains(lower(event), 'e') GROUP BY 1 ORDER BY n DESC, event LIMIT 200",
    "project_status": """SELECT project_id, count(*) FILTER (WHERE retired_generation IS NULL) AS files, CAST(coalesce(sum(rows) FILTER (WHERE retired_generation IS NULL), 0) AS BIGINT) AS rows, CAST(coalesce(sum(bytes) FILTER (WHERE retired_generation IS NULL), 0) AS BIGINT) AS bytes,
        min(day) FILTER (WHERE retired_generation IS NULL) AS first_day, max(day) FILTER (WHERE retired_generation IS NULL) AS last_day, max(created_generation) AS generation FROM lake_files GROUP BY 1""",
    "reconcile_day_event": """WITH a AS (SELECT strftime(timestamp, '%Y-%m-%d') AS day, event, count(*) AS n, count(DISTINCT distinct_id) AS p FROM captured_events GROUP BY ALL), b AS (SELECT strftime(timestamp, '%Y-%m-%d') AS day, event, count(*) AS n, count(DISTINCT distinct_id) AS p FROM event_mirror GROUP BY ALL),
        j AS (SELECT coalesce(a.day, b.day) AS day, coalesce(a.event, b.event) AS event, coalesce(a.n, 0) AS our_events, coalesce(b.n, 0) AS their_events, coalesce(a.p, 0) AS our_persons, coalesce(b.p, 0) AS their_persons FROM a FULL JOIN b ON a.day = b.day AND a.event = b.event)
        SELECT *, abs(our_events - their_events) * 100 <= greatest(our_events, their_events) AND abs(our_persons - their_persons) * 100 <= greatest(our_persons, their_persons) AS ok FROM j""",
}
_SAID = f"SELECT event, CASE WHEN session_id IS NULL THEN us - us % {DAY} ELSE us - us % 1000000 END AS said FROM (SELECT *, epoch_us(timestamp) AS us FROM captured_events) t"
_RANKED = f"m AS (SELECT *, coalesce(nullif(browser, ''), '$$_none') AS bd FROM ev WHERE event = '$pageview' AND {_RANGE}), top AS (SELECT bd FROM m GROUP BY bd ORDER BY count(*) DESC, bd LIMIT 3)"
_CHROME = f"{_RANGE} AND browser = 'Chrome'"
SQL |= {
    "filter_date_before": f"SELECT event, count(*) AS n FROM ({_SAID}) t WHERE said < epoch_us(TIMESTAMP '2018-01-10') GROUP BY 1",
    "filter_date_after": f"SELECT event, count(*) AS n FROM ({_SAID}) t WHERE said > epoch_us(TIMESTAMP '2018-01-10 06:30:00') GROUP BY 1",
    "paths_filtered": SQL["paths_all"].replace(_RANGE, _CHROME),
    "actors_paths_filtered": SQL["actors_paths"].replace(_RANGE, _CHROME),
    "actors_trends_other": f"WITH {_EV}, {_RANKED} SELECT DISTINCT person AS person_id FROM m WHERE bd NOT IN (SELECT bd FROM top)",
    "actors_page": f"WITH {_EV}, p AS (SELECT DISTINCT person FROM ev WHERE event = '$pageview' AND us // {DAY} = {START // DAY + 3} ORDER BY person LIMIT 50 OFFSET 20) SELECT CAST(row_number() OVER (ORDER BY person) - 1 AS INT) AS place, person AS person_id FROM p",
    "trends_all_months": f"SELECT epoch_us(date_trunc('month', timestamp)) AS bucket, CAST(count(*) AS DOUBLE) AS value FROM captured_events WHERE event = '$pageview' AND epoch_us(timestamp) < {dates.trunc(NOW, 'day') + DAY} GROUP BY 1",
    "feed_next_page": f"""WITH e AS (SELECT uuid, event, epoch_us(timestamp) AS us FROM captured_events), a AS (SELECT * FROM e WHERE us < {END} ORDER BY us DESC, uuid DESC LIMIT 151), c AS (SELECT min(us) AS us FROM a WHERE us > (SELECT min(us) FROM a)),
        b AS (SELECT * FROM e WHERE us < (SELECT us FROM c) ORDER BY us DESC, uuid DESC LIMIT 151) SELECT uuid, event, us AS at FROM b WHERE us > (SELECT min(us) FROM b) OR (SELECT count(*) FROM b) <= 150""",
}
_MEMBERS = "m AS (SELECT k AS key, json_extract_string(properties, '/' || replace(replace(k, '~', '~0'), '/', '~1')) AS value FROM (SELECT properties, unnest(json_keys(properties)) AS k FROM captured_events) t)"
SQL["catalog_keys"] = f"""WITH {_MEMBERS}, c AS (SELECT key, CASE WHEN regexp_full_match(value, {_NUMBER}) THEN 'number' WHEN value IN ('true', 'false') THEN 'boolean' ELSE 'string' END AS type, count(*) AS n FROM m WHERE value IS NOT NULL GROUP BY ALL)
    SELECT key, CAST(sum(n) AS BIGINT) AS n, min((-n, type))[2] AS type FROM c GROUP BY key ORDER BY n DESC, key LIMIT 500"""
SQL["catalog_person_keys"] = SQL["catalog_keys"].replace("captured_events", "persons")
SQL["catalog_values"] = f"""WITH {_MEMBERS}, c AS (SELECT key, value, count(*) AS n FROM m WHERE value IS NOT NULL AND value <> '' AND length(value) <= 200 AND NOT regexp_matches(key, '(?i)(^|_)(id|uuid|token)$') GROUP BY ALL)
    SELECT key, value, n FROM c QUALIFY row_number() OVER (PARTITION BY key ORDER BY n DESC, value) <= 100"""
_ALL = f"us >= {WHOLE.start} AND us < {WHOLE.end}"
SQL |= {
    "trends_total_whole": _trend_sql(_MEASURES["total"], "event = '$pageview'", WHOLE),
    "funnel_ordered_whole": SQL["funnel_ordered"].replace(_RANGE, _ALL),
    "paths_all_whole": SQL["paths_all"].replace(_RANGE, _ALL),
    "web_overview_whole": f"{_overview_sql(WHOLE, 'current')} UNION ALL {_overview_sql(dates.previous(WHOLE), 'previous')}",
    "stickiness_day_whole": SQL["stickiness_day"].replace(_RANGE, _ALL).replace("range(1, 15)", f"range(1, {len(dates.buckets(WHOLE)) + 1})"),
}
