"""Trends: a measure of one or more series of events over time."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.contract import OTHER, Breakdown, Filter, Period, Series, check_breakdown, check_filters, check_series
from strandline.functions import dates, formula, properties
from strandline.functions.times import DAY, HOUR, WEEK, bucket, floor_to
from strandline.operators.relation import Source, named, needs_person_properties, relation, with_person
from strandline.session import local_rows

#: Up to so many rows a result is sent to the grid of its buckets, not the other way round.
BROADCAST_ROWS = 100_000
TRAILING_DAYS = {"weekly_active": 7, "monthly_active": 30}
PERCENTILES = {"median": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99}


def measure(series: Series) -> Column:
    """The aggregate of a series, as a double; 0 where there is nothing to measure."""
    if series.math == "total":
        value = F.count(F.lit(1))
    elif series.math in ("dau", "weekly_active", "monthly_active"):
        value = F.countDistinct("person_id")
    elif series.math == "unique_session":
        value = F.countDistinct("session_id")
    else:
        n = properties.number(properties.text(series.prop))
        value = F.percentile(n, PERCENTILES[series.math]) if series.math in PERCENTILES else getattr(F, series.math)(n)
    return F.coalesce(value.cast("double"), F.lit(0.0)).alias("value")


def matching(source: Source, series: Series, filters: tuple[Filter, ...], start: int, end: int, breakdown: Breakdown | None, person: bool = False) -> DataFrame:
    """The events of a series, with its breakdown value as `breakdown`; with person_id if asked for or
    if a filter or the breakdown looks at persons."""
    everything = (*series.filters, *filters)
    per_person = needs_person_properties(everything) or (breakdown is not None and breakdown.scope == "person")
    events = relation(source, start, end, person or per_person, per_person).where(named(series.event) & properties.condition(everything))
    value = properties.label(properties.text(breakdown.key, breakdown.scope)) if breakdown else F.lit(None).cast("string")
    return events.withColumn("breakdown", value)


def top_values(events: DataFrame, limit: int) -> tuple[list[str], bool]:
    """The breakdown values with most events, and whether there are more."""
    ranked = events.groupBy("breakdown").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "breakdown").limit(limit + 1).collect()
    return [r["breakdown"] for r in ranked[:limit]], len(ranked) > limit


def fold(value: Column, top: list[str]) -> Column:
    """A value of the top list, or the one that stands for all others."""
    return F.when(value.isin(top), value).otherwise(F.lit(OTHER)) if top else F.lit(OTHER)


def active_persons(source: Source, events: DataFrame, unit: Column) -> DataFrame:
    """breakdown, unit, person_id, each once: reduced to distinct ids before their persons are looked up."""
    if "person_id" in events.columns:
        return events.select("breakdown", unit.alias("unit"), "person_id").distinct()
    ids = events.select("breakdown", unit.alias("unit"), "project_id", "distinct_id").distinct()
    return with_person(ids, source).select("breakdown", "unit", "person_id")


def trailing(active: DataFrame, period: Period, n_days: int) -> DataFrame:
    """Different persons in the n days up to each bucket's end, per breakdown and bucket, from
    `active_persons`.

    Each person's active hours or days are reduced to one row each and sent to the few buckets
    whose windows cover them, found by arithmetic: an equi-aggregation, no join by range.
    """
    span = n_days * DAY
    active = active.withColumnRenamed("unit", "granule")
    if period.interval == "month":
        first = bucket(F.col("granule"), "month")
        later = bucket(F.col("granule") + span, "month")
        candidates = F.array_distinct(F.array(first, bucket(first + 31 * DAY, "month"), later))
        end_of = lambda b: bucket(b + 31 * DAY, "month")
    else:
        size = {"hour": HOUR, "day": DAY, "week": WEEK}[period.interval]
        candidates = F.sequence(bucket(F.col("granule"), period.interval), bucket(F.col("granule") + span, period.interval), F.lit(size))
        end_of = lambda b: b + size
    covered = F.filter(candidates, lambda b: (end_of(b) > F.col("granule")) & (end_of(b) - span <= F.col("granule")))
    placed = active.withColumn("bucket", F.explode(covered)).where(F.col("bucket").between(dates.trunc(period.start, period.interval), period.end - 1))
    return placed.groupBy("breakdown", "bucket").agg(F.countDistinct("person_id").cast("double").alias("value"))


def one_series(source: Source, series: Series, period: Period, filters: tuple[Filter, ...], breakdown: Breakdown | None, top: tuple[list[str], bool] | None) -> DataFrame:
    """breakdown, bucket (null: the whole period), value; buckets without events are missing."""
    n_days = TRAILING_DAYS.get(series.math)
    start = period.start - (n_days + 1) * DAY if n_days else period.start
    events = matching(source, series, filters, start, period.end, breakdown)
    if breakdown:
        events = events.withColumn("breakdown", fold(F.col("breakdown"), top[0]))
    if n_days:
        granule = floor_to(F.col("at"), HOUR if period.interval == "hour" else DAY)
        inside = active_persons(source, events.where(F.col("at") >= period.start), F.lit(None).cast("long"))
        whole = inside.groupBy("breakdown").agg(measure(series)).withColumn("bucket", F.lit(None).cast("long"))
        return trailing(active_persons(source, events, granule), period, n_days).unionByName(whole)
    if series.math == "dau":
        timed = active_persons(source, events, bucket(F.col("at"), period.interval)).withColumnRenamed("unit", "bucket")
    else:
        timed = events.withColumn("bucket", bucket(F.col("at"), period.interval))
    sets = timed.groupingSets([[F.col("breakdown"), F.col("bucket")], [F.col("breakdown")]], F.col("breakdown"), F.col("bucket"))
    return sets.agg(measure(series))


def trends(source: Source, series: list[Series], period: Period, filters: tuple[Filter, ...] = (), breakdown: Breakdown | None = None, formula_text: str | None = None, compare: bool = False) -> DataFrame:
    """Columns period ('current' or 'previous'), series, breakdown, bucket, value.

    One row for every series, breakdown value and bucket, zeros included, and one with bucket null
    for the whole period. Without breakdown each series is one row set with breakdown null; with a
    breakdown a series shows its `limit` values with most events and '$$_other' for the rest; a
    missing or empty value is '$$_none'. The ranking of the current period holds for the previous
    one too. With a formula there is the single series 0, its result; missing values count as 0.
    Trailing maths count, per bucket, the persons of the 7 or 30 days up to the bucket's end, and
    for the whole period those within it. Events without a timestamp lie in no period.
    """
    check_series(series)
    check_filters(filters)
    check_breakdown(breakdown)
    tops = [None] * len(series)
    if breakdown:
        tops = [top_values(matching(source, s, filters, period.start, period.end, breakdown), breakdown.limit) for s in series]
    parts = [_filled(source, series, p, filters, breakdown, tops, name, formula_text) for p, name in ((period, "current"), (dates.previous(period), "previous"))[: 1 + compare]]
    return reduce(DataFrame.unionByName, parts)


def _filled(source: Source, series: list[Series], period: Period, filters: tuple[Filter, ...], breakdown: Breakdown | None, tops: list, name: str, formula_text: str | None) -> DataFrame:
    spark = source.events.sparkSession
    starts = dates.buckets(period)
    found = reduce(DataFrame.unionByName, (one_series(source, s, period, filters, breakdown, tops[i]).withColumn("series", F.lit(i)) for i, s in enumerate(series)))
    if breakdown:
        shown = [(i, v) for i, top in enumerate(tops) for v in [*top[0], *([OTHER] if top[1] else [])]]
        if formula_text is not None:
            keys = list(dict.fromkeys(v for _, v in shown))
            shown = [(i, v) for i in range(len(series)) for v in keys]
    else:
        shown = [(i, None) for i in range(len(series))]
    if not shown:
        return spark.createDataFrame([], "period string, series int, breakdown string, bucket long, value double")
    # at most 20 series of 301 values by 10,001 buckets, made where they are needed
    grid = local_rows(spark, shown, "g_series int, g_breakdown string").withColumn("g_bucket", F.explode(F.array_append(F.lit(np.array(starts, dtype=np.int64)), F.lit(None).cast("long"))))
    same = (F.col("g_series") == F.col("series")) & F.col("g_breakdown").eqNullSafe(F.col("breakdown")) & F.col("g_bucket").eqNullSafe(F.col("bucket"))
    # after folding there is at most one row for each of the grid
    if len(shown) * (len(starts) + 1) <= BROADCAST_ROWS:
        found = F.broadcast(found)
    filled = grid.join(found, same, "left").select(F.lit(name).alias("period"), F.col("g_series").alias("series"), F.col("g_breakdown").alias("breakdown"), F.col("g_bucket").alias("bucket"), F.coalesce("value", F.lit(0.0)).alias("value"))
    if formula_text is None:
        return filled
    values = [F.coalesce(F.sum(F.when(F.col("series") == i, F.col("value"))), F.lit(0.0)) for i in range(len(series))]
    wide = filled.groupBy("period", "breakdown", "bucket").agg(*(v.alias(f"v{i}") for i, v in enumerate(values)))
    result = formula.column(formula_text, [F.col(f"v{i}") for i in range(len(series))])
    return wide.select("period", F.lit(0).alias("series"), "breakdown", "bucket", result.alias("value"))


def actors(source: Source, series: Series, period: Period, at: int | None, filters: tuple[Filter, ...] = (), breakdown: Breakdown | None = None, shown: str | None = None) -> DataFrame:
    """person_id of everyone behind one point: a bucket start, or the whole period if None.

    Trailing maths look at the window up to the bucket's end, clipped to the period's end; session
    counts need a session, property maths a number. `shown`: a breakdown value as the chart shows it,
    '$$_other' for everyone outside the values of the whole period it shows.
    """
    check_series([series])
    n_days = TRAILING_DAYS.get(series.math)
    start, end = (period.start, period.end) if at is None else (at, min(dates.advance(at, period.interval), period.end))
    if at is not None and n_days:
        start = dates.advance(at, period.interval) - n_days * DAY
    elif at is not None:
        start = max(start, period.start)
    events = matching(source, series, filters, start, end, breakdown, True)
    if series.math == "unique_session":
        events = events.where(F.col("session_id").isNotNull())
    if series.prop is not None:
        events = events.where(properties.number(properties.text(series.prop)).isNotNull())
    if shown is not None and breakdown is not None:
        top, _ = top_values(matching(source, series, filters, period.start, period.end, breakdown), breakdown.limit)
        events = events.where(fold(F.col("breakdown"), top) == shown)
    return events.select("person_id").distinct()


