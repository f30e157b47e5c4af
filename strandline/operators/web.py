"""Web analytics: visitors, sessions, bounces and where they come from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.contract import Filter, InvalidQuery, Period
from strandline.functions import dates, properties
from strandline.functions.times import MINUTE, SECOND, bucket, floor_to
from strandline.operators.relation import Source, relation, with_person
from strandline.operators.sessions import number_sessions
from strandline.session import local_rows

GAP = 30 * MINUTE
BOUNCE_US = 10 * SECOND
ENTRY_DIMENSIONS = ("referring_domain", "utm_source", "utm_medium", "utm_campaign", "browser", "os", "device_type", "country")
DIRECT = "$direct"
ORDER = ("at", "uuid")


def session_facts(source: Source, period: Period, filters: list[Filter] | None = None) -> DataFrame:
    """One row per session with a pageview: person_id, start_at, duration_us, pageviews,
    autocaptures, entry_page, exit_page, the entry dimensions, bounced.

    A session is all events of a session_id, or a person's run of events without one that no pause
    above 30 minutes interrupts. Entry values are those of the first pageview that has one.
    Bounced: one pageview, no autocapture, under ten seconds. Events without a session_id are
    first combined per person and 30 minutes, so the window that finds the pauses sees at most 48
    rows a day of anyone, however many events they have.
    """
    events = relation(source, period.start, period.end).where(properties.explore_condition(filters or [], period.end))
    named = F.coalesce("session_id", F.lit("")) != ""
    view = F.col("event") == "$pageview"
    first = lambda c: F.min(F.when(view & F.col(c).isNotNull(), F.struct(*ORDER, F.col(c).alias("value"))))
    pieces = events.groupBy(named.alias("named"), F.when(named, F.col("session_id")).otherwise(F.col("person_id")).alias("key"), F.when(named, 0).otherwise(floor_to(F.col("at"), GAP)).alias("slot")).agg(
        F.count_if(view).alias("pageviews"),
        F.count_if(F.col("event") == "$autocapture").alias("autocaptures"),
        F.min("at").alias("slot_start"),
        F.max("at").alias("slot_end"),
        first("person_id").alias("person_id"),
        first("pathname").alias("entry_page"),
        F.max(F.when(view & F.col("pathname").isNotNull(), F.struct(*ORDER, F.col("pathname").alias("value")))).alias("exit_page"),
        *(first(c).alias(c) for c in ENTRY_DIMENSIONS),
    )
    numbered = number_sessions(pieces, ["named", "key"], GAP)
    values = ("person_id", "entry_page", *ENTRY_DIMENSIONS)
    grouped = numbered.groupBy("named", "key", "session_no").agg(
        F.sum("pageviews").alias("pageviews"),
        F.sum("autocaptures").alias("autocaptures"),
        F.min("slot_start").alias("start_at"),
        (F.max("slot_end") - F.min("slot_start")).alias("duration_us"),
        F.max("exit_page")["value"].alias("exit_page"),
        *(F.min(c)["value"].alias(c) for c in values),
    )
    bounced = (F.col("pageviews") == 1) & (F.col("autocaptures") == 0) & (F.col("duration_us") < BOUNCE_US)
    return grouped.where("pageviews > 0").drop("named", "key", "session_no").withColumn("bounced", bounced)


def _rate(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, 100.0 * part / whole)


def period_totals(source: Source, periods: dict[str, Period], filters: list[Filter] | None = None) -> DataFrame:
    """One row per period (column period): visitors, pageviews, sessions, bounce_rate (%),
    session_duration_s. A period without events has none of these but 0.

    The events of all periods are read once and combined per distinct id, session (or 30 minutes
    without one) and period before persons are looked up; visitors and sessions come from these
    pieces. Bounces and durations need no entry values, so none are carried.
    """
    start, end = min(p.start for p in periods.values()), max(p.end for p in periods.values())
    tag = F.coalesce(*(F.when((F.col("at") >= p.start) & (F.col("at") < p.end) & properties.explore_condition(filters or [], p.end), F.lit(n)) for n, p in periods.items()))
    events = relation(source, start, end, person=False).withColumn("period", tag).where(F.col("period").isNotNull())
    counts = lambda: (F.sum("pageviews").alias("pageviews"), F.sum("autocaptures").alias("autocaptures"), F.min("slot_start").alias("slot_start"), F.max("slot_end").alias("slot_end"))
    session = F.nullif("session_id", F.lit(""))
    ids = events.groupBy("period", "project_id", "distinct_id", session.alias("session"), F.when(session.isNull(), floor_to(F.col("at"), GAP)).otherwise(0).alias("slot")).agg(
        F.count_if(F.col("event") == "$pageview").alias("pageviews"), F.count_if(F.col("event") == "$autocapture").alias("autocaptures"), F.min("at").alias("slot_start"), F.max("at").alias("slot_end")
    )
    found = with_person(ids, source)
    # each piece counts twice: for its person's views, and for its session or run of slots
    named = F.col("session").isNotNull()
    own = F.struct(F.lit("person").alias("kind"), F.lit(False).alias("named"), F.col("person_id").alias("key"), F.lit(0).cast("long").alias("slot"))
    part = F.struct(F.lit("session").alias("kind"), named.alias("named"), F.when(named, F.col("session")).otherwise(F.col("person_id")).alias("key"), F.col("slot").cast("long").alias("slot"))
    measures = ["pageviews", "autocaptures", "slot_start", "slot_end"]
    twice = found.select("period", F.explode(F.when(F.col("pageviews") > 0, F.array(own, part)).otherwise(F.array(part))).alias("e"), *measures).select("period", "e.*", *measures)
    keys = ["period", "kind", "named", "key"]
    pieces = twice.groupBy(*keys, "slot").agg(*counts())
    whole = number_sessions(pieces, keys, GAP).groupBy(*keys, "session_no").agg(*counts()).where("pageviews > 0")
    duration, session = F.col("slot_end") - F.col("slot_start"), F.col("kind") == "session"
    bounced = (F.col("pageviews") == 1) & (F.col("autocaptures") == 0) & (duration < BOUNCE_US)
    counted = whole.groupBy("period").agg(
        F.count_if(~session & F.col("key").isNotNull()).alias("visitors"),
        F.sum(F.when(~session, F.col("pageviews"))).alias("pageviews"),
        F.count_if(session).alias("sessions"),
        _rate(F.count_if(session & bounced), F.count_if(session)).alias("bounce_rate"),
        (F.avg(F.when(session, duration)) / SECOND).alias("session_duration_s"),
    )
    names = local_rows(source.events.sparkSession, [(n,) for n in periods], "of_period string")
    joined = names.join(F.broadcast(counted), F.col("of_period") == F.col("period"), "left").drop("period").withColumnRenamed("of_period", "period")  # a row per period
    return joined.select(*(F.coalesce(c, F.lit(0)).alias(c) for c in ("visitors", "pageviews", "sessions")), "bounce_rate", "session_duration_s", "period")


def totals(source: Source, period: Period, filters: list[Filter] | None = None) -> DataFrame:
    """The row of one period."""
    return period_totals(source, {"": period}, filters).drop("period")


def overview(source: Source, period: Period, filters: list[Filter] | None = None, compare: bool = True) -> DataFrame:
    """`period_totals` of the period and, unless it covers all events, of the one before (column period)."""
    return period_totals(source, {"current": period} | ({"previous": dates.previous(period)} if compare else {}), filters)


def over_time(source: Source, period: Period, filters: list[Filter] | None = None) -> DataFrame:
    """bucket, visitors, pageviews for every bucket of the period."""
    views = relation(source, period.start, period.end).where(properties.explore_condition(filters or [], period.end)).where(F.col("event") == "$pageview")
    counted = views.groupBy(bucket(F.col("at"), period.interval).alias("b")).agg(F.countDistinct("person_id").alias("visitors"), F.count(F.lit(1)).alias("pageviews"))
    grid = local_rows(source.events.sparkSession, [(b,) for b in dates.buckets(period)], "bucket long")
    return grid.join(counted, F.col("bucket") == F.col("b"), "left").select("bucket", F.coalesce("visitors", F.lit(0)).alias("visitors"), F.coalesce("pageviews", F.lit(0)).alias("pageviews"))


def breakdown(source: Source, period: Period, by: str, limit: int = 10, filters: list[Filter] | None = None) -> DataFrame:
    """Columns value, visitors, views, bounce_rate: the `limit` values with most visitors.

    page: persons and views per path, with the bounces of the sessions that enter there. entry_page
    and exit_page: sessions and their persons. Others: by the session's entry value; without one
    '$direct' for the referring domain, '$$_none' else.
    """
    if not 1 <= limit <= 100:
        raise InvalidQuery("1 to 100 rows")
    sessions = session_facts(source, period, filters)
    if by == "page":
        views = relation(source, period.start, period.end).where(properties.explore_condition(filters or [], period.end)).where((F.col("event") == "$pageview") & F.col("pathname").isNotNull())
        pages = views.groupBy(F.col("pathname").alias("value")).agg(F.countDistinct("person_id").alias("visitors"), F.count(F.lit(1)).alias("views"))
        entered = sessions.where(F.col("entry_page").isNotNull()).groupBy(F.col("entry_page").alias("e_page")).agg(_rate(F.count_if("bounced"), F.count(F.lit(1))).alias("bounce_rate"))
        found = pages.join(entered, F.col("value") == F.col("e_page"), "left").drop("e_page")
    elif by in ("entry_page", "exit_page"):
        found = sessions.where(F.col(by).isNotNull()).groupBy(F.col(by).alias("value")).agg(F.countDistinct("person_id").alias("visitors"), F.count(F.lit(1)).alias("views"), _rate(F.count_if("bounced"), F.count(F.lit(1))).alias("bounce_rate"))
    elif by in ENTRY_DIMENSIONS:
        missing = F.lit(DIRECT) if by == "referring_domain" else F.lit("$$_none")
        value = F.coalesce(F.nullif(F.col(by), F.lit("")), missing)
        found = sessions.groupBy(value.alias("value")).agg(F.countDistinct("person_id").alias("visitors"), F.sum("pageviews").alias("views"), F.lit(None).cast("double").alias("bounce_rate"))
    else:
        raise InvalidQuery(f"no breakdown by {by!r}")
    return found.select("value", "visitors", "views", "bounce_rate").orderBy(F.desc("visitors"), F.desc("views"), "value").limit(limit)


def live_visitors(source: Source, now: int) -> DataFrame:
    """One row, visitors: persons with a pageview in the five minutes up to now."""
    events = relation(source, now - 5 * MINUTE, now + 1)
    return events.where(F.col("event") == "$pageview").agg(F.countDistinct("person_id").alias("visitors"))
