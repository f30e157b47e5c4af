"""Retention: of those who did one thing in a period, who did another later."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.contract import MAX_RETENTION, InvalidQuery, Period, Series, check_series
from strandline.functions import dates, properties
from strandline.functions.times import bucket
from strandline.operators.relation import Source, named, needs_person_properties, relation
from strandline.session import local_rows


def periods(now: int, interval: str, total: int) -> list[int]:
    """Starts of the last `total` buckets, the one with `now` included."""
    if not 1 <= total <= MAX_RETENTION:
        raise InvalidQuery("1 to 100 intervals")
    at = dates.trunc(now, interval)
    starts = [at]
    for _ in range(total - 1):
        at = dates.trunc(at - 1, interval)
        starts.append(at)
    return starts[::-1]


def _active(source: Source, series: Series, start: int | None, end: int, starts: list[int], interval: str, first_time: bool) -> DataFrame:
    """Different (person_id, period number) with a matching event; or each person's first ever."""
    events = relation(source, None if first_time else start, end, True, needs_person_properties(series.filters))
    matching = events.where(named(series.event) & properties.condition(series.filters))
    at = F.col("at")
    if first_time:
        matching = matching.groupBy("person_id").agg(F.min("at").alias("at")).where(F.col("at") >= start)
    number = F.array_position(F.lit(np.array(starts, dtype=np.int64)), bucket(at, interval)) - 1
    return matching.select("person_id", number.cast("int").alias("period")).where("period >= 0").distinct()


def members(source: Source, target: Series, returning: Series, now: int, interval: str = "day", total: int = 8, first_time: bool = False) -> DataFrame:
    """Columns cohort, offset, person_id: everyone in each cell; offset 0 is the whole cohort.

    A person is in the cohort of every period with the target event, or only in that of their first
    one ever. Cell (c, k) has the members of cohort c with the returning event in period c + k.
    """
    check_series([target, returning])
    starts = periods(now, interval, total)
    end = dates.advance(starts[-1], interval)
    cohorts = _active(source, target, starts[0], end, starts, interval, first_time).withColumnRenamed("period", "cohort")
    back = _active(source, returning, starts[0], end, starts, interval, False).select(F.col("person_id").alias("r_person"), "period")
    later = cohorts.join(back, (F.col("person_id") == F.col("r_person")) & (F.col("period") > F.col("cohort"))).select("cohort", (F.col("period") - F.col("cohort")).alias("offset"), "person_id")
    return cohorts.select("cohort", F.lit(0).alias("offset"), "person_id").unionByName(later)


def retention(source: Source, target: Series, returning: Series, now: int, interval: str = "day", total: int = 8, first_time: bool = False) -> DataFrame:
    """Columns cohort_start, offset, persons: cohort c has the total - c cells up to the last period."""
    starts = periods(now, interval, total)
    counted = members(source, target, returning, now, interval, total, first_time).groupBy("cohort", "offset").agg(F.count(F.lit(1)).alias("persons"))
    cells = [(c, o, starts[c]) for c in range(total) for o in range(total - c)]
    grid = local_rows(source.events.sparkSession, cells, "g_cohort int, g_offset int, cohort_start long")
    joined = grid.join(counted, (F.col("g_cohort") == F.col("cohort")) & (F.col("g_offset") == F.col("offset")), "left")
    return joined.select("cohort_start", F.col("g_offset").alias("offset"), F.coalesce("persons", F.lit(0)).alias("persons"))


def lifecycle_cells(source: Source, series: Series, period: Period) -> DataFrame:
    """Columns bucket, status, person_id. new: first bucket ever; returning: active in the one
    before, too; resurrecting: active, but not in the one before; dormant: active in the one
    before, not in this. The bucket that holds the period's start counts whole."""
    check_series([series])
    starts = dates.buckets(period)
    before = dates.trunc(starts[0] - 1, period.interval)
    ordinal = {s: i for i, s in enumerate([before, *starts])}
    everything = relation(source, None, period.end, True, needs_person_properties(series.filters)).where(named(series.event) & properties.condition(series.filters))
    active = everything.select("person_id", bucket(F.col("at"), period.interval).alias("bucket")).distinct()
    person = Window.partitionBy("person_id")
    known = active.withColumn("first", F.min("bucket").over(person)).where(F.col("bucket") >= before)
    number = F.array_position(F.lit(np.array(list(ordinal), dtype=np.int64)), F.col("bucket")).cast("int") - 1
    known = known.withColumn("no", number)
    ordered = person.orderBy("no")
    known = known.withColumn("last_no", F.lag("no").over(ordered)).withColumn("next_no", F.lead("no").over(ordered))
    status = F.when(F.col("bucket") == F.col("first"), "new").when(F.col("last_no") == F.col("no") - 1, "returning").otherwise("resurrecting")
    here = known.where("no > 0").select("bucket", status.alias("status"), "person_id")
    following = F.get(F.lit(np.array(starts, dtype=np.int64)), F.col("no"))
    gone = known.where((F.coalesce("next_no", F.lit(-1)) != F.col("no") + 1) & (F.col("no") < len(starts)))
    return here.unionByName(gone.select(following.alias("bucket"), F.lit("dormant").alias("status"), "person_id"))


def lifecycle(source: Source, series: Series, period: Period) -> DataFrame:
    """Columns bucket, status, value for all four statuses of every bucket; dormant is negative."""
    counted = lifecycle_cells(source, series, period).groupBy("bucket", "status").agg(F.count(F.lit(1)).alias("n"))
    cells = [(b, s) for b in dates.buckets(period) for s in ("new", "returning", "resurrecting", "dormant")]
    grid = local_rows(source.events.sparkSession, cells, "g_bucket long, g_status string")
    joined = grid.join(counted, (F.col("g_bucket") == F.col("bucket")) & (F.col("g_status") == F.col("status")), "left")
    n = F.coalesce("n", F.lit(0))
    return joined.select(F.col("g_bucket").alias("bucket"), F.col("g_status").alias("status"), F.when(F.col("g_status") == "dormant", -n).otherwise(n).alias("value"))


def active_buckets(source: Source, series: Series, period: Period) -> DataFrame:
    """person_id, n: in how many buckets of the period each person has the event."""
    check_series([series])
    events = relation(source, period.start, period.end, True, needs_person_properties(series.filters)).where(named(series.event) & properties.condition(series.filters))
    return events.groupBy("person_id").agg(F.countDistinct(bucket(F.col("at"), period.interval)).alias("n"))


def stickiness(source: Source, series: list[Series], period: Period) -> DataFrame:
    """Columns series, n_buckets, persons: how many persons are active in exactly so many buckets,
    from one to all of them."""
    total = len(dates.buckets(period))
    out = None
    for i, s in enumerate(series):
        counted = active_buckets(source, s, period).groupBy("n").agg(F.count(F.lit(1)).alias("persons"))
        grid = source.events.sparkSession.range(1, total + 1).withColumnRenamed("id", "n_buckets")
        part = grid.join(counted, F.col("n_buckets") == F.col("n"), "left").select(F.lit(i).alias("series"), "n_buckets", F.coalesce("persons", F.lit(0)).alias("persons"))
        out = part if out is None else out.unionByName(part)
    return out
