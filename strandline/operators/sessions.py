"""Sessions: each key's events split where the activity pauses."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.times import MINUTE, floor_to


def activity_slots(df: DataFrame, keys: list[str], at: str, gap_us: int = 30 * MINUTE) -> DataFrame:
    """Per key and gap-long slot of time: first and last event and the number of events.

    Two events of one slot are less than the gap apart, so no session ends inside a slot. The
    slots of a key are bounded by time, not by its rows, and are combined on the map side: even a
    key with a third of all rows reaches the window below as 48 rows a day (for 30 minutes).
    """
    return df.groupBy(*keys, floor_to(F.col(at), gap_us).alias("slot")).agg(F.min(at).alias("slot_start"), F.max(at).alias("slot_end"), F.count(F.lit(1)).alias("slot_events"))


def number_sessions(slots: DataFrame, keys: list[str], gap_us: int = 30 * MINUTE) -> DataFrame:
    """`slots` with the session's number in its key: lag flags the gaps, a running sum counts them."""
    by_time = Window.partitionBy(*keys).orderBy("slot")
    paused = F.col("slot_start") - F.lag("slot_end").over(by_time) > gap_us
    flagged = slots.withColumn("starts", F.coalesce(paused.cast("int"), F.lit(1)))
    return flagged.withColumn("session_no", F.sum("starts").over(by_time.rowsBetween(Window.unboundedPreceding, 0)))


def sessionize(df: DataFrame, keys: list[str], at: str, gap_us: int = 30 * MINUTE) -> DataFrame:
    """Columns: keys, session_no, start_us, end_us, duration_us, n_events.

    `at` holds microseconds. A session starts where more than `gap_us` passed since the key's
    previous event; exactly the gap keeps it open. Events at the same instant are one moment of
    the same session. Events without a time can't be placed and belong to no session. Null keys
    form a group of their own. An empty table gives no sessions.
    """
    slots = activity_slots(df.where(F.col(at).isNotNull()).select(*keys, at), keys, at, gap_us)
    return (
        number_sessions(slots, keys, gap_us)
        .groupBy(*keys, "session_no")
        .agg(F.min("slot_start").alias("start_us"), F.max("slot_end").alias("end_us"), F.sum("slot_events").alias("n_events"))
        .select(*keys, "session_no", "start_us", "end_us", (F.col("end_us") - F.col("start_us")).alias("duration_us"), "n_events")
    )


def event_sessions(events: DataFrame, gap_us: int = 30 * MINUTE) -> DataFrame:
    """Sessions per distinct_id and session_id of unique events (uuid, at, distinct_id, session_id).

    Events without a session_id (null or empty) form a group of their own per distinct_id, shown
    as ''. A session_id that is never renewed is split like any other group.
    """
    grouped = events.select("distinct_id", F.coalesce("session_id", F.lit("")).alias("session_id"), "at")
    return sessionize(grouped, ["distinct_id", "session_id"], "at", gap_us)


def run_count(slots: DataFrame, keys: list[str], gap_us: int = 30 * MINUTE) -> DataFrame:
    """Number of sessions per key from its slots (slot, slot_start, slot_end)."""
    return number_sessions(slots, keys, gap_us).groupBy(*keys).agg(F.sum("starts").alias("runs"))
