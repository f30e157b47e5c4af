"""Counts by event time that are corrected as late events arrive, up to a cut-off.

Panes: one per project and hour, never overlapping. An event changes the one pane that its time
lies in, whenever it arrives; windows are composed of whole panes, so only the windows that cover
a changed pane are composed anew.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.functions.times import HOUR, floor_to

COUNTS = ["n_first", "n_in_time", "n_too_late"]


def batch_arrivals(batches: DataFrame) -> DataFrame:
    """batch_id, arrived_us: the smallest recorded arrival above 0 over all listings of a batch."""
    return batches.where("received_at_ms > 0").groupBy("batch_id").agg((F.min("received_at_ms") * 1000).alias("arrived_us"))


def pane_deltas(events: DataFrame, keys: list[str], pane_us: int = HOUR, lateness_us: int = 48 * HOUR) -> DataFrame:
    """Columns keys, pane, n_first, n_in_time, n_too_late of `events` (keys, at, arrived_us).

    n_first: arrived at or before the pane's end, or unknown when. n_in_time: later, up to
    `lateness_us` after the end (inclusive). n_too_late: the rest. Deltas of separate sets of
    events can be added up, so each micro-batch contributes its own. Events without a time lie in
    no pane. Combined on the map side: a hot key leaves each task as one row per pane.
    """
    end = F.col("pane") + pane_us
    first = F.col("arrived_us").isNull() | (F.col("arrived_us") <= end)
    in_time = F.col("arrived_us") <= end + lateness_us
    placed = events.where(F.col("at").isNotNull()).withColumn("pane", floor_to(F.col("at"), pane_us))
    return placed.groupBy(*keys, "pane").agg(
        F.count_if(first).alias("n_first"),
        F.count_if(~first & in_time).alias("n_in_time"),
        F.count_if(~first & ~in_time).alias("n_too_late"),
    )


def add_deltas(*parts: DataFrame, keys: list[str]) -> DataFrame:
    """Sum of pane tables."""
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole.groupBy(*keys, "pane").agg(*(F.sum(c).alias(c) for c in COUNTS))


def covering(panes: DataFrame, window_us: int, slide_us: int, pane_us: int = HOUR) -> DataFrame:
    """`panes` once for each window [window_start, +window_us) that covers it.

    Window and slide must be whole panes. A window of one pane is the pane itself.
    """
    if window_us % pane_us or slide_us % pane_us or not 0 < slide_us <= window_us:
        raise ValueError("window and slide must be multiples of the pane, and slide at most the window")
    if window_us == pane_us:
        return panes.withColumn("window_start", F.col("pane"))
    last = floor_to(F.col("pane"), slide_us)
    first = floor_to(F.col("pane") - window_us, slide_us) + slide_us
    return panes.withColumn("window_start", F.explode(F.sequence(first, last, F.lit(slide_us))))


def compose(panes: DataFrame, keys: list[str], window_us: int = HOUR, slide_us: int = HOUR, pane_us: int = HOUR) -> DataFrame:
    """Windows from panes: keys, window_start, n_first, n_final (corrected), n_too_late."""
    covered = covering(panes, window_us, slide_us, pane_us)
    if window_us > pane_us:
        covered = covered.groupBy(*keys, "window_start").agg(*(F.sum(c).alias(c) for c in COUNTS))
    return covered.select(*keys, "window_start", "n_first", (F.col("n_first") + F.col("n_in_time")).alias("n_final"), "n_too_late")


def recompose(panes: DataFrame, changed: DataFrame, keys: list[str], window_us: int, slide_us: int, pane_us: int = HOUR) -> DataFrame:
    """Only the windows that cover a pane of `changed` (keys, pane), from the pane table as it is now."""
    touched = covering(changed.select(*keys, "pane").distinct(), window_us, slide_us, pane_us).select(*keys, "window_start").distinct()
    null_safe = [F.col(f"w.{k}").eqNullSafe(F.col(f"t.{k}")) for k in [*keys, "window_start"]]
    condition = null_safe[0]
    for more in null_safe[1:]:
        condition = condition & more
    wanted = covering(panes, window_us, slide_us, pane_us).alias("w").join(touched.alias("t"), condition, "left_semi")
    return wanted.groupBy(*keys, "window_start").agg(*(F.sum(c).alias(c) for c in COUNTS)).select(*keys, "window_start", "n_first", (F.col("n_first") + F.col("n_in_time")).alias("n_final"), "n_too_late")
