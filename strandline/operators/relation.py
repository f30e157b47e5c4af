"""The event relation that every insight starts from."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.contract import Filter
from strandline.functions.times import micros


@dataclass(frozen=True)
class Source:
    """Events with their identity tables. `events` has the columns of the event schema and
    project_id; the identity tables may be missing."""

    events: DataFrame
    overrides: DataFrame | None = None
    persons: DataFrame | None = None


def needs_person_properties(filters: tuple[Filter, ...]) -> bool:
    return any(f.scope == "person" for f in filters)


def relation(source: Source, start: int | None = None, end: int | None = None, person: bool = True, person_properties: bool = False) -> DataFrame:
    """Events of [start, end) with `at` (µs) and, if asked for, person_id and person_properties.

    The range is a condition on the timestamp column itself, so it reaches the Parquet scan. The
    identity join is left out where no person is needed. A person is the override of its
    distinct_id, or the distinct_id. Whether the overrides are broadcast is left to the optimizer,
    which knows their size; a hot distinct_id in a shuffled join is split at run time.
    """
    events = source.events
    if start is not None:
        events = events.where(F.col("timestamp") >= F.timestamp_micros(F.lit(start)))
    if end is not None:
        events = events.where(F.col("timestamp") < F.timestamp_micros(F.lit(end)))
    events = events.withColumn("at", micros(events, "timestamp"))
    if not person:
        return events
    events = with_person(events, source)
    if person_properties:
        if source.persons is None:
            return events.withColumn("person_properties", F.lit(None).cast("string"))
        known = source.persons.select(F.col("project_id").alias("p_project"), F.col("id").alias("p_id"), F.col("properties").alias("person_properties"))
        events = events.join(known, (F.col("project_id") == F.col("p_project")) & (F.col("person_id") == F.col("p_id")), "left").drop("p_project", "p_id")
    return events


def with_person(rows: DataFrame, source: Source) -> DataFrame:
    """Any rows with project_id and distinct_id, with their person_id. Rows that are combined per
    distinct_id before are fewer to join: of a hot id one a bucket, not all its events."""
    if source.overrides is None:
        return rows.withColumn("person_id", F.col("distinct_id"))
    own = source.overrides.select(F.col("project_id").alias("o_project"), F.col("distinct_id").alias("o_id"), F.col("person_id").alias("o_person"))
    joined = rows.join(own, (F.col("project_id") == F.col("o_project")) & (F.col("distinct_id") == F.col("o_id")), "left")
    return joined.withColumn("person_id", F.coalesce("o_person", "distinct_id")).drop("o_project", "o_id", "o_person")


def named(event: str | None) -> Column:
    """The event has this name; any event if there is none."""
    return F.lit(True) if event is None else F.col("event") == event


def earliest_event(events: DataFrame) -> int | None:
    """Microseconds of the first event, for periods that start with it."""
    return events.agg(F.min(micros(events, "timestamp")).alias("at")).first()["at"]
