"""Event feed, persons, catalogs, project status and reconciliation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.contract import Filter, InvalidQuery
from strandline.functions import properties
from strandline.functions.times import MINUTE, day_text, micros
from strandline.operators.relation import Source, relation
from strandline.operators.sessions import activity_slots, run_count

MAX_PAGE = 200


def feed(events: DataFrame, limit: int = 50, before: int | None = None, event: str | None = None, distinct_ids: DataFrame | None = None, filters: list[Filter] | None = None, now: int = 0) -> DataFrame:
    """The newest events first, at most `limit`, before a moment if given.

    A top-k by time and uuid: no full sort. A person's feed takes its distinct ids; none, no rows.
    """
    if not 1 <= limit <= MAX_PAGE:
        raise InvalidQuery("1 to 200 events")
    rows = events if before is None else events.where(F.col("timestamp") < F.timestamp_micros(F.lit(before)))
    rows = rows.withColumn("at", micros(rows, "timestamp")).where(properties.explore_condition(filters or [], now))
    if event is not None:
        rows = rows.where(F.col("event") == event)
    if distinct_ids is not None:
        rows = rows.join(distinct_ids.select("distinct_id"), "distinct_id", "left_semi")
    return rows.orderBy(F.desc("at"), F.desc("uuid")).limit(limit)


def page(events: DataFrame, limit: int = 50, before: int | None = None, **more: object) -> tuple[list, int | None]:
    """One page of the feed and the cursor of the next: rows that share their microsecond with the
    next page's first are left to it, unless the whole page is one microsecond."""
    if not 1 <= limit < MAX_PAGE:
        raise InvalidQuery("1 to 199 events a page")
    rows = feed(events, limit + 1, before, **more).collect()
    return cut(rows, limit, lambda r: r["at"])


def cut(rows: list, limit: int, at) -> tuple[list, int | None]:
    """The rows of a page from limit + 1 rows, newest first, and the next page's cursor."""
    if len(rows) <= limit:
        return rows, None
    tied = at(rows[limit])
    kept = [r for r in rows[:limit] if at(r) != tied]
    if not kept:
        return rows[:limit], at(rows[limit - 1])
    return kept, at(kept[-1])


def display_name(document: Column, first_id: Column) -> Column:
    """A person's email, else name, else first id."""
    text = lambda key: F.nullif(F.trim(properties.json_text(document, key)), F.lit(""))
    return F.coalesce(text("email"), text("name"), first_id)


def persons(people: DataFrame, distinct_ids: DataFrame, search: str | None = None, limit: int = 100, before: tuple[str, str] | None = None) -> DataFrame:
    """Newest persons first, at most `limit` <= 100; searched by prefix of an id, or part of email or name."""
    if not 1 <= limit <= 100:
        raise InvalidQuery("1 to 100 persons")
    rows = people
    if before is not None:
        rows = rows.where(F.struct("created_at", "id") < F.struct(F.lit(before[0]), F.lit(before[1])))
    if search:
        held = distinct_ids.where(F.col("distinct_id").startswith(search)).select(F.col("project_id").alias("h_project"), F.col("person_id").alias("h_person")).distinct()
        rows = rows.join(held, (F.col("project_id") == F.col("h_project")) & (F.col("id") == F.col("h_person")), "left")
        inside = reduce(lambda a, b: a | b, (F.contains(F.lower(F.coalesce(properties.json_text(F.col("properties"), k), F.lit(""))), F.lit(search.lower())) for k in ("email", "name")))
        rows = rows.where(F.col("h_person").isNotNull() | F.col("id").startswith(search) | inside)
    return rows.orderBy(F.desc("created_at"), F.desc("id")).limit(limit).select("project_id", "id", "created_at", "is_identified", display_name(F.col("properties"), F.col("id")).alias("display_name"))


def find_person(people: DataFrame, distinct_ids: DataFrame, wanted: str) -> DataFrame:
    """The person with this id, or with this distinct id."""
    owner = distinct_ids.where(F.col("distinct_id") == wanted).groupBy("project_id").agg(F.max_by("person_id", "seq").alias("person_id"))
    ids = owner.select("project_id", F.col("person_id").alias("id")).unionByName(people.where(F.col("id") == wanted).select("project_id", "id")).distinct()
    return people.join(ids, ["project_id", "id"], "left_semi")


def person_stats(source: Source) -> DataFrame:
    """person_id, event_count, first_seen, last_seen (µs), session_count of everyone with events:
    different session ids plus the runs of events without one."""
    events = relation(source)
    base = events.groupBy("person_id").agg(F.count(F.lit(1)).alias("event_count"), F.min("at").alias("first_seen"), F.max("at").alias("last_seen"), F.countDistinct("session_id").alias("ids"))
    runs = run_count(activity_slots(events.where(F.col("session_id").isNull()).select("person_id", "at"), ["person_id"], "at", 30 * MINUTE), ["person_id"])
    runs = runs.select(F.col("person_id").alias("r_person"), "runs")
    joined = base.join(runs, F.col("person_id") == F.col("r_person"), "left")
    return joined.select("person_id", "event_count", "first_seen", "last_seen", (F.col("ids") + F.coalesce("runs", F.lit(0))).alias("session_count"))


def event_names(events: DataFrame, search: str = "", limit: int = 200) -> DataFrame:
    """event, n, last_seen (µs): names that contain the text, most frequent first."""
    rows = events.where(F.contains(F.lower("event"), F.lit(search.lower())))
    rows = rows.withColumn("at", micros(rows, "timestamp"))
    return rows.groupBy("event").agg(F.count(F.lit(1)).alias("n"), F.max("at").alias("last_seen")).orderBy(F.desc("n"), "event").limit(limit)


def _members(document: Column) -> Column:
    return F.explode(F.map_entries(F.from_json(document, "map<string,string>")))


def property_keys(rows: DataFrame, document: str = "properties", limit: int = 500) -> DataFrame:
    """key, n, type: every top-level key with the type its values have most often (ties by name)."""
    members = rows.select(_members(F.col(document)).alias("m")).select("m.key", "m.value").where(F.col("value").isNotNull())
    kind = F.when(F.col("value").rlike(properties.NUMBER), "number").when(F.col("value").isin("true", "false"), "boolean").otherwise("string")
    counted = members.groupBy("key", kind.alias("type")).agg(F.count(F.lit(1)).alias("n"))
    by_key = counted.groupBy("key").agg(F.sum("n").alias("total"), F.min(F.struct((-F.col("n")).alias("less"), "type")).alias("most"))
    return by_key.select("key", F.col("total").alias("n"), F.col("most.type").alias("type")).orderBy(F.desc("n"), "key").limit(limit)


def property_values(rows: DataFrame, document: str = "properties", per_key: int = 100, max_chars: int = 200) -> DataFrame:
    """key, value, n: the most frequent short values of every key; keys that look like ids are left out."""
    members = rows.select(_members(F.col(document)).alias("m")).select("m.key", "m.value")
    usable = members.where(F.col("value").isNotNull() & (F.col("value") != "") & (F.length("value") <= max_chars) & ~F.col("key").rlike(r"(?i)(^|_)(id|uuid|token)$"))
    counted = usable.groupBy("key", "value").agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("n"), "value"))
    return counted.withColumn("rank", rank).where(F.col("rank") <= per_key).select("key", "value", "n")


def project_status(lake_files: DataFrame) -> DataFrame:
    """Per project: live files, rows, bytes, first and last day, latest generation."""
    live = F.col("retired_generation").isNull()
    return lake_files.groupBy("project_id").agg(
        F.count_if(live).alias("files"),
        F.coalesce(F.sum(F.when(live, F.col("rows"))), F.lit(0)).alias("rows"),
        F.coalesce(F.sum(F.when(live, F.col("bytes"))), F.lit(0)).alias("bytes"),
        F.min(F.when(live, F.col("day"))).alias("first_day"),
        F.max(F.when(live, F.col("day"))).alias("last_day"),
        F.max("created_generation").alias("generation"),
    )


def reconcile(ours: DataFrame, theirs: DataFrame, tolerance_percent: float = 1.0) -> DataFrame:
    """day, event, our_events, their_events, our_persons, their_persons, ok: two systems' counts
    side by side; ok if they differ by at most the tolerance of the larger."""

    def counts(rows: DataFrame, tag: str) -> DataFrame:
        rows = rows.withColumn("at", micros(rows, "timestamp"))
        return rows.groupBy(day_text(F.col("at")).alias(f"{tag}_day"), F.col("event").alias(f"{tag}_event")).agg(F.count(F.lit(1)).alias(f"{tag}_events"), F.countDistinct("distinct_id").alias(f"{tag}_persons"))

    joined = counts(ours, "our").join(counts(theirs, "their"), F.col("our_day").eqNullSafe(F.col("their_day")) & F.col("our_event").eqNullSafe(F.col("their_event")), "full_outer")
    numbers = {c: F.coalesce(c, F.lit(0)) for c in ("our_events", "their_events", "our_persons", "their_persons")}
    near = lambda a, b: F.abs(a - b) * 100 <= F.greatest(a, b) * tolerance_percent
    ok = near(numbers["our_events"], numbers["their_events"]) & near(numbers["our_persons"], numbers["their_persons"])
    return joined.select(F.coalesce("our_day", "their_day").alias("day"), F.coalesce("our_event", "their_event").alias("event"), *(c.alias(n) for n, c in numbers.items()), ok.alias("ok"))
