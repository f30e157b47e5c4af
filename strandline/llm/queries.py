"""The pN_ queries of the llm problems, over the tables of a data folder, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions.times import DAY, day_text, micros
from strandline.llm import bitmaps, mixing, stuffed_pages, subsequences, tokenizer
from strandline.plans.problem_queries import table, unique_captured
from strandline.session import materialize, scratch

CELL = ["day", "event", "project_id", "country"]


def _by_day(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "captured_events")
    return events.select(day_text(micros(events, "timestamp")).alias("day"), "event", "project_id", "country", "distinct_id")


def p1_distinct(spark: SparkSession, folder: str) -> DataFrame:
    """Different distinct_ids per day, per event and per day, event, project and country."""
    sets = {"day": ["day"], "event": ["event"], "day_event_project_country": CELL}
    return bitmaps.distinct_counts(_by_day(spark, folder), "distinct_id", sets, "project_id").select("grouping", *CELL, "n_distinct", "error_bound")


def p1_trailing_week(spark: SparkSession, folder: str) -> DataFrame:
    """Different distinct_ids per project in the seven days up to each day: OR of the days' bitmaps,
    which are written down once, packed by bucket."""
    events = table(spark, folder, "captured_events")
    us = micros(events, "timestamp")
    rows = events.select("project_id", ((us - F.pmod(us, F.lit(DAY))) / F.lit(DAY)).cast("long").alias("day_no"), "distinct_id")
    groups = ["project_id", "day_no"]
    words = bitmaps.union(bitmaps.member_words(rows, groups, "distinct_id", bitmaps.dictionary(rows, "distinct_id", "project_id")), groups)
    daily = materialize(bitmaps.pack(words, groups))
    weekly = daily.withColumn("day_no", F.explode(F.sequence("day_no", F.col("day_no") + 6)))
    return bitmaps.cardinality(bitmaps.union(bitmaps.unpack(weekly, groups), groups), groups)


def p1_two_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Different distinct_ids per day and event, from bitmaps stored by two runs, the batches that
    arrived first and those after: the second run's dictionary goes on from the first one's."""
    events = table(spark, folder, "captured_events")
    half = events.agg(F.avg("batch_id")).first()[0]
    first = F.coalesce(F.col("batch_id") <= half, F.lit(True))
    rows = events.select(day_text(micros(events, "timestamp")).alias("day"), "event", "project_id", "distinct_id", first.alias("first"))
    store = bitmaps.BitmapStore(spark, scratch(spark), ["day", "event"])
    for run, part in enumerate((F.col("first"), ~F.col("first"))):
        store.add(rows.where(part), "distinct_id", run, "project_id")
    return bitmaps.cardinality(store.bitmaps(), ["day", "event"])


def p1_both_events(spark: SparkSession, folder: str) -> DataFrame:
    """Different distinct_ids with both a $pageview and a $identify on the same day: AND of bitmaps."""
    rows = _by_day(spark, folder).where(F.col("event").isin("$pageview", "$identify"))
    words = bitmaps.union(bitmaps.member_words(rows, ["day", "event"], "distinct_id", bitmaps.dictionary(rows, "distinct_id", "project_id")), ["day", "event"])
    sides = [words.where(F.col("event") == e).select("day", "word", "bits") for e in ("$pageview", "$identify")]
    return bitmaps.cardinality(bitmaps.intersect(*sides, ["day"]), ["day"])


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    unique = unique_captured(spark, folder, "event", "distinct_id")
    steps = unique.where(~F.col("event").startswith("$")).select(F.col("distinct_id").alias("entity"), "at", "uuid", F.col("event").alias("name"))
    ids = table(spark, folder, "captured_events").agg(F.countDistinct("distinct_id").alias("n")).first()["n"]
    found = subsequences.frequent_subsequences(steps, max(1, -(-ids // 100)))
    return found.select(F.array_join("pattern", " > ").alias("pattern"), "support")


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    """The ids of every document's whole text."""
    return tokenizer.encode(table(spark, folder, "documents"))


def token_sizes(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, source and size in tokens of every document, counted once and written down."""
    documents = table(spark, folder, "documents")
    counted = tokenizer.encode(documents.select(F.struct("doc_id", "source").alias("doc"), "text"), key="doc", count_only=True)
    return materialize(counted.select("doc.doc_id", "doc.source", "n_tokens"))


def p9_mix(spark: SparkSession, folder: str) -> DataFrame:
    """Every use of a document in each mix, in the order of training."""
    return mixing.mix(token_sizes(spark, folder), table(spark, folder, "mix_targets"))


def p9_shares(spark: SparkSession, folder: str) -> DataFrame:
    """The shares each mix reached, beside its targets."""
    sizes, targets = token_sizes(spark, folder), table(spark, folder, "mix_targets")
    return mixing.shares(sizes, targets, mixing.mix(sizes, targets))


def p10_evidence(spark: SparkSession, folder: str) -> DataFrame:
    """Per document: its words, their share in lists, the share of its phrases on other hosts."""
    return stuffed_pages.stuffed_pages(table(spark, folder, "documents"))


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return p10_evidence(spark, folder).where("stuffed").select("doc_id")


QUERIES = {f.__name__: f for f in (p1_distinct, p1_trailing_week, p1_two_runs, p1_both_events, p3_found, p8_ids, p9_mix, p9_shares, p10_found, p10_evidence)}

_DAY = "strftime(timestamp, '%Y-%m-%d')"
SQL = {
    "p1_distinct": f"""WITH e AS (SELECT {_DAY} AS day, event, project_id, country, distinct_id FROM captured_events WHERE distinct_id IS NOT NULL)
        SELECT 'day' AS grouping, day, NULL AS event, NULL AS project_id, NULL AS country, count(DISTINCT distinct_id) AS n_distinct, CAST(0 AS DOUBLE) AS error_bound FROM e GROUP BY day
        UNION ALL SELECT 'event', NULL, event, NULL, NULL, count(DISTINCT distinct_id), 0 FROM e GROUP BY event
        UNION ALL SELECT 'day_event_project_country', day, event, project_id, country, count(DISTINCT distinct_id), 0 FROM e GROUP BY ALL""",
    "p1_trailing_week": f"""WITH e AS (SELECT DISTINCT project_id, epoch_us(timestamp) // {DAY} AS d, distinct_id FROM captured_events)
        SELECT project_id, CAST(d + k AS BIGINT) AS day_no, count(DISTINCT distinct_id) AS n_distinct, CAST(0 AS DOUBLE) AS error_bound FROM e, range(7) r(k) GROUP BY 1, 2""",
    "p1_two_runs": f"SELECT {_DAY} AS day, event, count(DISTINCT distinct_id) AS n_distinct, CAST(0 AS DOUBLE) AS error_bound FROM captured_events WHERE distinct_id IS NOT NULL GROUP BY ALL",
    "p1_both_events": f"""SELECT day, count(*) AS n_distinct, CAST(0 AS DOUBLE) AS error_bound FROM (
        SELECT {_DAY} AS day, distinct_id FROM captured_events WHERE event = '$pageview' INTERSECT SELECT {_DAY}, distinct_id FROM captured_events WHERE event = '$identify') t GROUP BY day""",
}
