"""The pN_ queries of the general problems, over the tables of a data folder, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions.times import HOUR, MINUTE, micros
from strandline.operators import compaction, data_diff, feature_table, late_events, sessions
from strandline.operators.unique_events import earliest
from strandline.session import materialize, scratch


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of the folder; the session reads times as UTC."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{folder}/{name}.parquet")


def unique_captured(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """uuid, at (µs) and `columns` of the unique events."""
    events = table(spark, folder, "captured_events")
    return earliest(events, F.col("uuid"), micros(events, "timestamp"), **{c: F.col(c) for c in columns}).withColumnRenamed("key", "uuid")


def p2_diff(spark: SparkSession, folder: str) -> DataFrame:
    """All differences between the two copies, with the number of surplus copies on each side."""
    sides = []
    for name in ("captured_events", "event_mirror"):
        rows = table(spark, folder, name)
        first = earliest(rows, F.lower("uuid"), micros(rows, "timestamp"), event=F.col("event"), distinct_id=F.col("distinct_id"))
        sides.append(first.select(F.col("key").alias("uuid"), "event", F.col("at").alias("timestamp"), "distinct_id"))
    return data_diff.diff_copies(*sides, "uuid", ["event", "timestamp", "distinct_id"], "missing_in_mirror", "missing_in_capture")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return p2_diff(spark, folder).select("uuid", "field")


def late_panes(spark: SparkSession, folder: str) -> DataFrame:
    """Panes of an hour per project of the unique events, by arrival."""
    events = table(spark, folder, "captured_events")
    arrivals = late_events.batch_arrivals(table(spark, folder, "captured_batches")).withColumnRenamed("batch_id", "b_id")
    arrived = events.select("uuid", "project_id", "batch_id", micros(events, "timestamp").alias("us")).join(arrivals, F.col("batch_id") == F.col("b_id"), "left")
    first = earliest(arrived, F.col("uuid"), F.col("us"), {"arrived_us": F.min("arrived_us")}, project_id=F.col("project_id"))
    return late_events.pane_deltas(first, ["project_id"])


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    windows = late_events.compose(late_panes(spark, folder), ["project_id"])
    late = windows.where((F.col("n_final") > F.col("n_first")) | (F.col("n_too_late") > 0))
    return late.select("project_id", F.col("window_start").alias("hour_us"), "n_first", "n_final", "n_too_late")


def p4_windows_6h(spark: SparkSession, folder: str) -> DataFrame:
    """The same counts for windows of six hours, one starting each hour, composed of the panes."""
    return late_events.compose(late_panes(spark, folder), ["project_id"], 6 * HOUR, HOUR)


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    found = sessions.event_sessions(unique_captured(spark, folder, "distinct_id", "session_id"))
    return found.select("distinct_id", "session_id", "start_us", "end_us", "n_events")


def p5_by_day(spark: SparkSession, folder: str) -> DataFrame:
    """Sessions per day of their start: number, events, total and longest duration."""
    found = sessions.event_sessions(unique_captured(spark, folder, "distinct_id", "session_id"))
    day = (F.col("start_us") - F.pmod(F.col("start_us"), F.lit(24 * HOUR))).alias("day_us")
    return found.groupBy(day).agg(F.count(F.lit(1)).alias("n_sessions"), F.sum("n_events").alias("n_events"), F.sum("duration_us").alias("total_us"), F.max("duration_us").alias("longest_us"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return compaction.plan(table(spark, folder, "lake_files")).select("id")


def p6_plan(spark: SparkSession, folder: str) -> DataFrame:
    """Per bin: how many files it replaces, and their bytes and rows."""
    return compaction.bin_summary(compaction.plan(table(spark, folder, "lake_files")))


def p6_compact(spark: SparkSession, folder: str) -> DataFrame:
    """The rewritten bins: rows and checksums of the new files, verified before the commit."""
    manifest = materialize(compaction.plan(table(spark, folder, "lake_files")))
    return compaction.compact(table(spark, folder, "captured_events"), manifest, scratch(spark), 1).select("project_id", "day", "bin", "n_files", "n_rows")


def person_features(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "captured_events")
    amount = feature_table.strict_number(F.get_json_object("properties", "$.amount"))
    values = {c: F.col(c) for c in ("project_id", "distinct_id", "event", "session_id")}
    unique = earliest(events, F.col("uuid"), micros(events, "timestamp"), **values, amount=amount)
    cells = feature_table.activity(unique, table(spark, folder, "distinct_ids"))
    persons = table(spark, folder, "persons").select("project_id", F.col("id").alias("person_id"))
    return feature_table.feature_table(persons, cells)


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return feature_table.stale_stats(person_features(spark, folder), table(spark, folder, "person_stats")).select("person_id")


def p7_features(spark: SparkSession, folder: str) -> DataFrame:
    """The feature table; features as text, one line per event name: name=count@last_at$cents."""
    line = lambda e: F.concat(e["key"], F.lit("="), e["value"]["n"].cast("string"), F.lit("@"), e["value"]["last_at"].cast("string"), F.lit("$"), F.coalesce(F.round(e["value"]["amount"] * 100).cast("long"), F.lit(0)).cast("string"))
    lines = F.array_join(F.array_sort(F.transform(F.map_entries("features"), line)), "\n")
    return person_features(spark, folder).withColumn("features", lines)


_UNIQUE = "(SELECT * FROM captured_events QUALIFY row_number() OVER (PARTITION BY uuid ORDER BY timestamp) = 1)"
_GAP = 30 * MINUTE
_ARRIVED = f"""
arrival AS (SELECT uuid, min(received_at_ms * 1000) FILTER (WHERE received_at_ms > 0) AS a FROM captured_events LEFT JOIN captured_batches USING (batch_id) GROUP BY uuid),
placed AS (SELECT project_id, epoch_us(timestamp) - epoch_us(timestamp) % {HOUR} AS pane, a FROM {_UNIQUE} u LEFT JOIN arrival USING (uuid)),
panes AS (SELECT project_id, pane, count(*) FILTER (WHERE a IS NULL OR a <= pane + {HOUR}) AS n_first,
  count(*) FILTER (WHERE a > pane + {HOUR} AND a <= pane + {49 * HOUR}) AS n_in_time, count(*) FILTER (WHERE a > pane + {49 * HOUR}) AS n_too_late FROM placed GROUP BY ALL)"""
_SESSIONS = f"""
flagged AS (SELECT distinct_id, coalesce(session_id, '') AS session_id, epoch_us(timestamp) AS t_us,
  CASE WHEN epoch_us(timestamp) - lag(epoch_us(timestamp)) OVER w <= {_GAP} THEN 0 ELSE 1 END AS starts, uuid FROM {_UNIQUE} u
  WINDOW w AS (PARTITION BY distinct_id, coalesce(session_id, '') ORDER BY timestamp, uuid)),
numbered AS (SELECT *, sum(starts) OVER (PARTITION BY distinct_id, session_id ORDER BY t_us, uuid ROWS UNBOUNDED PRECEDING) AS nr FROM flagged),
found AS (SELECT distinct_id, session_id, min(t_us) AS start_us, max(t_us) AS end_us, count(*) AS n_events FROM numbered GROUP BY distinct_id, session_id, nr)"""
_FILES = r"""
files AS (SELECT project_id, day, name, min(id) AS id, max(bytes) AS bytes, max(rows) AS rows FROM (
  SELECT *, regexp_extract(replace(relative_path, '\', '/'), '([^/]+)$', 1) AS name FROM lake_files WHERE retired_generation IS NULL) f GROUP BY project_id, day, name),
small AS (SELECT *, count(*) OVER (PARTITION BY project_id, day) AS n FROM files WHERE bytes IS NULL OR bytes < 32768)"""
_PERSON_EVENTS = f"""
owner AS (SELECT project_id, distinct_id, arg_max(person_id, seq) AS person_id FROM distinct_ids GROUP BY ALL),
ev AS (SELECT u.project_id, coalesce(o.person_id, u.distinct_id) AS person_id, event, session_id, epoch_us(timestamp) AS t_us, uuid, json_extract_string(properties, '$.amount') AS amount
  FROM {_UNIQUE} u LEFT JOIN owner o USING (project_id, distinct_id)),
runs AS (SELECT project_id, person_id, sum(s) AS runs FROM (SELECT project_id, person_id, CASE WHEN t_us - lag(t_us) OVER (PARTITION BY project_id, person_id ORDER BY t_us, uuid) <= {_GAP} THEN 0 ELSE 1 END AS s FROM ev WHERE session_id IS NULL) q GROUP BY ALL),
base AS (SELECT project_id, person_id, count(*) AS n, min(t_us) AS f, max(t_us) AS l, count(DISTINCT session_id) AS s FROM ev GROUP BY ALL),
full_stats AS (SELECT p.project_id, p.id AS person_id, coalesce(n, 0) AS event_count, f AS first_seen, l AS last_seen, CAST(coalesce(s, 0) + coalesce(runs, 0) AS BIGINT) AS session_count
  FROM persons p LEFT JOIN base b ON p.project_id = b.project_id AND p.id = b.person_id LEFT JOIN runs r ON p.project_id = r.project_id AND p.id = r.person_id)"""

QUERIES = {f.__name__: f for f in (p2_found, p2_diff, p4_found, p4_windows_6h, p5_found, p5_by_day, p6_found, p6_plan, p6_compact, p7_found, p7_features)}

_DIFF = f"""
WITH a AS (SELECT lower(uuid) AS uuid, event, epoch_us(timestamp) AS t, distinct_id AS d FROM captured_events QUALIFY row_number() OVER (PARTITION BY lower(uuid) ORDER BY timestamp, event, d) = 1),
b AS (SELECT lower(uuid) AS uuid, event, epoch_us(timestamp) AS t, distinct_id AS d FROM event_mirror QUALIFY row_number() OVER (PARTITION BY lower(uuid) ORDER BY timestamp, event, d) = 1),
found AS (SELECT uuid, 'missing_in_mirror' AS field FROM a WHERE uuid NOT IN (SELECT uuid FROM b)
UNION ALL SELECT uuid, 'missing_in_capture' FROM b WHERE uuid NOT IN (SELECT uuid FROM a)
UNION ALL SELECT uuid, 'event' FROM a JOIN b USING (uuid) WHERE a.event IS DISTINCT FROM b.event
UNION ALL SELECT uuid, 'timestamp' FROM a JOIN b USING (uuid) WHERE a.t IS DISTINCT FROM b.t
UNION ALL SELECT uuid, 'distinct_id' FROM a JOIN b USING (uuid) WHERE a.d IS DISTINCT FROM b.d)"""

SQL = {
    "p2_found": f"{_DIFF} SELECT uuid, field FROM found",
    "p2_diff": f"{_DIFF} SELECT uuid, field, CAST(field <> 'missing_in_capture' AS BIGINT) AS left_copies, CAST(field <> 'missing_in_mirror' AS BIGINT) AS right_copies FROM found",
    "p4_found": f"WITH {_ARRIVED} SELECT project_id, pane AS hour_us, n_first, n_first + n_in_time AS n_final, n_too_late FROM panes WHERE n_in_time + n_too_late > 0",
    "p4_windows_6h": f"""WITH {_ARRIVED} SELECT project_id, pane - {HOUR} * k AS window_start, CAST(sum(n_first) AS BIGINT) AS n_first, CAST(sum(n_first + n_in_time) AS BIGINT) AS n_final, CAST(sum(n_too_late) AS BIGINT) AS n_too_late
        FROM panes, range(6) r(k) GROUP BY 1, 2""",
    "p5_found": f"WITH {_SESSIONS} SELECT * FROM found",
    "p5_by_day": f"WITH {_SESSIONS} SELECT start_us - start_us % {24 * HOUR} AS day_us, count(*) AS n_sessions, CAST(sum(n_events) AS BIGINT) AS n_events, CAST(sum(end_us - start_us) AS BIGINT) AS total_us, max(end_us - start_us) AS longest_us FROM found GROUP BY 1",
    "p6_found": f"WITH {_FILES} SELECT id FROM small WHERE n > 1",
    "p6_plan": f"WITH {_FILES} SELECT project_id, day, 0 AS chunk, CAST(0 AS BIGINT) AS bin, count(*) AS n_files, CAST(sum(bytes) AS BIGINT) AS bytes_before, CAST(sum(rows) AS BIGINT) AS rows_registered FROM small WHERE n > 1 GROUP BY project_id, day",
    "p6_compact": f"""WITH {_FILES}, chosen AS (SELECT project_id, day, name FROM small WHERE n > 1), ids AS (SELECT c.project_id, c.day, c.name, l.id FROM chosen c JOIN lake_files l ON l.project_id = c.project_id AND l.day = c.day
        AND regexp_extract(replace(relative_path, '\', '/'), '([^/]+)$', 1) = c.name AND l.retired_generation IS NULL)
        SELECT i.project_id, i.day, CAST(0 AS BIGINT) AS bin, (SELECT count(*) FROM chosen c WHERE c.project_id = i.project_id AND c.day = i.day) AS n_files, count(*) AS n_rows FROM (SELECT DISTINCT project_id, day, id FROM ids) i JOIN captured_events e ON e.file_id = i.id GROUP BY i.project_id, i.day""",
    "p7_found": f"""WITH {_PERSON_EVENTS}, stored AS (SELECT DISTINCT project_id, person_id, event_count, first_seen, last_seen, session_count FROM person_stats)
        SELECT DISTINCT coalesce(f.person_id, s.person_id) AS person_id FROM full_stats f FULL JOIN stored s ON f.project_id = s.project_id AND f.person_id = s.person_id
        WHERE f.person_id IS NULL OR s.person_id IS NULL OR f.event_count IS DISTINCT FROM s.event_count OR f.first_seen IS DISTINCT FROM s.first_seen OR f.last_seen IS DISTINCT FROM s.last_seen OR f.session_count IS DISTINCT FROM s.session_count""",
    "p7_features": rf"""WITH {_PERSON_EVENTS}, cells AS (SELECT project_id, person_id, event, count(*) AS n, max(t_us) AS l, sum(CASE WHEN regexp_full_match(amount, '-?[0-9]+(\.[0-9]+)?([eE][-+]?[0-9]+)?') THEN CAST(amount AS DOUBLE) END) AS amount FROM ev GROUP BY ALL),
        lines AS (SELECT project_id, person_id, concat(event, '=', n, '@', l, '$', CAST(coalesce(round(amount * 100), 0) AS BIGINT)) AS line FROM cells)
        SELECT f.*, coalesce(t.features, '') AS features FROM full_stats f LEFT JOIN (SELECT project_id, person_id, string_agg(line, chr(10) ORDER BY line) AS features FROM lines GROUP BY ALL) t USING (project_id, person_id)""",
}
