"""Queries of flags, identity, lake and ad-hoc SQL, with their SQL."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions.times import DAY, day_text, micros
from strandline.operators import flags, identity, sql_tab
from strandline.plans.insight_queries import NOW, source
from strandline.plans.problem_queries import table
from strandline.session import scratch
from strandline.sources import lake

ROLLOUT = {"key": "new-nav", "filters": {"groups": [{"rollout_percentage": 45}]}}
VARIANTS = {
    "key": "checkout-test",
    "filters": {
        "groups": [{"properties": [{"key": "plan", "operator": "exact", "value": ["team", "PRO"]}], "rollout_percentage": 80}, {"properties": [{"key": "seats", "operator": "gte", "value": 10}], "variant": "b"}],
        "multivariate": {"variants": [{"key": "a", "rollout_percentage": 50}, {"key": "b", "rollout_percentage": 30}, {"key": "c", "rollout_percentage": 20}]},
        "payloads": {"b": {"colour": "blue"}},
    },
}


def flag(spark: SparkSession, folder: str, definition: dict) -> DataFrame:
    ids = identity.latest(table(spark, folder, "distinct_ids"))
    found = flags.evaluate_all([definition], ids, table(spark, folder, "persons"), NOW)
    return found.select("project_id", "distinct_id", "enabled", "variant", "payload", "reason", "condition_index")


def identity_latest(spark: SparkSession, folder: str) -> DataFrame:
    return identity.latest(table(spark, folder, "distinct_ids")).select("project_id", "distinct_id", "person_id", "seq")


def identity_overrides(spark: SparkSession, folder: str) -> DataFrame:
    """The overrides that follow from the full mapping, applied as changes to none."""
    mapping = table(spark, folder, "distinct_ids")
    empty = mapping.select("project_id", "distinct_id", "person_id").limit(0)
    return identity.apply_changes(empty, mapping)


def identity_changes(spark: SparkSession, folder: str) -> DataFrame:
    """The overrides as they are, after a feed of changes: every superseded row of the mapping, and
    a mapping of an id to itself, which removes its override, for those of one project."""
    current = table(spark, folder, "person_overrides")
    first = current.agg(F.min("project_id").alias("first"))
    own = current.join(F.broadcast(first), F.col("project_id") == F.col("first"), "left_semi").select("project_id", "distinct_id", F.col("distinct_id").alias("person_id"), F.lit(1 << 40).alias("seq"))
    return identity.apply_changes(current, table(spark, folder, "distinct_ids").select("project_id", "distinct_id", "person_id", "seq").unionByName(own))


def identity_components(spark: SparkSession, folder: str) -> DataFrame:
    """Size of the connected groups of distinct ids and persons, by size."""
    edges = table(spark, folder, "distinct_ids").select(F.concat("project_id", F.lit("|d|"), "distinct_id").alias("a"), F.concat("project_id", F.lit("|p|"), "person_id").alias("b"))
    sizes = identity.components(edges).groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    return sizes.groupBy("size").agg(F.count(F.lit(1)).alias("components"))


def actor_summaries(spark: SparkSession, folder: str) -> DataFrame:
    people = table(spark, folder, "persons")
    wanted = table(spark, folder, "distinct_ids").select("person_id").distinct()
    found = identity.summaries(wanted, people, table(spark, folder, "distinct_ids"))
    return found.select("person_id", "display_name", F.array_join("distinct_ids", ",").alias("ids"))


def per_day(events: DataFrame) -> DataFrame:
    """Per project and day what tells which rows are there: their number, different uuids, moments
    within the day and lengths of their names added up."""
    at = micros(events, "timestamp")
    return events.groupBy("project_id", day_text(at).alias("day")).agg(
        F.count(F.lit(1)).alias("n"),
        F.countDistinct("uuid").alias("uuids"),
        F.sum(F.pmod(at, F.lit(DAY))).alias("us_in_day"),
        F.sum(F.length("event") + 7 * F.length("distinct_id")).cast("long").alias("lengths"),
    )


def compact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return per_day(lake.compacted(table(spark, folder, "captured_events")))


def erase_persons(spark: SparkSession, folder: str) -> DataFrame:
    """What remains after everyone with an override is erased."""
    return per_day(lake.without_persons(table(spark, folder, "captured_events"), table(spark, folder, "person_overrides")))


def retention_drop(spark: SparkSession, folder: str) -> DataFrame:
    return per_day(lake.retained(table(spark, folder, "captured_events"), "2018-01-29", 14))


def lake_life(spark: SparkSession, folder: str) -> DataFrame:
    """A lake from two commits, the batches that arrived first and those after, compacted; then those
    with an override are erased and days older than 14 days retired; read back from the catalog."""
    events, root = table(spark, folder, "captured_events"), scratch(spark)
    half = F.lit(events.agg(F.avg("batch_id")).first()[0])
    for part in (F.col("batch_id") <= half, F.col("batch_id") > half):
        lake.commit(spark, root, events.where(part).select("project_id", *lake.EVENT_SCHEMA.names), None, NOW)
    lake.compact(spark, root, NOW)
    lake.erase(spark, root, table(spark, folder, "person_overrides"), NOW)
    lake.retire(spark, root, "2018-01-29", 14, NOW)
    return per_day(lake.read_lake(spark, root, lake.catalog(spark, root).where("retired_generation IS NULL")))


SELECT = "SELECT event, count(*) AS n, count(DISTINCT person_id) AS people, max(timestamp) < now_utc() AS past FROM events WHERE browser IS NOT NULL GROUP BY event HAVING count(*) > 5"


def sql_select(spark: SparkSession, folder: str) -> DataFrame:
    return sql_tab.query(source(spark, folder), SELECT, NOW)


QUERIES = {
    "flag_rollout": partial(flag, definition=ROLLOUT),
    "flag_variant": partial(flag, definition=VARIANTS),
    "flag_steady": partial(flag, definition=ROLLOUT | {"ensure_experience_continuity": True}),
    "identity_latest": identity_latest,
    "identity_overrides": identity_overrides,
    "identity_changes": identity_changes,
    "identity_components": identity_components,
    "actor_summaries": actor_summaries,
    "compact_dedup": compact_dedup,
    "erase_persons": erase_persons,
    "retention_drop": retention_drop,
    "lake_life": lake_life,
    "sql_select": sql_select,
}

_IDS = "ids AS (SELECT project_id, distinct_id, person_id, seq FROM distinct_ids QUALIFY row_number() OVER (PARTITION BY project_id, distinct_id ORDER BY seq DESC, person_id DESC) = 1)"


def _hash(key: str, salt: str = "") -> str:
    return f"CAST(CAST('0x' || substr(sha1('{key}.' || distinct_id || '{salt}'), 1, 15) AS BIGINT) AS DOUBLE) / 1152921504606846975"


_DAY = "strftime(timestamp, '%Y-%m-%d')"
_PER_DAY = f"project_id, {_DAY} AS day, count(*) AS n, count(DISTINCT uuid) AS uuids, CAST(sum(epoch_us(timestamp) % {DAY}) AS BIGINT) AS us_in_day, CAST(sum(length(event) + 7 * length(distinct_id)) AS BIGINT) AS lengths"
_PLAN, _SEATS = "json_extract_string(properties, '/plan')", "json_extract_string(properties, '/seats')"
SQL = {
    "flag_rollout": f"WITH {_IDS}, h AS (SELECT *, {_hash('new-nav')} <= 0.45 AS e FROM ids) SELECT project_id, distinct_id, e AS enabled, CAST(NULL AS VARCHAR) AS variant, CAST(NULL AS VARCHAR) AS payload, CASE WHEN e THEN 'condition_match' ELSE 'out_of_rollout_bound' END AS reason, 0 AS condition_index FROM h",
    "flag_steady": f"""WITH {_IDS}, h AS (SELECT ids.project_id, ids.distinct_id, {_hash('new-nav').replace('distinct_id', 'coalesce(p.first_seen_key, ids.distinct_id)')} <= 0.45 AS e FROM ids LEFT JOIN persons p ON p.project_id = ids.project_id AND p.id = ids.person_id)
        SELECT project_id, distinct_id, e AS enabled, CAST(NULL AS VARCHAR) AS variant, CAST(NULL AS VARCHAR) AS payload, CASE WHEN e THEN 'condition_match' ELSE 'out_of_rollout_bound' END AS reason, 0 AS condition_index FROM h""",
    "flag_variant": rf"""WITH {_IDS}, j AS (SELECT ids.*, properties, {_hash('checkout-test')} AS h, {_hash('checkout-test', 'variant')} AS v FROM ids LEFT JOIN persons p ON p.project_id = ids.project_id AND p.id = ids.person_id),
        m AS (SELECT *, coalesce(lower({_PLAN}) IN ('team', 'pro'), false) AS m0, coalesce(CASE WHEN regexp_full_match(trim({_SEATS}), '[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?') THEN CAST(trim({_SEATS}) AS DOUBLE) >= 10 ELSE {_SEATS} >= '10' END, false) AS m1 FROM j),
        d AS (SELECT *, CASE WHEN m0 AND h <= 0.8 THEN 0 WHEN m1 THEN 1 END AS c, CASE WHEN m0 THEN 0 WHEN m1 THEN 1 END AS near FROM m)
        SELECT project_id, distinct_id, c IS NOT NULL AS enabled, CASE WHEN c = 1 THEN 'b' WHEN c = 0 THEN CASE WHEN v < 0.5 THEN 'a' WHEN v < 0.8 THEN 'b' ELSE 'c' END END AS variant,
        CASE WHEN c = 1 OR c = 0 AND v >= 0.5 AND v < 0.8 THEN '{"{"}"colour": "blue"{"}"}' END AS payload, CASE WHEN c IS NOT NULL THEN 'condition_match' WHEN near IS NOT NULL THEN 'out_of_rollout_bound' ELSE 'no_condition_match' END AS reason, coalesce(c, near) AS condition_index FROM d""",
    "identity_latest": f"WITH {_IDS} SELECT * FROM ids",
    "identity_changes": f"""WITH {_IDS}, ch AS (SELECT project_id, distinct_id, CASE WHEN own THEN distinct_id ELSE person_id END AS person_id FROM (SELECT ids.*, EXISTS (SELECT 1 FROM person_overrides o WHERE o.project_id = ids.project_id AND o.distinct_id = ids.distinct_id AND o.project_id = (SELECT min(project_id) FROM person_overrides)) AS own FROM ids) t)
        SELECT * FROM ch WHERE person_id <> distinct_id UNION ALL SELECT project_id, distinct_id, person_id FROM person_overrides o WHERE NOT EXISTS (SELECT 1 FROM ids WHERE ids.project_id = o.project_id AND ids.distinct_id = o.distinct_id) AND project_id <> (SELECT min(project_id) FROM person_overrides)""",
    "identity_components": """WITH RECURSIVE e AS (SELECT concat(project_id, '|d|', distinct_id) AS a, concat(project_id, '|p|', person_id) AS b FROM distinct_ids), both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
        reached AS (SELECT DISTINCT a AS node, a AS seen FROM both_ways UNION SELECT r.node, x.b FROM reached r JOIN both_ways x ON x.a = r.seen), least AS (SELECT node, min(seen) AS c FROM reached GROUP BY node)
        SELECT size, count(*) AS components FROM (SELECT c, count(*) AS size FROM least GROUP BY c) t GROUP BY size""",
    "identity_overrides": f"WITH {_IDS} SELECT project_id, distinct_id, person_id FROM ids WHERE person_id <> distinct_id",
    "actor_summaries": f"""WITH {_IDS}, o AS (SELECT person_id, list_sort(list(DISTINCT distinct_id))[1:10] AS l FROM ids GROUP BY 1), w AS (SELECT DISTINCT person_id FROM distinct_ids)
        SELECT w.person_id, coalesce(nullif(json_extract_string(properties, '/email'), ''), nullif(json_extract_string(properties, '/name'), ''), o.l[1], w.person_id) AS display_name, coalesce(array_to_string(o.l, ','), w.person_id) AS ids
        FROM w LEFT JOIN o USING (person_id) LEFT JOIN persons p ON p.id = w.person_id""",
    "compact_dedup": f"SELECT {_PER_DAY} FROM (SELECT * FROM captured_events QUALIFY row_number() OVER (PARTITION BY project_id, {_DAY}, uuid ORDER BY timestamp) = 1) t GROUP BY ALL",
    "erase_persons": f"SELECT {_PER_DAY} FROM captured_events e ANTI JOIN person_overrides o USING (project_id, distinct_id) GROUP BY ALL",
    "retention_drop": f"SELECT {_PER_DAY} FROM captured_events WHERE {_DAY} >= '2018-01-15' GROUP BY ALL",
    "lake_life": f"""WITH cut AS (SELECT avg(batch_id) AS half FROM captured_events), parts AS (SELECT c.*, batch_id <= half AS early FROM captured_events c, cut),
        committed AS (SELECT * FROM parts QUALIFY row_number() OVER (PARTITION BY early, project_id, uuid ORDER BY timestamp) = 1), merged AS (SELECT * FROM committed QUALIFY row_number() OVER (PARTITION BY project_id, {_DAY}, uuid ORDER BY timestamp) = 1)
        SELECT {_PER_DAY} FROM merged ANTI JOIN person_overrides o USING (project_id, distinct_id) WHERE {_DAY} >= '2018-01-15' GROUP BY ALL""",
    "sql_select": "SELECT event, count(*) AS n, count(DISTINCT coalesce(o.person_id, e.distinct_id)) AS people, max(timestamp) < TIMESTAMPTZ '2018-01-28 12:00:00+00' AS past FROM captured_events e LEFT JOIN person_overrides o ON e.project_id = o.project_id AND e.distinct_id = o.distinct_id WHERE browser IS NOT NULL GROUP BY event HAVING count(*) > 5",
}
