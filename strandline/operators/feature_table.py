"""One row of features per entity, from events of hundreds of types, in blocks of types."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions.times import MINUTE, floor_to
from strandline.operators.sessions import run_count
from strandline.session import bucketed, bytes_of, materialize

KEYS = ["project_id", "person_id"]
#: Bytes of activity, as written, that one bucket of entities holds on average, unless that asks
#: for more buckets than a table may have.
BUCKET_BYTES, MAX_BUCKETS = 128 << 20, 100_000


def strict_number(text: Column) -> Column:
    """DOUBLE where the text is a plain decimal number (optional sign, fraction, exponent)."""
    return F.when(text.rlike(r"^-?[0-9]+(\.[0-9]+)?([eE][-+]?[0-9]+)?$"), text.try_cast("double"))


def entity_of(distinct_ids: DataFrame) -> DataFrame:
    """project_id, distinct_id, person_id: the row with the highest seq holds."""
    latest = F.max(F.struct("seq", "person_id"))
    return distinct_ids.groupBy("project_id", "distinct_id").agg(latest.alias("latest")).select("project_id", "distinct_id", "latest.person_id")


def activity(events: DataFrame, distinct_ids: DataFrame, gap_us: int = 30 * MINUTE) -> DataFrame:
    """Pre-aggregated activity per entity, event and session (or slot of time without one).

    `events`: unique events with project_id, distinct_id, event, session_id, at, amount. They are
    combined per distinct_id before the join to its entity, so that a hot id crosses the network
    as its sessions and slots, not as its rows. An id without an entity is its own.
    """
    slot = F.when(F.col("session_id").isNull(), floor_to(F.col("at"), gap_us))
    cells = events.groupBy("project_id", "distinct_id", "event", "session_id", slot.alias("slot")).agg(
        F.count(F.lit(1)).alias("n"), F.min("at").alias("first_at"), F.max("at").alias("last_at"), F.sum("amount").alias("amount")
    )
    owner = entity_of(distinct_ids).select(F.col("project_id").alias("o_project"), F.col("distinct_id").alias("o_id"), "person_id")
    joined = cells.join(owner, (F.col("project_id") == F.col("o_project")) & (F.col("distinct_id") == F.col("o_id")), "left")
    return joined.withColumn("person_id", F.coalesce("person_id", "distinct_id")).drop("o_project", "o_id")


def feature_blocks(cells: DataFrame, n_blocks: int, buckets: int) -> list[DataFrame]:
    """One DataFrame per block of event types: keys, n_<b>, first_<b>, last_<b> and types_<b>, a
    map from event name to (n, last_at, amount).

    The types are spread over the blocks by hash, so a block holds a bounded share of them however
    many there are. The (entity, event) totals are written once, partitioned by block and bucketed
    by entity; each block then reads its own part and is aggregated without a shuffle.
    """
    totals = cells.groupBy(*KEYS, F.coalesce("event", F.lit("")).alias("event")).agg(F.sum("n").alias("n"), F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at"), F.sum("amount").alias("amount"))
    block = F.pmod(F.xxhash64("event"), F.lit(n_blocks)).cast("int")
    stored = bucketed(totals.withColumn("block", block), buckets, KEYS, "block")
    entry = F.struct("event", F.struct("n", "last_at", "amount"))
    return [
        stored.where(F.col("block") == b)
        .groupBy(*KEYS)
        .agg(F.sum("n").alias(f"n_{b}"), F.min("first_at").alias(f"first_{b}"), F.max("last_at").alias(f"last_{b}"), F.map_from_entries(F.collect_list(entry)).alias(f"types_{b}"))
        for b in range(n_blocks)
    ]


def session_block(cells: DataFrame) -> DataFrame:
    """keys, session_count: different session_ids, plus the runs of events without one."""
    with_id = cells.where(F.col("session_id").isNotNull()).select(*KEYS, "session_id").distinct().select(*KEYS, F.lit(1).cast("long").alias("count"))
    slots = cells.where(F.col("session_id").isNull() & F.col("slot").isNotNull()).groupBy(*KEYS, "slot").agg(F.min("first_at").alias("slot_start"), F.max("last_at").alias("slot_end"))
    runs = run_count(slots, KEYS).select(*KEYS, F.col("runs").alias("count"))
    # of each id with a session one row is left by now, and is added up before it is moved
    return with_id.unionByName(runs).groupBy(*KEYS).agg(F.sum("count").alias("session_count"))


def feature_table(entities: DataFrame, cells: DataFrame, n_blocks: int = 4, buckets: int | None = None) -> DataFrame:
    """Keys, event_count, first_seen, last_seen, session_count, features (map from event name to
    count, last_at and total amount): one row for each row of `entities` (project_id, person_id).

    `cells` as from `activity`. Every block has the buckets of the entity table, so the joins need
    no further shuffle; only `entities` is moved once. An entity without events has 0, null, null,
    0 and an empty map. A null event name is the name ''; amounts that are no plain number add
    nothing. Entities are taken as they come: repeat one and its row is repeated. `cells` is
    written down first; there are as many buckets as its size asks for, at least one per core.
    """
    cells = materialize(cells)
    cores = cells.sparkSession.sparkContext.defaultParallelism
    buckets = buckets or min(MAX_BUCKETS, max(cores, -(-bytes_of(cells) // BUCKET_BYTES)))
    blocks = feature_blocks(cells, n_blocks, buckets)
    wide = reduce(lambda left, block: left.join(block, KEYS, "left"), [*blocks, session_block(cells)], entities.select(*KEYS))
    total = reduce(lambda a, b: a + b, (F.coalesce(F.col(f"n_{b}"), F.lit(0)) for b in range(n_blocks)))
    empty = F.create_map().cast("map<string,struct<n:bigint,last_at:bigint,amount:double>>")
    one = n_blocks == 1
    return wide.select(
        *KEYS,
        total.alias("event_count"),
        (F.col("first_0") if one else F.least(*(f"first_{b}" for b in range(n_blocks)))).alias("first_seen"),
        (F.col("last_0") if one else F.greatest(*(f"last_{b}" for b in range(n_blocks)))).alias("last_seen"),
        F.coalesce("session_count", F.lit(0)).cast("long").alias("session_count"),
        F.map_concat(*(F.coalesce(F.col(f"types_{b}"), empty) for b in range(n_blocks))).alias("features"),
    )


def stale_stats(computed: DataFrame, stored: DataFrame) -> DataFrame:
    """Keys of entities whose stored row is missing, has no entity, or differs in any figure."""
    figures = ["event_count", "first_seen", "last_seen", "session_count"]
    a = computed.select(*KEYS, F.struct(*figures).alias("computed"))
    b = stored.select(*(F.col(k).alias(f"s_{k}") for k in KEYS), F.struct(*figures).alias("stored")).distinct()
    same = F.col("project_id").eqNullSafe(F.col("s_project_id")) & F.col("person_id").eqNullSafe(F.col("s_person_id"))
    joined = a.join(b, same, "full_outer").where(~F.col("computed").eqNullSafe(F.col("stored")))
    return joined.select(*(F.coalesce(k, f"s_{k}").alias(k) for k in KEYS)).distinct()
