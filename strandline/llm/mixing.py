"""Mixing sources to target weights that may change over the course of training.

Each source's weight over training time is integrated to its cumulative demand of tokens. The
source's documents, in a random but repeatable order, lie one after the other on its cumulative
supply; the demand curve is inverted at each document to give the moment of training at which it
is due, and all documents are sorted by that moment.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Buckets over which a source's running sum of tokens is computed, however large the source.
BUCKETS = 1024
#: Up to so many rows the target table is sent to every task.
BROADCAST_ROWS = 10_000


def supply(sizes: DataFrame, seed: int = 0, buckets: int = BUCKETS) -> DataFrame:
    """Columns doc_id, source, n_tokens, before: tokens of the source's documents that come earlier.

    The order is by hash of doc_id. A running sum over a whole source would put it into one task;
    it is taken within each of `buckets` parts of the source and added to the sum of the parts
    before. Documents without tokens can't change a share and are left out.
    """
    spread = F.xxhash64(F.lit(seed), "doc_id")
    placed = sizes.where("n_tokens > 0").select("doc_id", "source", "n_tokens", spread.alias("h"), F.pmod(spread, F.lit(buckets)).cast("int").alias("b"))
    own = Window.partitionBy("source", "b").orderBy("h", "doc_id")
    inside = placed.withColumn("inside", F.sum("n_tokens").over(own) - F.col("n_tokens"))
    parts = placed.groupBy(F.col("source").alias("s_source"), F.col("b").alias("s_b")).agg(F.sum("n_tokens").alias("part"))
    earlier = Window.partitionBy("s_source").orderBy("s_b")
    parts = parts.withColumn("start", F.sum("part").over(earlier) - F.col("part")).drop("part")
    joined = inside.join(parts, F.col("source").eqNullSafe(F.col("s_source")) & (F.col("b") == F.col("s_b")))
    return joined.select("doc_id", "source", "n_tokens", (F.col("start") + F.col("inside")).alias("before"))


def linear_schedule(low: Column, high: Column) -> Column:
    """A weight that goes straight from `low` to `high`, as segments (see `due`)."""
    return segments([(F.lit(0.0), low), (F.lit(1.0), high)])


def segments(knots: list[tuple[Column, Column]]) -> Column:
    """Segments of the weight curve through (time, weight) knots, each with the share of the whole
    demand that is due before and after it: t0, t1, w0, w1, c0, c1."""
    areas = [(b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:])]
    total = sum(areas[1:], areas[0])
    made, c = [], F.lit(0.0)
    for (a, b), area in zip(zip(knots, knots[1:]), areas):
        end = c + F.when(total > 0, area / total).otherwise(0.0)
        made.append(F.struct(a[0].alias("t0"), b[0].alias("t1"), a[1].alias("w0"), b[1].alias("w1"), c.alias("c0"), end.alias("c1"), total.alias("total")))
        c = end
    return F.array(*made)


def due(schedule: Column, share: Column) -> Column:
    """The time (0 to 1) at which `share` of the schedule's demand is due: the integral, inverted."""
    s = F.coalesce(F.get(F.filter(schedule, lambda x: x["c1"] >= share), F.lit(0)), F.element_at(schedule, -1))
    length, rise = s["t1"] - s["t0"], s["w1"] - s["w0"]
    area = (share - s["c0"]) * s["total"] / length
    root = F.sqrt(F.greatest(F.lit(0.0), s["w0"] * s["w0"] + 2 * rise * area))
    # w0 x + rise x²/2 = area, in the form that doesn't cancel; 0 <= x <= 1 along the segment
    x = F.when(s["w0"] + root > 0, 2 * area / (s["w0"] + root)).otherwise(0.0)
    return s["t0"] + length * F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def demand(sizes: DataFrame, targets: DataFrame, ramp: float = 0.5) -> DataFrame:
    """Per mix and source: target and reachable tokens, supply, and the schedule of its weight.

    A mix is size_ratio times all tokens of `sizes`; a source is to give target_share of that, but
    can give at most max_repeats times what it has. Over training its weight changes linearly by
    up to `ramp`: sources of longer documents come later (a curriculum), while the shares of the
    whole stay as targeted; 0 keeps the weights constant.
    """
    stats = sizes.where("n_tokens > 0").groupBy(F.col("source").alias("s_source")).agg(F.sum("n_tokens").alias("supply"), F.count(F.lit(1)).alias("n_docs"))
    total = sizes.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("all_tokens")).first()["all_tokens"]
    known = targets.join(stats, F.col("source").eqNullSafe(F.col("s_source")), "left")
    mix = Window.partitionBy("mix_name")
    by_length = mix.orderBy(F.coalesce(F.col("supply") / F.col("n_docs"), F.lit(0.0)), "source")
    rank = known.withColumn("rank", F.percent_rank().over(by_length))
    centre = rank.withColumn("centre", F.sum(F.col("rank") * F.col("target_share")).over(mix) / F.sum("target_share").over(mix))
    tilt = (F.col("rank") - F.col("centre")) * ramp
    reach = F.least(F.col("target_tokens"), F.col("max_repeats") * F.coalesce("supply", F.lit(0)))
    return (
        centre.withColumn("target_tokens", F.col("target_share") * F.col("size_ratio") * F.lit(total))
        .withColumn("planned_tokens", reach)
        .withColumn("schedule", linear_schedule(F.col("target_share") * (1 - tilt), F.col("target_share") * (1 + tilt)))
        .select("mix_name", "source", "target_share", "max_repeats", "target_tokens", "planned_tokens", F.coalesce("supply", F.lit(0)).alias("supply"), "schedule")
    )


def mix(sizes: DataFrame, targets: DataFrame, ramp: float = 0.5, seed: int = 0) -> DataFrame:
    """Columns mix_name, source, doc_id, repeat_no (from 0), n_tokens, position: every use of a
    document in a mix, sorted by mix and position.

    `sizes`: doc_id, source, n_tokens. `targets`: mix_name, source, target_share, max_repeats,
    size_ratio. A source's documents are taken in order, from the start again after the last,
    until the planned tokens are reached: a use counts if at least half of it lies within, so a
    source misses its plan by at most half a document. No document is used more than max_repeats
    times. A source without documents, or with too few, gives what it can; `shares` reports it.
    Null sizes count as 0, a null source is a source like any other. Empty tables give no rows.
    """
    sizes = sizes.select("doc_id", "source", F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"))
    wanted = demand(sizes, targets, ramp).select("mix_name", F.col("source").alias("d_source"), "max_repeats", "planned_tokens", "supply", "schedule")
    small = targets.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    uses = supply(sizes, seed).join(F.broadcast(wanted) if small else wanted, F.col("source").eqNullSafe(F.col("d_source")))
    middle = F.col("before") + F.col("n_tokens") / 2
    fits = F.floor((F.col("planned_tokens") - middle) / F.col("supply")) + 1
    copies = F.greatest(F.lit(0), F.least(F.col("max_repeats").cast("long"), fits)).cast("int")
    repeated = uses.withColumn("middle", middle).withColumn("copies", copies).where("copies > 0").withColumn("repeat_no", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    share = (F.col("repeat_no") * F.col("supply") + F.col("middle")) / F.col("planned_tokens")
    placed = repeated.select("mix_name", "source", "doc_id", "repeat_no", "n_tokens", due(F.col("schedule"), share).alias("position"))
    order = ["mix_name", "position", "source", "doc_id", "repeat_no"]
    return placed.repartitionByRange(*order).sortWithinPartitions(*order)


def shares(sizes: DataFrame, targets: DataFrame, mixed: DataFrame) -> DataFrame:
    """Per mix and source: target_share, actual_share (of what the mix reached), target_tokens,
    actual_tokens, n_docs, most_repeats (uses of its most used document)."""
    per_doc = mixed.groupBy("mix_name", "source", "doc_id").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("uses"))
    reached = per_doc.groupBy(F.col("mix_name").alias("r_mix"), F.col("source").alias("r_source")).agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("n_docs"), F.max("uses").alias("most_repeats"))
    wanted = demand(sizes.select("doc_id", "source", F.coalesce("n_tokens", F.lit(0)).alias("n_tokens")), targets)
    joined = wanted.join(reached, F.col("mix_name").eqNullSafe(F.col("r_mix")) & F.col("source").eqNullSafe(F.col("r_source")), "left")
    tokens = F.coalesce("tokens", F.lit(0))
    whole = F.sum(tokens).over(Window.partitionBy("mix_name"))
    return joined.select(
        "mix_name",
        "source",
        "target_share",
        F.when(whole > 0, tokens / whole).otherwise(0.0).alias("actual_share"),
        "target_tokens",
        tokens.alias("actual_tokens"),
        F.coalesce("n_docs", F.lit(0)).alias("n_docs"),
        F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"),
    )
