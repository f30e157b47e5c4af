"""Paths: what people do next, step by step."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.contract import Paths, Period, check_paths
from strandline.functions import properties
from strandline.operators.relation import Source, needs_person_properties, relation


def walks(source: Source, paths: Paths, period: Period) -> DataFrame:
    """person_id, step (from 1), node, at: each person's nodes, repeats in a row reduced to their
    first, from the start point and up to the end point if there are any, cut to the step limit."""
    check_paths(paths)
    events = relation(source, period.start, period.end, True, needs_person_properties(paths.filters)).where(properties.condition(paths.filters))
    viewed = F.when(F.col("event") == "$pageview", F.col("pathname")) if "pageview" in paths.kinds else F.lit(None).cast("string")
    custom = F.when(~F.col("event").startswith("$"), F.col("event")) if "custom" in paths.kinds else F.lit(None).cast("string")
    nodes = events.withColumn("node", F.coalesce(viewed, custom)).where(F.col("node").isNotNull()).select("person_id", "at", "uuid", "node")
    person = Window.partitionBy("person_id")
    order = person.orderBy("at", "uuid")
    changed = nodes.withColumn("before", F.lag("node").over(order)).where(F.col("before").isNull() | (F.col("before") != F.col("node")))
    numbered = changed.withColumn("no", F.row_number().over(order))
    if paths.start is not None:
        begins = F.min(F.when(F.col("node") == paths.start, F.col("no"))).over(person)
        numbered = numbered.withColumn("begins", begins).where(F.col("no") >= F.col("begins"))
    if paths.end is not None:
        ends = F.min(F.when(F.col("node") == paths.end, F.col("no"))).over(person)
        numbered = numbered.withColumn("ends", ends).where(F.col("no") <= F.col("ends"))
    first = F.col("begins") if paths.start is not None else F.lit(1)
    return numbered.withColumn("step", F.col("no") - first + 1).where(F.col("step") <= paths.steps).select("person_id", "step", "node", "at")


def hops(source: Source, paths: Paths, period: Period) -> DataFrame:
    """person_id, source, target, took_us of each step to the next; nodes as '<step>_<node>'."""
    order = Window.partitionBy("person_id").orderBy("step")
    name = lambda step, node: F.concat(step.cast("string"), F.lit("_"), node)
    stepped = walks(source, paths, period).withColumn("next_node", F.lead("node").over(order)).withColumn("next_at", F.lead("at").over(order))
    return stepped.where(F.col("next_node").isNotNull()).select("person_id", name(F.col("step"), F.col("node")).alias("source"), name(F.col("step") + 1, F.col("next_node")).alias("target"), (F.col("next_at") - F.col("at")).alias("took_us"))


def links(source: Source, paths: Paths, period: Period) -> DataFrame:
    """Columns source, target, persons, average_s: the links that most persons took, at most
    `edges` of them; ties by name."""
    found = hops(source, paths, period).groupBy("source", "target").agg(F.count(F.lit(1)).alias("persons"), (F.sum("took_us") / F.count(F.lit(1)) / 1e6).alias("average_s"))
    return found.orderBy(F.desc("persons"), "source", "target").limit(paths.edges)


def actors(source: Source, paths: Paths, period: Period, start: str, target: str) -> DataFrame:
    """person_id of those who took the link."""
    return hops(source, paths, period).where((F.col("source") == start) & (F.col("target") == target)).select("person_id").distinct()
