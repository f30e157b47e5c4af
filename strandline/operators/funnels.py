"""Funnels: how far people get through a series of steps within a window."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.contract import OTHER, Filter, Funnel, Period, check_funnel
from strandline.functions import properties
from strandline.operators.relation import Source, named, needs_person_properties, relation

ORDER = ("at", "uuid")


def _rows(source: Source, funnel: Funnel, period: Period) -> DataFrame:
    """person_id, at, uuid, s0..sn (matches step), x0..xm (is exclusion), breakdown."""
    filters: tuple[Filter, ...] = (*funnel.filters, *(f for s in funnel.steps for f in s.filters))
    b = funnel.breakdown
    per_person = needs_person_properties(filters) or (b is not None and b.scope == "person")
    events = relation(source, period.start, period.end, True, per_person)
    names = [s.event for s in funnel.steps] + [x.event for x in funnel.exclusions]
    if funnel.order != "strict" and None not in names:
        # not derivable from the step conditions by the optimizer; reaches the scan
        events = events.where(F.col("event").isin(sorted(set(names))))
    common = properties.condition(funnel.filters)
    steps = [(named(s.event) & properties.condition(s.filters) & common).alias(f"s{i}") for i, s in enumerate(funnel.steps)]
    exclusions = [(F.col("event") == x.event).alias(f"x{j}") for j, x in enumerate(funnel.exclusions)]
    value = properties.label(properties.text(b.key, b.scope)) if b else F.lit(None).cast("string")
    rows = events.select("person_id", *ORDER, *steps, *exclusions, value.alias("breakdown"))
    if funnel.order == "strict":
        return rows
    useful = reduce(lambda a, c: a | c, (F.col(c) for c in rows.columns if c[0] in "sx" and c[1:].isdigit()))
    return rows.where(useful)


def _next(value: Column, including: bool) -> Column:
    """The nearest non-null `value` at a later row of the person (or at this one, if including).

    Read backwards, it is the last one seen so far, which a window keeps up row by row.
    """
    back = Window.partitionBy("person_id").orderBy(F.desc("at"), F.desc("uuid"))
    return F.last(value, ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, 0 if including else -1))


def _ordered(rows: DataFrame, funnel: Funnel) -> DataFrame:
    """Per anchor `times`: when each step was reached in turn, and `bad`: an exclusion came between.

    The earliest next row that matches a step is the same for every attempt that is at this row,
    so one pass from the last step to the first finds all attempts. Nothing is collected: a person
    with any number of rows streams through the window.
    """
    n = len(funnel.steps)
    back = Window.partitionBy("person_id").orderBy(F.desc("at"), F.desc("uuid"))
    rows = rows.withColumn("rn", -F.row_number().over(back))
    for j in range(len(funnel.exclusions)):
        rows = rows.withColumn(f"nx{j}", _next(F.when(F.col(f"x{j}"), F.struct("rn", "at")), False))
    marks = [F.col(f"nx{j}").alias(f"nx{j}") for j in range(len(funnel.exclusions))]
    for k in range(n - 1, -1, -1):
        chain = F.struct("at", "rn", *marks)
        here = F.array(chain) if k == n - 1 else F.concat(F.array(chain), F.coalesce(F.col("later"), F.array().cast(rows.schema["later"].dataType)))
        rows = rows.withColumn("chain", F.when(F.col(f"s{k}"), here))
        if k:
            rows = rows.withColumn("later", _next(F.col("chain"), False))
    anchors = rows.where("s0")
    within = F.filter("chain", lambda c: c["at"] - F.col("at") <= funnel.window_us)
    anchors = anchors.withColumn("reached", within).withColumn("times", F.transform("reached", lambda c: c["at"]))
    bad = F.lit(False)
    for j, x in enumerate(funnel.exclusions):
        since = F.get(F.col("reached"), F.lit(x.from_step))[f"nx{j}"]
        until = F.get(F.col("reached"), F.lit(x.to_step))["rn"]
        between = F.when(until.isNotNull(), since["rn"] < until).otherwise(since["at"] - F.col("at") <= funnel.window_us)
        bad = bad | F.coalesce(between, F.lit(False))
    return anchors.where(~bad)


def _strict(rows: DataFrame, funnel: Funnel) -> DataFrame:
    """Attempts whose steps are consecutive events; an exclusion can't come between."""
    on = Window.partitionBy("person_id").orderBy(*ORDER)
    for k in range(1, len(funnel.steps)):
        rows = rows.withColumn(f"t{k}", F.lead(F.when(F.col(f"s{k}"), F.col("at")), k).over(on))
    times, so_far = [F.col("at")], F.lit(True)
    for k in range(1, len(funnel.steps)):
        so_far = so_far & F.coalesce(F.col(f"t{k}") - F.col("at") <= funnel.window_us, F.lit(False))
        times.append(F.when(so_far, F.col(f"t{k}")))
    return rows.withColumn("times", F.array_compact(F.array(*times))).where("s0")


def _unordered(rows: DataFrame, funnel: Funnel) -> DataFrame:
    """Attempts from any step's event; one event may cover several steps."""
    for k in range(len(funnel.steps)):
        rows = rows.withColumn(f"t{k}", _next(F.when(F.col(f"s{k}"), F.col("at")), True))
    covered = [F.when(F.col(f"t{k}") - F.col("at") <= funnel.window_us, F.col(f"t{k}")) for k in range(len(funnel.steps))]
    return rows.withColumn("times", F.sort_array(F.array_compact(F.array(*covered)))).where(F.size("times") > 0)


def outcomes(source: Source, funnel: Funnel, period: Period) -> DataFrame:
    """One row per person in the funnel: person_id, depth, times (µs per step reached), breakdown.

    Of a person's attempts the deepest counts, of those the earliest. Rows of one person are in
    order of time, then uuid; a step is in time up to and including the window. The breakdown is
    the value at the attempt's first event. Persons are partitioned by hash; hot ones stream.
    """
    check_funnel(funnel)
    attempts = {"ordered": _ordered, "strict": _strict, "unordered": _unordered}[funnel.order](_rows(source, funnel, period), funnel)
    best = F.max(F.struct(F.size("times").alias("depth"), (-F.col("at")).alias("earliest"), "place", "times", "breakdown"))
    on = Window.partitionBy("person_id").orderBy(F.desc("at"), F.desc("uuid"))
    # of attempts at the same time the first row's counts
    placed = attempts.withColumn("place", F.row_number().over(on))
    return placed.groupBy("person_id").agg(best.alias("best")).select("person_id", "best.depth", "best.times", "best.breakdown")


def with_shown(found: DataFrame, limit: int) -> DataFrame:
    """Outcomes with their breakdown folded to the `limit` values that most persons enter with."""
    ranked = found.groupBy("breakdown").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "breakdown").limit(limit).collect()
    top = [r["breakdown"] for r in ranked]
    return found.withColumn("breakdown", F.when(F.col("breakdown").isin(top), F.col("breakdown")).otherwise(F.lit(OTHER)))


def steps(found: DataFrame, n_steps: int, by_breakdown: bool = False) -> DataFrame:
    """Per step (from 0): count, conversion_rate (% of the first), dropped_off (from the step
    before), average_s and median_s from the step before; per breakdown if asked for."""
    group = ["breakdown"] if by_breakdown else []
    reached = found.select(*group, "times", F.explode(F.sequence(F.lit(0), F.col("depth") - 1)).alias("step"))
    took = (F.get("times", F.col("step")) - F.get("times", F.col("step") - 1)) / 1e6
    per_step = reached.groupBy(*group, "step").agg(F.count(F.lit(1)).alias("count"), F.avg(took).alias("average_s"), F.percentile(took, 0.5).alias("median_s"))
    keys = found.select(*group).distinct() if by_breakdown else found.sparkSession.range(1).select()
    grid = keys.withColumn("g_step", F.explode(F.sequence(F.lit(0), F.lit(n_steps - 1))))
    if by_breakdown:
        grid = grid.withColumnRenamed("breakdown", "g_breakdown")
    same = F.col("g_step") == F.col("step")
    if by_breakdown:
        same = same & F.col("g_breakdown").eqNullSafe(F.col("breakdown"))
    all_steps = grid.join(per_step, same, "left").withColumn("count", F.coalesce("count", F.lit(0)))
    on = Window.partitionBy(*(["g_breakdown"] if by_breakdown else [F.lit(0)])).orderBy("g_step")
    first, before = F.first("count").over(on), F.lag("count").over(on)
    return all_steps.select(
        *([F.col("g_breakdown").alias("breakdown")] if by_breakdown else []),
        F.col("g_step").alias("step"),
        "count",
        F.when(first > 0, 100.0 * F.col("count") / first).otherwise(0.0).alias("conversion_rate"),
        F.coalesce(before - F.col("count"), F.lit(0)).alias("dropped_off"),
        "average_s",
        "median_s",
    )


def time_to_convert(found: DataFrame, n_steps: int, max_bins: int = 11) -> DataFrame:
    """Histogram of the seconds from first to last step, of those who finish: from_s, width_s, n.

    Bins of whole seconds, at most `max_bins`, empty ones included; no finishers, no bins.
    """
    done = found.where(F.col("depth") == n_steps).select(((F.element_at("times", -1) - F.element_at("times", 1)) / 1e6).alias("s"))
    low, high = done.agg(F.floor(F.min("s")), F.max("s")).first()
    if low is None:
        return found.sparkSession.createDataFrame([], "from_s long, width_s long, n long")
    width = max(1, -(-int(high - low + 1) // (max_bins - 1)))
    counts = done.groupBy(F.floor((F.col("s") - low) / width).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    bins = found.sparkSession.range(int((high - low) // width) + 1).withColumnRenamed("id", "b")
    return bins.join(counts, F.col("b") == F.col("bin"), "left").select((F.col("b") * width + low).alias("from_s"), F.lit(width).cast("long").alias("width_s"), F.coalesce("n", F.lit(0)).alias("n"))


def actors(found: DataFrame, step: int, dropped: bool = False) -> DataFrame:
    """person_id of those who got past to `step` (converted), or got to the one before and no further."""
    if dropped:
        return found.where((F.col("depth") == step) & (F.lit(step) > 0)).select("person_id")
    return found.where(F.col("depth") > step).select("person_id")
