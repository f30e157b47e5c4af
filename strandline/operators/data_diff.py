"""Differences between two copies of one dataset, row by row and field by field."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def residues(left: DataFrame, right: DataFrame) -> DataFrame:
    """EXCEPT ALL in both directions at once: each row with `surplus`, its number of copies in
    `left` less those in `right`; rows with equal numbers are gone.

    Both directions come from one aggregation over the signed union, which is what EXCEPT ALL is
    rewritten to for each direction alone. It is combined on the map side, so a row repeated any
    number of times is one row per task. Nulls equal nulls.
    """
    signed = left.withColumn("surplus", F.lit(1)).unionByName(right.withColumn("surplus", F.lit(-1)))
    return signed.groupBy(*left.columns).agg(F.sum("surplus").alias("surplus")).where("surplus <> 0")


def diff_copies(left: DataFrame, right: DataFrame, key: str, fields: list[str], left_only: str, right_only: str) -> DataFrame:
    """Columns key, field, left_copies, right_copies: one row for each key only one side has
    (field = `right_only` / `left_only`) and for each field that differs in a key both have.

    Normalise and reduce both sides first; they need the columns `key` and `fields`, others are
    ignored. A key with several differing rows on one side is compared by its smallest residue;
    a null key is matched with a null key. Null differs from any value. Of rows that both sides
    hold in unequal numbers the surplus copies count as one-sided. Empty tables give every key of
    the other side, or nothing.

    The full join of the two residues by key is one aggregation by key of both, told apart by the
    sign of their surplus: the residues come from one pass and are not split into two inputs first.
    """
    columns = [F.col(key).alias("key"), *(F.col(f).alias(f"f{i}") for i, f in enumerate(fields))]
    rest = residues(left.select(*columns), right.select(*columns))
    values = F.struct(*(f"f{i}" for i in range(len(fields))))

    def side(sign: int, tag: str) -> list[Column]:
        own = F.col("surplus") * sign > 0
        return [F.min(F.when(own, values)).alias(tag), F.sum(F.when(own, F.col("surplus") * sign)).alias(f"{tag}_copies")]

    joined = rest.groupBy("key").agg(*side(1, "left"), *side(-1, "right"))
    one_sided = [
        F.when(F.col("right_copies").isNull(), F.lit(left_only)),
        F.when(F.col("left_copies").isNull(), F.lit(right_only)),
    ]
    differing = [F.when(F.col("left_copies").isNotNull() & F.col("right_copies").isNotNull() & ~F.col("left")[f"f{i}"].eqNullSafe(F.col("right")[f"f{i}"]), F.lit(f)) for i, f in enumerate(fields)]
    return joined.select(
        F.col("key").alias(key),
        F.explode(F.array_compact(F.array(*one_sided, *differing))).alias("field"),
        F.coalesce("left_copies", F.lit(0)).alias("left_copies"),
        F.coalesce("right_copies", F.lit(0)).alias("right_copies"),
    )
