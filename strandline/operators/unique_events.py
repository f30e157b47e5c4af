"""One row per event id: retries and repeated deliveries reduced to the earliest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def earliest(df: DataFrame, key: Column, order: Column, also: dict[str, Column] | None = None, **values: Column) -> DataFrame:
    """One row per `key`, with the `values` of its row that comes first by `order`.

    A minimum over (order, values): it is combined on the map side, so a key that holds a third
    of all rows leaves each task as one row, and there is a single shuffle, on the key. Rows that
    tie in `order` are decided by the values in the order given, so the result doesn't depend on
    the order of arrival. A row without `order` counts only where the key has no other. Null keys
    form one group, as in SQL GROUP BY. `also`: aggregates over all rows of the key.
    Columns: key, at, the values, then `also`.
    """
    also = also or {}
    first = F.min(F.struct(order.isNull().alias("unknown"), order.alias("at"), *(c.alias(n) for n, c in values.items())))
    grouped = df.groupBy(key.alias("key")).agg(first.alias("first"), *(c.alias(n) for n, c in also.items()))
    return grouped.select("key", "first.at", *(F.col("first")[n].alias(n) for n in values), *also)
