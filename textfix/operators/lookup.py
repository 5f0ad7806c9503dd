"""Attach values to words by a join in which no key gathers in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lookup_join(left: DataFrame, right: DataFrame, key: str, weight: str) -> DataFrame:
    """Left join on ``key``; ``right`` has one row per key and ``weight`` counts its left rows.

    ``right`` should hold every frequent key of ``left``, those without values included, since hot
    keys are found by their weight. A key with over a quarter of a task's mean share is joined by
    broadcast where its rows are: that is at most four keys per shuffle partition. All other rows,
    and rows without a key, take part in a plain join.
    """
    values = [c for c in right.columns if c not in (key, weight)]
    tasks = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = right.agg(F.sum(weight).alias("total")).scalar()
    hot = F.col(weight) * (4 * tasks) > total
    hot_rows = F.broadcast(right.where(hot).select(key, *values))
    cold_rows = right.where(~F.coalesce(hot, F.lit(False))).select(F.col(key).alias("_key"), *values)
    # A NULL key matches nothing; a random key of its own spreads such rows.
    rest = left.join(hot_rows.select(key), key, "left_anti")
    keyed = rest.where(F.col(key).isNotNull())
    joined = keyed.join(cold_rows, F.col(key) == F.col("_key"), "left").drop("_key")
    empty = [F.lit(None).cast(right.schema[c].dataType).alias(c) for c in values]
    unkeyed = left.where(F.col(key).isNull()).select(*left.columns, *empty)
    names = [*left.columns, *values]
    return (
        joined.select(*names)
        .unionByName(left.join(hot_rows, key).select(*names))
        .unionByName(unkeyed.select(*names))
    )
