"""Ordered work without sending a whole group to one task.

Rows are cut into chunks by their order number. Windows run inside a chunk; only one summary row per
chunk is handled in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textfix.operators.lookup import lookup_join
from textfix.session import materialize

CHUNK_ROWS = 100_000


def number_rows(df: DataFrame, order: str, name: str, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Add the global row number (from 1) in the order of a dense integer column."""
    chunked = df.withColumn("_chunk", F.floor(F.col(order) / chunk_rows))
    before = Window.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = chunked.groupBy("_chunk").agg(F.count(F.lit(1)).alias("_n")).select(
        "_chunk", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")
    )
    local = F.row_number().over(Window.partitionBy("_chunk").orderBy(order))
    return (
        chunked.withColumn("_local", local)
        .join(offsets, "_chunk")
        .withColumn(name, (F.col("_before") + F.col("_local")).cast("long"))
        .drop("_chunk", "_local", "_before")
    )


def previous_value(
    df: DataFrame,
    order: str,
    value: Column,
    name: str,
    group: list[str] | None = None,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Add the last non-NULL ``value`` of the rows before this one, per group.

    ``order`` is an integer column without repeats in a group.
    """
    # A struct of the group columns as key: NULL groups equal themselves in joins.
    keys = ["_g"]
    chunked = df.withColumns({
        "_g": F.struct(F.lit(0).alias("_0"), *(group or [])),
        "_chunk": F.floor(F.col(order) / chunk_rows),
        "_v": value,
    })
    spot = Window.partitionBy(*keys, "_chunk").orderBy(order)
    local = F.last("_v", ignorenulls=True).over(
        spot.rowsBetween(Window.unboundedPreceding, -1)
    )
    tails = chunked.groupBy(*keys, "_chunk").agg(
        F.max_by("_v", F.when(F.col("_v").isNotNull(), F.col(order))).alias("_tail")
    )
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = tails.select(
        *keys, "_chunk", F.last("_tail", ignorenulls=True).over(before).alias("_carried")
    )
    return (
        chunked.withColumn("_local", local)
        .join(carried, [*keys, "_chunk"])
        .withColumn(name, F.coalesce("_local", "_carried"))
        .drop("_g", "_chunk", "_v", "_local", "_carried")
    )


def values_at_ranks(
    df: DataFrame,
    value: str,
    ranks: dict[str, Column],
    shares: list[float],
    group: list[str],
) -> DataFrame:
    """Exact values at given 0-based ranks of each group: rows (group, label, value).

    ``ranks`` are expressions of the group size ``n``; ``shares`` say roughly where they lie.
    Equal values are counted first. Approximate quantiles just below and above each share then cut
    a group into bands; counts per band tell which band holds a rank, and only that band is
    sorted. The quantiles steer the amount of work, never the result.
    """
    near = sorted({min(max(s + d, 0.0), 1.0) for s in shares for d in (-0.002, 0.002)})
    # A struct of the group columns as key: NULL groups equal themselves in joins.
    rows = df.where(F.col(value).isNotNull()).select(
        F.struct(F.lit(0).alias("_0"), *group).alias("_g"), F.col(value).alias("_v")
    )
    sizes = rows.groupBy("_g").agg(
        F.count(F.lit(1)).alias("n"), F.percentile_approx("_v", near, 10_000).alias("_cuts")
    )
    sizes = materialize(sizes.withColumn("_w", F.col("n")), "group-sizes")
    counted = rows.groupBy("_g", "_v").agg(F.count(F.lit(1)).alias("_c"))
    banded = (
        lookup_join(counted, sizes, "_g", "_w")
        .withColumn("_band", F.size(F.filter("_cuts", lambda c: c < F.col("_v"))))
        .drop("_cuts")
    )
    spans = banded.groupBy("_g", "n", "_band").agg(F.sum("_c").alias("_in"))
    order = Window.partitionBy("_g").orderBy("_band").rowsBetween(Window.unboundedPreceding, -1)
    wanted = F.array(
        *[F.struct(F.lit(k).alias("label"), r.cast("long").alias("rank")) for k, r in ranks.items()]
    )
    here = F.filter(
        wanted,
        lambda w: (w["rank"] >= F.col("_before")) & (w["rank"] < F.col("_before") + F.col("_in")),
    )
    targets = (
        spans.withColumn("_before", F.coalesce(F.sum("_in").over(order), F.lit(0)))
        .select("_g", "_band", "_before", here.alias("_wanted"))
        .where(F.size("_wanted") > 0)
    )
    in_band = Window.partitionBy("_g", "_band").orderBy("_v")
    picked = banded.join(targets, ["_g", "_band"]).withColumn(
        "_upto", F.col("_before") + F.sum("_c").over(in_band)
    )
    hit = F.filter(
        "_wanted",
        lambda w: (w["rank"] < F.col("_upto")) & (w["rank"] >= F.col("_upto") - F.col("_c")),
    )
    found = picked.select("_g", F.explode(hit).alias("_hit"), F.col("_v").alias("value"))
    return found.select(*[F.col("_g")[g].alias(g) for g in group], F.col("_hit.label").alias("label"), "value")


def first_rows(df: DataFrame, order: str, k: int) -> DataFrame:
    """The first ``k`` rows by a unique column of any type that has an order, whatever ``k`` is.

    The rows are written once in ranges of the order. Counts of the ranges say which are taken whole;
    only the range in which the last row lies is sorted.
    """
    ranged = df.repartitionByRange(F.col(order)).withColumn("_range", F.spark_partition_id())
    ranged = materialize(ranged, "first-rows")
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))  # a row for each task
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    whole = sizes.where(F.col("_before") + F.col("_n") <= k).select("_range")
    last = sizes.where((F.col("_before") < k) & (F.col("_before") + F.col("_n") > k))
    inside = Window.partitionBy("_range").orderBy(order)
    cut = (
        ranged.join(F.broadcast(last), "_range")
        .withColumn("_no", F.row_number().over(inside) + F.col("_before"))
        .where(F.col("_no") <= k)
    )
    return ranged.join(F.broadcast(whole), "_range").select(*df.columns).unionByName(
        cut.select(*df.columns)
    )
