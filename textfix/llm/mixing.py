"""Mixing sources to target weights, with built-in functions only.

Targets are found by filling up: a source that reaches its limit stops and the others share the rest.
A source's documents are in a random order given by a hash of their id and lie in 256 blocks of that
order. Whole passes take all blocks; the last pass takes blocks from the front and ends inside one,
which is opened twice more (256 smaller blocks, then its documents), so no window ever holds more than
256 rows or 1/65536 of a source.

The blocks that are taken are dealt to output shards by a splitting tree: each node cuts its blocks,
in an order drawn at random for that node, into two halves that differ by one block at most. How many
blocks of each source a half receives is then a draw from the multivariate hypergeometric
distribution, the quotas add up exactly, and no block is dealt twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textfix.llm.common import WORD, attach
from textfix.session import materialize

SEED = 20


def targets(sizes: DataFrame, weights: tuple[int, ...], share: float, limit: float) -> DataFrame:
    """Add ``target`` to (source, source_size): weights repeat along the sources in order.

    The windows are over the sources, not their documents. ``level`` is what a weight of one gets
    if all sources with a smaller limit per weight stop there; the true level is the largest.
    """
    every = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("no") % len(weights) + 1).cast("int"))
    ranked = sizes.withColumn("no", F.row_number().over(every) - 1).withColumn("weight", weight)
    ranked = ranked.withColumn("most", F.col("source_size") * F.lit(float(limit)))
    everything = Window.partitionBy()
    before = Window.orderBy(F.col("most") / F.col("weight"), "no").rowsBetween(
        Window.unboundedPreceding, -1
    )
    total = F.sum("source_size").over(everything) * F.lit(float(share))
    left = total - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    to_share = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    leveled = ranked.withColumn("level", left / to_share)
    level = F.max("level").over(everything)
    return leveled.withColumn("target", F.least("most", level * F.col("weight"))).drop(
        "no", "weight", "most", "level"
    )


def _cut(parts: DataFrame, by: str, keys: list[str]) -> DataFrame:
    """The part in which each source's last pass ends, and the words it needs from there.

    ``parts`` has (keys, by, words, rest). A source whose last pass is empty has no cut.
    """
    front = Window.partitionBy(*keys).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    seen = parts.withColumn("_before", F.coalesce(F.sum("words").over(front), F.lit(0)))
    here = (F.col("_before") < F.col("rest")) & (F.col("rest") <= F.col("_before") + F.col("words"))
    return seen.where(here).withColumn("rest", F.col("rest") - F.col("_before")).drop("_before")


def mix(
    df: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: tuple[int, ...] = (3, 1, 2),
    share: float = 1.5,
    limit: int = 2,
    shards: int = 16,
    whole: bool = False,
) -> DataFrame:
    """(id, size, source_size, target, taken, shards) per row of ``df``.

    ``size`` counts words (NULL text: 0). ``taken`` is how many words the mix takes: whole passes,
    and for one document per source part of a pass, or with ``whole`` all or nothing of it, whichever
    is nearer to the target. ``shards`` lists where its passes go, an array
    of as many shards as passes; ``shards`` (the argument) must be a power of two. Rows that repeat
    an id share one place in the order. A NULL source is a source, the last one; sources without
    words have target 0. NULL ids share one place. The same input gives the same mix.
    """
    place = F.xxhash64(F.lit(SEED), F.col("id"))
    rows = df.select(
        F.col(id_col).alias("id"),
        F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)).cast("long").alias("size"),
        F.col(source).alias("source"),
    )
    rows = rows.select(
        "id", "size", "source",
        F.shiftrightunsigned(place, 56).cast("int").alias("b1"),
        F.shiftrightunsigned(place, 48).bitwiseAND(255).cast("int").alias("b2"),
        place.alias("place"),
    )
    # A name that is never NULL and tells NULL from every string.
    name = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))
    rows = materialize(rows.withColumn("name", name), "mix-rows")
    blocks = rows.groupBy("name", "source", "b1").agg(
        F.sum("size").alias("words"), F.count(F.lit(1)).alias("n")
    )
    blocks = materialize(blocks, "mix-blocks")
    sources = blocks.groupBy("name", "source").agg(F.sum("words").alias("source_size"))
    planned = targets(sources, weights, share, limit)
    full = F.coalesce(F.floor(F.col("target") / F.nullif("source_size", F.lit(0))), F.lit(0)).cast("int")
    planned = planned.withColumn("passes", full).withColumn(
        "rest", F.round(F.col("target") - F.col("passes") * F.col("source_size")).cast("long")
    )
    planned = materialize(planned.drop("source"), "mix-plan")

    cut1 = _cut(blocks.select("name", "b1", "words").join(planned.select("name", "rest"), "name"), "b1", ["name"])
    cut1 = materialize(cut1.select("name", F.col("b1").alias("cut1"), "rest"), "mix-cut1")
    inside = rows.join(cut1, (rows["name"] == cut1["name"]) & (rows["b1"] == cut1["cut1"])).select(
        rows["name"], "b2", "place", "size", "rest"
    )
    cut2 = _cut(inside.groupBy("name", "b2", "rest").agg(F.sum("size").alias("words")), "b2", ["name"])
    cut2 = materialize(cut2.select("name", F.col("b2").alias("cut2"), F.col("rest").alias("rest2")), "mix-cut2")
    deep = inside.drop("rest").join(
        cut2, (inside["name"] == cut2["name"]) & (inside["b2"] == cut2["cut2"])
    ).select(inside["name"], "place", "size", F.col("rest2").alias("rest"))
    cut3 = _cut(deep.groupBy("name", "place", "rest").agg(F.sum("size").alias("words")), "place", ["name"])
    cut3 = cut3.select(
        "name", F.col("place").alias("cut3"), (F.col("rest") / F.col("words")).alias("portion")
    )
    ends = cut1.select("name", "cut1").join(cut2.select("name", "cut2"), "name").join(cut3, "name")

    plan = blocks.select("name", "b1", "n").join(planned, "name").join(ends, "name", "left")
    plan = materialize(plan, "mix-blocks-planned")
    dealt = deal(plan, shards)
    plan = plan.join(dealt, ["name", "b1"], "left").drop("rest")
    plan = materialize(plan, "mix-dealt")
    out = attach(rows, plan, ["name", "b1"], "n")
    # The order of documents is (b1, b2, place); the three cuts say where the last pass ends.
    b1, b2, at = F.col("b1"), F.col("b2"), F.col("place")
    last = (
        F.when(F.col("cut1").isNull() | (b1 > F.col("cut1")), 0)
        .when(b1 < F.col("cut1"), F.col("size"))
        .when(b2 < F.col("cut2"), F.col("size"))
        .when(b2 > F.col("cut2"), 0)
        .when(at < F.col("cut3"), F.col("size"))
        .when(at > F.col("cut3"), 0)
        .otherwise(F.col("size") * F.round(F.col("portion")) if whole else F.round(F.col("size") * F.col("portion")))
        .cast("long")
    )
    out = out.withColumn("last", last)
    used = F.when(F.col("size") == 0, 0).otherwise(F.col("passes") + (F.col("last") > 0).cast("int"))
    return out.select(
        F.col("id").alias(id_col), "size", "source_size", "target",
        (F.col("size") * F.col("passes") + F.col("last")).alias("taken"),
        F.slice(F.coalesce("dealt", F.array().cast("array<int>")), F.lit(1), used).alias("shards"),
    )


def deal(plan: DataFrame, shards: int) -> DataFrame:
    """(name, b1, dealt): the shards of each block's passes, by the splitting tree.

    The table has a row for each block and pass, a number that follows the sources and not the
    documents.
    """
    last_pass = (F.col("cut1").isNotNull() & (F.col("b1") <= F.col("cut1"))).cast("int")
    n_passes = F.col("passes") + last_pass
    taken = plan.where(n_passes > 0).select(
        "name", "b1", F.explode(F.sequence(F.lit(1), n_passes)).alias("pass")
    )
    taken = taken.withColumn("node", F.lit(0))
    for depth in range(shards.bit_length() - 1):
        drawn = F.xxhash64(F.lit(SEED), F.lit(depth), "name", "b1", "pass")
        order = Window.partitionBy("node").orderBy(drawn, "name", "b1", "pass")
        half = F.row_number().over(order) * 2 > F.count(F.lit(1)).over(Window.partitionBy("node"))
        taken = taken.withColumn("_half", half.cast("int")).withColumn(
            "node", F.col("node") * 2 + F.col("_half")
        ).drop("_half")
    listed = F.array_sort(F.collect_list(F.struct("pass", "node")))
    return taken.groupBy("name", "b1").agg(
        F.transform(listed, lambda x: x["node"]).alias("dealt")
    )


def draw(df: DataFrame, mixed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The documents as the mix takes them, in the columns of ``df``: a row for each pass.

    ``mixed`` is the result of ``mix`` with ``whole``. Rows are ordered by shard and at random inside a
    shard, in each partition.
    """
    picked = mixed.where(F.size("shards") > 0).groupBy(F.col(id_col).alias("_id")).agg(
        F.first("shards").alias("_shards")
    )
    rows = df.join(picked, df[id_col].eqNullSafe(F.col("_id"))).select(
        df["*"], F.posexplode("_shards").alias("_pass", "_shard")
    )
    random = F.xxhash64(F.lit(SEED), F.col("_shard"), F.col("_pass"), F.col(id_col))
    return rows.sortWithinPartitions("_shard", random).select(df.columns)
