"""Helpers shared by the corpus operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textfix.session import materialize

# The white space of the corpus operators: blank and the controls 0x09 to 0x0D.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def attach(left: DataFrame, right: DataFrame, key: str | list[str], weight: str) -> DataFrame:
    """Left join on ``key``; ``right`` has one row per key and ``weight`` says how many left rows.

    Keys that hold more than a quarter of a task's mean share are joined by broadcast where their
    left rows are: by that definition there are at most four such keys per shuffle partition. All
    other rows are joined by a shuffle in which no key is large. Both tables should be written
    tables, as they are read more than once. NULL keys get NULL values.
    """
    spark = left.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    total = right.agg(F.sum(weight)).first()[0] or 0
    is_hot = F.coalesce(F.col(weight) * (4 * parts) > F.lit(int(total)), F.lit(False))
    hot = F.broadcast(right.where(is_hot).drop(weight))
    names = [key] if isinstance(key, str) else key
    rest = left.join(hot.select(*names), key, "left_anti")
    cold = rest.join(right.where(~is_hot).drop(weight), key, "left")
    return cold.unionByName(left.join(hot, key))


def without(df: DataFrame, key: list[str], drop: DataFrame, again: DataFrame) -> DataFrame:
    """The rows of ``df`` whose key isn't in ``drop``; of those whose key is in ``again`` only one.

    ``again`` should be a written table; as a rule it is empty, and no other row is compared.
    """
    rest = df.join(drop, key, "left_anti")
    if again.isEmpty():
        return rest
    once = rest.join(again, key, "left_semi").dropDuplicates(key)
    return rest.join(again, key, "left_anti").unionByName(once)


def components(edges: DataFrame, name: str) -> DataFrame:
    """(node, root) for every node of an undirected graph; ``root`` is the smallest node reached.

    ``edges`` has two long columns, a and b. Large-star and small-star rounds: each links the
    neighbours of a node to its smallest one, until nothing changes. Every round is written to the
    shared folder, so a lost executor costs at most one round.
    """
    high, low = F.greatest("a", "b"), F.least("a", "b")
    now = edges.where(F.col("a") != F.col("b")).select(high.alias("u"), low.alias("v"))
    now = materialize(now.distinct(), f"{name}-edges")
    seen = None
    while True:
        mark = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if mark == seen or not mark[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        seen = mark
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = (
            attach(both, _smallest(both, name), "u", "n")
            .where(F.col("v") > F.col("u"))
            .select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
            .distinct()
        )
        large = materialize(large, f"{name}-large")
        least = _smallest(large, name)
        small = (
            attach(large, least, "u", "n")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(least.select("u", F.col("m").alias("v")))
            .where(F.col("u") != F.col("v"))
            .distinct()
        )
        now = materialize(small, f"{name}-edges")


def _smallest(edges: DataFrame, name: str) -> DataFrame:
    """(u, smallest neighbour m, number of neighbours n)."""
    found = edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    return materialize(found, f"{name}-least")
