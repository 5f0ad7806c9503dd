import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from textfix.operators.lookup import lookup_join
from textfix.operators.ordering import first_rows, number_rows, previous_value, values_at_ranks
from textfix.operators.stats import (
    mean_and_median,
    median_throughput,
    metric_pivot,
    metric_series,
    nearest_rank_percentiles,
)


def test_number_rows(spark):
    df = spark.range(1000).select((F.col("id") * 7 + 3).alias("o")).repartition(5)
    got = {r["o"]: r["n"] for r in number_rows(df, "o", "n", 100).collect()}
    assert got == {i * 7 + 3: i + 1 for i in range(1000)}


def test_previous_value(spark):
    rng = random.Random(3)
    rows = [(g, o, rng.choice([None, None, None, o])) for g in "ab" for o in range(300)]
    df = spark.createDataFrame(rows, "g string, o long, v long").repartition(4)
    for chunk in (7, 1000):
        got = {(r["g"], r["o"]): r["p"] for r in previous_value(df, "o", F.col("v"), "p", ["g"], chunk).collect()}
        last = {}
        for g, o, v in rows:
            assert got[(g, o)] == last.get(g)
            last[g] = v if v is not None else last.get(g)


def nearest_rank(xs, p):
    xs = sorted(xs)
    return xs[max(0, min(len(xs) - 1, int(round(p / 100 * (len(xs) - 1)))))]


@pytest.mark.parametrize("n", [1, 2, 4, 6, 5000])
def test_percentiles(spark, n):
    rng = random.Random(n)
    groups = {"x": [rng.random() for _ in range(n)], "ties": [rng.choice([1.0, 1.0, 2.0]) for _ in range(n)]}
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs], "g string, v double")
    ps = (0, 50, 75, 99, 100) if n < 100 else (50, 99)
    got = {(r["g"], r["p"]): r["value"] for r in nearest_rank_percentiles(df, "v", ["g"], ps).collect()}
    assert got == {(g, float(p)): nearest_rank(vs, p) for g, vs in groups.items() for p in ps}


def test_ranks_do_not_depend_on_the_estimate(spark):
    df = spark.range(2000).select(F.lit("g").alias("g"), (F.col("id") * 3 % 2000).cast("double").alias("v"))
    wrong = values_at_ranks(df, "v", {"a": F.lit(17), "b": F.lit(1999)}, [0.5], ["g"])
    assert {(r["label"], r["value"]) for r in wrong.collect()} == {("a", 17.0), ("b", 1999.0)}


def test_mean_and_median(spark):
    rows = [("a", 1.0), ("a", 2.0), ("a", 4.0), ("a", 100.0), ("b", 5.0), (None, 3.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r["g"]: (r["mean"], r["median"]) for r in mean_and_median(df, "v", ["g"]).collect()}
    assert got == {"a": (26.75, 3.0), "b": (5.0, 5.0), None: (3.0, 3.0)}


def test_throughput(spark):
    rows = [("m", 1, 10, 1.0), ("m", 1, 10, 1.0), ("m", 2, 30, 1.0), ("m", 3, 5, 1.0)]
    df = spark.createDataFrame(rows, "model string, run int, items int, sec double")
    assert median_throughput(df, "items", "sec", ["model"], "run").first()["throughput"] == 10.0


def test_metrics(spark):
    rows = [
        (0, "throughput", "mini", 1, 1, 20.2), (1, "throughput", "mini", 1, 4, 47.0),
        (2, "throughput", "tiny", 1, 1, 35.4), (3, "throughput", "mini", 1, 1, 21.0),
        (4, "beam_throughput", "mini", 2, 16, 90.4), (5, "speller_only", None, None, None, 6480.0),
    ]
    df = spark.createDataFrame(rows, "seq long, metric string, model string, beam int, batch int, value double")
    got = {r["batch"]: (r["mini"], r["tiny"]) for r in metric_pivot(df, names=["mini", "tiny"]).collect()}
    assert got == {1: (21.0, 35.4), 4: (47.0, None)}
    assert {r["beam"]: r["value"] for r in metric_series(df).collect()} == {2: 90.4}


def test_first_rows(spark):
    df = spark.range(30_000).select((F.col("id") * 13).alias("o")).repartition(6)
    for k in (5, 20_000, 40_000):
        assert first_rows(df, "o", k).agg(F.count("*"), F.max("o")).first() == (
            min(k, 30_000), (min(k, 30_000) - 1) * 13
        )


def test_lookup_join_with_a_hot_key(spark):
    keys = ["hot"] * 5000 + [f"k{i}" for i in range(2000)] + [None] * 50 + ["other"] * 3
    left = spark.createDataFrame([(i, k) for i, k in enumerate(keys)], "id long, k string")
    right = spark.createDataFrame(
        [("hot", 5000, "H")] + [(f"k{i}", 1, f"v{i}") for i in range(0, 2000, 2)], "k string, w long, v string"
    )
    got = {r["id"]: r["v"] for r in lookup_join(left, right, "k", "w").collect()}
    want = {r["k"]: r["v"] for r in right.collect()}
    assert got == {i: want.get(k) for i, k in enumerate(keys)}
    assert math.isclose(statistics.mean(got), 3526)


def test_lookup_join_spreads_a_hot_key_that_has_no_value(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        left = spark.range(40_000, numPartitions=8).select(
            "id", F.when(F.col("id") % 10 > 0, "the").otherwise(F.concat(F.lit("k"), F.col("id"))).alias("k")
        )
        right = left.groupBy("k").agg(F.count("*").alias("w")).withColumn("v", F.when(F.col("k") != "the", F.col("k")))
        out = lookup_join(left, right, "k", "w").withColumn("task", F.spark_partition_id())
        sizes = [r["count"] for r in out.groupBy("task").count().collect()]
        assert sum(sizes) == 40_000 and max(sizes) <= 2 * sum(sizes) / len(sizes) + 4500
        assert max(sizes) <= 5000
        assert out.where("v IS NULL").count() == 36_000 and out.where("v = k").count() == 4000
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_previous_value_of_a_null_group(spark):
    rows = [(None, 1, 1), (None, 2, None), ("a", 1, None), ("a", 5, 7), (None, 9, 4)]
    df = spark.createDataFrame(rows, "g string, o long, v long")
    got = {(r["g"], r["o"]): r["p"] for r in previous_value(df, "o", F.col("v"), "p", ["g"], 3).collect()}
    assert got == {(None, 1): None, (None, 2): 1, ("a", 1): None, ("a", 5): None, (None, 9): 1}


def test_statistics_without_groups(spark):
    df = spark.createDataFrame([(1.0, 1), (2.0, 2), (9.0, 3)], "v double, run int")
    assert tuple(mean_and_median(df, "v", []).first()) == (4.0, 2.0)
    assert median_throughput(df, "v", "run", [], "run").first()["throughput"] == 1.0


def test_first_rows_of_a_struct_order(spark):
    df = spark.range(80_000).select(
        F.struct((F.col("id") % 7).cast("string").alias("file"), F.col("id").alias("block")).alias("line_no"), "id"
    )
    want = sorted((str(i % 7), i) for i in range(80_000))
    for k in (0, 10_001, 70_000, 90_000):
        got = sorted((r["line_no"]["file"], r["id"]) for r in first_rows(df, "line_no", k).collect())
        assert got == want[:k]
