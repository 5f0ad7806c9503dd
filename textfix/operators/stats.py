"""Report statistics: exact percentiles, medians, throughput and metric pivots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textfix.operators.ordering import values_at_ranks


def nearest_rank_percentiles(
    df: DataFrame, value: str, group: list[str], percents: tuple[float, ...] = (50, 75, 90, 95, 99)
) -> DataFrame:
    """Rows (group, p, value); the rank ``p/100 * (n-1)`` is rounded half to even and clamped."""
    last = F.col("n") - 1
    ranks = {
        str(p): F.greatest(F.least(F.rint(F.lit(p / 100) * last), last), F.lit(0))
        for p in percents
    }
    found = values_at_ranks(df, value, ranks, [p / 100 for p in percents], group)
    return found.select(*group, F.col("label").cast("double").alias("p"), "value")


def mean_and_median(df: DataFrame, value: str, group: list[str]) -> DataFrame:
    """Mean, and the median that averages the middle two of an even number."""
    last = F.col("n") - 1
    middle = values_at_ranks(
        df, value, {"low": F.floor(last / 2), "high": F.ceil(last / 2)}, [0.5], group
    )
    # A struct of the group as key: it is there without groups too, and NULL groups equal themselves.
    key = F.struct(F.lit(0).alias("_0"), *group).alias("_g")
    medians = middle.groupBy(key).agg(F.avg("value").alias("median"))
    means = df.groupBy(key).agg(F.avg(value).alias("mean"))
    found = means.join(medians, "_g")
    return found.select(*[F.col("_g")[g].alias(g) for g in group], "mean", "median")


def median_throughput(
    df: DataFrame, items: str, seconds: str, config: list[str], run: str
) -> DataFrame:
    """Items per second of each run, then the median over the runs of a configuration."""
    rates = df.groupBy(*config, run).agg((F.sum(items) / F.sum(seconds)).alias("rate"))
    return mean_and_median(rates, "rate", config).select(*config, F.col("median").alias("throughput"))


def metric_pivot(
    metrics: DataFrame,
    metric: str = "throughput",
    rows: str = "batch",
    columns: str = "model",
    seq: str = "seq",
    names: list | None = None,
) -> DataFrame:
    """One row per ``rows`` value, one column per ``columns`` value; the last entry (``seq``) wins."""
    last = F.max_by("value", seq)
    picked = metrics.where(F.col("metric") == metric)
    cells = picked.groupBy(rows, columns).agg(last.alias("value"))
    return cells.groupBy(rows).pivot(columns, names).agg(F.first("value"))


def metric_series(
    metrics: DataFrame, metric: str = "beam_throughput", key: str = "beam", seq: str = "seq"
) -> DataFrame:
    """One value per key of a single metric; the last entry wins."""
    picked = metrics.where(F.col("metric") == metric)
    return picked.groupBy(key).agg(F.max_by("value", seq).alias("value"))
