"""File sinks. Each writes a directory of part files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_pairs(pairs: DataFrame, path: str, mode: str = "error") -> None:
    """``src<TAB>tgt`` lines without quoting."""
    pairs.select(F.concat("src", F.lit("\t"), "tgt")).write.mode(mode).text(path)


def write_regressions(rows: DataFrame, path: str, mode: str = "error") -> None:
    names = ["input", "model_output", "gold", "sim_in", "sim_out"]
    rows.select(*names).write.mode(mode).option("header", True).option("escape", '"').csv(path)


def write_metrics(rows: DataFrame, path: str, mode: str = "error") -> None:
    names = ["metric", "model", "beam", "batch", "value"]
    rows.select(*names).write.mode(mode).option("header", True).option("nullValue", "-").csv(path)
