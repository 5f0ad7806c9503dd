"""File sources. A pattern that matches nothing raises when the table is built."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textfix.functions.text import strip
from textfix.operators.dictionary import merge_dictionaries
from textfix.operators.pairs import blocks_from_text


def read_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Text files as (file, line_no, line).

    ``line_no`` grows in file order inside each file: it is the position of the row in the scan, so
    it holds only for this one read.
    """
    raw = spark.read.text(paths)
    return raw.select(
        F.col("_metadata.file_path").alias("file"),
        F.monotonically_increasing_id().alias("line_no"),
        F.col("value").alias("line"),
    )


def matched_files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Names of all files that match, empty ones included: (file).

    A scan leaves empty files out, so the names come from the listing that Spark holds of its input.
    """
    names = spark.read.text(paths).inputFiles()
    return spark.createDataFrame([(name,) for name in names], "file string")


def read_eval_csv(spark: SparkSession, path: str) -> DataFrame:
    """Labelled evaluation rows: input, gold, use_case, ref."""
    raw = (
        spark.read.option("header", True).option("multiLine", True)
        .option("quote", '"').option("escape", '"').csv(path)
    )

    def column(name: str, default: str):
        col = F.col(f"`{name}`") if name in raw.columns else F.lit(None).cast("string")
        return F.coalesce(col, F.lit(default if name not in raw.columns else ""))

    return raw.select(
        column("input", "").alias("input"),
        column("Correct Sentence", "").alias("gold"),
        column("Use Case", "?").alias("use_case"),
        column("actual_output", "").alias("ref"),
    )


def read_pairs(spark: SparkSession, paths: str | list[str], quoted: bool = False) -> DataFrame:
    """Sentence pairs, one ``src<TAB>tgt`` per line, both not blank and kept as they are.

    ``quoted=True`` reads fields as quoted CSV does, where a leading quote may span lines.
    """
    if quoted:
        raw = (
            spark.read.schema("src string, tgt string").option("sep", "\t")
            .option("quote", '"').option("escape", '"').option("multiLine", True).csv(paths)
        )
    else:
        cols = F.split("value", "\t", -1)
        raw = spark.read.text(paths).select(
            F.get(cols, F.lit(0)).alias("src"), F.get(cols, F.lit(1)).alias("tgt")
        )
    return raw.where((strip(F.col("src")) != "") & (strip(F.col("tgt")) != ""))


def read_m2_blocks(spark: SparkSession, paths: str | list[str], annotator: int = 0) -> DataFrame:
    """Annotated blocks of well-formed files: blank line between blocks, one sentence each.

    For other files use :func:`read_lines` with ``m2_blocks``.
    """
    raw = spark.read.option("lineSep", "\n\n").text(paths)
    return blocks_from_text(
        raw.select(
            F.col("_metadata.file_path").alias("file"),
            F.monotonically_increasing_id().alias("block"),
            "value",
        ),
        annotator,
    )


def read_dictionary(spark: SparkSession, path: str, extra: list[str] | None = None) -> DataFrame:
    """Frequency dictionary of ``term count`` lines, merged with any extra ones."""

    def one(p: str) -> DataFrame:
        cols = F.split(strip(F.col("value")), " ")
        table = spark.read.text(p).select(
            F.get(cols, F.lit(0)).alias("term"),
            F.get(cols, F.lit(1)).try_cast("long").alias("count"),
        )
        return table.where((F.col("term") != "") & F.col("count").isNotNull())

    main = one(path)
    if main.isEmpty():
        raise FileNotFoundError(f"no dictionary entries in {path}")
    return merge_dictionaries(main, *[one(p) for p in extra or []])


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """Metric rows: seq, metric, model, beam, batch, value; ``-`` means not applicable."""
    schema = "metric string, model string, beam string, batch string, value double"
    raw = spark.read.schema(schema).option("header", True).option("nullValue", "-").csv(path)
    return raw.select(
        F.monotonically_increasing_id().alias("seq"), "metric", "model",
        F.col("beam").try_cast("int").alias("beam"),
        F.col("batch").try_cast("int").alias("batch"), "value",
    )
