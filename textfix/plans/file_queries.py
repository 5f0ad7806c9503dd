"""Queries that write tables as files in the shared folder and read them with the file sources."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from textfix.operators import dictionary as dic
from textfix.operators import pairs, scoring
from textfix.plans import fixtures as fx
from textfix.plans.registry import _scored, query
from textfix.session import shared_dir
from textfix.sources import readers, writers


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/textfix/{name}-{uuid.uuid4().hex}"


@query
def pair_files(spark, sf):
    path = _folder(spark, "pairs")
    writers.write_pairs(fx.word_pairs(spark, sf), path)
    return readers.read_pairs(spark, path)


@query
def dictionary_files(spark, sf):
    """The documents' dictionary and one of the conversations, read as main and extra file."""
    own = dic.word_frequencies(fx.documents(spark, sf), "text", fx.MIN_COUNT)
    extra = dic.word_frequencies(fx.load(spark, sf, "conversations"), "text", 5)
    paths = [_folder(spark, name) for name in ("terms", "extra-terms")]
    for terms, path in zip((own, extra), paths):
        terms.select(F.concat_ws(" ", "term", F.col("count").cast("string"))).write.text(path)
    return readers.read_dictionary(spark, paths[0], paths[1:])


@query
def metric_files(spark, sf):
    path = _folder(spark, "metrics")
    writers.write_metrics(fx.metric_rows(spark, sf), path)
    return readers.read_metrics(spark, path).drop("seq")


@query
def regression_files(spark, sf):
    path = _folder(spark, "regressions")
    writers.write_regressions(scoring.regressions(_scored(spark, sf), digits=None), path)
    schema = "input string, model_output string, gold string, sim_in double, sim_out double"
    return (
        spark.read.schema(schema).option("header", True).option("multiLine", True)
        .option("escape", '"').csv(path)
    )


@query
def eval_files(spark, sf):
    path = _folder(spark, "eval")
    rows = fx.eval_rows(spark, sf).select(
        "input", F.col("gold").alias("Correct Sentence"), F.col("use_case").alias("Use Case"),
        F.col("ref").alias("actual_output"),
    )
    rows.write.option("header", True).option("escape", '"').csv(path)
    return readers.read_eval_csv(spark, path)


@query
def m2_files(spark, sf):
    """Annotated blocks written to one folder for each corpus part, read from two paths."""
    whole = fx.m2_lines(spark, sf).withColumn("at", F.floor(F.col("line_no") / fx.LINES))
    block = F.array_sort(F.collect_list(F.struct("line_no", "line")))
    text = F.array_join(F.transform(F.filter(block, lambda x: x["line"] != ""), lambda x: x["line"]), "\n")
    blocks = whole.groupBy("file", "at").agg(text.alias("value"))
    base = _folder(spark, "m2")
    blocks.select("file", "value").write.partitionBy("file").option("lineSep", "\n\n").text(base)
    read = readers.read_m2_blocks(spark, [f"{base}/file=part-0", f"{base}/file=part-[1-3]"])
    return pairs.prepare_m2(read).select("src", "tgt")


@query
def lang8_files(spark, sf):
    path = _folder(spark, "lang8")
    fx.lang8_lines(spark, sf).select("line").write.text(path)
    return pairs.prepare_lang8(readers.read_lines(spark, f"{path}/part-*")).select("src", "tgt")
