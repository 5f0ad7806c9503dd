"""Frequency dictionaries: tables of (term, count)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textfix.functions.text import plain_cores


def vocabulary(words: DataFrame, core: str) -> DataFrame:
    """Distinct lower-cased words of a column with the number of uses: (word, n)."""
    return words.groupBy(F.lower(core).alias("word")).agg(F.count(F.lit(1)).alias("n"))


def word_frequencies(texts: DataFrame, text: str = "text", min_count: int = 1) -> DataFrame:
    """Count the plain words of a corpus and keep those seen at least ``min_count`` times."""
    words = texts.select(F.explode(plain_cores(F.col(text))).alias("core"))
    counts = vocabulary(words, "core").where(F.col("n") >= min_count)
    return counts.select(F.col("word").alias("term"), F.col("n").alias("count"))


def merge_dictionaries(*dictionaries: DataFrame) -> DataFrame:
    """Union of dictionaries; the counts of a repeated term add up."""
    rows = [d.select("term", F.col("count").cast("long").alias("count")) for d in dictionaries]
    merged = reduce(DataFrame.unionByName, rows)
    return merged.groupBy("term").agg(F.sum("count").alias("count"))


def unknown_words(vocabulary: DataFrame, dictionary: DataFrame, word: str = "word") -> DataFrame:
    """Rows whose word the dictionary does not hold."""
    known = dictionary.select(F.col("term").alias(word))
    return vocabulary.join(known, word, "left_anti")
