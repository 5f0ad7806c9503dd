"""URL filter: rules for hosts and paths first, boosted trees on lexical features for the rest.

The addresses that rules judge are the labelled ones: their verdicts train the trees, which then
judge the addresses that no rule fits. Rules and trees are compiled to Column expressions.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textfix.llm.common import attach
from textfix.llm.trees import Boosted, boost
from textfix.session import materialize

# Labelled addresses that are fitted at most; beyond it those with the smallest hash.
FIT_ROWS = 20_000
# Rules of the registered query: (verdict, host, path).
RULES = [
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for NULL and for addresses without ``://``."""
    start = F.instr(url, "://")
    rest = F.when(start > 0, F.substring(url, start + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def matched_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """(rule, verdict) of the longest rule that fits, else NULL.

    A rule fits its host and all hosts below it if the path starts with the rule's path.
    """
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    # Shorter rules first, so that the longest is the outermost test.
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        below = (host == rule_host) | host.endswith("." + rule_host)
        rule = F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))
        found = F.when(below & path.startswith(rule_path), rule).otherwise(found)
    return found


def entropy(text: Column) -> Column:
    """Bits per character."""
    n = F.length(text)

    def bits(c: Column) -> Column:
        share = (n - F.length(F.replace(text, c, F.lit("")))) / n
        return -share * F.log2(share)

    letters = F.array_distinct(F.filter(F.split(text, ""), lambda c: c != ""))
    return F.aggregate(F.transform(letters, bits), F.lit(0.0), lambda a, b: a + b)


def lexical(url: Column, host: Column, path: Column) -> dict[str, Column]:
    url = F.coalesce(url, F.lit(""))
    n = F.length(url)

    def count(text: Column, pattern: str) -> Column:
        return F.regexp_count(text, F.lit(pattern)).cast("double")

    return {
        "length": n.cast("double"),
        "host_length": F.length(host).cast("double"),
        "labels": count(host, r"[^.]+"),
        "depth": count(path, r"[^/]+"),
        "digit_ratio": F.when(n > 0, count(url, "[0-9]") / n).otherwise(0.0),
        "entropy": entropy(url),
        "parameters": count(url, r"[?&][^=&#]+="),
        "hyphens": count(host, "-"),
        "marked": F.contains(url, F.lit("#")).cast("double"),
        "secure": F.startswith(url, F.lit("https")).cast("double"),
    }


def filter_urls(
    pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, id_col: str = "page_id",
    url: str = "url", limit: int = FIT_ROWS,
) -> DataFrame:
    """(id, host, path, rule, verdict, score) per row of ``pages``.

    ``rule`` is NULL where none fits; there the verdict is ``block`` from a score of 0.5. NULL and
    malformed addresses have an empty host and path, fit no rule and are scored like any other. A
    host's suffix is what follows its last dot. Without labelled rows the score is 0.5.
    """
    host, path = host_and_path(F.col(url))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url).alias("url"), host.alias("host"), path.alias("path"))
    rows = rows.withColumn("found", matched_rule(F.col("host"), F.col("path"), rules)).withColumn(
        "suffix", F.substring_index("host", ".", -1)
    )
    stats = lexical(F.col("url"), F.col("host"), F.col("path"))
    rows = rows.select(
        "id", "host", "path", "suffix", F.col("found.rule").alias("rule"),
        F.col("found.verdict").alias("verdict"), *[c.alias(f"f_{k}") for k, c in stats.items()],
    )
    rows = materialize(rows, "url-features")
    # Suffix statistics over all rows: how common it is, and what share of its rows has parameters.
    total = rows.count()
    suffixes = rows.groupBy("suffix").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg((F.col("f_parameters") > 0).cast("double")).alias("f_suffix_parameters"),
    )
    suffixes = suffixes.withColumn("f_suffix_share", F.col("n") / F.lit(max(total, 1)))
    rows = attach(rows, materialize(suffixes, "url-suffixes"), "suffix", "n")
    names = [f"f_{k}" for k in stats] + ["f_suffix_parameters", "f_suffix_share"]
    model = fit(rows, names, limit)
    score = 1 / (1 + F.exp(-model.column([F.col(n) for n in names])))
    rows = rows.withColumn("score", score)
    judged = F.when(F.col("score") >= 0.5, "block").otherwise("allow")
    return rows.select(
        F.col("id").alias(id_col), "host", "path", "rule",
        F.coalesce("verdict", judged).alias("verdict"), "score",
    )


def fit(rows: DataFrame, names: list[str], limit: int) -> Boosted:
    """Boosted trees on the rows with a rule's verdict."""
    known = rows.where(F.col("verdict").isNotNull()).select(
        *names, (F.col("verdict") == "block").cast("double").alias("y")
    )
    found = known.orderBy(F.xxhash64(*names), *names, "y").limit(limit).toArrow()
    x = np.column_stack([found.column(n).to_numpy().astype(float) for n in names])
    return boost(x, found.column("y").to_numpy().astype(float))
