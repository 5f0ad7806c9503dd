"""Scoring of corrected texts against gold: (id, input, gold, pred, ref, use_case)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textfix.functions.similarity import with_ratios
from textfix.functions.text import normalize
from textfix.session import computed_once

# The labels of each bucket, and the buckets in report order.
CORE_LABELS = [
    "basic-standard-lang", "Punctuation", "Unofficial Spellings & Non-Standard Form",
    "missing commas", "Incorrect word combinations", "superflous commas", "Apostrophe",
    "incorrect word order", "wrong use of tenses", "Casing Errors", "Basic Typos",
    "Basic Commas", "Agreement Errors", "Double Negation", "Word Confusion",
    "Inconsistent Spacing",
]
FORMATTING_LABELS = [
    "ISBN & IBAN Numbers", "Incorrect Currency Formats", "Inconsistent Use of Numbers & Letters",
    "Incorrect Time and Date Formats", "Different Measurement Units", "Incorrect Dates",
]
STYLE_LABELS = [
    "Misspelled Names & Acronyms", "Wrong Name in E-Mail", "Repetition",
    "Overused Words & Phrases", "Lack of Clarity", "Informal Style Detection", "Foreign Terms",
]
CORE = "CORE (in-scope)"
FORMATTING = "FORMATTING (out of scope)"
STYLE = "STYLE/NAMES (out of scope)"
UNCLASSIFIED = "UNCLASSIFIED"
OUT = "OUT (out of scope)"
BUCKETS = [CORE, FORMATTING, STYLE, UNCLASSIFIED]


def scope_of(use_case: Column) -> Column:
    """Bucket of a label; labels outside the taxonomy, and missing ones, are unclassified."""
    return (
        F.when(use_case.isin(CORE_LABELS), CORE)
        .when(use_case.isin(FORMATTING_LABELS), FORMATTING)
        .when(use_case.isin(STYLE_LABELS), STYLE)
        .otherwise(UNCLASSIFIED)
    )


def in_or_out(use_case: Column) -> Column:
    return F.when(use_case.isin(CORE_LABELS), CORE).otherwise(OUT)


def align(inputs: DataFrame, golds: DataFrame, preds: DataFrame, id_cols: list[str]) -> DataFrame:
    """Bring inputs, gold and predictions of the same key together."""
    return inputs.join(golds, id_cols).join(preds, id_cols)


def with_norms(df: DataFrame) -> DataFrame:
    names = {"input": "n_in", "gold": "n_gold", "pred": "n_out", "ref": "n_ref"}
    return df.withColumns({n: normalize(F.col(c)) for c, n in names.items() if c in df.columns})


def scored(df: DataFrame, autojunk: bool = True) -> DataFrame:
    """Add normal forms, their similarity to gold and the scope bucket, once for all reports."""
    normed = with_norms(df)
    sims = {"n_in": "sim_in", "n_out": "sim_out", "n_ref": "sim_ref"}
    gold = F.col("n_gold")
    wanted = {name: F.col(n) for n, name in sims.items() if n in normed.columns}
    full = with_ratios(normed, wanted, gold, autojunk)
    added = [c for c in full.columns if c not in df.columns]
    packed = computed_once(full, "_s", F.struct(*added))
    return packed.select(*df.columns, "_s.*").withColumn("bucket", scope_of(F.col("use_case")))


def _percent(flag: Column) -> Column:
    return F.avg(flag.cast("double")) * 100


def match_rate(normed: DataFrame) -> DataFrame:
    """Percent of exact and of normalised matches, for both systems."""
    text = {c: F.coalesce(F.col(c), F.lit("")) for c in ("pred", "ref", "gold")}
    return normed.agg(
        _percent(text["pred"] == text["gold"]).alias("our_exact"),
        _percent(F.col("n_out") == F.col("n_gold")).alias("our_norm"),
        _percent(text["ref"] == text["gold"]).alias("ref_exact"),
        _percent(F.col("n_ref") == F.col("n_gold")).alias("ref_norm"),
    )


def mean_similarity(df: DataFrame) -> DataFrame:
    return df.agg(*[F.avg(c).alias(c) for c in ("sim_in", "sim_out", "sim_ref")])


def direction(df: DataFrame, eps: float = 1e-9) -> DataFrame:
    """How many predictions moved towards gold, stayed, or moved away."""
    before, after = F.col("sim_in"), F.col("sim_out")
    return df.agg(
        F.count_if(after > before + eps).alias("better"),
        F.count_if(F.abs(after - before) <= eps).alias("same"),
        F.count_if(after < before - eps).alias("worse"),
    )


def by_use_case(normed: DataFrame) -> DataFrame:
    """Matches per label, most frequent label first."""
    return (
        normed.groupBy("use_case")
        .agg(
            F.count(F.lit(1)).alias("n"),
            _percent(F.col("n_out") == F.col("n_gold")).alias("ours"),
            _percent(F.col("n_ref") == F.col("n_gold")).alias("ref"),
        )
        .orderBy(F.desc("n"), "use_case")
    )


def by_scope(df: DataFrame) -> DataFrame:
    """Matches and mean similarity per bucket in report order; empty buckets are absent."""
    order = F.array_position(F.array(*[F.lit(b) for b in BUCKETS]), F.col("bucket"))
    return (
        df.groupBy("bucket")
        .agg(
            F.count(F.lit(1)).alias("n"),
            _percent(F.col("n_out") == F.col("n_gold")).alias("ours"),
            _percent(F.col("n_ref") == F.col("n_gold")).alias("ref"),
            F.avg("sim_out").alias("our_sim"),
            F.avg("sim_in").alias("in_sim"),
        )
        .withColumn("net", F.when(F.col("our_sim") >= F.col("in_sim"), "net+").otherwise("net-"))
        .orderBy(order)
    )


def scope_counts(df: DataFrame) -> DataFrame:
    return df.groupBy(scope_of(F.col("use_case")).alias("bucket")).agg(
        F.count(F.lit(1)).alias("n")
    )


def in_scope(df: DataFrame) -> DataFrame:
    return df.where(scope_of(F.col("use_case")) == CORE)


def with_verdict(df: DataFrame, eps: float = 0.01) -> DataFrame:
    """Add ``verdict``: unchanged, improved, regressed or lateral."""
    verdict = (
        F.when(F.col("n_out") == F.col("n_in"), "unchanged")
        .when(F.col("sim_out") > F.col("sim_in") + eps, "improved")
        .when(F.col("sim_out") < F.col("sim_in") - eps, "regressed")
        .otherwise("lateral")
    )
    return df.withColumn("verdict", verdict)


def error_profile(df: DataFrame, eps: float = 0.01) -> DataFrame:
    """Of the in-scope rows: how many were edited, and how many edits helped or hurt.

    Shares of an empty set are NULL; shares among edits divide by one if there are none.
    """
    verdict = F.col("verdict")
    counts = with_verdict(in_scope(df), eps).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(verdict == "unchanged").alias("unchanged"),
        F.count_if(verdict != "unchanged").alias("edited"),
        F.count_if(verdict == "improved").alias("improved"),
        F.count_if(verdict == "regressed").alias("regressed"),
        F.count_if(verdict == "lateral").alias("lateral"),
        F.count_if((verdict != "unchanged") & (F.col("n_out") == F.col("n_gold"))).alias(
            "exact_edits"
        ),
        _percent(F.col("n_out") == F.col("n_gold")).alias("match_pct"),
    )
    edits = F.greatest(F.col("edited"), F.lit(1))
    shares = {
        "unchanged_pct": F.try_divide(100 * F.col("unchanged"), F.col("n")),
        "edited_pct": F.try_divide(100 * F.col("edited"), F.col("n")),
    }
    for name in ("improved", "regressed", "lateral", "exact_edits"):
        shares[f"{name}_pct"] = 100 * F.col(name) / edits
    return counts.withColumns(shares).withColumn("edit_precision", F.col("improved_pct"))


def evaluate_report(df: DataFrame, eps: float = 1e-9, edit_eps: float = 0.01) -> DataFrame:
    """Every measure of a scored table at three levels, from one scan: (level, label, ...).

    ``level`` is ``all``, ``bucket`` or ``use_case``. Rows of both scopes count in the verdicts, so the
    in-scope profile is the row of that bucket. A missing label has a row of its own.
    """
    text = {c: F.coalesce(F.col(c), F.lit("")) for c in ("pred", "ref", "gold")}
    before, after, verdict = F.col("sim_in"), F.col("sim_out"), F.col("verdict")
    level = F.grouping_id()
    counted = with_verdict(df, edit_eps).groupingSets([["use_case"], ["bucket"], []], "use_case", "bucket").agg(
        F.when(level == 3, "all").when(level == 2, "bucket").otherwise("use_case").alias("level"),
        F.count(F.lit(1)).alias("n"),
        _percent(text["pred"] == text["gold"]).alias("our_exact"),
        _percent(F.col("n_out") == F.col("n_gold")).alias("our_norm"),
        _percent(text["ref"] == text["gold"]).alias("ref_exact"),
        _percent(F.col("n_ref") == F.col("n_gold")).alias("ref_norm"),
        *[F.avg(c).alias(c) for c in ("sim_in", "sim_out", "sim_ref")],
        F.count_if(after > before + eps).alias("better"),
        F.count_if(F.abs(after - before) <= eps).alias("same"),
        F.count_if(after < before - eps).alias("worse"),
        *[F.count_if(verdict == v).alias(v) for v in ("unchanged", "improved", "regressed", "lateral")],
        F.count_if((verdict != "unchanged") & (F.col("n_out") == F.col("n_gold"))).alias("exact_edits"),
    )
    # An empty table has its row for the whole, as every aggregate without groups.
    return counted.where((F.col("level") == "all") | (F.col("n") > 0)).withColumn(
        "label", F.when(F.col("level") == "bucket", F.col("bucket")).when(F.col("level") == "use_case", F.col("use_case"))
    ).drop("use_case", "bucket")


def model_profile(df: DataFrame, eps: float = 0.01) -> DataFrame:
    """Error profile with a flag for a broken run: no match, all changed, none improved."""
    broken = (
        (F.col("match_pct") == 0) & (F.col("edited") == F.col("n")) & (F.col("improved") == 0)
    )
    return error_profile(df, eps).withColumn("suspect_run", broken)


def regressions(df: DataFrame, eps: float = 0.01, digits: int | None = 3) -> DataFrame:
    """In-scope rows that moved away from gold, with both similarities, rounded half to even."""
    moved = with_verdict(in_scope(df), eps).where(F.col("verdict") == "regressed")

    def shown(c: Column) -> Column:
        return c if digits is None else F.bround(c, digits)

    keys = [c for c in ("id", "sid") if c in df.columns]
    return moved.select(
        *keys, "input", F.col("pred").alias("model_output"), "gold",
        shown(F.col("sim_in")).alias("sim_in"), shown(F.col("sim_out")).alias("sim_out"),
    )
