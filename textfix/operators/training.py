"""Making and judging training sets of sentence pairs."""

from __future__ import annotations

import sys
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textfix.functions.text import normalize, plain_cores, words
from textfix.operators.lookup import lookup_join
from textfix.operators.ordering import first_rows
from textfix.session import computed_once, materialize

# Executors get the functions below inside the plan and need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Fixed value: the longest n-gram of GLEU.
GLEU_ORDER = 4
GLEU_COUNTS = ["c", "r", *[f"_{name}{n}" for n in range(1, GLEU_ORDER + 1) for name in ("hit", "all")]]


def decontaminate(
    train: DataFrame, held_out: DataFrame, text: str = "src", held_text: str = "src"
) -> DataFrame:
    """Drop training rows whose normal form occurs in a held-out table; NULL counts as empty.

    Each distinct form is judged once, and its verdict is brought back by weight, so a form that
    many rows share does not gather.
    """
    keyed = train.withColumn("_form", normalize(F.col(text)))
    held = held_out.select(normalize(F.col(held_text)).alias("_form"), F.lit(True).alias("_held"))
    counts = keyed.groupBy("_form").agg(F.count(F.lit(1)).alias("_n"))
    verdicts = materialize(counts.join(held.distinct(), "_form", "left"), "held-forms")
    judged = lookup_join(keyed, verdicts, "_form", "_n")
    return judged.where(F.col("_held").isNull()).select(*train.columns)


def length_cap(pairs: DataFrame, max_tokens: int = 128) -> DataFrame:
    """Pairs of at most ``max_tokens`` words on either side, white space as single blanks."""
    split = computed_once(pairs, "_w", F.struct(words(F.col("src")).alias("src"), words(F.col("tgt")).alias("tgt")))
    short = (F.size("_w.src") <= max_tokens) & (F.size("_w.tgt") <= max_tokens)
    return split.where(short).withColumns(
        {side: F.array_join(f"_w.{side}", " ") for side in ("src", "tgt")}
    ).drop("_w")


def identity_mix(pairs: DataFrame, clean: DataFrame, share: float, text: str = "src") -> DataFrame:
    """Add unchanged pairs (x, x) from distinct clean texts until they are ``share`` of the result.

    All pairs stay. The texts taken are those with the smallest MD5, so reruns agree and a larger
    share holds a smaller one; too few texts give a smaller share.
    """
    if not 0 <= share < 1:
        raise ValueError(f"share must lie in [0, 1), not {share}")
    # Counted first and taken afterwards.
    pairs = materialize(pairs.select("src", "tgt"), "pairs")
    texts = clean.select(F.col(text).alias("src")).where(F.col("src").isNotNull()).distinct()
    wanted = round(pairs.count() * share / (1 - share))
    ordered = texts.withColumn("_order", F.struct(F.md5(F.encode("src", "utf-8")), "src"))
    taken = first_rows(ordered, "_order", wanted)
    return pairs.unionByName(taken.select("src", F.col("src").alias("tgt")))


def confidence_gate(edits: DataFrame, threshold: float, score: str = "score") -> DataFrame:
    """Edits whose score reaches the threshold; NULL and NaN scores never do."""
    return edits.where((F.col(score) >= threshold) & ~F.isnan(score))


def confidence_curve(
    edits: DataFrame, thresholds: list[float], score: str = "score", correct: str = "correct"
) -> DataFrame:
    """Kept edits, right ones, precision and coverage if only scores from each threshold on stay.

    One pass counts the edits between neighbouring thresholds; the sums over the few counts follow.
    Precision is NULL where nothing is kept, coverage where there are no edits.
    """
    usable = F.col(score).isNotNull() & ~F.isnan(score)
    right = F.coalesce(F.col(correct), F.lit(False))
    levels = sorted(set(thresholds))
    step = reduce(lambda a, b: a + b, [(F.col(score) >= t).cast("int") for t in levels])
    counts = edits.groupBy(F.when(usable, step).otherwise(0).alias("_step")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(right).alias("right")
    )

    def at_least(i: int, name: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("_step") > i, F.col(name))), F.lit(0))

    rows = [
        F.struct(F.lit(float(t)).alias("threshold"), at_least(i, "n").alias("kept"),
                 at_least(i, "right").alias("right"))
        for i, t in enumerate(levels)
    ]
    summed = counts.agg(F.array(*rows).alias("rows"), F.sum("n").alias("total"))
    return summed.select("total", F.explode("rows").alias("r")).select(
        "r.threshold", "r.kept", "r.right",
        F.try_divide(F.col("r.right"), F.col("r.kept")).alias("precision"),
        F.try_divide(F.col("r.kept"), F.col("total")).alias("coverage"),
    )


def f_score(
    predicted: DataFrame, gold: DataFrame, id_cols: list[str], beta: float = 0.5
) -> DataFrame:
    """Precision, recall and F of two edit tables (ids, start, end, repl) by exact matches.

    Repeated edits of a text count once. A side without edits has a precision or recall of one.
    """
    key = [*id_cols, "start", "end", "repl"]
    sides = predicted.select(*key, F.lit(1).alias("_side")).unionByName(
        gold.select(*key, F.lit(2).alias("_side"))
    )
    found = sides.groupBy(*key).agg(F.bit_or("_side").alias("_in"))
    counts = found.agg(
        F.count_if(F.col("_in") == 3).alias("tp"), F.count_if(F.col("_in") == 1).alias("fp"),
        F.count_if(F.col("_in") == 2).alias("fn"),
    )

    def part(other: str) -> Column:
        return F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col(other)), F.lit(1.0))

    p, r, b = F.col("precision"), F.col("recall"), beta * beta
    return counts.withColumns({"precision": part("fp"), "recall": part("fn")}).withColumn(
        "f", F.coalesce(F.try_divide((1 + b) * p * r, b * p + r), F.lit(0.0))
    )


def _gram_counts(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
    """Per text the words of answer and reference, and per length the n-grams that count and all of them."""

    def grams(tokens: list[str], n: int) -> Counter:
        return Counter(zip(*[tokens[k:] for k in range(n)]))

    for answers, references, sources in batches:
        rows = []
        for c, r, s in zip(answers, references, sources):
            c, r, s, row = list(c), list(r), list(s), [len(c), len(r)]
            for n in range(1, GLEU_ORDER + 1):
                in_c, in_r, in_s = grams(c, n), grams(r, n), grams(s, n)
                shared = {g: min(k, in_r[g]) for g, k in in_c.items()}
                row.append(sum(shared[g] - max(min(k, in_s[g]) - shared[g], 0) for g, k in in_c.items()))
                row.append(max(len(c) - n + 1, 0))
            rows.append(row)
        yield pd.DataFrame(rows, columns=GLEU_COUNTS, dtype="int64")


def gleu(df: DataFrame, id_cols: list[str], source: str, reference: str, answer: str) -> DataFrame:
    """Corpus GLEU of corrected texts with one reference: c, r, p1..p4 and gleu.

    An n-gram shared with the reference counts for the answer; one that the answer shares with the
    source more often than with the reference counts against it by the excess. The score is the
    geometric mean of the four precisions, cut at zero, times the brevity penalty. ``id_cols`` are a
    key of ``df``: a row is a whole text, its n-grams are counted where it lies, and only sums are shuffled.
    """
    count = F.pandas_udf(_gram_counts, ", ".join(f"{c} long" for c in GLEU_COUNTS))
    sides = [words(F.coalesce(F.col(c), F.lit(""))) for c in (answer, reference, source)]
    counted = df.select(count(*sides).alias("g"))
    sums = counted.agg(
        *[F.coalesce(F.sum(f"g.{c}"), F.lit(0)).alias(c) for c in GLEU_COUNTS[:2]],
        *[F.sum(f"g.{c}").alias(c) for c in GLEU_COUNTS[2:]],
    )
    names = [f"p{n}" for n in range(1, GLEU_ORDER + 1)]
    found = {
        p: F.coalesce(F.try_divide(F.greatest(F.col(f"_hit{n}"), F.lit(0)), F.col(f"_all{n}")), F.lit(0.0))
        for n, p in enumerate(names, 1)
    }
    logs = reduce(lambda a, b: a + b, [F.ln(p) for p in names])
    brevity = F.when(F.col("c") >= F.col("r"), 1.0).otherwise(F.exp(1 - F.col("r") / F.col("c")))
    score = F.when(F.least(*names) > 0, brevity * F.exp(logs / GLEU_ORDER)).otherwise(0.0)
    return sums.withColumns(found).select("c", "r", *names, score.alias("gleu"))


def name_policy(uses: DataFrame, names: DataFrame) -> DataFrame:
    """Add ``policy`` to words as typed (core, n): ``keep`` for capitalised words that ``names``
    (name) knows in any case, ``eligible`` for other capitalised words, ``plain`` for the rest."""
    known = names.select(F.lower("name").alias("_word")).distinct().withColumn("_name", F.lit(True))
    joined = uses.withColumn("_word", F.lower("core")).join(known, "_word", "left")
    policy = (
        F.when(~F.col("core").rlike(r"^\p{Lu}"), "plain")
        .when(F.col("_name"), "keep")
        .otherwise("eligible")
    )
    return joined.withColumn("policy", policy).drop("_word", "_name")


def bigram_counts(texts: DataFrame, text: str = "text") -> DataFrame:
    """Neighbouring plain words of a text, lower-cased: (prev, word, n)."""
    cores = F.col("_cores")
    follows = F.slice(cores, 2, F.greatest(F.size(cores) - 1, F.lit(0)))
    listed = computed_once(texts.select(F.col(text).alias("_text")), "_cores", plain_cores(F.col("_text")))
    both = listed.select(F.explode(F.arrays_zip(cores.alias("prev"), follows.alias("word"))).alias("b"))
    # The last word has none after it.
    pairs = both.where(F.col("b.word").isNotNull())
    return pairs.groupBy(F.lower("b.prev").alias("prev"), F.lower("b.word").alias("word")).agg(
        F.count(F.lit(1)).alias("n")
    )


def bigram_rerank(contexts: DataFrame, candidates: DataFrame, bigrams: DataFrame) -> DataFrame:
    """Best candidate of a word after each word it follows: (prev, word, term, seen).

    ``contexts`` (prev, word) are distinct; ``candidates`` are (word, term, count, distance). Nearer
    terms come first, then terms seen more often after ``prev`` (``seen``), then frequent ones, then
    by name. A word meets its candidates once per word before it, not once per use.
    """
    choices = contexts.select("prev", "word").join(candidates, "word")
    seen = bigrams.select("prev", F.col("word").alias("term"), F.col("n").alias("seen"))
    joined = choices.join(seen, ["prev", "term"], "left")
    rank = F.struct(
        "distance", (-F.coalesce("seen", F.lit(0))).alias("_less"), (-F.col("count")).alias("_rare"), "term"
    )
    best = joined.groupBy("prev", "word").agg(F.min(rank).alias("b"))
    return best.select("prev", "word", "b.term", (-F.col("b._less")).alias("seen"))
