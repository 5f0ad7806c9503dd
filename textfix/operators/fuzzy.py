"""Dictionary terms near a word, ranked, and the gate for applying the best one unasked."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textfix.config import SpellConfig
from textfix.functions.distance import may_be_within, near_distance, plain_edits
from textfix.operators.index import HALF, TWICE, WHOLE, DictionaryIndex, sizes, term_keys, word_keys
from textfix.session import computed_once, materialize


def fuzzy_candidates(
    vocabulary: DataFrame, dictionary: DataFrame | DictionaryIndex, k: int, word: str = "word"
) -> DataFrame:
    """All (word, term, count, distance) with at most ``k`` edits between word and term.

    Words within ``k`` edits share a key, so an equi-join on hashed keys finds every pair and the
    distance test removes the rest: strings left after ``k`` deletions, and halves with one deletion
    for the longest terms at two edits. Pairs whose letters differ too much are dropped before they are
    compared. Words too long for any term are dropped first; they have no candidate. An index of the
    dictionary is only read; without one the keys of the terms are made in the plan.
    """
    if isinstance(dictionary, DictionaryIndex):
        if k > dictionary.k:
            raise ValueError(f"the index serves {dictionary.k} edits, not {k}")
        longest, halves_from, keys = dictionary.longest, dictionary.halves_from, dictionary.keys
    else:
        longest, halves_from = sizes(dictionary)
        keys = term_keys(dictionary, k, halves_from)
    # Words are few bytes but much work: one task per shuffle partition, whatever their size.
    tasks = int(vocabulary.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    words = (
        vocabulary.select(F.col(word).alias("word"))
        .where((F.length("word") > 0) & (F.length("word") <= longest + k))
        .repartition(tasks, "word")
    )
    if k > 1:  # read for keys of whole words and of halves
        words = materialize(words, "unknown")
    kinds = [WHOLE] if k < 2 else [TWICE, HALF]
    left = word_keys(words, k, longest, halves_from=halves_from).withColumnRenamed("letters", "_letters")
    right = keys.where(F.col("kind").isin(kinds))
    word_col, term = F.col("word"), F.col("term")
    both = F.col("letters").bitwiseAND(F.col("_letters"))
    differ = F.greatest(*(F.bit_count(F.col(c).bitwiseXOR(both)) for c in ("letters", "_letters")))
    # Both sides grow by exploding far beyond the size Spark reads off their files, so neither may be
    # taken for small and sent whole to the driver.
    pairs = (
        left.drop("kind").join(right.drop("kind").hint("shuffle_hash"), "key")
        .where((F.abs(F.length(word_col) - F.length(term)) <= k) & (differ <= k))
        .select("word", "term", "count", differ.alias("_differ"))
    )
    # Most pairs that share a key are too far apart, and few need more than their plain edits, which are
    # counted once. Only the near ones are shuffled to drop repeats.
    pairs = computed_once(pairs, "_plain", plain_edits(word_col, term, k))
    known = F.col("_plain"), F.col("_differ")
    near = pairs.where(may_be_within(word_col, term, k, *known))
    scored = computed_once(near, "distance", near_distance(word_col, term, *known, k))
    return scored.where(F.col("distance") <= k).select("word", "term", "count", "distance").distinct()


def rank_candidates(candidates: DataFrame, top: int | None = None) -> DataFrame:
    """Number the candidates of a word: closest first, then most frequent, then by term.

    All are kept, or the first ``top``.

    Adds ``rank``, and ``closest`` for those at the smallest distance of the word.
    """
    best = Window.partitionBy("word").orderBy("distance", F.desc("count"), "term")
    ranked = candidates.withColumn("rank", F.row_number().over(best))
    ranked = ranked if top is None else ranked.where(F.col("rank") <= top)
    return ranked.withColumn("closest", F.col("distance") == F.first("distance").over(best))


def gate(ranked: DataFrame, cfg: SpellConfig) -> DataFrame:
    """One row per word: best term, its distance and count, runner-up count, ``autofix`` flag, and
    ``terms``, the ranked terms in order.

    The runner-up is the next term at the same distance. The best term is safe when it is near,
    common, and far more common than the runner-up.
    """
    listed = F.array_sort(F.collect_list(F.struct("rank", "term", "distance", "count", "closest")))
    per_word = ranked.groupBy("word").agg(listed.alias("_l"))
    best, second = F.get("_l", F.lit(0)), F.get("_l", F.lit(1))
    flat = per_word.select(
        "word",
        best["term"].alias("term"),
        best["distance"].alias("distance"),
        best["count"].alias("count"),
        F.when(second["closest"], second["count"]).alias("runner_up"),
        F.transform("_l", lambda c: c["term"]).alias("terms"),
    )
    safe = (
        (F.col("distance") <= cfg.autocorrect_max_distance)
        & (F.col("count") >= cfg.min_suggestion_count)
        & F.coalesce(F.col("count") >= cfg.dominance_ratio * F.col("runner_up"), F.lit(True))
    )
    return flat.withColumn("autofix", safe)
