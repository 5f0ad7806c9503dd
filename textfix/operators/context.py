"""Spelling decided per use where a word has several near terms: the word before it tells which."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textfix.config import SpellConfig
from textfix.functions.text import case_allows, let
from textfix.operators.dictionary import unknown_words
from textfix.operators.fuzzy import fuzzy_candidates, gate, rank_candidates
from textfix.operators.index import DictionaryIndex, terms_of
from textfix.operators.lookup import lookup_join
from textfix.operators.spelling import piece_cores, repair, speller_vocabulary, values_of_text
from textfix.session import computed_once, materialize


def use_verdicts(words: DataFrame, dictionary: DataFrame | DictionaryIndex, cfg: SpellConfig) -> DataFrame:
    """(word, n, fix, terms) per vocabulary word: a safe fix, or else the terms among which each use
    chooses.

    These are the terms at the smallest distance of the word that are common enough, if that distance
    may be corrected unasked and the gate refuses the best one. Words without either have two NULLs.
    """
    k = min(cfg.max_edit_distance, cfg.autocorrect_max_distance)
    unknown = unknown_words(words.select("word"), terms_of(dictionary))
    ranked = rank_candidates(materialize(fuzzy_candidates(unknown, dictionary, k), "candidates"))
    safe = gate(ranked, cfg).where("autofix").select("word", F.col("term").alias("fix"))
    common = F.col("closest") & (F.col("count") >= cfg.min_suggestion_count)
    terms = ranked.where(common).groupBy("word").agg(
        F.collect_list(F.struct("term", "count")).alias("_terms")
    )
    return words.join(safe, "word", "left").join(terms, "word", "left").select(
        "word", "n", "fix", F.when(F.col("fix").isNull(), F.col("_terms")).alias("terms")
    )


def context_fixes(
    contexts: DataFrame, terms: DataFrame, bigrams: DataFrame, cfg: SpellConfig
) -> DataFrame:
    """(prev, word, n, fix) for every row of ``contexts`` (prev, word, n), which are distinct.

    ``terms`` (word, terms) are the choices of a word, ``bigrams`` (prev, word, n) how often a word
    follows another. The term that follows ``prev`` most often is the fix if it does so often enough and
    by the dominance ratio more often than the next one; else the fix is NULL. A word that occurs after
    very many others is joined where its contexts are.
    """
    weights = contexts.groupBy("word").agg(F.count(F.lit(1)).alias("contexts"))
    known = materialize(weights.join(terms, "word"), "open-words")
    listed = lookup_join(contexts, known.select("word", "terms", "contexts"), "word", "contexts")
    choices = listed.select("prev", "word", "n", F.explode("terms").alias("t")).select(
        "prev", "word", "n", "t.term", "t.count"
    )
    follows = bigrams.select("prev", F.col("word").alias("term"), F.col("n").alias("_seen"))
    seen = choices.join(follows, ["prev", "term"], "left")
    rank = F.struct(
        (-F.coalesce("_seen", F.lit(0))).alias("less"), (-F.col("count")).alias("rare"), "term"
    )
    per_use = seen.groupBy("prev", "word").agg(
        F.max("n").alias("n"), F.slice(F.array_sort(F.collect_list(rank)), 1, 2).alias("_two")
    )
    best, second = F.get("_two", F.lit(0)), F.get("_two", F.lit(1))
    often = -best["less"]
    sure = (often >= cfg.min_context_count) & (
        often >= cfg.dominance_ratio * F.coalesce(-second["less"], F.lit(0))
    )
    return per_use.select("prev", "word", "n", F.when(sure, best["term"]).alias("fix"))


def _open_uses(text: Column, cfg: SpellConfig) -> Column:
    """Distinct (prev, word) of the uses that ``_values`` leaves open and that follow a plain word."""

    def opened(cores: Column) -> Column:
        before = F.concat(F.array(F.lit("")), cores)
        pairs = F.arrays_zip(cores.alias("core"), F.slice(before, 1, F.size(cores)).alias("before"))
        return F.filter(
            pairs,
            lambda p: (p["before"] != "")
            & case_allows(p["core"], cfg)
            & F.coalesce(F.col("_values")[F.lower(p["core"])]["open"], F.lit(False)),
        )

    lowered = F.transform(
        let(piece_cores(text), opened),
        lambda p: F.struct(F.lower(p["before"]).alias("prev"), F.lower(p["core"]).alias("word")),
    )
    return F.array_distinct(lowered)


def spell_correct_context(
    df: DataFrame,
    dictionary: DataFrame | DictionaryIndex,
    bigrams: DataFrame,
    cfg: SpellConfig | None = None,
    text: str = "text",
    out: str = "spell_corrected",
    *,
    id_cols: list[str],
) -> DataFrame:
    """Add the spelling-corrected text, as ``spell_correct`` does, and also correct uses of words with
    several near terms where the word before them decides.

    ``id_cols`` are a key of ``df``; ``bigrams`` (prev, word, n) counts neighbours in lower case, as
    ``training.bigram_counts`` does. The word before is the token right before, as typed; a use at the
    start of a text, or after a token that is no plain word, stays. NULL texts stay NULL.

    Most words are decided once each. Only open uses, (prev, word) once per text, and the texts that
    hold one are shuffled a second time. The texts with their word verdicts are written in between.
    """
    cfg = cfg or SpellConfig()
    words = materialize(speller_vocabulary(df, text, cfg), "vocabulary")
    verdicts = materialize(use_verdicts(words, dictionary, cfg), "verdicts")
    opened = F.col("terms").isNotNull()
    verdict = F.struct("fix", opened.alias("open"))
    uses = verdicts.select(
        "word", "n", F.when(F.col("fix").isNotNull() | opened, verdict).alias("verdict")
    )
    marked = df.join(values_of_text(df, uses, "verdict", cfg, text, id_cols), id_cols, "left")
    marked = materialize(marked, "marked")
    has_open = F.coalesce(F.exists(F.map_values("_values"), lambda v: v["open"]), F.lit(False))

    of_text = marked.where(has_open).select(*id_cols, F.explode(_open_uses(F.col(text), cfg)).alias("_u"))
    of_text = materialize(of_text.select(*id_cols, "_u.prev", "_u.word"), "open-uses")
    contexts = materialize(of_text.groupBy("prev", "word").agg(F.count(F.lit(1)).alias("n")), "contexts")
    choices = verdicts.where(opened).select("word", "terms")
    # Neither word holds a blank, so the two joined by one are a key.
    key = F.concat_ws(" ", "prev", "word").alias("context")
    fixes = context_fixes(contexts, choices, bigrams, cfg).select(key, "fix", "n")
    fixes = materialize(fixes, "context-fixes")
    chosen = (
        lookup_join(of_text.select(*id_cols, key), fixes, "context", "n")
        .where(F.col("fix").isNotNull())
        .groupBy(*id_cols)
        .agg(F.map_from_entries(F.collect_list(F.struct("context", "fix"))).alias("_contexts"))
    )
    none = F.lit(None).cast("map<string,string>").alias("_contexts")
    both = marked.where(~has_open).select("*", none).unionByName(
        marked.where(has_open).join(chosen, id_cols, "left")
    )

    def fix_of(word: Column, before: Column) -> Column:
        context = F.concat_ws(" ", F.lower(F.coalesce(before, F.lit(""))), word)
        by_use = F.when(F.col("_contexts").isNotNull(), F.col("_contexts")[context])
        return F.coalesce(F.col("_values")[word]["fix"], by_use)

    # Texts without a word that has a fix or is open stay as they are.
    done = F.when(F.col("_values").isNull(), F.col(text)).otherwise(repair(F.col(text), fix_of, cfg))
    return computed_once(both, out, done).drop("_values", "_contexts")
