"""The whole correction job: spell, mask, correct, restore, guard."""

from __future__ import annotations

import sys
import uuid
from collections.abc import Callable, Iterator
from types import ModuleType

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textfix.config import CorrectionConfig
from textfix.functions.masking import mask, sentences_protected, unmask, unmasked_nothing
from textfix.functions.similarity import with_meaning, word_diff
from textfix.functions.text import sentences, strip, word_cores
from textfix.operators.dictionary import vocabulary
from textfix.operators.index import DictionaryIndex, terms_of
from textfix.operators.lookup import lookup_join
from textfix.operators.ordering import CHUNK_ROWS, number_rows, previous_value
from textfix.operators.spelling import spell_correct
from textfix.session import computed_once, materialize

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# A corrector maps the masked text to the corrected masked text.
Corrector = Callable[[Column], Column]


def identity(masked: Column) -> Column:
    return masked


def _worker_models() -> dict:
    """Models of this Python worker. This code travels inside the plan and is unpickled anew for every
    task, so what outlives a task hangs on a module of the worker's own."""
    return sys.modules.setdefault("_textfix_models", ModuleType("_textfix_models")).__dict__


def batch_corrector(factory: Callable[[], Callable[[list[str]], list[str]]]) -> Corrector:
    """Run a user's model over Arrow batches.

    ``factory`` is called on the executor, once per Python worker that meets a text and is kept for
    its later tasks; it returns a function from a list of texts to a list of the same length and
    order. NULL texts never reach it. The batch size is
    ``spark.sql.execution.arrow.maxRecordsPerBatch``.
    """
    key = uuid.uuid4().hex

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        models = _worker_models()
        for texts in batches:
            out = texts.astype("object").copy()
            present = texts.notna()
            todo = texts[present].tolist()
            if todo:
                if key not in models:
                    models[key] = factory()
                done = list(models[key](todo))
                if len(done) != len(todo):
                    raise ValueError(f"corrector returned {len(done)} texts for {len(todo)}")
                out[present] = done
            yield out

    return F.pandas_udf(run, "string").asNondeterministic()


def known_cores(text: Column, min_len: int) -> Column:
    return F.filter(word_cores(text), lambda w: F.length(w) >= min_len)


def dropped_words(spelled: Column, candidate: Column, min_len: int) -> Column:
    """Words of the spelled text that the candidate no longer has."""
    return F.array_except(known_cores(spelled, min_len), word_cores(candidate))


def _unlike(value: Column, other: Column) -> Column:
    """``value`` to be kept beside ``other``: nothing where they are equal."""
    return F.when(~value.eqNullSafe(other), F.struct(value.alias("v")))


def _restored(kept: Column, other: Column) -> Column:
    return F.when(kept.isNull(), other).otherwise(kept["v"])


def _drops_unknown(
    df: DataFrame, text: str, dictionary: DataFrame | DictionaryIndex, cfg: CorrectionConfig, id_cols: list[str]
) -> DataFrame:
    """Add ``_lost``: does the candidate lose a word the dictionary does not know?

    The texts are written and shuffled here, so ``_spelled``, ``_masked`` and ``_cand`` are kept only where
    they differ from the text they were made of.
    """
    original, spelled, masked, cand = (F.col(c) for c in (text, "_spelled", "_masked", "_cand"))
    lost = F.when(cand != spelled, dropped_words(spelled, cand, cfg.speller.min_token_len))
    rest = [c for c in df.columns if c not in ("_spelled", "_masked", "_cand")]
    # Found as the texts are written: the few lost words are read several times, the texts are not.
    base = computed_once(df, "_words", lost).select(
        *rest, "_words", _unlike(spelled, original).alias("_spelled"),
        _unlike(masked, spelled).alias("_masked"), _unlike(cand, spelled).alias("_cand"),
    )
    base = materialize(base, "candidates")
    words = base.select(*id_cols, F.explode("_words").alias("word"))
    terms = terms_of(dictionary).select(F.col("term").alias("word"), F.lit(True).alias("known"))
    verdicts = materialize(vocabulary(words, "word").join(terms, "word", "left"), "verdicts")
    flagged = (
        lookup_join(words, verdicts, "word", "n")
        .where(F.col("known").isNull())
        .select(*id_cols, F.lit(True).alias("_hit"))
        .distinct()
    )
    joined = base.drop("_words").join(flagged, id_cols, "left")
    joined = joined.withColumn("_spelled", _restored(spelled, original))
    return joined.withColumns(
        {"_masked": _restored(masked, spelled), "_cand": _restored(cand, spelled), "_lost": F.coalesce("_hit", F.lit(False))}
    ).drop("_hit")


def correct(
    df: DataFrame,
    dictionary: DataFrame | DictionaryIndex | None,
    corrector: Corrector = identity,
    cfg: CorrectionConfig | None = None,
    text: str = "text",
    *,
    id_cols: list[str],
) -> DataFrame:
    """Add ``correction``: STRUCT<original, spell_corrected, masked, final, fell_back,
    meaning_guarded, changed>.

    A lost sentinel falls back to the spelled text. An edit is refused when it drops an unknown
    word, changes the number of negations or rewrites the text. ``id_cols`` are a key of
    ``df``.
    """
    cfg = cfg or CorrectionConfig()
    original = F.col(text)
    if cfg.use_speller:
        step = spell_correct(df, dictionary, cfg.speller, text, "_spelled", id_cols=id_cols)
    else:
        step = df.withColumn("_spelled", original)
    spelled = F.col("_spelled")
    step = step.withColumn("_m", mask(spelled) if cfg.use_protector else unmasked_nothing(spelled))
    step = step.withColumn("_corrected", corrector(F.col("_m.masked")))
    step = step.withColumn("_u", unmask(F.col("_corrected"), F.col("_m.spans")))
    step = step.withColumn("_cand", F.when(F.col("_u.ok"), F.col("_u.text")).otherwise(spelled))
    # Only these are needed from here on; they are written below.
    needed = [F.col("_m.masked").alias("_masked"), F.col("_u.ok").alias("_ok"), "_cand"]
    step = step.select(*df.columns, "_spelled", *needed)
    cand = F.col("_cand")
    guarded = F.lit(False)
    if cfg.meaning_guard:
        if cfg.use_speller:
            step = _drops_unknown(step, text, dictionary, cfg, id_cols)
        else:
            step = step.withColumn("_lost", F.lit(False))
        open_case = (cand != spelled) & ~F.col("_lost")
        step = with_meaning(
            step, "_kept", F.when(open_case, spelled), F.when(open_case, cand),
            cfg.min_meaning_sim, cfg.autojunk,
        )
        guarded = (cand != spelled) & (F.col("_lost") | ~F.col("_kept"))
    step = step.withColumn("_guarded", guarded)
    step = step.withColumn("_final", F.when(F.col("_guarded"), spelled).otherwise(cand))
    record = F.struct(
        original.alias("original"),
        spelled.alias("spell_corrected"),
        F.col("_masked").alias("masked"),
        F.col("_final").alias("final"),
        (~F.col("_ok")).alias("fell_back"),
        F.col("_guarded").alias("meaning_guarded"),
        (F.col("_final") != original).alias("changed"),
    )
    done = computed_once(step, "correction", F.when(original.isNotNull(), record))
    return done.select(*df.columns, "correction")


def split_sentences(
    df: DataFrame, id_cols: list[str], text: str = "text", protect_first: bool = False
) -> DataFrame:
    """One row per sentence: ids, sent_no, sentence. ``protect_first`` keeps structured spans whole."""
    split = sentences_protected if protect_first else sentences
    return df.select(*id_cols, F.posexplode(split(F.col(text))).alias("sent_no", "sentence"))


def grammar_cards(corrected: DataFrame) -> DataFrame:
    """Rows whose final text differs from the spelled text, outer white space aside."""
    c = F.col("correction")
    return corrected.where(strip(c["final"]) != strip(c["spell_corrected"]))


def review(
    df: DataFrame,
    dictionary: DataFrame | DictionaryIndex | None,
    corrector: Corrector = identity,
    cfg: CorrectionConfig | None = None,
    id_cols: list[str] | None = None,
    text: str = "text",
    protect_first: bool = False,
) -> DataFrame:
    """Sentence cards: ids, sent_no, raw, final, diff, guarded.

    With ``protect_first`` a full stop inside an address or a number does not end a sentence.
    """
    ids = id_cols or ["id"]
    keys = [*ids, "sent_no"]
    fixed = correct(
        split_sentences(df, ids, text, protect_first), dictionary, corrector, cfg, "sentence", id_cols=keys
    )
    c = F.col("correction")
    return grammar_cards(fixed).select(
        *keys,
        F.col("sentence").alias("raw"),
        c["final"].alias("final"),
        word_diff(c["spell_corrected"], c["final"]).alias("diff"),
        c["meaning_guarded"].alias("guarded"),
    )


def example_report(
    examples: DataFrame,
    dictionary: DataFrame | DictionaryIndex | None,
    corrector: Corrector = identity,
    cfg: CorrectionConfig | None = None,
    order: str = "line_no",
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Corrected examples (order, category, note, input) numbered in order.

    ``header`` marks the first row of a run of the same category; ``fell_back`` the rows where an
    entity could not be kept.
    """
    numbered = number_rows(examples, order, "n", chunk_rows)
    linked = previous_value(numbered, "n", F.col("category"), "_prev")
    fixed = correct(linked, dictionary, corrector, cfg, "input", id_cols=["n"])
    c = F.col("correction")
    return fixed.select(
        "n",
        "category",
        "note",
        (F.col("_prev").isNull() | (F.col("_prev") != F.col("category"))).alias("header"),
        "input",
        c["final"].alias("final"),
        c["fell_back"].alias("fell_back"),
    )
