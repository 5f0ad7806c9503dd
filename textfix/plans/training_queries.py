"""Queries of the training-set operators, of reports in other settings, and of a user's model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textfix.config import CorrectionConfig
from textfix.functions import text as t
from textfix.functions.edits import apply_edits, extract_edits
from textfix.operators import context, corruption, scoring, spelling, training
from textfix.operators.ordering import first_rows
from textfix.operators.pairs import distinct_pairs, prepare_lang8
from textfix.plans import correct as job
from textfix.plans import fixtures as fx
from textfix.plans.registry import _blocks, _candidates, _cores, _hazard, _rounded, _scored, query
from textfix.session import computed_once, materialize

THRESHOLDS = [0.0, 0.25, 0.5, 0.75, 0.9, 1.0]
IDENTITY_SHARE = 0.3
TOKEN_CAP = 12


@query
def decontaminate(spark, sf):
    """Sentences of the documents that no benchmark text holds."""
    held = fx.load(spark, sf, "benchmark").select(
        F.explode(t.sentences(F.col("text"))).alias("sentence")
    )
    return training.decontaminate(fx.doc_sentences(spark, sf), held, "sentence", "sentence")


@query
def length_cap(spark, sf):
    return training.length_cap(fx.word_pairs(spark, sf), TOKEN_CAP)


@query
def identity_mix(spark, sf):
    pairs = distinct_pairs(prepare_lang8(fx.lang8_lines(spark, sf)))
    clean = fx.flat_sentences(spark, sf).select(F.col("sentence").alias("src"))
    return training.identity_mix(pairs, clean, IDENTITY_SHARE)


def _edits(spark: SparkSession, sf: str) -> DataFrame:
    """Changed evaluation rows with a confidence that follows the sentence key."""
    rows = scoring.with_norms(fx.eval_rows(spark, sf)).where(F.col("n_out") != F.col("n_in"))
    return rows.select(
        "sid", (F.col("sid") % 101 / 100).alias("score"),
        (F.col("n_out") == F.col("n_gold")).alias("correct"),
    )


@query
def confidence_gate(spark, sf):
    return training.confidence_gate(_edits(spark, sf), 0.75)


@query
def confidence_curve(spark, sf):
    done = training.confidence_curve(_edits(spark, sf), THRESHOLDS)
    return _rounded(done, ["precision", "coverage"])


@query
def f_half(spark, sf):
    """Edits of one annotator, some left out, moved or worded otherwise, against the whole set."""
    edits = _blocks(spark, sf).select("file", "block", F.explode("edits").alias("e"))
    gold = edits.select("file", "block", "e.start", "e.end", "e.repl")
    no = F.floor(F.col("block") / fx.LINES)
    hurt = gold.where(no % 7 != 0).withColumns({
        "repl": F.when(no % 11 == 0, F.concat("repl", F.lit("s"))).otherwise(F.col("repl")),
        "end": F.when(no % 13 == 0, F.col("end") + 1).otherwise(F.col("end")),
    })
    done = training.f_score(hurt, gold, ["file", "block"])
    return _rounded(done, ["precision", "recall", "f"])


def _extracted(df: DataFrame, source: str, target: str) -> DataFrame:
    edits = computed_once(df, "_edits", extract_edits(F.col(source), F.col(target)))
    return edits.select("sid", F.explode("_edits").alias("e")).select("sid", "e.start", "e.end", "e.repl")


@query
def edit_extraction(spark, sf):
    """Edits between the two texts of a pair, and whether they rebuild the second one."""
    pairs = computed_once(fx.word_pairs(spark, sf), "edits", extract_edits(F.col("src"), F.col("tgt")))
    rebuilt = F.array_join(apply_edits(t.words(F.col("src")), F.col("edits")), " ")
    shown = F.transform("edits", lambda e: F.concat_ws(":", e["start"], e["end"], e["repl"]))
    wanted = F.array_join(t.words(F.col("tgt")), " ")
    return pairs.select("sid", F.array_join(shown, "|").alias("edits"), (rebuilt == wanted).alias("rebuilt"))


@query
def f_half_extracted(spark, sf):
    """Edit scores from texts alone: a system that leaves every third sentence as it is, and puts a word
    of its own before every fifth."""
    sid = F.col("sid")
    pairs = fx.word_pairs(spark, sf).withColumn(
        "answer",
        F.when(sid % 3 == 0, F.col("src"))
        .when(sid % 5 == 0, F.concat(F.lit("¶ "), F.col("tgt")))
        .otherwise(F.col("tgt")),
    )
    pairs = materialize(pairs, "answered")
    done = training.f_score(_extracted(pairs, "src", "answer"), _extracted(pairs, "src", "tgt"), ["sid"])
    return _rounded(done, ["precision", "recall", "f"])


ERROR_MIX = {"article": 0.01, "word_order": 0.1, "punctuation": 0.15, "casing": 0.1, "spelling": 0.2, "spacing": 0.12}


@query
def corrupt(spark, sf):
    """Sentences with errors to a target mix; over a quarter stays clean."""
    done = corruption.corrupt(fx.flat_sentences(spark, sf), ERROR_MIX, ["sid"], "sentence")
    return done.select("sid", "kind", "src", "tgt")


@query
def corruption_mix(spark, sf):
    done = corruption.corrupt(fx.flat_sentences(spark, sf), ERROR_MIX, ["sid"], "sentence")
    return _rounded(corruption.mix_report(done), ["share"])


@query
def gleu(spark, sf):
    rows = fx.eval_rows(spark, sf)
    done = training.gleu(rows, ["sid"], "input", "gold", "pred")
    return _rounded(done, ["p1", "p2", "p3", "p4", "gleu"])


@query
def abbreviations(spark, sf):
    """Terms of three letters stand for themselves with an ending."""
    short = fx.dictionary(spark, sf).where(F.length("term") == 3)
    table = short.select(F.col("term").alias("word"), F.concat("term", F.lit("ing")).alias("fix"))
    done = spelling.abbreviations(fx.documents(spark, sf), table, id_cols=["doc_id"])
    return done.select("doc_id", "expanded")


@query
def gazetteer(spark, sf):
    """Words of the documents by policy; the names are the capitalised words of the benchmark."""
    names = fx.load(spark, sf, "benchmark").select(
        F.explode(t.plain_cores(F.col("text"))).alias("name")
    ).where(F.col("name").rlike("^[A-Z]"))
    uses = _cores(spark, sf).where(t.is_plain_word(F.col("core")))
    return training.name_policy(uses, names).select("core", "n", "policy")


@query
def bigram_rerank(spark, sf):
    """The best dictionary term for every unknown word, by the word before it."""
    bigrams = materialize(training.bigram_counts(fx.documents(spark, sf)), "bigrams")
    near = materialize(_candidates(spark, sf, 1), "near")
    unknown = near.select("word").distinct()
    contexts = bigrams.join(unknown, "word").select("prev", "word")
    return training.bigram_rerank(contexts, near, bigrams)


@query
def spell_correct_context(spark, sf):
    """Spelling of all documents; words with several near terms by the word before each use."""
    docs = fx.documents(spark, sf)
    fixed = context.spell_correct_context(
        docs, fx.dictionary(spark, sf), training.bigram_counts(docs), fx.SPELL, id_cols=["doc_id"]
    )
    return fixed.select("doc_id", "spell_corrected")


@query
def context_fixes(spark, sf):
    """The term chosen for an open word after each word that it follows, NULL where none is sure."""
    docs = fx.documents(spark, sf)
    words = materialize(spelling.speller_vocabulary(docs, "text", fx.SPELL), "vocabulary")
    verdicts = context.use_verdicts(words, fx.dictionary(spark, sf), fx.SPELL)
    terms = materialize(verdicts.where(F.col("terms").isNotNull()).select("word", "terms"), "open-terms")
    bigrams = materialize(training.bigram_counts(docs), "bigrams")
    followed = materialize(bigrams.join(terms.select("word"), "word"), "contexts")
    return context.context_fixes(followed, terms, bigrams, fx.SPELL)


@query
def top_regressions(spark, sf):
    """The first five regressions by key, as a report shows them."""
    return first_rows(scoring.regressions(_scored(spark, sf)), "sid", 5)


@query
def scope_in_out(spark, sf):
    return fx.eval_rows(spark, sf).groupBy(
        scoring.in_or_out(F.col("use_case")).alias("bucket")
    ).agg(F.count(F.lit(1)).alias("n"))


@query
def stage_switches(spark, sf):
    """The corrector alone, without speller, protection and guard."""
    cfg = CorrectionConfig(use_speller=False, use_protector=False, meaning_guard=False)
    done = job.correct(
        fx.all_sentences(spark, sf), None, _hazard, cfg, "sentence", id_cols=["sid"]
    )
    return done.select("sid", "correction.*").drop("original")


def exclaim():
    """A stand-in for a user's model: a final full stop becomes an exclamation mark."""
    return lambda texts: [x[:-1] + "!" if x.endswith(".") else x for x in texts]


@query
def model_correct(spark, sf):
    done = job.correct(
        fx.all_sentences(spark, sf), fx.dictionary(spark, sf), job.batch_corrector(exclaim),
        fx.CORRECTION, "sentence", id_cols=["sid"],
    )
    return done.select("sid", "correction.*").drop("original")
