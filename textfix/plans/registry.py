"""One query per operator over the given tables: name -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textfix.functions import completions as comp
from textfix.functions import similarity as sim
from textfix.functions import text as t
from textfix.functions.distance import edit_distance as full_distance
from textfix.functions.masking import mask as mask_text
from textfix.functions.masking import unmask as unmask_text
from textfix.operators import dictionary as dic
from textfix.operators import fuzzy, pairs, scoring, spelling, stats
from textfix.operators.index import dictionary_index
from textfix.operators.ordering import first_rows
from textfix.plans import correct as job
from textfix.plans import fixtures as fx
from textfix.session import materialize, shared_dir
from textfix.streaming.chunks import idle_chunks, stop_chunks
from textfix.streaming.correct import stream_correct as start_stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _join(array: Column, sep: str = "|") -> Column:
    return F.array_join(array, sep)


def _words_of(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct word tokens of the documents with their number of uses."""
    toks = fx.documents(spark, sf).select(F.explode(t.words(F.col("text"))).alias("token"))
    return toks.groupBy("token").agg(F.count(F.lit(1)).alias("n"))


def _vocabulary(spark: SparkSession, sf: str) -> DataFrame:
    return spelling.speller_vocabulary(fx.documents(spark, sf), "text", fx.SPELL)


# ---- tokens and predicates ------------------------------------------------------------------


@query
def tokenize(spark, sf):
    toks = t.tokens(F.col("text"))
    return fx.documents(spark, sf).select(
        "doc_id", F.size(toks).cast("long").alias("n"), _join(toks).alias("tokens")
    )


@query
def peel(spark, sf):
    return _words_of(spark, sf).select("token", t.peel(F.col("token")).alias("p")).select(
        "token", "p.pre", "p.core", "p.post"
    )


@query
def peel_protect(spark, sf):
    return _words_of(spark, sf).select("token", t.peel_protect(F.col("token")).alias("p")).select(
        "token", "p.pre", "p.core", "p.post"
    )


def _cores(spark, sf):
    return _words_of(spark, sf).groupBy(t.peel(F.col("token"))["core"].alias("core")).agg(
        F.sum("n").alias("n")
    )


@query
def plain_words(spark, sf):
    return _cores(spark, sf).where(t.is_plain_word(F.col("core")))


@query
def correctable_tokens(spark, sf):
    return _cores(spark, sf).where(t.is_correctable(F.col("core")))


@query
def structured_spans(spark, sf):
    pages = fx.page_sentences(spark, sf).select(F.explode(t.words(F.col("sentence"))).alias("token"))
    docs = fx.documents(spark, sf).select(F.explode(t.words(F.col("text"))).alias("token"))
    core = t.peel_protect(F.col("token"))["core"]
    spans = docs.unionByName(pages).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    found = spans.select(core.alias("core"), "n").where(t.is_structured(F.col("core")))
    return found.groupBy("core").agg(F.sum("n").alias("n"))


@query
def sentences(spark, sf):
    return fx.doc_sentences(spark, sf)


@query
def sentences_protected(spark, sf):
    """Sentences of the documents and page texts whose addresses and numbers stay whole."""
    docs = fx.documents(spark, sf).select(F.col("doc_id").alias("id"), "text")
    pages = fx.page_sentences(spark, sf).select(F.col("sid").alias("id"), F.col("sentence").alias("text"))
    split = job.split_sentences(docs.unionByName(pages), ["id"], protect_first=True)
    return split.select("id", F.col("sent_no").cast("long").alias("sent_no"), "sentence")


@query
def normalize(spark, sf):
    return fx.eval_rows(spark, sf).select("sid", t.normalize(F.col("pred")).alias("norm"))


@query
def negation_count(spark, sf):
    n = t.negation_count(F.concat(F.col("text"), F.lit(" isn’t n`t WOULD'VE no"), F.col("lang")))
    return fx.documents(spark, sf).select("doc_id", n.cast("long").alias("n"))


@query
def word_cores(spark, sf):
    return fx.documents(spark, sf).select(
        "doc_id", _join(F.array_sort(t.word_cores(F.col("text")))).alias("cores")
    )


@query
def match_case(spark, sf):
    """Case pattern of every core on its reversed spelling."""
    core = F.col("core")
    return _cores(spark, sf).where(t.is_plain_word(core)).select(
        "core", t.match_case(core, F.lower(F.reverse(core))).alias("cased")
    )


# ---- dictionary, candidates, spelling ---------------------------------------------------------


@query
def word_frequencies(spark, sf):
    return dic.word_frequencies(fx.documents(spark, sf), "text", fx.MIN_COUNT)


@query
def merge_dictionaries(spark, sf):
    own = dic.word_frequencies(fx.documents(spark, sf), "text", fx.MIN_COUNT)
    extra = dic.word_frequencies(fx.load(spark, sf, "conversations"), "text", 5)
    return dic.merge_dictionaries(own, extra)


@query
def unknown_vocab(spark, sf):
    return dic.unknown_words(_vocabulary(spark, sf), fx.dictionary(spark, sf))


@query
def protected_terms(spark, sf):
    """Unknown words once the words of the benchmark texts are allowed as well."""
    allowed = dic.word_frequencies(fx.load(spark, sf, "benchmark"), "text")
    merged = dic.merge_dictionaries(fx.dictionary(spark, sf), allowed)
    return dic.unknown_words(_vocabulary(spark, sf), merged)


def _candidates(spark, sf, k):
    index = dictionary_index(fx.dictionary(spark, sf), k)
    unknown = dic.unknown_words(_vocabulary(spark, sf), index.terms)
    return fuzzy.fuzzy_candidates(unknown, index, k)


@query
def fuzzy_candidates(spark, sf):
    return _candidates(spark, sf, 2)


@query
def edit_distance(spark, sf):
    """The full distance of every pair that shares a one-deletion key, near or not."""
    near = _candidates(spark, sf, 1)
    turned = F.concat(F.substr("word", F.lit(2)), F.left("word", F.lit(1)))
    word, term = F.col("word"), F.col("term")
    return near.select(
        "word", "term", full_distance(word, term).cast("long").alias("distance"),
        full_distance(turned, term).cast("long").alias("turned"),
    )


@query
def rank_candidates(spark, sf):
    ranked = fuzzy.rank_candidates(_candidates(spark, sf, 1))
    return ranked.select(
        "word", "term", F.col("rank").cast("long").alias("rank"), "closest"
    )


@query
def topk_candidates(spark, sf):
    ranked = fuzzy.rank_candidates(_candidates(spark, sf, 2), fx.SPELL.top_suggestions)
    return ranked.select("word", F.col("rank").cast("long").alias("rank"), "term", "count")


@query
def autofix_gate(spark, sf):
    ranked = fuzzy.rank_candidates(_candidates(spark, sf, 1), 2)
    return fuzzy.gate(ranked, fx.SPELL).select(
        "word", "term", "count", F.coalesce("runner_up", F.lit(0)).alias("runner_up"), "autofix"
    )


@query
def spell_correct(spark, sf):
    fixed = spelling.spell_correct(
        fx.documents(spark, sf), fx.dictionary(spark, sf), fx.SPELL, id_cols=["doc_id"]
    )
    return fixed.select("doc_id", "spell_corrected")


def _analyzed(spark, sf):
    index = dictionary_index(fx.dictionary(spark, sf))
    return spelling.analyze_tokens(fx.documents(spark, sf), index, fx.SPELL, ["doc_id"])


@query
def analyze_tokens(spark, sf):
    return _analyzed(spark, sf).select(
        "doc_id", F.col("pos").cast("long").alias("pos"), "kind", "raw", "pre", "core", "post",
        "status", "fix", _join(F.col("candidates")).alias("candidates"),
    )


@query
def apply_suggestions(spark, sf):
    """Every token with suggestions gets the first one."""
    read = ["doc_id", "pos", "kind", "raw", "pre", "post", "status", "candidates"]
    analyzed = materialize(_analyzed(spark, sf).select(read), "analyzed")
    chosen = analyzed.where(F.col("status") == "suggest").select(
        "doc_id", "pos", F.get("candidates", F.lit(0)).alias("word")
    )
    return spelling.apply_suggestions(analyzed, chosen, ["doc_id"])


@query
def replace_first(spark, sf):
    """The first sentence of each document replaced inside the document, once."""
    first = F.get(t.sentences(F.col("text")), F.lit(0))
    out = t.replace_first(F.col("text"), first, F.lit("$1 done"))
    return fx.documents(spark, sf).select("doc_id", out.alias("text"))


# ---- masking, guards, correction --------------------------------------------------------------


@query
def mask(spark, sf):
    m = mask_text(F.col("sentence"))
    return fx.all_sentences(spark, sf).select("sid", m.alias("m")).select(
        "sid", "m.masked", _join(F.col("m.spans")).alias("spans")
    )


@query
def unmask(spark, sf):
    """Masked sentences damaged in four ways and restored."""
    masked = fx.all_sentences(spark, sf).select("sid", mask_text(F.col("sentence")).alias("m"))
    text, kind = F.col("m.masked"), F.col("sid") % 4
    hurt = (
        F.when(kind == 0, F.concat(F.lit("__1__ "), text, F.lit(" __0__ __77__")))
        .when(kind == 1, F.replace(text, F.lit("__0__"), F.lit("_0_")))
        .when(kind == 2, F.replace(text, F.lit("__0__"), F.lit("")))
        .otherwise(text)
    )
    return masked.select("sid", unmask_text(hurt, F.col("m.spans")).alias("u")).select(
        "sid", "u.text", "u.ok"
    )


@query
def similarity(spark, sf):
    return scoring.scored(fx.eval_rows(spark, sf)).select("sid", "sim_in", "sim_out", "sim_ref")


@query
def word_edits(spark, sf):
    return fx.word_pairs(spark, sf).select(
        "sid", sim.word_edits(F.col("src"), F.col("tgt")).cast("long").alias("n_edits")
    )


@query
def word_diff(spark, sf):
    diff = sim.word_diff(F.col("src"), F.col("tgt"))
    shown = F.transform(diff, lambda d: F.concat(d["t"], F.when(d["c"], "+").otherwise("=")))
    return fx.word_pairs(spark, sf).select("sid", _join(shown, " ").alias("diff"))


@query
def meaning_guard(spark, sf):
    s, kind = F.col("sentence"), F.col("sid") % 5
    after = (
        F.when(kind == 0, s)
        .when(kind == 1, F.concat(s, F.lit(" not")))
        .when(kind == 2, F.coalesce(fx.marked(s, 2), F.concat(s, fx.marks(2))))
        .when(kind == 3, F.coalesce(fx.marked(s, F.length(s) + 20), F.concat(s, fx.marks(1))))
        .otherwise(F.coalesce(fx.marked(s, 1, True), F.concat(fx.marks(1), s)))
    )
    return sim.with_meaning(fx.doc_sentences(spark, sf), "kept", s, after).select("sid", "kept")


@query
def dropped_names(spark, sf):
    """Unknown words lost when the last fifth of every document's characters is cut off."""
    terms = fx.dictionary(spark, sf)
    cut = F.left("text", F.length("text") - F.floor(F.length("text") / 5).cast("int"))
    lost = fx.documents(spark, sf).select(
        "doc_id", F.explode(job.dropped_words(F.col("text"), cut, fx.SPELL.min_token_len)).alias("word")
    )
    return dic.unknown_words(lost, terms).select("doc_id", "word")


@query
def clean_completion(spark, sf):
    return fx.completions(spark, sf).select(
        "sid", comp.clean_completion(F.col("completion")).alias("clean")
    )


@query
def chat_messages(spark, sf):
    messages = comp.chat_messages(F.col("text"), "fix it")
    return fx.load(spark, sf, "conversations").select(
        "conv_id", "turn", F.to_json(messages).alias("messages")
    )


def _hazard(masked: Column) -> Column:
    return fx.hazard(F.col("sid"), masked)


def _corrected(spark, sf):
    return job.correct(
        fx.all_sentences(spark, sf), fx.dictionary(spark, sf), _hazard, fx.CORRECTION, "sentence",
        id_cols=["sid"],
    )


@query
def correct(spark, sf):
    return _corrected(spark, sf).select("sid", "correction.*").drop("original")


@query
def grammar_cards(spark, sf):
    return job.grammar_cards(_corrected(spark, sf)).select(
        "sid", F.col("correction.spell_corrected").alias("spell_corrected"),
        F.col("correction.final").alias("final"),
    )


def _reviewed(spark, sf, terms):
    sid = F.col("doc_id") * fx.SENTENCES + F.col("sent_no")
    return job.review(
        fx.documents(spark, sf), terms, lambda masked: fx.hazard(sid, masked), fx.CORRECTION,
        ["doc_id"],
    )


@query
def review(spark, sf):
    shown = F.transform("diff", lambda d: F.concat(d["t"], F.when(d["c"], "+").otherwise("=")))
    return _reviewed(spark, sf, fx.dictionary(spark, sf)).select(
        "doc_id", F.col("sent_no").cast("long").alias("sent_no"), "raw", "final",
        _join(shown, " ").alias("diff"), "guarded",
    )


@query
def suggestion_summary(spark, sf):
    terms = fx.dictionary(spark, sf)
    analyzed = spelling.analyze_tokens(fx.documents(spark, sf), terms, fx.SPELL, ["doc_id"])
    return spelling.suggestion_summary(analyzed, _reviewed(spark, sf, terms), ["doc_id"])


@query
def example_report(spark, sf):
    turns = fx.load(spark, sf, "conversations")
    width = turns.agg(F.max("turn") + 1).scalar()
    order = F.col("conv_id") * width + F.col("turn")
    examples = turns.select(
        order.alias("line_no"), F.col("role").alias("category"), F.lit("turn").alias("note"),
        F.col("text").alias("input"),
    )
    return job.example_report(
        examples, fx.dictionary(spark, sf), lambda masked: fx.hazard(F.col("n"), masked),
        fx.CORRECTION, chunk_rows=100_000_000,
    )


# ---- scoring ----------------------------------------------------------------------------------


def _normed(spark, sf):
    return scoring.with_norms(fx.eval_rows(spark, sf))


def _scored(spark, sf):
    return scoring.scored(fx.eval_rows(spark, sf))


def _scored_core(spark, sf):
    """For reports on in-scope rows: the others are not compared."""
    return scoring.scored(scoring.in_scope(fx.eval_rows(spark, sf)))


@query
def score_join(spark, sf):
    rows = fx.eval_rows(spark, sf)
    inputs, golds = rows.select("sid", "input"), rows.select("sid", "gold")
    preds = rows.select("sid", F.col("pred").alias("out"))
    joined = scoring.align(inputs, golds, preds, ["sid"])
    return joined.select("sid", "input", "gold", "out")


@query
def scope_counts(spark, sf):
    return scoring.scope_counts(fx.eval_rows(spark, sf))


@query
def match_rate(spark, sf):
    return scoring.match_rate(_normed(spark, sf))


@query
def by_use_case(spark, sf):
    return scoring.by_use_case(_normed(spark, sf))


def _rounded(df: DataFrame, names: list[str]) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


@query
def mean_similarity(spark, sf):
    return _rounded(scoring.mean_similarity(_scored(spark, sf)), ["sim_in", "sim_out", "sim_ref"])


@query
def direction(spark, sf):
    return scoring.direction(_scored(spark, sf))


@query
def by_scope(spark, sf):
    return _rounded(scoring.by_scope(_scored(spark, sf)), ["our_sim", "in_sim"])


@query
def evaluate_report(spark, sf):
    """All shares, means and counts of an evaluation, whole, by bucket and by label, in one pass."""
    shown = scoring.evaluate_report(_scored(spark, sf))
    return _rounded(shown, ["sim_in", "sim_out", "sim_ref"])


@query
def error_profile(spark, sf):
    return scoring.error_profile(_scored_core(spark, sf)).drop("match_pct")


@query
def model_profile(spark, sf):
    return scoring.model_profile(_scored_core(spark, sf)).select(
        "n", "edited", "improved", "match_pct", "edit_precision", "suspect_run"
    )


@query
def regressions(spark, sf):
    return scoring.regressions(_scored_core(spark, sf), digits=None)


# ---- measurements -----------------------------------------------------------------------------


@query
def latency_percentiles(spark, sf):
    return stats.nearest_rank_percentiles(fx.load(spark, sf, "events"), "value", ["event_type"])


@query
def mean_median(spark, sf):
    done = stats.mean_and_median(fx.load(spark, sf, "events"), "value", ["event_type"])
    return _rounded(done, ["mean", "median"])


@query
def throughput(spark, sf):
    """Events per unit of value, by type, with the user as the run."""
    events = fx.load(spark, sf, "events").withColumn("items", F.lit(1))
    done = stats.median_throughput(events, "items", "value", ["event_type"], "user_id")
    return _rounded(done, ["throughput"])


@query
def metric_pivot(spark, sf):
    return stats.metric_pivot(fx.metric_rows(spark, sf))


@query
def metric_series(spark, sf):
    return stats.metric_series(fx.metric_rows(spark, sf))


@query
def idle_sessions(spark, sf):
    return idle_chunks(fx.load(spark, sf, "events"), ["user_id"], "ts", 1800)


@query
def stop_sessions(spark, sf):
    """Chunks of a user's events: a purchase stands for a full stop, two of them or two idle days end one."""
    events = fx.load(spark, sf, "events")
    stops = (F.col("event_type") == "purchase").cast("int")
    return stop_chunks(events, ["user_id"], "ts", stops, 172_800)


# ---- corpora ----------------------------------------------------------------------------------


def _blocks(spark, sf):
    return pairs.m2_blocks(fx.m2_lines(spark, sf), chunk_rows=fx.LINE_SLICE)


@query
def m2_blocks(spark, sf):
    return _blocks(spark, sf).select(
        "file", "block", _join(F.col("src"), " ").alias("src"),
        F.size("edits").cast("long").alias("n_edits"),
    )


@query
def m2_pairs(spark, sf):
    return pairs.prepare_m2(_blocks(spark, sf)).select(
        "src", "tgt", F.col("line_no.file").alias("file"), F.col("line_no.block").alias("block")
    )


@query
def prep_counters(spark, sf):
    blocks = materialize(_blocks(spark, sf), "blocks")
    return pairs.prep_counters(blocks, files=fx.m2_lines(spark, sf))


@query
def job_counters(spark, sf):
    """Counters that come with the writes of both preparation jobs."""
    jobs = {
        "m2": pairs.prepare_m2_counted(_blocks(spark, sf)),
        "lang8": pairs.prepare_lang8_counted(fx.lang8_lines(spark, sf)),
    }
    rows = []
    for name, (made, counters) in jobs.items():
        materialize(made, f"{name}-pairs")
        found = counters.get()
        rows.append((name, found["pairs"], found["identities"], found["broken"]))
    return spark.createDataFrame(rows, "job string, pairs long, identities long, broken long")


@query
def lang8_pairs(spark, sf):
    return pairs.prepare_lang8(fx.lang8_lines(spark, sf))


def _entries(spark, sf):
    return pairs.parse_lang8(fx.lang8_lines(spark, sf), keep_identity=True)


@query
def length_ratio(spark, sf):
    return pairs.length_ratio(_entries(spark, sf))


@query
def minimal_edit(spark, sf):
    return pairs.minimal_edit(fx.word_pairs(spark, sf), 3)


@query
def distinct_pairs(spark, sf):
    return pairs.distinct_pairs(_entries(spark, sf))


@query
def first_occurrence(spark, sf):
    return pairs.first_occurrence(_entries(spark, sf), "line_no")


@query
def limit_pairs(spark, sf):
    return first_rows(pairs.first_occurrence(_entries(spark, sf), "line_no"), "line_no", 500)


@query
def mix_corpora(spark, sf):
    clean = pairs.prepare_m2(_blocks(spark, sf))
    noisy = pairs.prepare_lang8(fx.lang8_lines(spark, sf))
    return pairs.mix_corpora(clean, noisy, 1000)


# ---- streaming --------------------------------------------------------------------------------


@query
def stream_correct(spark, sf):
    """All conversation turns through a stream, read back from its sink."""
    source = spark.read.parquet(f"{sf}/conversations.parquet")
    # A pattern fits the table as one file, which a stream refuses by its plain path, and as a folder.
    stream = spark.readStream.schema(source.schema).parquet(f"{sf}/conversations.parque[t]")
    base = f"{shared_dir(spark)}/textfix/stream-{uuid.uuid4().hex}"
    running = start_stream(
        stream, fx.dictionary(spark, sf), f"{base}/out", f"{base}/state",
        lambda masked: fx.hazard(F.col("conv_id") + F.col("turn"), masked), fx.CORRECTION, "text",
        id_cols=["conv_id", "turn"], available_now=True,
    )
    running.awaitTermination()
    done = spark.read.parquet(f"{base}/out")
    return done.select(
        "conv_id", "turn", F.col("correction.final").alias("final"),
        F.col("correction.fell_back").alias("fell_back"),
        F.col("correction.meaning_guarded").alias("meaning_guarded"),
    )
