"""Tables derived from the given ones, used by the registered queries and their checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textfix.config import CorrectionConfig, SpellConfig
from textfix.functions.text import let, sentences, words
from textfix.operators.dictionary import word_frequencies
from textfix.session import computed_once, materialize

# The dictionary is counted from the documents, so the thresholds follow its scale.
SPELL = SpellConfig(min_suggestion_count=50, dominance_ratio=2.0)
CORRECTION = CorrectionConfig(speller=SPELL)
MIN_COUNT = 20
# Sentence key: doc_id * SENTENCES + position; page sentences follow after PAGES.
SENTENCES = 10_000_000
PAGES = 900_000_000_000_000_000
# Lines per sentence in line-oriented tables, and a slice of line numbers for ordered work.
LINES = 8
LINE_SLICE = SENTENCES * LINES * 1000
# Sentences of more words are changed at their end only.
MIDDLE_WORDS = 150
# A mark that occurs in no text. Put between two halves of a text, it makes a pair that has to be
# compared, though the similarity is known in advance.
MARK = "§"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; how it is split into tasks is the session's setting."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")


def dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = word_frequencies(documents(spark, sf_dir), "text", MIN_COUNT)
    return materialize(counted, "dictionary")


def doc_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sid, sentence) of every document."""
    split = documents(spark, sf_dir).select(
        "doc_id", F.posexplode(sentences(F.col("text"))).alias("idx", "sentence")
    )
    return split.select((F.col("doc_id") * SENTENCES + F.col("idx")).alias("sid"), "sentence")


def page_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sid, sentence) with a link in brackets and a time for every page."""
    page = F.col("page_id").cast("string")
    text = F.concat(
        F.lit("please visit ("), F.col("url"), F.lit(") before "), page, F.lit("pm.")
    )
    return load(spark, sf_dir, "pages").select(
        (F.col("page_id") + PAGES).alias("sid"), text.alias("sentence")
    )


def all_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doc_sentences(spark, sf_dir).unionByName(page_sentences(spark, sf_dir))


def marks(n: int | Column) -> Column:
    return F.repeat(F.lit(MARK), F.lit(n) if isinstance(n, int) else n)


def marked(text: Column, n: int | Column, replace: bool | Column = False) -> Column:
    """``n`` marks put before the first word of the second half, or in place of the blank before it; into
    the middle of a single word.

    NULL where the similarity to the text would not be known: no such blank between plain words, or
    so few blanks in a long text that matching does not ignore them.
    """
    half = F.floor(F.length(text) / 2).cast("int")
    replace = F.lit(replace) if isinstance(replace, bool) else replace

    def halves(at: Column) -> Column:
        return F.struct(at.alias("at"), F.left(text, at).alias("head"), F.substr(text, at + 1).alias("tail"))

    def put(h: Column) -> Column:
        blanks = (F.length(text) < 150) | ((F.size(words(text)) - 3) * 100 > F.length(text) + 300)
        known = (h["at"] > half) & h["head"].rlike(r"[\p{L}\p{N},] $") & h["tail"].rlike(r"^[\p{L}\p{N}]") & blanks
        before = F.when(replace, F.left(text, h["at"] - 1)).otherwise(h["head"])
        return F.when(known, F.concat(before, marks(n), h["tail"])).when(
            text.rlike(r"^[\p{L}\p{N}]{2,100}[.!?]*$"), split_word
        )

    letters = F.length(F.rtrim(text, F.lit(".!?")))
    inner = letters - F.floor(letters / 2).cast("int")
    split_word = F.concat(F.left(text, inner), marks(n), F.substr(text, inner + 1))
    at = half + F.instr(F.substr(text, half + 1), F.lit(" "))
    return let(at, lambda found: let(halves(found), put))


def eval_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sid, input, gold, pred, ref, use_case): corrupted inputs and three kinds of answers."""
    gold, sid = F.col("gold"), F.col("sid")
    kind = sid % 5
    rows = doc_sentences(spark, sf_dir).select("sid", F.col("sentence").alias("gold"))
    many = F.floor(F.length(gold) / 2).cast("int") + 1
    # Halves of a text are found once for all that is put between them.
    n = F.when(kind.isin(1, 3), 1).when(kind == 2, 2).when(kind == 4, many).otherwise(5)
    rows = rows.withColumn("_marked", marked(gold, n, kind == 3))
    put = F.col("_marked")
    rows = rows.withColumn(
        "input",
        F.when(kind == 0, gold)
        .when(kind == 1, F.lower(F.coalesce(put, gold)))
        .when(kind == 2, F.coalesce(put, F.concat(gold, marks(2))))
        .when(kind == 3, F.coalesce(put, F.concat(marks(2), gold)))
        .otherwise(F.coalesce(put, F.concat(gold, marks(many)))),
    ).withColumn(
        "use_case",
        F.when(kind == 0, "basic-standard-lang")
        .when(kind == 1, "Casing Errors")
        .when(kind == 2, "Incorrect Dates")
        .when(kind == 3, "Basic Typos")
        .otherwise(F.when(sid % 2 == 0, "Repetition").otherwise("unlisted label")),
    )
    behind = F.concat(F.col("input"), marks(5))
    worse = F.when(kind == 0, F.coalesce(put, behind)).otherwise(behind)

    def answer(turn: Column) -> Column:
        return F.when(turn == 0, gold).when(turn == 1, F.col("input")).otherwise(worse)

    answers = {"pred": answer(sid % 3), "ref": answer((sid + 1) % 3)}
    return rows.withColumns(answers).drop("_marked")


def flat_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences as single lines."""
    return doc_sentences(spark, sf_dir).select(
        "sid", F.translate("sentence", "\r\n\t", "   ").alias("sentence")
    )


def m2_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotation lines (file, line_no, line): edits by two annotators, deletions, edits out of
    order, no-ops, and some blocks that are cut short."""
    sid = F.col("sid")
    text = F.concat(F.lit("S "), F.col("sentence"))

    def note(span: str, kind: str, repl: str, who: Column) -> Column:
        head = f"A {span}|||{kind}|||{repl}|||REQUIRED|||-NONE-|||"
        return F.concat(F.lit(head), who.cast("string"))

    lines = F.array(
        text,
        note("1 2", "R:OTHER", "xx yy", sid % 2),
        F.when(sid % 10 == 0, note("0 1", "U:OTHER", "-NONE-", F.lit(0))),
        F.when(sid % 15 == 0, note("3 3", "M:OTHER", "zz", F.lit(0))),
        note("-1 -1", "noop", "-NONE-", F.lit(0)),
        F.when(sid % 19 != 0, F.lit("")),
    )
    exploded = flat_sentences(spark, sf_dir).select("sid", F.posexplode(lines).alias("k", "line"))
    return exploded.where(F.col("line").isNotNull()).select(
        F.concat(F.lit("part-"), (F.floor(sid / SENTENCES) % 4).cast("string")).alias("file"),
        (sid * LINES + F.col("k")).alias("line_no"),
        "line",
    )


def lang8_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learner entries (line_no, line), with short lines, bad counts, long targets and repeats."""
    sid, gold = F.col("sid"), F.col("sentence")
    count = F.when(sid % 11 == 0, "x").otherwise((sid % 4).cast("string"))
    source = F.when(sid % 5 == 0, gold).otherwise(F.concat(gold, F.lit(f" {MARK}")))
    target = F.when(sid % 13 == 0, F.concat_ws(" ", gold, gold, gold, gold)).otherwise(gold)
    short = F.concat_ws("\t", count, sid.cast("string"), F.lit("u"), F.lit("1"), source)
    line = F.when(sid % 9 == 0, short).otherwise(F.concat_ws("\t", short, target))
    copies = F.sequence(F.lit(0), F.when(sid % 17 == 0, 1).otherwise(0))
    return flat_sentences(spark, sf_dir).select(
        "sid", line.alias("line"), F.explode(copies).alias("copy")
    ).select((sid * LINES + F.col("copy")).alias("line_no"), "line")


def word_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sid, src, tgt): up to five words put into the middle of each sentence, or one changed there."""
    src, k = F.col("sentence"), (F.col("sid") % 6).cast("int")
    w = F.col("w")
    n = F.size(w)
    half = n - F.floor(n / 2).cast("int")
    middle = (n >= 2) & (n <= MIDDLE_WORDS)
    # The changed word differs from the next one, so that the rest of the sentence stays matched.
    change = middle & (k == 1) & (F.lower(F.get(w, half)) != F.lower(F.get(w, half + 1)))
    at = F.when(middle, half).otherwise(n)
    change = F.coalesce(change, F.lit(False))
    rest = F.slice(w, at + 1 + change.cast("int"), n)
    tgt = F.array_join(F.concat(F.slice(w, F.lit(1), at), F.array_repeat(F.lit(MARK), k), rest), " ")
    split = computed_once(flat_sentences(spark, sf_dir), "w", words(src))
    return computed_once(split, "tgt", tgt).select("sid", src.alias("src"), "tgt")


def completions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sid, completion): answers with thoughts, labels, quotes or comments around the sentence."""
    s, kind = F.col("sentence"), F.col("sid") % 5
    wrapped = (
        F.when(kind == 0, s)
        .when(kind == 1, F.concat(F.lit("<think>a\nb</think>\n\n"), s))
        .when(kind == 2, F.concat(F.lit("Corrected:  "), s))
        .when(kind == 3, F.concat(F.lit(' "'), s, F.lit('" ')))
        .otherwise(F.concat(s, F.lit("\r\nNote: none.")))
    )
    return flat_sentences(spark, sf_dir).select("sid", wrapped.alias("completion"))


def metric_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq, metric, model, beam, batch, value) from the events."""
    return load(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"),
        F.when(F.col("user_id") % 3 == 0, "beam_throughput").otherwise("throughput").alias("metric"),
        F.col("event_type").alias("model"),
        (F.col("user_id") % 5 + 1).cast("int").alias("beam"),
        F.pow(F.lit(2), F.col("event_id") % 7).cast("int").alias("batch"),
        "value",
    )


def hazard(sid: Column, masked: Column) -> Column:
    """A corrector that takes every branch of the guards, chosen by the sentence key."""
    kind = sid % 7
    last = F.regexp_extract(masked, r"([^ \n]+)\z", 1)
    shorter = F.left(masked, F.length(masked) - F.length(last) - 1)
    raised = F.when(
        masked.rlike("^[a-z]"), F.concat(F.upper(F.left(masked, F.lit(1))), F.substr(masked, F.lit(2)))
    ).otherwise(masked)
    return (
        F.when(kind == 0, masked)
        .when(kind == 1, F.concat(raised, F.lit(".")))
        .when(kind == 2, F.replace(masked, F.lit("__0__"), F.lit("____")))
        .when(kind == 3, F.replace(masked, F.lit("__0__"), F.lit("")))
        .when(kind == 4, F.concat(masked, F.lit(" not")))
        .when(kind == 5, F.lit("x"))
        .otherwise(
            F.when(F.length(last) * 4 <= F.length(masked), shorter).otherwise(masked)
        )
    )
