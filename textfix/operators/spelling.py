"""Guarded spelling: decide once per distinct unknown word, then apply to every use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textfix.config import SpellConfig
from textfix.functions.text import (
    BARE_RE,
    PEEL_RE,
    PIECE_CORE_RE,
    PIECE_RE,
    WS_CHARS,
    case_allows,
    is_correctable,
    let,
    match_case,
    peel,
    plain_cores,
    tokens,
)
from textfix.operators.dictionary import unknown_words, vocabulary
from textfix.operators.fuzzy import fuzzy_candidates, gate, rank_candidates
from textfix.operators.index import DictionaryIndex, terms_of
from textfix.operators.lookup import lookup_join
from textfix.session import computed_once, materialize


# Words of a text that are searched one by one for that of a token, on average.
SLOT_WORDS = 8
# Words with over this part of all uses, that is so many at most, may be sent to all tasks.
COMMON_WORDS = 10_000


def correctable_cores(text: Column, cfg: SpellConfig) -> Column:
    """Cores of a text that the speller may look at, as typed."""
    return F.filter(plain_cores(text), lambda c: case_allows(c, cfg))


def speller_vocabulary(df: DataFrame, text: str, cfg: SpellConfig) -> DataFrame:
    """Distinct words the speller may look at, with the number of uses: (word, n)."""
    words = df.select(F.explode(plain_cores(F.col(text))).alias("core"))
    return vocabulary(words.where(case_allows(F.col("core"), cfg)), "core")


def autofixes(words: DataFrame, dictionary: DataFrame | DictionaryIndex, cfg: SpellConfig) -> DataFrame:
    """Words of a vocabulary with a safe correction: (word, fix).

    A safe correction lies within ``autocorrect_max_distance``; if no term does, the nearest one
    fails the gate. So shorter deletion keys are enough here.
    """
    k = min(cfg.max_edit_distance, cfg.autocorrect_max_distance)
    unknown = unknown_words(words.select("word"), terms_of(dictionary))
    ranked = rank_candidates(fuzzy_candidates(unknown, dictionary, k), 2)
    return gate(ranked, cfg).where("autofix").select("word", F.col("term").alias("fix"))


def pieces(text: Column) -> Column:
    """The words of a text, each with the white space after it; white space at the start is one more."""
    return F.regexp_extract_all(text, F.lit(PIECE_RE), F.lit(0))


def piece_cores(text: Column) -> Column:
    """The core of each of the ``pieces`` of a text that is a plain word, else the empty string."""
    return F.regexp_extract_all(text, F.lit(PIECE_CORE_RE), F.lit(1))


def repair(text: Column, fix_of, cfg: SpellConfig) -> Column:
    """Rewrite a text word by word; ``fix_of`` maps a lower-cased word and the core of the piece before it
    (NULL at the start, empty if it is no plain word) to its fix or NULL.

    A piece is a word with the white space after it; the peeled ends keep that space. The cores of all
    pieces are found by one search, and only words with a fix are taken apart.
    """
    least = max(cfg.min_token_len, 1)

    def fixes(cores: Column) -> Column:
        return F.transform(
            cores, lambda c, i: F.when(F.length(c) >= least, fix_of(F.lower(c), F.get(cores, i - 1)))
        )

    def token(p: Column) -> Column:
        fixed = F.concat(
            F.regexp_extract(p["raw"], PEEL_RE, 1),
            match_case(p["core"], p["fix"]),
            F.regexp_extract(p["raw"], PEEL_RE, 3),
        )
        return F.when(p["fix"].isNotNull() & case_allows(p["core"], cfg), fixed).otherwise(p["raw"])

    def whole(cores: Column) -> Column:
        parts = F.arrays_zip(pieces(text).alias("raw"), cores.alias("core"), fixes(cores).alias("fix"))
        return F.array_join(F.transform(parts, token), "")

    return F.when(text.isNotNull(), let(piece_cores(text), whole))


def spell_correct(
    df: DataFrame,
    dictionary: DataFrame | DictionaryIndex,
    cfg: SpellConfig | None = None,
    text: str = "text",
    out: str = "spell_corrected",
    *,
    id_cols: list[str],
) -> DataFrame:
    """Add the spelling-corrected text; ``id_cols`` are a key of ``df``.

    Words are decided once each. The words of a text are joined with the decisions, and the few
    fixes of a text come back to it as a map.
    """
    cfg = cfg or SpellConfig()
    words = materialize(speller_vocabulary(df, text, cfg), "vocabulary")
    fixes = materialize(autofixes(words, dictionary, cfg), "fixes")
    return apply_fixes(df, words, fixes, cfg, text, out, id_cols=id_cols)


def values_of_text(
    df: DataFrame, uses: DataFrame, value: str, cfg: SpellConfig, text: str, id_cols: list[str]
) -> DataFrame:
    """(ids, ``_values``): per text a map from its words to those of their values that are not NULL.

    ``uses`` holds every word of the vocabulary with its number of uses, (word, value, n): the most
    frequent words are often without a value. Only distinct words of a text are shuffled, without those.
    """
    used = df.select(
        *id_cols,
        F.explode(
            F.array_distinct(F.transform(correctable_cores(F.col(text), cfg), F.lower))
        ).alias("word"),
    )
    # Most uses are of common words without a value: at most COMMON_WORDS of them, by definition, are
    # dropped where they are.
    total = uses.agg(F.sum("n").alias("total")).scalar()
    common = F.col(value).isNull() & (F.col("n") * COMMON_WORDS > total)
    used = used.join(F.broadcast(uses.where(common).select("word")), "word", "left_anti")
    others = uses.where(~F.coalesce(common, F.lit(False)))
    return (
        lookup_join(used.select(*id_cols, "word"), others.select("word", value, "n"), "word", "n")
        .where(F.col(value).isNotNull())
        .groupBy(*id_cols)
        .agg(F.map_from_entries(F.collect_list(F.struct("word", value))).alias("_values"))
    )


def apply_fixes(
    df: DataFrame,
    words: DataFrame,
    fixes: DataFrame,
    cfg: SpellConfig,
    text: str = "text",
    out: str = "spell_corrected",
    *,
    id_cols: list[str],
) -> DataFrame:
    """Add the text with every word of ``fixes`` (word, fix) replaced, case and marks kept.

    ``words`` is the vocabulary of ``df`` by :func:`speller_vocabulary` with the same ``cfg``.
    """
    uses = materialize(words.join(fixes, "word", "left").select("word", "fix", "n"), "uses")
    joined = df.join(values_of_text(df, uses, "fix", cfg, text, id_cols), id_cols, "left")
    repaired = repair(F.col(text), lambda w, _: F.col("_values")[w], cfg)
    # Most texts have no fix and stay as they are.
    done = F.when(F.col("_values").isNull(), F.col(text)).otherwise(repaired)
    return computed_once(joined, out, done).drop("_values")


def abbreviations(
    df: DataFrame,
    table: DataFrame,
    text: str = "text",
    out: str = "expanded",
    *,
    id_cols: list[str],
) -> DataFrame:
    """Add the text with abbreviations written out; ``table`` holds (word, fix), words distinct.

    Words are matched whole and without regard to case; the case pattern and marks of the text stay.
    """
    cfg = SpellConfig(min_token_len=1, allcaps_min_len=1)
    words = materialize(speller_vocabulary(df, text, cfg), "vocabulary")
    lowered = table.select(F.lower("word").alias("word"), "fix")
    return apply_fixes(df, words, lowered, cfg, text, out, id_cols=id_cols)


def word_decisions(words: DataFrame, dictionary: DataFrame | DictionaryIndex, cfg: SpellConfig) -> DataFrame:
    """Verdict per vocabulary word: (word, n, status, fix, candidates).

    ``ok`` known; ``autofix`` a safe correction; ``suggest`` up to ``top_suggestions`` terms within
    ``max_edit_distance``; ``unknown`` nothing near.
    """
    known = terms_of(dictionary).select(F.col("term").alias("word"), F.lit(True).alias("_known"))
    flagged = words.join(known, "word", "left")
    unknown = flagged.where(F.col("_known").isNull()).select("word")
    ranked = rank_candidates(
        fuzzy_candidates(unknown, dictionary, cfg.max_edit_distance), max(cfg.top_suggestions, 2)
    )
    best = gate(ranked, cfg).select("word", "term", "autofix", "terms")
    status = (
        F.when(F.col("_known"), "ok")
        .when(F.col("term").isNull(), "unknown")
        .when(F.col("autofix"), "autofix")
        .otherwise("suggest")
    )
    return (
        flagged.join(best, "word", "left")
        .withColumn("status", status)
        .select(
            "word", "n", "status",
            F.when(F.col("status") == "autofix", F.col("term")).alias("fix"),
            F.when(
                F.col("status") == "suggest", F.slice("terms", 1, cfg.top_suggestions)
            ).alias("candidates"),
        )
    )


def token_table(
    df: DataFrame, id_cols: list[str], text: str = "text", carry: list[str] | None = None
) -> DataFrame:
    """One row per token: id, pos, kind, raw, pre, core, post. The raw pieces rebuild the text."""
    kept = [*id_cols, *(carry or [])]
    raw, word, none = F.col("raw"), F.col("kind") == "word", F.lit("")
    # A token is white space if its first character is. Most words have nothing to peel off.
    space = F.left(raw, F.lit(1)).isin(list(WS_CHARS))
    bare = F.struct(none.alias("pre"), raw.alias("core"), none.alias("post"))
    return (
        df.select(*kept, F.posexplode(tokens(F.col(text))).alias("pos", "raw"))
        .withColumn("kind", F.when(space, "space").otherwise("word"))
        .withColumn("_p", F.when(word & raw.rlike(BARE_RE), bare).when(word, peel(raw)))
        .select(*kept, "pos", "kind", "raw", "_p.pre", "_p.core", "_p.post")
    )


def in_slots(values: Column) -> Column:
    """The entries of a map by hash of their keys, as an array of small maps: a map is searched entry by
    entry, so one of all the words of a long text costs its length for each of its tokens."""

    def slots(entries: Column) -> Column:
        n = F.floor(F.size(entries) / SLOT_WORDS).cast("int") + 1
        return F.transform(
            F.sequence(F.lit(0), n - 1),
            lambda k: F.map_from_entries(F.filter(entries, lambda e: slot(e["key"], n) == k)),
        )

    return F.when(values.isNotNull(), let(F.map_entries(values), slots))


def slot(word: Column, n: Column) -> Column:
    return F.pmod(F.xxhash64(word), n.cast("long"))


def from_slots(slots: Column, word: Column) -> Column:
    """The value of ``word`` in :func:`in_slots`, or NULL."""
    return F.get(slots, slot(word, F.size(slots)).cast("int"))[word]


def analyze_tokens(
    df: DataFrame,
    dictionary: DataFrame | DictionaryIndex,
    cfg: SpellConfig | None = None,
    id_cols: list[str] | None = None,
    text: str = "text",
) -> DataFrame:
    """Token table with status, fix and candidates of every word; ``id_cols`` are a key of ``df``.

    Known words need no verdict, so only the others come back to a text, as one map. Tokens are made
    after the last shuffle.
    """
    cfg = cfg or SpellConfig()
    ids = id_cols or ["id"]
    words = materialize(speller_vocabulary(df, text, cfg), "vocabulary")
    decisions = word_decisions(words, dictionary, cfg).select(
        "word", "n",
        F.when(F.col("status") != "ok", F.struct("status", "fix", "candidates")).alias("verdict"),
    )
    decisions = materialize(decisions, "decisions")
    joined = df.join(values_of_text(df, decisions, "verdict", cfg, text, ids), ids, "left")
    joined = joined.withColumn("_slots", in_slots(F.col("_values")))
    core, slots = F.col("core"), F.col("_slots")
    looked_up = slots.isNotNull() & (F.col("kind") == "word") & is_correctable(core, cfg)
    verdict = F.when(looked_up, from_slots(slots, F.lower(core)))
    toks = token_table(joined, ids, text, ["_slots"]).withColumn("_verdict", verdict)
    # Few tokens have a fix or candidates: the case of the others is not looked at.
    fix, terms = F.col("_verdict.fix"), F.col("_verdict.candidates")
    return toks.select(
        *ids, "pos", "kind", "raw", "pre", "core", "post",
        F.when(F.col("kind") == "word", F.coalesce("_verdict.status", F.lit("ok"))).alias("status"),
        F.when(fix.isNotNull(), match_case(core, fix)).alias("fix"),
        F.when(terms.isNotNull(), F.transform(terms, lambda t: match_case(core, t))).alias("candidates"),
    )


def analyze(
    df: DataFrame,
    dictionary: DataFrame | DictionaryIndex,
    cfg: SpellConfig | None = None,
    id_cols: list[str] | None = None,
    text: str = "text",
) -> DataFrame:
    """One row per text with its whole token stream in ``tokens``."""
    ids = id_cols or ["id"]
    parts = ["pos", "kind", "raw", "pre", "core", "post", "status", "fix", "candidates"]
    streams = (
        analyze_tokens(df, dictionary, cfg, ids, text)
        .groupBy(*ids)
        .agg(F.array_sort(F.collect_list(F.struct(*parts))).alias("tokens"))
    )
    empty = F.array().cast(streams.schema["tokens"].dataType)
    kept = F.when(F.col(text).isNotNull(), F.coalesce("tokens", empty))
    return df.join(streams, ids, "left").withColumn("tokens", kept)


def apply_suggestions(
    analyzed: DataFrame, decisions: DataFrame, id_cols: list[str], out: str = "text"
) -> DataFrame:
    """Rebuild texts from a token table, putting ``decisions`` (id, pos, word) in place.

    Only the named token changes; marks around it and all other tokens stay as typed. ``decisions`` has
    one row per token at most. The tokens of a text go to it once, with its decisions behind them.
    """
    word, at = F.col("kind") == "word", F.col("pos").cast("long") * 2
    toks = analyzed.select(
        *id_cols,
        F.struct(
            at.alias("at"), F.col("raw").alias("text"), F.when(word, F.col("pre")).alias("pre"),
            F.when(word, F.col("post")).alias("post"),
        ).alias("_t"),
    )
    none = F.lit(None).cast("string")
    put = decisions.dropna(subset=[*id_cols, "pos", "word"]).select(
        *(F.col(c).cast(analyzed.schema[c].dataType).alias(c) for c in id_cols),
        F.struct((at + 1).alias("at"), F.col("word").alias("text"), none.alias("pre"), none.alias("post")).alias("_t"),
    )
    listed = (
        toks.unionByName(put).groupBy(*id_cols)
        .agg(F.array_sort(F.collect_list("_t")).alias("_l"), F.bool_or(F.col("_t.at") % 2 == 0).alias("_any"))
        .where("_any")
    )

    def piece(t: Column, i: Column) -> Column:
        after = F.get("_l", i + 1)
        chosen = F.when(after["at"] == t["at"] + 1, F.concat(t["pre"], after["text"], t["post"]))
        # The row of a decision has no piece of its own.
        return F.when(t["at"] % 2 == 0, F.coalesce(chosen, t["text"]))

    return listed.select(*id_cols, F.array_join(F.transform("_l", piece), "").alias(out))


def suggestion_summary(analyzed: DataFrame, cards: DataFrame, id_cols: list[str]) -> DataFrame:
    """Per text: number of tokens with suggestions and number of grammar cards."""
    spelling = analyzed.groupBy(*id_cols).agg(
        F.count_if(F.col("status") == "suggest").alias("n_suggest")
    )
    grammar = cards.groupBy(*id_cols).agg(F.count(F.lit(1)).alias("n_cards"))
    return spelling.join(grammar, id_cols, "left").withColumn(
        "n_cards", F.coalesce("n_cards", F.lit(0))
    )
