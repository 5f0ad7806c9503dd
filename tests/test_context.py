"""Spelling that reads the word before a use, against a plain program and by hand."""

from collections import Counter
from dataclasses import replace

import pytest

from textfix.config import SpellConfig
from textfix.operators.context import context_fixes, spell_correct_context
from textfix.operators.spelling import spell_correct
from textfix.operators.training import bigram_counts

CFG = SpellConfig(min_suggestion_count=10, dominance_ratio=2.0, min_context_count=3)
TERMS = [("cat", 50), ("cut", 40), ("cot", 9), ("the", 900), ("paper", 60), ("receive", 80), ("black", 70)]
SEEN = "the cat " * 5 + "paper cut " * 4 + "black cat black cut "
TEXTS = [
    (1, "the ct, paper ct; black ct! ct"),
    (2, "  THE «Ct» paper\n CT paper-ct 12 ct I recieve the ct"),
    (3, "ct the 12 ct"),
    (4, ""),
    (5, None),
    (6, "the the cat"),
    (7, "the Ctt teh ct"),
]


@pytest.fixture(scope="module")
def terms(spark):
    return spark.createDataFrame(TERMS, "term string, count long")


@pytest.fixture(scope="module")
def bigrams(spark):
    return bigram_counts(spark.createDataFrame([(SEEN,)], "text string"))


def corrected(df, terms, bigrams, cfg=CFG):
    done = spell_correct_context(df, terms, bigrams, cfg, id_cols=["id"])
    assert done.columns == [*df.columns, "spell_corrected"]
    return {r["id"]: r["spell_corrected"] for r in done.collect()}


def test_each_use_by_the_word_before_it(spark, terms, bigrams):
    df = spark.createDataFrame(TEXTS, "id long, text string")
    got = corrected(df, terms, bigrams, replace(CFG, min_token_len=2))
    # After "black" both terms are as frequent; after "ct" neither was seen.
    assert got[1] == "the cat, paper cut; black ct! ct"
    # Capitals of two letters are too short, and "12" is no plain word.
    assert got[2] == "  THE «Cat» paper\n CT paper-ct 12 ct I receive the cat"
    assert [got[k] for k in (3, 4, 5, 6)] == [TEXTS[2][1], "", None, TEXTS[5][1]]
    # The word before is read as typed: "teh" was never seen before "cat".
    assert got[7] == "the Cat the ct"
    # Words of two letters are left alone by default, as spell_correct does.
    assert corrected(df, terms, bigrams)[1] == TEXTS[0][1]


def test_without_context_it_is_spell_correct(spark, terms, bigrams):
    df = spark.createDataFrame(TEXTS, "id long, text string")
    plain = {r["id"]: r["spell_corrected"] for r in spell_correct(df, terms, CFG, id_cols=["id"]).collect()}
    assert corrected(df, terms, bigrams.where("false")) == plain
    never = replace(CFG, min_context_count=10**9)
    assert corrected(df, terms, bigrams, never) == plain
    assert corrected(df.where("false"), terms, bigrams) == {}


def test_against_a_plain_program(spark, terms, bigrams):
    words = "the paper black cat cut ct cxt ca x recieve".split()
    rows = [(i, " ".join(words[(i * 7 + j * (3 + i % 5)) % len(words)] for j in range(12))) for i in range(60)]
    seen = Counter(zip(SEEN.split(), SEEN.split()[1:], strict=False))
    # Terms at one edit with a count of ten or more; "ca" and "ct" have two letters, so they stay.
    near = {"cxt": ["cat", "cut"]}

    def fix(before, word):
        if word == "recieve":
            return "receive"
        ranked = sorted(((seen[(before, t)], t) for t in near.get(word, [])), reverse=True)
        if ranked and ranked[0][0] >= 3 and ranked[0][0] >= 2 * ranked[1][0]:
            return ranked[0][1]
        return word

    want = {}
    for key, text in rows:
        parts = text.split()
        want[key] = " ".join(fix(b, w) for b, w in zip(["", *parts], parts, strict=False))
    df = spark.createDataFrame(rows, "id long, text string").repartition(5)
    assert corrected(df, terms, bigrams) == want
    assert any("cut" in want[k].split() and "cxt" in t.split() for k, t in rows)


def test_a_use_may_be_most_of_the_text(spark, terms, bigrams):
    rows = [(i, "the cxt " * 40 + f"paper cxt w{i}") for i in range(300)]
    df = spark.createDataFrame(rows, "id long, text string")
    assert corrected(df, terms, bigrams) == {i: "the cat " * 40 + f"paper cut w{i}" for i, _ in rows}


def test_every_context_has_a_row(spark, bigrams):
    contexts = spark.createDataFrame(
        [("the", "ct", 7), ("black", "ct", 1), ("none", "ct", 2)], "prev string, word string, n long"
    )
    open_terms = spark.createDataFrame(
        [("ct", [("cat", 50), ("cut", 40)])], "word string, terms array<struct<term:string,count:bigint>>"
    )
    got = {(r["prev"], r["n"], r["fix"]) for r in context_fixes(contexts, open_terms, bigrams, CFG).collect()}
    assert got == {("the", 7, "cat"), ("black", 1, None), ("none", 2, None)}
