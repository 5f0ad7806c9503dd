import random

import pytest
from pyspark.sql import functions as F

from textfix.config import SpellConfig
from textfix.functions.text import is_space, peel, plain_core
from textfix.operators import spelling
from textfix.operators.dictionary import merge_dictionaries, unknown_words, word_frequencies
from textfix.operators.spelling import (
    analyze,
    analyze_tokens,
    apply_suggestions,
    spell_correct,
    suggestion_summary,
)

TERMS = [
    ("the", 23_000_000_000), ("receive", 90_000_000), ("receiver", 1_000_000), ("cup", 50_000_000),
    ("zip", 60_000_000), ("clip", 20_000_000), ("right", 900_000_000), ("site", 500_000_000),
    ("note", 400_000_000), ("night", 300_000_000), ("rare", 9_999_999), ("a", 10**10),
]
TEXTS = [
    (1, "teh Teh TEH «teh», I recieve RECIEVE recieves"),
    (2, "cip nite raghu rarr xqzzzz the"),
    (3, ""),
    (4, None),
    (5, "  a@b.com teh2 well-teh\n"),
]


@pytest.fixture(scope="module")
def terms(spark):
    return spark.createDataFrame(TERMS, "term string, count long")


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame(TEXTS, "id long, text string")


def corrected(df, terms, cfg=None):
    out = spell_correct(df, terms, cfg, id_cols=["id"]).select("id", "spell_corrected").collect()
    return {r["id"]: r["spell_corrected"] for r in out}


def test_spell_correct(texts, terms):
    assert corrected(texts, terms) == {
        # Short all-capitals stay; a long one is corrected. "recieves" is two edits from anything.
        1: "the The TEH «the», I receive RECEIVE recieves",
        # cip: zip and cup tie too closely. raghu: two edits. rarr: target too rare.
        2: "cip nite raghu rarr xqzzzz the",
        3: "",
        4: None,
        5: "  a@b.com teh2 well-teh\n",
    }


def test_partitions_do_not_matter(texts, terms):
    assert corrected(texts.repartition(8), terms) == corrected(texts.coalesce(1), terms)


def test_correction_is_stable(texts, terms):
    once = spell_correct(texts, terms, id_cols=["id"]).select("id", F.col("spell_corrected").alias("text"))
    assert corrected(once, terms) == {r["id"]: r["text"] for r in once.collect()}


def test_thresholds(texts, terms):
    loose = SpellConfig(dominance_ratio=1.0, min_suggestion_count=1, autocorrect_max_distance=2)
    assert corrected(texts, terms, loose)[2] == "zip site right rare xqzzzz the"
    none = SpellConfig(autocorrect_max_distance=0)
    assert corrected(texts.where("id = 1"), terms, none)[1] == TEXTS[0][1]
    proper = SpellConfig(correct_capitalized=False)
    assert corrected(texts, terms, proper)[1].startswith("the Teh TEH «the»,")


def test_analyze(texts, terms):
    rows = {r["id"]: r["tokens"] for r in analyze(texts, terms).collect()}
    assert rows[4] is None and rows[3] == []
    for key, text in TEXTS:
        if text:
            assert "".join(t["raw"] for t in rows[key]) == text
    by_core = {t["core"]: t for r in (rows[1], rows[2]) for t in r if t["kind"] == "word"}
    assert by_core["the"]["status"] == "ok"
    assert (by_core["Teh"]["status"], by_core["Teh"]["fix"]) == ("autofix", "The")
    assert by_core["TEH"]["status"] == "ok"
    assert by_core["RECIEVE"]["fix"] == "RECEIVE"
    assert by_core["cip"]["candidates"] == ["zip", "cup", "clip"]
    assert by_core["nite"]["candidates"] == ["site", "note"]
    assert by_core["raghu"]["candidates"] == ["right"]
    assert by_core["xqzzzz"]["status"] == "unknown"
    assert by_core["recieves"]["candidates"] == ["receive", "receiver"]


def test_at_most_six_suggestions(spark, texts):
    many = spark.createDataFrame([(c + "ip", n + 1) for n, c in enumerate("bdhlnrstw")], "term string, count long")
    toks = analyze_tokens(texts, many, id_cols=["id"]).where("core = 'cip'").first()
    assert toks["candidates"] == ["wip", "tip", "sip", "rip", "nip", "lip"]


def test_apply_suggestions(spark, texts, terms):
    analyzed = analyze_tokens(texts, terms, id_cols=["id"])
    chosen = spark.createDataFrame([(2, 0, "zip"), (2, 4, "right"), (1, 1, "gone")], "id long, pos int, word string")
    out = {r["id"]: r["text"] for r in apply_suggestions(analyzed, chosen, ["id"]).collect()}
    assert out[2] == "zip nite right rarr xqzzzz the"
    assert out[1] == TEXTS[0][1]
    cards = spark.createDataFrame([(2,), (2,)], "id long")
    found = {r["id"]: (r["n_suggest"], r["n_cards"]) for r in suggestion_summary(analyzed, cards, ["id"]).collect()}
    assert found[2] == (4, 2) and found[1] == (1, 0)


def test_one_word_may_be_most_of_the_text(spark, terms):
    rows = [(i, "teh cip " * 50 + f"w{chr(97 + i % 26)}xyz") for i in range(200)]
    df = spark.createDataFrame(rows, "id long, text string")
    assert set(corrected(df, terms, SpellConfig())) == set(range(200))
    statuses = analyze_tokens(df, terms, id_cols=["id"]).groupBy("core", "status").count().collect()
    counts = {(r["core"], r["status"]): r["count"] for r in statuses}
    assert counts[("teh", "autofix")] == 10_000 and counts[("cip", "suggest")] == 10_000


def test_dictionaries(spark):
    df = spark.createDataFrame([("The cat. the «CAT» x1 a",), ("cat",), (None,)], "text string")
    counts = {r["term"]: r["count"] for r in word_frequencies(df).collect()}
    assert counts == {"the": 2, "cat": 3, "a": 1}
    assert {r["term"] for r in word_frequencies(df, min_count=3).collect()} == {"cat"}
    own = word_frequencies(df)
    extra = spark.createDataFrame([("cat", 4), ("demra", 1)], "term string, count int")
    merged = {r["term"]: r["count"] for r in merge_dictionaries(own, extra).collect()}
    assert merged == {"the": 2, "cat": 7, "a": 1, "demra": 1}
    words = spark.createDataFrame([("demra",), ("raghu",)], "word string")
    allowed = merge_dictionaries(own, extra)
    assert [r["word"] for r in unknown_words(words, allowed).collect()] == ["raghu"]


def test_cores_of_all_pieces_by_one_search(spark):
    rng = random.Random(3)
    bits = ["a", "Don't", "x-y", "'", "-", "«", "»", ",", "(", "_", "1", "é", " ", "  ", "\n", "\u00a0", "\u2003", "§", "😀", "-a"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(14))) for _ in range(600)]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(2)
    cores = F.transform(spelling.pieces(F.col("text")), plain_core)
    rows = df.select(spelling.piece_cores(F.col("text")).alias("got"), cores.alias("want")).collect()
    assert len(rows) == 600 and all(r["got"] == r["want"] for r in rows)
    assert sum(c != "" for r in rows for c in r["want"]) > 200


def test_texts_without_a_fix_stay_as_they_are(spark):
    df = spark.createDataFrame([(1, "teh cat", {"teh": "the"}), (2, "teh cat", None)], "id int, text string, _values map<string,string>")
    words = spark.createDataFrame([("teh", 1), ("cat", 1)], "word string, n long")
    fixes = spark.createDataFrame([("teh", "the")], "word string, fix string")
    done = spelling.apply_fixes(df.drop("_values"), words, fixes, SpellConfig(), id_cols=["id"])
    plan = done._jdf.queryExecution().optimizedPlan().toString()
    assert "CASE WHEN isnull(_values" in plan
    assert {r["spell_corrected"] for r in done.collect()} == {"the cat"}


def test_words_of_a_long_text_are_searched_in_small_parts(spark):
    words = [f"w{i}" for i in range(300)]
    rows = [(1, {w: w + "!" for w in words}), (2, {}), (3, None), (4, {"w1": None})]
    df = spark.createDataFrame(rows, "id int, v map<string,string>").withColumn("s", spelling.in_slots(F.col("v")))
    sizes = {r["id"]: r["n"] for r in df.select("id", F.transform("s", F.size).alias("n")).collect()}
    assert sum(sizes[1]) == 300 and max(sizes[1]) <= 4 * spelling.SLOT_WORDS and sizes[3] is None
    asked = df.select("id", "s", F.explode(F.array(*map(F.lit, [*words, "x"]))).alias("w"))
    got = {(r["id"], r["w"]): r["f"] for r in asked.select("id", "w", spelling.from_slots(F.col("s"), F.col("w")).alias("f")).collect()}
    assert got == {(i, w): (v or {}).get(w) for i, v in rows for w in [*words, "x"]}


def test_tokens_without_marks_are_not_peeled(spark):
    rng = random.Random(6)
    bits = ["ab", "Don't", "x-y", "'", "«", ",", "(", "_", "12", "é", " ", "\n", " ", " ", "§", "😀"]
    texts = [(i, "".join(rng.choice(bits) for _ in range(rng.randrange(12)))) for i in range(400)]
    toks = spelling.token_table(spark.createDataFrame(texts, "id int, text string").repartition(2), ["id"])
    peeled = toks.select("*", peel(F.col("raw")).alias("p"), is_space(F.col("raw")).alias("space")).collect()
    for r in peeled:
        assert (r["kind"] == "space") == r["space"]
        assert (r["pre"], r["core"], r["post"]) == ((None,) * 3 if r["space"] else tuple(r["p"]))
    # Only words that are not letters and digits throughout go through the patterns.
    plan = toks._jdf.queryExecution().optimizedPlan().toString()
    assert "^[A-Za-z0-9_]++" in plan


def test_applying_suggestions_shuffles_the_tokens_once(spark):
    tokens = [(i, p, "space" if p % 2 else "word", " " if p % 2 else f"({i}w{p})") for i in range(300) for p in range(9)]
    part = lambda at: F.when(F.col("kind") == "word", F.substring("raw", *at))
    analyzed = spark.createDataFrame(tokens, "id int, pos int, kind string, raw string").select(
        "*", part((1, 1)).alias("pre"), part((-1, 1)).alias("post")
    )
    rows = [(i, p, f"n{p}") for i in range(0, 300, 3) for p in (0, 1, 8)] + [(5, 2, None), (999, 0, "gone"), (None, 0, "x")]
    chosen = spark.createDataFrame(rows, "id long, pos long, word string")
    done = apply_suggestions(analyzed, chosen, ["id"])
    plan = done._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
    put = {(i, p): w for i, p, w in rows if w}
    pieces = lambda i: (f"({put[i, p]})" if (i, p) in put and p % 2 == 0 else raw for j, p, _, raw in tokens if j == i)
    assert {r["id"]: r["text"] for r in done.collect()} == {i: "".join(pieces(i)) for i in range(300)}


def test_common_words_without_a_value_are_not_shuffled(spark):
    df = spark.createDataFrame([(i, f"the cat teh w{chr(97 + i % 26)}x") for i in range(60)], "id long, text string")
    uses = spark.createDataFrame(
        [("the", None, 60), ("cat", None, 60), ("teh", "the", 60)] + [(f"w{chr(97 + i)}x", None, 2) for i in range(26)],
        "word string, fix string, n long",
    )
    found = spelling.values_of_text(df, uses, "fix", SpellConfig(), "text", ["id"])
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert f"* {spelling.COMMON_WORDS})" in plan and plan.count("LeftAnti") >= 2
    assert {r["id"]: r["_values"] for r in found.collect()} == {i: {"teh": "the"} for i in range(60)}
