import math

import pytest
from pyspark.sql import functions as F

from textfix.operators import spelling
from textfix.operators import training as tr


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=str)


def test_decontaminate_by_normal_form(spark):
    train = spark.createDataFrame(
        [(1, "A  cat."), (2, "a dog"), (3, None), (4, "a cat"), (5, "a cat here")], "id int, src string"
    )
    held = spark.createDataFrame([("a CAT!",), ("a CAT!",), ("x",)], "src string")
    assert rows(tr.decontaminate(train, held), "id") == [(2,), (3,), (5,)]
    blank = spark.createDataFrame([("",)], "src string")
    assert rows(tr.decontaminate(train, blank), "id") == [(1,), (2,), (4,), (5,)]
    assert tr.decontaminate(train, held.limit(0)).count() == 5
    assert tr.decontaminate(train.limit(0), held).count() == 0


def test_decontaminate_one_text_in_most_rows(spark):
    train = spark.range(5000).select(
        "id", F.when(F.col("id") % 3 > 0, "same").otherwise(F.col("id").cast("string")).alias("src")
    )
    held = spark.createDataFrame([("3",)], "src string")
    assert tr.decontaminate(train, held).count() == 4999


def test_length_cap(spark):
    pairs = spark.createDataFrame(
        [("a\t b", "c  d e"), ("a b c d", "a"), ("a", "a b c d"), (None, "a"), ("", "")], "src string, tgt string"
    )
    assert rows(tr.length_cap(pairs, 3), "src", "tgt") == [("", ""), ("a b", "c d e")]


def test_identity_mix_share_and_nesting(spark):
    pairs = spark.createDataFrame([(f"s{i}", f"t{i}") for i in range(70)], "src string, tgt string")
    clean = spark.createDataFrame([(f"c{i % 200}",) for i in range(300)] + [(None,)], "src string")
    small, large = (rows(tr.identity_mix(pairs, clean, s), "src", "tgt") for s in (0.3, 0.5))
    assert len(small) == 100 and len(large) == 140
    same = [r for r in small if r[0] == r[1]]
    assert len(same) == 30 and set(same) <= set(large)
    assert rows(tr.identity_mix(pairs, clean, 0.0), "src", "tgt") == rows(pairs, "src", "tgt")
    assert tr.identity_mix(pairs, clean.limit(0), 0.5).count() == 70
    with pytest.raises(ValueError):
        tr.identity_mix(pairs, clean, 1.0)


SCORES = [(0.9, True), (0.9, False), (0.5, True), (0.2, None), (None, True), (math.nan, True)]


def test_confidence(spark):
    edits = spark.createDataFrame(SCORES, "score double, correct boolean")
    got = rows(tr.confidence_curve(edits, [0.5, 0.0, 0.95, 0.9]), "threshold", "kept", "right", "precision", "coverage")
    assert got == [
        (0.0, 4, 2, 0.5, 4 / 6), (0.5, 3, 2, 2 / 3, 0.5), (0.9, 2, 1, 0.5, 2 / 6), (0.95, 0, 0, None, 0.0),
    ]
    assert tr.confidence_gate(edits, 0.5).count() == 3
    empty = rows(tr.confidence_curve(edits.limit(0), [0.5]), "kept", "precision", "coverage")
    assert empty == [(0, None, None)]


def test_f_score(spark):
    schema = "id int, start int, end int, repl string"
    gold = spark.createDataFrame([(1, 0, 1, "a"), (1, 2, 3, None), (2, 0, 1, "a")], schema)
    pred = spark.createDataFrame([(1, 0, 1, "a"), (1, 0, 1, "a"), (1, 2, 3, None), (2, 0, 1, "b")], schema)
    got = tr.f_score(pred, gold, ["id"]).first()
    assert (got["tp"], got["fp"], got["fn"]) == (2, 1, 1)
    assert got["f"] == pytest.approx(2 / 3)
    none = tr.f_score(pred.limit(0), gold, ["id"]).first()
    assert (none["precision"], none["recall"]) == (1.0, 0.0)
    assert tr.f_score(pred.limit(0), gold.limit(0), ["id"]).first()["f"] == 1.0


def gleu_of(spark, *texts):
    df = spark.createDataFrame([(i, *t) for i, t in enumerate(texts)], "id int, s string, r string, c string")
    return tr.gleu(df, ["id"], "s", "r", "c").first()


def test_gleu(spark):
    assert gleu_of(spark, ("a b c d e", "a b x d e", "a b x d e"))["gleu"] == pytest.approx(1.0)
    # Nothing changed: what the source alone shares counts against the answer.
    got = gleu_of(spark, ("a b c d e f", "a b c d e x", "a b c d e f"))
    assert [got[f"p{n}"] for n in range(1, 5)] == pytest.approx([4 / 6, 3 / 5, 2 / 4, 1 / 3])
    short = gleu_of(spark, ("a b c d e", "a b c d e", "a b c d"))
    assert short["gleu"] == pytest.approx(math.exp(1 - 5 / 4))
    # Repeated words are clipped by the reference.
    assert gleu_of(spark, ("z", "a b", "a a a"))["p1"] == pytest.approx(1 / 3)
    blank = gleu_of(spark, (None, None, ""))
    assert (blank["c"], blank["r"], blank["gleu"]) == (0, 0, 0.0)


def test_abbreviations(spark):
    df = spark.createDataFrame([(1, "Pls, (asap) plss x"), (2, None), (3, ""), (4, "PLS pls")], "id int, text string")
    table = spark.createDataFrame([("pls", "please"), ("ASAP", "at once"), ("X", "times")], "word string, fix string")
    got = rows(spelling.abbreviations(df, table, id_cols=["id"]), "id", "expanded")
    assert got == [(1, "Please, (at once) plss times"), (2, None), (3, ""), (4, "PLEASE please")]


def test_name_policy(spark):
    uses = spark.createDataFrame([("Anna", 2), ("Table", 1), ("anna", 1), ("ÉVA", 1)], "core string, n int")
    names = spark.createDataFrame([("anna",), ("Anna",), ("Éva",), (None,)], "name string")
    assert rows(tr.name_policy(uses, names), "core", "policy") == [
        ("Anna", "keep"), ("Table", "eligible"), ("anna", "plain"), ("ÉVA", "keep")
    ]


def test_bigrams(spark):
    texts = spark.createDataFrame([("The cat sat, the Cat",), ("one",), ("",), (None,)], "text string")
    counts = tr.bigram_counts(texts)
    assert rows(counts, "prev", "word", "n") == [("cat", "sat", 1), ("sat", "the", 1), ("the", "cat", 2)]
    contexts = spark.createDataFrame([("the", "ct"), ("a", "ct")], "prev string, word string")
    near = spark.createDataFrame(
        [("ct", "cut", 9, 1), ("ct", "cat", 5, 1), ("ct", "cart", 99, 2)],
        "word string, term string, count long, distance int",
    )
    got = rows(tr.bigram_rerank(contexts, near, counts), "prev", "word", "term", "seen")
    assert got == [("a", "ct", "cut", 0), ("the", "ct", "cat", 2)]


def test_gleu_counts_grams_where_the_text_lies(spark):
    df = spark.createDataFrame([(1, "a b a b", "a b a", "a b b a")], "id int, s string, r string, c string")
    plan = tr.gleu(df, ["id"], "s", "r", "c")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and plan.count("ArrowEvalPython") == 1


def test_a_text_is_searched_once_for_its_neighbours(spark):
    texts = spark.createDataFrame([("The cat, the CAT the",), ("alone",), ("",), (None,), ("1 2",)], "text string")
    counts = tr.bigram_counts(texts)
    assert rows(counts, "prev", "word", "n") == [("cat", "the", 2), ("the", "cat", 2)]
    plan = counts._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1


def test_identity_mix_makes_its_pairs_once(spark):
    calls = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            calls.add(len(batch))
            yield batch

    pairs = spark.range(40).selectExpr("concat('s', id) AS src", "'t' AS tgt").mapInPandas(seen, "src string, tgt string")
    clean = spark.range(40).selectExpr("concat('c', id) AS src")
    assert tr.identity_mix(pairs, clean, 0.5).count() == 80 and calls.value == 40
