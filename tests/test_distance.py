import random

from pyspark.sql import functions as F

from textfix.functions.distance import deletion_keys, distance_within, edit_distance, may_be_within
from textfix.operators.fuzzy import fuzzy_candidates

TWO = "a string, b string"


def brute(a, b):
    """Textbook table with adjacent transpositions."""
    d = [[max(i, j) if 0 in (i, j) else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def test_known_distances(apply):
    rows = [("teh", "the"), ("recieve", "receive"), ("wirld", "world"), ("raghu", "right"), ("ca", "abc"), ("", "ab")]
    assert apply(edit_distance, rows, TWO) == [1, 1, 1, 2, 3, 2]


def test_distances_against_brute_force(apply):
    rng = random.Random(1)
    rows = [tuple("".join(rng.choices("abc", k=rng.randint(0, 7))) for _ in "ab") for _ in range(400)]
    want = [brute(a, b) for a, b in rows]
    assert apply(edit_distance, rows, TWO) == want
    for k in (0, 1, 2, 3):
        got = apply(lambda a, b: distance_within(a, b, k), rows, TWO)
        assert got == [w if w <= k else None for w in want]


def test_deletion_keys(apply):
    assert len(apply(lambda c: deletion_keys(c, 2), ["abcdefg"])[0]) == 1 + 7 + 21
    assert sorted(apply(lambda c: deletion_keys(c, 2), ["ab"])[0]) == ["", "a", "ab", "b"]


def test_candidates_against_all_pairs(spark):
    rng = random.Random(2)
    make = lambda n, top: sorted({"".join(rng.choices("abcd", k=rng.randint(1, top))) for _ in range(n)})
    words, terms = [*make(120, 7), "a" * 30], make(60, 7)
    vocab = spark.createDataFrame([(w,) for w in words], "word string")
    dictionary = spark.createDataFrame([(t, i) for i, t in enumerate(terms)], "term string, count long")
    for k in (1, 2):
        got = {(r["word"], r["term"], r["distance"]) for r in fuzzy_candidates(vocab, dictionary, k).collect()}
        want = {(w, t, brute(w, t)) for w in words for t in terms if brute(w, t) <= k}
        assert got == want


def test_distance_is_native(spark):
    plan = spark.range(1).select(edit_distance(F.lit("ab"), F.col("id").cast("string")))
    assert "Python" not in plan._jdf.queryExecution().toString()


def test_candidate_keys_are_not_sent_to_the_driver(spark, tmp_path):
    """A small file of words gives many keys; what Spark reads off the file says nothing about them."""
    rows = [(f"word{i}", i) for i in range(50)]
    spark.createDataFrame(rows, "term string, count long").write.parquet(str(tmp_path / "terms"))
    terms = spark.read.parquet(str(tmp_path / "terms"))
    for k in (1, 2):
        near = fuzzy_candidates(terms.select(F.concat("term", F.lit("x")).alias("word")), terms, k)
        plan = near._jdf.queryExecution().executedPlan().toString()
        assert "ShuffledHashJoin" in plan and "Broadcast" not in plan


def test_what_is_dropped_before_the_distance_is_too_far(apply):
    rng = random.Random(3)
    rows = [tuple("".join(rng.choices("abc", k=rng.randint(0, 7))) for _ in "ab") for _ in range(400)]
    for k in (0, 1, 2):
        kept = apply(lambda a, b: may_be_within(a, b, k), rows, TWO)
        assert all(may for (a, b), may in zip(rows, kept) if brute(a, b) <= k)


def test_candidates_count_plain_edits_once(spark):
    rows = [(f"word{i}", i) for i in range(50)]
    terms = spark.createDataFrame(rows, "term string, count long")
    near = fuzzy_candidates(terms.select(F.concat("term", F.lit("x")).alias("word")), terms, 2)
    plan = near._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("levenshtein(word") == 1
