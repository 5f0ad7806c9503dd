import random

import pytest
from pyspark.sql import functions as F

from textfix.operators import index as ix
from textfix.operators.fuzzy import fuzzy_candidates


def osa(a, b):
    before, row = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            best = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, before[j - 2] + 1)
            new.append(best)
        before, row = row, new
    return row[-1]


def edited(word, rng):
    chars = list(word)
    for _ in range(rng.randrange(4)):
        k, kind = rng.randrange(len(chars) + 1), rng.randrange(4)
        if kind == 0:
            chars.insert(k, rng.choice("abcdé"))
        elif kind == 1 and k < len(chars):
            del chars[k]
        elif kind == 2 and k < len(chars):
            chars[k] = rng.choice("abcdé")
        elif kind == 3 and k + 1 < len(chars):
            chars[k], chars[k + 1] = chars[k + 1], chars[k]
    return "".join(chars)


@pytest.fixture(scope="module")
def words():
    rng = random.Random(4)
    terms = {"".join(rng.choice("abcdé") for _ in range(rng.randrange(1, 26))) for _ in range(150)}
    found = {edited(t, rng) for t in terms for _ in range(4)} - {""}
    for t in sorted(terms):  # swaps across the middle, alone and with another edit
        k = len(t) // 2
        if len(t) > 3:
            swapped = t[: k - 1] + t[k] + t[k - 1] + t[k + 1 :]
            found |= {swapped, swapped[1:], swapped[:-1], "z" + swapped, swapped + "z"}
    return sorted(terms), sorted(found)


@pytest.mark.parametrize("k", [0, 1, 2])
def test_candidates_equal_brute_force_with_and_without_an_index(spark, words, k):
    terms, found = words
    want = sorted((w, t, len(t), osa(w, t)) for w in found for t in terms if osa(w, t) <= k)
    dictionary = spark.createDataFrame([(t, len(t)) for t in terms], "term string, count long").repartition(3)
    vocabulary = spark.createDataFrame([(w,) for w in found], "word string").repartition(3)
    index = ix.dictionary_index(dictionary)
    for given in (dictionary, index):
        got = fuzzy_candidates(vocabulary, given, k)
        assert sorted(map(tuple, got.collect())) == want


def test_keys_of_a_long_word_grow_with_its_length_only(spark):
    for size in (12, 30, 60):
        word = "".join(chr(97 + k % 26) for k in range(size))
        terms = spark.createDataFrame([(word, 1)], "term string, count long")
        kinds = {r["kind"]: r["n"] for r in ix.term_keys(terms, 2).groupBy("kind").agg(F.count(F.lit(1)).alias("n")).collect()}
        assert kinds == {ix.WHOLE: size + 1, ix.HALF: size + 2}
        asked = ix.word_keys(terms.select(F.col("term").alias("word")), 2, 100)
        assert 4 * size <= asked.count() <= 6 * size + 20


def test_an_index_is_only_read(spark):
    dictionary = spark.createDataFrame([("banana", 3), ("bandana", 5), ("internationally", 9)], "term string, count long")
    index = ix.dictionary_index(dictionary)
    vocabulary = spark.createDataFrame([("bananna",), ("internatoinaly",)], "word string")
    found = fuzzy_candidates(vocabulary, index, 2)
    # The keys of the words come from generators, those of the terms from a scan of the written table.
    plan = found._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.splitlines() if "textfix_keys_" in line)
    assert "Bucketed" in scan and "key" in scan
    assert {(r["word"], r["term"], r["distance"]) for r in found.collect()} == {
        ("bananna", "banana", 1), ("bananna", "bandana", 2), ("internatoinaly", "internationally", 2)
    }
    with pytest.raises(ValueError, match="serves 1"):
        fuzzy_candidates(vocabulary, ix.dictionary_index(dictionary, 1), 2)
    with pytest.raises(ValueError, match="up to 2"):
        ix.dictionary_index(dictionary, 3)


def test_empty_dictionary_and_words(spark):
    none = spark.createDataFrame([], "term string, count long")
    some = spark.createDataFrame([("ab",), ("",), (None,)], "word string")
    for given in (none, ix.dictionary_index(none)):
        assert fuzzy_candidates(some, given, 2).collect() == []


def test_a_half_common_to_many_terms_does_not_meet_all_of_them(spark):
    """Endings such as -ation are common, so only the longest terms are found by their halves."""
    rng = random.Random(5)
    made = sorted({"".join(rng.choice("abcdefgh") for _ in range(6)) + "ation" for _ in range(500)})
    terms, found = made[::2] + ["x" * 40], [edited(t, rng) for t in made[1::2]] + ["x" * 38]
    dictionary = spark.createDataFrame([(t, 1) for t in terms], "term string, count long")
    vocabulary = spark.createDataFrame([(w,) for w in sorted(set(found))], "word string")
    longest, halves_from = ix.sizes(dictionary)
    assert (longest, halves_from) == (40, 12)
    left = ix.word_keys(vocabulary, 2, longest, halves_from=halves_from)
    right = ix.term_keys(dictionary, 2, halves_from).select("kind", "key", "term")
    assert left.join(right, ["kind", "key"]).count() < len(terms) * len(set(found)) / 10
    want = sorted((w, t, 1, osa(w, t)) for w in set(found) for t in terms if osa(w, t) <= 2)
    assert sorted(map(tuple, fuzzy_candidates(vocabulary, dictionary, 2).collect())) == want


def test_few_long_terms_are_found_by_halves(spark):
    sizes = lambda *words: ix.sizes(spark.createDataFrame([(w, 1) for w in words], "term string, count long"))
    assert sizes("") == (0, ix.HALVES_FROM) and sizes("a" * 12, "b") == (12, ix.HALVES_FROM)
    many = ["".join(chr(97 + i // 26 ** k % 26) for k in range(30)) for i in range(ix.HALVES_FOR + 1)]
    assert sizes(*many, "a") == (30, ix.TWICE_TO + 1)
