import hashlib
import random

import pytest
from pyspark.sql import functions as F

from textfix.functions import edits as e
from textfix.functions.text import words
from textfix.operators import corruption as c

CLEAN = [
    "The dogs see the house.", "She likes it, don't you?", "no place here", "", "Wait", "One two three four five.",
    "a the an", "It's the end; really!", "Ünï côdé text stays.", "He saw a cat", None,
]


@pytest.mark.parametrize("kind, text, want", [
    ("article", "He saw the cat and the dog", "He saw cat and the dog"), ("article", "the cat", "the cat"),
    ("word_order", "One two three", "two One three"), ("word_order", "One, two", "One, two"),
    ("apostrophe", "We don't won't", "We dont won't"), ("agreement", "The dogs runs", "The dog runs"),
    ("punctuation", "Wait, stop. Now", "Wait, stop Now"), ("punctuation", "none", "none"),
    ("casing", "see You There", "see you There"), ("casing", "all low", "all low"),
    ("spelling", "a word here", "a wrod here"), ("spelling", "abc", "abc"), ("spacing", "two words or", "twowords or"),
])
def test_each_error(spark, kind, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(c.CORRUPTORS[kind](F.col("t"))).first()[0] == want


def test_quotas_are_exact_and_reruns_agree(spark):
    rows = [(i, CLEAN[i % len(CLEAN)]) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, text string").repartition(4)
    mix = {"apostrophe": 0.05, "article": 0.1, "word_order": 0.05, "casing": 0.3, "punctuation": 0.15}
    got = c.corrupt(df, mix, ["id"], seed=3)
    found = {r["id"]: r for r in got.collect()}
    n = sum(t is not None for _, t in rows)
    counts = {k: sum(r["kind"] == k for r in found.values()) for k in mix}
    assert counts == c.quotas(mix, n)
    for i, text in rows:
        r = found[i]
        assert r["tgt"] == text == r["text"] and (r["src"] != text) == (r["kind"] is not None)
    again = c.corrupt(df.repartition(7), mix, ["id"], seed=3)
    assert {r["id"]: (r["kind"], r["src"]) for r in again.collect()} == {i: (r["kind"], r["src"]) for i, r in found.items()}
    other = c.corrupt(df, mix, ["id"], seed=4)
    assert {r["id"]: r["kind"] for r in other.collect()} != {i: r["kind"] for i, r in found.items()}
    report = {r["kind"]: r["n"] for r in c.mix_report(got).collect()}
    assert report == counts | {None: n - sum(counts.values())}


def test_a_type_without_enough_places_takes_all(spark):
    df = spark.createDataFrame([(1, "It's"), (2, "plain"), (3, "we're"), (4, None)], "id long, text string")
    got = {r["id"]: r["kind"] for r in c.corrupt(df, {"apostrophe": 0.9}, ["id"]).collect()}
    assert got == {1: "apostrophe", 2: None, 3: "apostrophe", 4: None}
    assert c.corrupt(df.limit(0), {"apostrophe": 0.9}, ["id"]).collect() == []
    with pytest.raises(ValueError):
        c.quotas({"a": 0.7, "b": 0.4}, 10)


def test_the_nth_key_is_found_by_its_digits(spark, monkeypatch):
    monkeypatch.setattr(c, "FEW", 3)
    keys = sorted(hashlib.md5(str(i).encode()).hexdigest() for i in range(500))
    df = spark.createDataFrame([(k,) for k in keys], "key string").repartition(3)
    for n in (1, 2, 250, 499, 500):
        assert c.smallest(df, "key", n) == keys[n - 1]
    assert c.smallest(df, "key", 0) == c.NONE and c.smallest(df, "key", 501) == c.ALL


# Edits between two texts


def least_edits(a, b):
    """Cost of the cheapest alignment, cell by cell."""
    cost = [[i + j if not i or not j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            best = min(cost[i - 1][j - 1] + (a[i - 1] != b[j - 1]), cost[i - 1][j] + 1, cost[i][j - 1] + 1)
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                best = min(best, cost[i - 2][j - 2] + 1)
            cost[i][j] = best
    return cost[-1][-1]


def rebuilt(a, edits):
    out, at = [], 0
    for start, end, repl in edits:
        assert at <= start <= end <= len(a)
        out += a[at:start] + repl.split()
        at = end
    return out + a[at:]


def test_alignments_rebuild_the_text_at_the_least_cost():
    rng = random.Random(6)
    for _ in range(400):
        a = [rng.choice("uvwxyz") for _ in range(rng.randrange(12))]
        b = list(a)
        for _ in range(rng.randrange(5)):
            k = rng.randrange(len(b) + 1)
            b[k : k + rng.randrange(3)] = [rng.choice("uvwxyz") for _ in range(rng.randrange(3))]
        found = e.align(a, b)
        assert rebuilt(a, found) == b
        assert all(x[1] < y[0] for x, y in zip(found, found[1:]))  # neighbours are merged
        names = {}
        x, y = ([names.setdefault(w, len(names)) for w in side] for side in (a, b))
        steps = e._steps(x, y)
        assert len(steps) == least_edits(a, b)


def test_swaps_merges_and_large_texts(monkeypatch):
    assert e.align("a b c d".split(), "b a c d".split()) == [(0, 2, "b a")]
    assert e.align("he go to home".split(), "he goes home now".split()) == [(1, 3, "goes"), (4, 4, "now")]
    assert e.align([], ["x", "y"]) == [(0, 0, "x y")] and e.align(["x"], []) == [(0, 1, "")] and e.align([], []) == []
    rng = random.Random(1)
    a = [f"w{rng.randrange(50)}" for _ in range(600)]
    b = [w if rng.random() > 0.2 else f"v{rng.randrange(50)}" for w in a]
    monkeypatch.setattr(e, "CELLS", 2000)
    assert rebuilt(a, e.align(a, b)) == b
    assert rebuilt(a, e.align(a, ["q"] * 700)) == ["q"] * 700


def test_extracted_edits_are_applied(spark):
    rows = [(1, "he go home", "He goes home now"), (2, None, "x"), (3, "x", None), (4, "same  text", "same text"), (5, "a b", "b a"), (6, "", "")]
    df = spark.createDataFrame(rows, "id int, a string, b string").repartition(2)
    found = df.withColumn("e", e.extract_edits(F.col("a"), F.col("b")))
    back = found.withColumn("back", F.array_join(e.apply_edits(words(F.coalesce("a", F.lit(""))), F.col("e")), " "))
    for r in back.collect():
        assert r["back"] == " ".join((r["b"] or "").split())
        assert (not r["e"]) == ((r["a"] or "").split() == (r["b"] or "").split())


def test_a_text_is_split_once_to_apply_its_edits(spark):
    df = spark.createDataFrame([("a b c",)], "a string").withColumn("e", e.extract_edits(F.col("a"), F.lit("a x c")))
    plan = df.select(e.apply_edits(words(F.col("a")), F.col("e")).alias("b"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(a") == 1


def test_alignments_of_empty_sides_and_single_words():
    assert e.common_ends("a b c d".split(), "a x c d".split()) == (1, 2)
    assert e.common_ends(["a"], ["a", "a"]) == (1, 0) and e.common_ends([], ["a"]) == (0, 0)
    assert e.align("a b".split(), "a § § b".split()) == [(1, 1, "§ §")] and e.align("a b c".split(), ["a", "c"]) == [(1, 2, "")]
    assert e.align(["a"], ["b"]) == [(0, 1, "b")] and e.align(["a"], ["a"]) == []
