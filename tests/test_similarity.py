import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from textfix.functions import similarity as s

TWO = "a string, b string"


@pytest.fixture
def added(spark):
    """Run one of the functions that add a column of a pair of texts."""

    def run(fn, rows, **options):
        numbered = [(i, *r) for i, r in enumerate(rows)]
        df = spark.createDataFrame(numbered, f"i int, {TWO}").repartition(3)
        out = fn(df, "out", F.col("a"), F.col("b"), **options)
        return [r["out"] for r in out.orderBy("i").collect()]

    return run


def texts(n, top, seed, alphabet="abcde  "):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        a = "".join(rng.choices(alphabet, k=rng.randint(0, top)))
        b = list(a)
        for _ in range(rng.randint(0, 6)):
            at = rng.randint(0, len(b))
            b[at:at + rng.randint(0, 2)] = rng.choices(alphabet, k=rng.randint(0, 3))
        out.append((a, "".join(b)))
    return out


def test_ratio_is_difflib(added):
    rows = texts(150, 60, 1) + texts(60, 400, 2) + [("", ""), ("a", ""), ("", "b"), ("ab", "abab")]
    rows += [(b, a) for a, b in rows]
    for junk in (True, False):
        got = added(s.with_ratio, rows, autojunk=junk)
        assert got == [SequenceMatcher(None, a, b, junk).ratio() for a, b in rows]


def test_ratio_of_missing_text(added):
    assert added(s.with_ratio, [(None, "a"), (None, None)]) == [0.0, 1.0]


def test_contained_long_text_needs_the_udf(added):
    base = "ab" * 150
    rows = [("x" + base, base), (base + "x", base)]
    assert added(s.with_ratio, rows) == [SequenceMatcher(None, a, b).ratio() for a, b in rows]


def test_one_text_at_the_start_of_the_other(added):
    rng = random.Random(8)
    rows = []
    for alphabet in ("ab", "abcdef gh", "abcdefghijklmnopqrstuvwxyz0123456789 .,"):
        for n in (1, 150, 199, 200, 260, 700):
            base = "".join(rng.choices(alphabet, k=n))
            more = base + "".join(rng.choices(alphabet + "#", k=rng.randint(1, n)))
            rows += [(base, more), (more, base)]
    assert added(s.with_ratio, rows) == [SequenceMatcher(None, a, b).ratio() for a, b in rows]


def test_bound_holds(apply):
    rows = texts(150, 40, 3)
    bounds = apply(s.ratio_bound, rows, TWO)
    assert all(SequenceMatcher(None, a, b).ratio() <= x + 1e-12 for (a, b), x in zip(rows, bounds))


def test_word_edits(apply):
    cases = [
        ("a b c", "a b c", 0), ("a b c", "a x c", 1), ("a b c", "a c", 1), ("a c", "a b b c", 2),
        ("a b c", "x a b c", 1), ("a b c d", "a x y z d", 3), ("", "a b", 2), ("a b", "", 2), ("", "", 0),
        ("one two three", "four five", 3), ("a b c d e", "a c e", 2), ("A b", "a b", 1),
    ]
    assert apply(s.word_edits, [c[:2] for c in cases], TWO) == [c[2] for c in cases]


def test_word_diff(apply):
    cases = [
        ("a b c", "a B c", [("a", False), ("B", False), ("c", False)]),
        ("a b c", "a x c", [("a", False), ("x", True), ("c", False)]),
        ("a c", "a b c d", [("a", False), ("b", True), ("c", False), ("d", True)]),
        ("a b c", "c", [("c", False)]),
        ("", "A", [("A", True)]),
        ("x y", "", []),
        ("The cat", "the CAT sat", [("the", False), ("CAT", False), ("sat", True)]),
    ]
    assert apply(s.word_diff, [c[:2] for c in cases], TWO) == [c[2] for c in cases]


def test_meaning(added):
    rows = [
        ("I do know", "I do not know"), ("I has a cat", "I have a cat"), ("short", "entirely else"),
        ("Same", "same"), ("a" * 30, "a" * 5), (None, "a"),
    ]
    assert added(s.with_meaning, rows) == [False, True, False, True, False, None]
    rows = texts(100, 50, 6)
    want = [SequenceMatcher(None, a, b).ratio() >= 0.6 for a, b in rows]
    assert added(s.with_meaning, rows) == want


def test_matcher_gives_the_results_of_difflib():
    rng = random.Random(7)
    for size, alphabet in ((40, "ab"), (40, "abcdefgh "), (450, "abcdefghijklmnopqrstuvwxyz    ,.éü§0123")):
        for _ in range(200):
            a = "".join(rng.choice(alphabet) for _ in range(rng.randrange(size)))
            chars = list(a)
            for _ in range(rng.randrange(30)):
                k = rng.randrange(len(chars) + 1)
                chars[k : k + rng.randrange(3)] = [rng.choice(alphabet) for _ in range(rng.randrange(3))]
            b = "".join(chars)
            for autojunk in (True, False):
                for x, y in ((a, b), (b, a)):
                    want = SequenceMatcher(None, x, y, autojunk).ratio()
                    assert s.Matcher(y, autojunk).ratio(x) == want
    matcher = s.Matcher("abcd" * 600)  # beyond the size that is compared by bits
    for x in ("", "bcda" * 700, "abcd" * 600):
        assert matcher.ratio(x) == SequenceMatcher(None, x, "abcd" * 600).ratio()


def test_several_answers_against_one_text(spark):
    rows = [(1, "kitten", "sitting", "kitten", None), (2, None, "a", "", "b"), (3, "same", "same", "same", "same")]
    df = spark.createDataFrame(rows, "id int, gold string, x string, y string, z string").repartition(2)
    got = s.with_ratios(df, {"rx": F.col("x"), "ry": F.col("y"), "rz": F.col("z")}, F.col("gold"))
    assert got.columns == [*df.columns, "rx", "ry", "rz"]
    for r in got.collect():
        want = [SequenceMatcher(None, r[c] or "", r["gold"] or "").ratio() for c in ("x", "y", "z")]
        assert [r["rx"], r["ry"], r["rz"]] == want


def test_new_words_as_difflib_matches():
    rng = random.Random(11)
    for size, letters in ((8, "ab"), (12, "abcdefgh"), (30, "abcdefghijklmnopqrst"), (260, "abcdefghijklmnopqrstuvwxyz0123456789")):
        for _ in range(1500):
            a = [rng.choice(letters) for _ in range(rng.randrange(size))]
            b = list(a)
            for _ in range(rng.choice((1, 1, 1, 2))):
                k = rng.randrange(len(b) + 1)
                b[k : k + rng.randrange(3)] = [rng.choice(letters + "§§§§") for _ in range(rng.randrange(4))]
            for x, y in ((a, b), (b, a)):
                blocks = SequenceMatcher(None, x, y).get_matching_blocks()
                kept = {j for _, start, n in blocks for j in range(start, start + n)}
                assert s._new_words(x, y) == [j not in kept for j in range(len(y))]


def test_usual_changes_need_no_matcher(monkeypatch):
    monkeypatch.delattr(s, "SequenceMatcher")
    for a, b, new in (
        ("the cat the dog", "the cat § the dog", [3]), ("a b c", "a x c", [2]), ("a b " * 150, "a b " * 150 + "a", [301]),
        ("a b c", "b c", []), ("", "a", [1]),
    ):
        flags = s._new_words(a.split(), b.split())
        assert [i + 1 for i, f in enumerate(flags) if f] == new


def test_ratio_of_texts_with_common_ends(monkeypatch):
    rng = random.Random(12)
    for size, letters in ((6, "ab"), (12, "abcdef"), (40, "abcdefghijklmnopqrst .")):
        for _ in range(3000):
            a = "".join(rng.choice(letters) for _ in range(rng.randrange(size)))
            k = rng.randrange(len(a) + 1)
            b = a[:k] + "".join(rng.choice(letters + "!!!") for _ in range(rng.randrange(3))) + a[k + rng.randrange(3) :]
            for x, y in ((a, b), (b, a)):
                for junk in (True, False):
                    assert s.Matcher(y, junk).ratio(x) == SequenceMatcher(None, x, y, junk).ratio()
    monkeypatch.delattr(s.Matcher, "_longest")
    assert s.Matcher("The cat sat!").ratio("The cat sat.") == 22 / 24
