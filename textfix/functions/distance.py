"""Edit distance with adjacent transpositions, and the keys that make it joinable."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textfix.functions.text import let


def without_char(word: Column, i: Column) -> Column:
    return F.concat(F.left(word, i - 1), F.substr(word, i + 1))


def places(first: Column, last: Column) -> Column:
    """first..last, or no element if that is empty."""
    return F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))


def deletion_keys(word: Column, k: int) -> Column:
    """The word and every string left after deleting up to ``k`` characters.

    Two words within ``k`` edits (transpositions included) share at least one key.
    """

    def shorter(text: Column, start: Column, left: int) -> Column:
        """``text`` and what deleting up to ``left`` characters from ``start`` on leaves."""
        kept = F.array(text)
        if left == 0:
            return kept
        deeper = F.transform(
            places(start, F.length(text)), lambda i: shorter(without_char(text, i), i, left - 1)
        )
        return F.concat(kept, F.flatten(deeper))

    return F.array_distinct(shorter(word, F.lit(1), k))


def with_deletion_key(df: DataFrame, word: str, k: int, key: str = "_key") -> DataFrame:
    """One row per deletion key of ``word``, hashed to 64 bits.

    The same strings as :func:`deletion_keys`, made by plain generators, which Spark compiles. A
    string reached by deleting either of two equal neighbours comes more than once.
    """
    done = F.lit(1 << 30)
    rows = df.withColumns({"_text": F.col(word), "_from": F.lit(1)})
    for _ in range(k):
        cuts = F.concat(F.array(F.lit(0)), places(F.col("_from"), F.length("_text")))
        rows = rows.withColumn("_cut", F.explode(cuts))
        kept = F.col("_cut") == 0
        rows = rows.withColumns(
            {
                "_text": F.when(kept, F.col("_text")).otherwise(without_char(F.col("_text"), F.col("_cut"))),
                "_from": F.when(kept, done).otherwise(F.col("_cut")),
            }
        )
    return rows.withColumn(key, F.xxhash64("_text")).drop("_text", "_from", "_cut")


def _swapped(word: Column, i: Column) -> Column:
    """``word`` with its characters ``i`` and ``i + 1`` exchanged."""
    one = F.lit(1)
    return F.concat(
        F.left(word, i - 1), F.substr(word, i + 1, one), F.substr(word, i, one), F.substr(word, i + 2)
    )


def _foreign(a: Column, b: Column) -> Column:
    """Number of characters of ``a`` that ``b`` does not have."""
    return F.length(F.call_function("translate", a, b, F.lit("")))


def _some_swap(a: Column, b: Column, limit: int) -> Column:
    """Does a swap of neighbours in ``a`` leave at most ``limit`` plain edits to ``b``?"""
    return F.exists(
        places(F.lit(1), F.length(a) - 1), lambda i: F.levenshtein(_swapped(a, i), b, limit) >= 0
    )


def apart(a: Column, b: Column) -> Column:
    """At least so many of the edits between the words are no swaps, which keep the characters."""
    return F.greatest(_foreign(a, b), _foreign(b, a))


def edit_distance(a: Column, b: Column) -> Column:
    """Insertions, deletions, substitutions and swaps of neighbours, each character used once."""

    def table(chars_a: Column, chars_b: Column) -> Column:
        width = F.size(chars_b)

        def next_row(state: Column, i: Column) -> Column:
            prev, prev2 = state["prev"], state["prev2"]

            def next_cell(row: Column, j: Column) -> Column:
                x, y = chars_a[i - 1], chars_b[j - 1]
                swap = F.when(
                    (i > 1) & (j > 1)
                    & (x == F.get(chars_b, j - 2)) & (F.get(chars_a, i - 2) == y),
                    F.get(prev2, j - 2) + 1,
                )
                return F.array_append(
                    row,
                    F.least(
                        row[j - 1] + 1,
                        prev[j] + 1,
                        prev[j - 1] + F.when(x == y, 0).otherwise(1),
                        swap,
                    ),
                )

            row = F.aggregate(F.sequence(F.lit(1), width), F.array(i), next_cell)
            return F.struct(row.alias("prev"), prev.alias("prev2"))

        first = F.struct(
            F.sequence(F.lit(0), width).alias("prev"),
            F.sequence(F.lit(0), width).alias("prev2"),
        )
        return F.aggregate(
            F.sequence(F.lit(1), F.size(chars_a)), first, next_row, lambda s: s["prev"][width]
        )

    def chars(text: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(1), F.length(text)), lambda i: F.substr(text, i, F.lit(1))
        )

    return (
        F.when(F.length(a) == 0, F.length(b))
        .when(F.length(b) == 0, F.length(a))
        .otherwise(let(chars(a), lambda x: let(chars(b), lambda y: table(x, y))))
    )


def plain_edits(a: Column, b: Column, k: int) -> Column:
    """Insertions, deletions and substitutions, -1 above what :func:`distance_within` ``k`` allows."""
    return F.levenshtein(a, b, 2 * k)


def may_be_within(
    a: Column, b: Column, k: int, plain: Column | None = None, differ: Column | None = None
) -> Column:
    """Necessary for :func:`distance_within`, in plain functions, which Spark compiles.

    A swap is two plain edits at most, so above ``k`` of them all but ``2 * k - plain`` edits are swaps.
    ``plain`` is :func:`plain_edits` and ``differ`` at most :func:`apart`, where they are known.
    """
    plain = plain_edits(a, b, k) if plain is None else plain
    differ = apart(a, b) if differ is None else differ
    return (plain >= 0) & ((plain <= k) | (differ <= 2 * k - plain))


def near_distance(a: Column, b: Column, plain: Column, differ: Column, k: int) -> Column:
    """:func:`edit_distance` where it is at most ``k``, else more than ``k`` or NULL.

    Above ``k`` plain edits some swap has to bring the words nearer; the few pairs where one does need
    the table. If one edit is no swap, that swap saves one plain edit more.
    """
    rest = 2 * (k - 1)
    swap = F.lit(False)
    if k > 0:
        swap = (differ <= 2 * k - plain) & F.when(differ == 0, _some_swap(a, b, rest)).otherwise(
            _some_swap(a, b, rest - 1) if k > 1 else F.lit(False)
        )
    one_swap = (plain == 2) & (differ == 0) & (F.length(a) == F.length(b))
    return (
        F.when(plain.between(0, 1), plain)
        .when(one_swap & _some_swap(a, b, 0), F.lit(1))
        .when(plain == 2, F.lit(2))
        .when((plain > 2) & ((plain <= k) | swap), edit_distance(a, b))
    )


def distance_within(a: Column, b: Column, k: int) -> Column:
    """:func:`edit_distance` where it is at most ``k``, else NULL."""
    found = F.struct(plain_edits(a, b, k).alias("plain"), apart(a, b).alias("differ"))
    near = let(found, lambda f: F.struct(near_distance(a, b, f["plain"], f["differ"], k).alias("d")))
    return let(near, lambda s: F.when(s["d"] <= k, s["d"]))
