"""Sequence similarity with the exact results of ``difflib.SequenceMatcher``.

Spark has no built-in with these results, so the comparison itself is an Arrow UDF. Everything that
can be settled by a native expression (equal strings, one string inside the other, an upper bound
below the threshold) is, and such rows reach the UDF as NULL.
"""

from __future__ import annotations

import sys
from collections import Counter
from difflib import SequenceMatcher

import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textfix.functions.edits import common_ends
from textfix.functions.text import let, negation_count, words
from textfix.session import computed_once

# Executors get the functions below inside the plan and need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# ``autojunk`` ignores frequent elements of a second sequence at least this long.
AUTOJUNK_LENGTH = 200
DIFF_TYPE = "array<struct<t:string,c:boolean>>"


# Pairs with more pairs of characters than this are left to ``difflib`` itself.
AREA = 1 << 20


def matching_ends(a: str | list[str], b: str | list[str], autojunk: bool = True) -> tuple[int, int] | None:
    """Lengths of the common start and end if ``difflib`` finds just these as matching blocks, else None.

    Between common ends ``P`` and ``S`` the sides differ by ``x`` and ``y``. If one side is a start of the
    other, it is the block. If no element of ``x`` is in ``b`` and none of ``y`` in ``a``, no run is longer
    than the longer end, and one as long goes over the place where ``x`` or ``y`` is missing: the first such
    run is ``P``, unless ``S`` is longer and also begins earlier. So the blocks are ``P`` and ``S``.
    """
    low, high = common_ends(a, b)
    x, y = a[low : len(a) - high], b[low : len(b) - high]
    if not high and not (x and y):
        return low, high
    if autojunk and len(b) >= AUTOJUNK_LENGTH or not (set(x).isdisjoint(b) and set(y).isdisjoint(a)):
        return None
    if low < high and not (x and y):
        joined, end = (b, b[low:]) if x else (a, a[low:])
        if any(joined[i : i + high] == end for i in range(low)):
            return None
    return low, high


class Matcher:
    """One second text, indexed once, against any number of first texts; results as ``difflib`` gives.

    A set of pairs of equal characters is one integer, a row of bits for each character of the first
    text. Runs of equal characters lie on its diagonals, so that shifting it by a diagonal step and
    intersecting gives the places where runs of double length end.
    """

    def __init__(self, second: str, autojunk: bool = True):
        self.second, self.autojunk = second, autojunk
        self.slow: SequenceMatcher | None = None
        self.masks: dict[str, int] | None = None
        self.ignores = False

    def _index(self) -> dict[str, int]:
        """Places of each character of the second text as bits, without those that are ignored."""
        if self.masks is None:
            self.masks, n = {}, len(self.second)
            often = n // 100 + 1 if self.autojunk and n >= AUTOJUNK_LENGTH else n
            kept = {c for c, k in Counter(self.second).items() if k <= often}
            self.ignores = len(kept) < len(set(self.second))
            for j, c in enumerate(self.second):
                if c in kept:
                    self.masks[c] = self.masks.get(c, 0) | 1 << j
        return self.masks

    def ratio(self, first: str) -> float:
        total = len(first) + len(self.second)
        if not total:
            return 1.0
        if ends := matching_ends(first, self.second, self.autojunk):
            return 2.0 * sum(ends) / total
        if len(first) * len(self.second) > AREA:
            if self.slow is None:
                self.slow = SequenceMatcher(None, "", self.second, self.autojunk)
            self.slow.set_seq1(first)
            return self.slow.ratio()
        matches, todo = 0, [(0, len(first), 0, len(self.second))]
        while todo:
            alo, ahi, blo, bhi = todo.pop()
            i, j, size = self._longest(first, alo, ahi, blo, bhi)
            if size:
                matches += size
                if alo < i and blo < j:
                    todo.append((alo, i, blo, j))
                if i + size < ahi and j + size < bhi:
                    todo.append((i + size, ahi, j + size, bhi))
        return 2.0 * matches / total

    def _longest(self, a: str, alo: int, ahi: int, blo: int, bhi: int) -> tuple[int, int, int]:
        """Start in both texts and length of the longest run, the first one in the first text."""
        masks, b = self._index(), self.second
        inside, width = (1 << bhi - blo) - 1, (bhi - blo + 8) // 8
        part = a[alo:ahi]
        rows = {c: (masks.get(c, 0) >> blo & inside).to_bytes(width, "little") for c in set(part)}
        runs = [int.from_bytes(b"".join([rows[c] for c in part]), "little")]
        i, j, size, step = alo, blo, 0, 8 * width + 1
        if runs[0]:
            size = 1
            while longer := runs[-1] & runs[-1] << size * step:
                runs.append(longer)
                size *= 2
            ends = runs[-1]
            for k in range(len(runs) - 2, -1, -1):
                if longer := ends & runs[k] << size * step:
                    ends, size = longer, size + (1 << k)
            row, column = divmod((ends & -ends).bit_length() - 1, 8 * width)
            i, j = alo + row - size + 1, blo + column - size + 1
        if self.ignores:  # a run goes on over ignored characters
            while i > alo and j > blo and a[i - 1] == b[j - 1]:
                i, j, size = i - 1, j - 1, size + 1
            while i + size < ahi and j + size < bhi and a[i + size] == b[j + size]:
                size += 1
        return i, j, size


def _ratio(a: str, b: str, autojunk: bool) -> float:
    return Matcher(b, autojunk).ratio(a)


def _ratios_udf(autojunk: bool):
    """Arrow UDF: the similarities of some first texts (NULL: skipped) to one second text."""

    def batch(second: pd.Series, firsts: pd.Series) -> pd.Series:
        matchers: dict[str, Matcher] = {}
        seen: dict[tuple[str, str], float] = {}
        out = []
        for b, some in zip(second, firsts):
            if b is None:
                out.append(None)
                continue
            found = []
            for a in some:
                if a is not None and (a, b) not in seen:
                    if b not in matchers:
                        matchers[b] = Matcher(b, autojunk)
                    seen[a, b] = matchers[b].ratio(a)
                found.append(None if a is None else seen[a, b])
            out.append(found)
        return pd.Series(out, dtype="object")

    return F.pandas_udf(batch, "array<double>")


def _edit_count(a: list[str], b: list[str]) -> int:
    """Words between matching blocks; a gap costs as much as its longer side."""
    edits = at_a = at_b = 0
    for block in SequenceMatcher(None, a, b).get_matching_blocks():
        gap_a, gap_b = block.a - at_a, block.b - at_b
        edits += gap_a if gap_a > gap_b else gap_b
        at_a, at_b = block.a + block.size, block.b + block.size
    return edits


def _lowered(text: str) -> list[str]:
    """The words of a text, each in lower case. White space is the same for ``split`` and for ``words``."""
    return text.lower().split() if text.isascii() else [w.lower() for w in text.split()]


def _new_words(a: list[str], b: list[str]) -> list[bool]:
    """Which words of ``b`` lie in none of the matching blocks that ``difflib`` finds."""
    if ends := matching_ends(a, b):
        return [False] * ends[0] + [True] * (len(b) - sum(ends)) + [False] * ends[1]
    new = [True] * len(b)
    for _, start, size in SequenceMatcher(None, a, b).get_matching_blocks():
        new[start : start + size] = [False] * size
    return new


def _flagged(before: pa.Array, after: pa.Array) -> pa.Array:
    """The words of each new text and whether they are new; NULL where a text is NULL."""
    ends, missing, found, new = [0], [], [], []
    for a, b in zip(before.to_pylist(), after.to_pylist()):
        missing.append(a is None or b is None)
        if not missing[-1]:
            found += b.split()
            new += _new_words(_lowered(a), _lowered(b))
        ends.append(len(found))
    flags = pa.StructArray.from_arrays([pa.array(found, pa.string()), pa.array(new, pa.bool_())], ["t", "c"])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flags, mask=pa.array(missing, pa.bool_()))


def _pairwise(fn, returns: str):
    """Arrow UDF of two columns; pairs with a NULL are skipped, repeats in a batch computed once."""

    def batch(left: pd.Series, right: pd.Series) -> pd.Series:
        seen: dict = {}
        out = []
        for a, b in zip(left, right):
            if a is None or b is None:
                out.append(None)
                continue
            key = (a, b) if isinstance(a, str) else (tuple(a), tuple(b))
            if key not in seen:
                seen[key] = fn(*key)
            out.append(seen[key])
        return pd.Series(out, dtype="object")

    return F.pandas_udf(batch, returns)


def _ratio_udf(autojunk: bool):
    return _pairwise(lambda a, b: _ratio(a, b, autojunk), "double")


def ratio_bound(a: Column, b: Column) -> Column:
    """Upper bound of the similarity from the two lengths."""
    total = F.length(a) + F.length(b)
    return F.when(total == 0, 1.0).otherwise(2.0 * F.least(F.length(a), F.length(b)) / total)


def compare(a: Column, b: Column, autojunk: bool = True) -> Column:
    """STRUCT<a, b, done>: the similarity where native expressions settle it, else the two texts.

    If one text starts with the other, the shorter one is the matching block, frequent characters
    or not: the first longest run of rare characters is the same place in both, and without such a
    run matching begins at the start. Elsewhere inside the other text this holds while no character
    is ignored.
    """

    def settled(a: Column, b: Column) -> Column:
        inside = a.contains(b) | b.contains(a)
        if autojunk:
            inside = a.startswith(b) | b.startswith(a) | (inside & (F.length(b) < AUTOJUNK_LENGTH))
        return F.when(a == b, 1.0).when(inside, ratio_bound(a, b))

    def pack(p: Column, done: Column) -> Column:
        rest = done.isNull()
        return F.struct(
            F.when(rest, p["a"]).alias("a"), F.when(rest, p["b"]).alias("b"), done.alias("done")
        )

    texts = F.struct(F.coalesce(a, F.lit("")).alias("a"), F.coalesce(b, F.lit("")).alias("b"))
    return let(
        texts,
        lambda p: let(
            F.struct(settled(p["a"], p["b"]).alias("done")), lambda s: pack(p, s["done"])
        ),
    )


def finish(pair: Column, autojunk: bool = True) -> Column:
    """Similarity of a pair made by :func:`compare` and kept in a column."""
    return F.coalesce(pair["done"], _ratio_udf(autojunk)(pair["a"], pair["b"]))


def with_ratio(df: DataFrame, name: str, a: Column, b: Column, autojunk: bool = True) -> DataFrame:
    """Add the character similarity from 0 to 1; NULL counts as empty. Argument order matters.

    The pair is a column of its own, so that it is computed once and the UDF reads plain fields.
    """
    paired = df.withColumn(f"_{name}", compare(a, b, autojunk))
    return paired.withColumn(name, finish(F.col(f"_{name}"), autojunk)).drop(f"_{name}")


def with_ratios(df: DataFrame, names: dict[str, Column], second: Column, autojunk: bool = True) -> DataFrame:
    """Add the similarity of several first texts to one second text, by one pass through Python.

    ``names`` gives the new columns. The second text is indexed once for all its first texts, and equal
    pairs of an Arrow batch are compared once.
    """
    pairs = F.struct(*[compare(a, second, autojunk).alias(name) for name, a in names.items()])
    paired = computed_once(df, "_pairs", pairs)
    firsts = F.array(*[F.col("_pairs")[name]["a"] for name in names])
    needed = F.coalesce(*[F.col("_pairs")[name]["b"] for name in names])
    compared = paired.withColumn("_ratios", _ratios_udf(autojunk)(needed, F.when(needed.isNotNull(), firsts)))
    found = {
        name: F.coalesce(F.col("_pairs")[name]["done"], F.get("_ratios", F.lit(k)))
        for k, name in enumerate(names)
    }
    return compared.withColumns(found).drop("_pairs", "_ratios")


def word_edits(source: Column, target: Column) -> Column:
    """Number of words changed, inserted or deleted between two texts."""
    udf = _pairwise(_edit_count, "int")
    differ = source != target
    return F.when(source == target, 0).otherwise(
        udf(F.when(differ, words(source)), F.when(differ, words(target)))
    )


def word_diff(before: Column, after: Column) -> Column:
    """Words of the new text, flagged where they are not matched in the old one, case aside."""
    def batch(left: pa.Array, right: pa.Array) -> pa.Array:
        return _flagged(left, right)

    differ = F.lower(before) != F.lower(after)
    plain = F.transform(words(after), lambda w: F.struct(w.alias("t"), F.lit(False).alias("c")))
    return F.when(F.lower(before) == F.lower(after), plain).otherwise(
        F.arrow_udf(batch, DIFF_TYPE)(F.when(differ, before), F.when(differ, after))
    )


def compare_meaning(
    before: Column, after: Column, min_sim: float = 0.6, autojunk: bool = True
) -> Column:
    """Pair for :func:`finish`; similarity -1 where the change is refused without comparing.

    Refused are pairs whose lengths alone keep them below ``min_sim`` and pairs with a different
    number of negations.
    """
    refused = F.struct(
        F.lit(None).cast("string").alias("a"), F.lit(None).cast("string").alias("b"),
        F.lit(-1.0).alias("done"),
    )

    def check(p: Column) -> Column:
        a, b = p["a"], p["b"]
        return (
            F.when(ratio_bound(a, b) < min_sim, refused)
            .when(negation_count(a) != negation_count(b), refused)
            .otherwise(compare(a, b, autojunk))
        )

    lowered = F.struct(F.lower(before).alias("a"), F.lower(after).alias("b"))
    return F.when(before.isNotNull() & after.isNotNull(), let(lowered, check))


def with_meaning(
    df: DataFrame,
    name: str,
    before: Column,
    after: Column,
    min_sim: float = 0.6,
    autojunk: bool = True,
) -> DataFrame:
    """Add a flag: false if the number of negations changed or little of the text is left."""
    paired = df.withColumn(f"_{name}", compare_meaning(before, after, min_sim, autojunk))
    kept = finish(F.col(f"_{name}"), autojunk) >= min_sim
    return paired.withColumn(name, kept).drop(f"_{name}")
