"""Token edits of annotated sentences."""

from __future__ import annotations

import sys
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

from textfix.functions.text import let, words

# Executors get the functions below inside the plan and need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

EDITS_TYPE = "array<struct<start:int,end:int,seq:int,repl:string>>"
# Cells of an alignment table; what is left between common ends of larger texts is cut at long matches first.
CELLS = 1 << 22
# Cost of a change; a changed word costs one more, so that of equally many changes those keep most words.
STEP = 1 << 20


def apply_edits(source: Column, edits: Column) -> Column:
    """Apply ``ARRAY<STRUCT<start, end, seq, repl>>`` to a token array.

    Edits run in (start, end) order, ties in ``seq`` order. An empty or ``-NONE-`` replacement
    deletes. An edit that starts before the end of the one before it moves the read mark back.
    """
    both = F.struct(source.alias("source"), edits.alias("edits"))
    return let(both, lambda p: _applied(p["source"], p["edits"]))


def _applied(source: Column, edits: Column) -> Column:
    def step(state: Column, edit: Column) -> Column:
        prev = state["prev"]
        kept = F.slice(source, prev + 1, F.greatest(edit["start"] - prev, F.lit(0)))
        added = F.when(
            (edit["repl"] == "") | (edit["repl"] == "-NONE-"), F.array().cast("array<string>")
        ).otherwise(words(edit["repl"]))
        return F.struct(
            F.concat(state["out"], kept, added).alias("out"), edit["end"].alias("prev")
        )

    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).alias("prev"))
    return F.aggregate(
        F.array_sort(edits),
        start,
        step,
        lambda s: F.concat(
            s["out"], F.slice(source, s["prev"] + 1, F.greatest(F.size(source) - s["prev"], F.lit(0)))
        ),
    )


def _table(a: list[int], b: list[int]) -> np.ndarray:
    """Costs of turning each start of ``a`` into each start of ``b``: words put in, taken out or changed,
    and neighbours swapped, are a step each."""
    n, m = len(a), len(b)
    x, y, place = np.array(a), np.array(b), np.arange(m + 1, dtype=np.int64) * STEP
    cost = np.zeros((n + 1, m + 1), np.int64)
    cost[0] = place
    for i in range(1, n + 1):
        row = np.empty(m + 1, np.int64)
        row[0] = i * STEP
        row[1:] = np.minimum(cost[i - 1, :-1] + (y != x[i - 1]) * (STEP + 1), cost[i - 1, 1:] + STEP)
        if i > 1 and m > 1:
            swap = (y[:-1] == x[i - 1]) & (y[1:] == x[i - 2])
            row[2:] = np.where(swap, np.minimum(row[2:], cost[i - 2, :-2] + STEP), row[2:])
        cost[i] = np.minimum.accumulate(row - place) + place
    return cost


def _steps(a: list[int], b: list[int]) -> list[tuple[int, int, int, int]]:
    """Changed stretches (a from, to, b from, to) of a cheapest alignment, from the left."""
    cost, i, j, found = _table(a, b), len(a), len(b), []
    while i or j:
        here = cost[i, j]
        if i and j and a[i - 1] == b[j - 1] and cost[i - 1, j - 1] == here:
            i, j = i - 1, j - 1
            continue
        if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1] and cost[i - 2, j - 2] + STEP == here:
            p, q = i - 2, j - 2
        elif i and j and cost[i - 1, j - 1] + STEP + 1 == here:
            p, q = i - 1, j - 1
        elif i and cost[i - 1, j] + STEP == here:
            p, q = i - 1, j
        else:
            p, q = i, j - 1
        found.append((p, i, q, j))
        i, j = p, q
    return found[::-1]


def common_ends(a: str | list[str], b: str | list[str]) -> tuple[int, int]:
    """Number of equal elements at the start, and of further ones at the end."""
    low = high = 0
    for x, y in zip(a, b):
        if x != y:
            break
        low += 1
    for x, y in zip(reversed(a[low:]), reversed(b[low:])):
        if x != y:
            break
        high += 1
    return low, high


def align(a: list[str], b: list[str]) -> list[tuple[int, int, str]]:
    """Edits (start, end, replacement) that turn the words of ``a`` into those of ``b``.

    Neighbouring changes are merged into one edit. Common words at both ends are left out first, which
    keeps the alignment cheapest; what is larger than ``CELLS`` then is cut at its longest matches.
    """
    low, high = common_ends(a, b)
    x, y = a[low : len(a) - high], b[low : len(b) - high]
    names: dict[str, int] = {}
    p, q = ([names.setdefault(w, len(names)) for w in side] for side in (x, y))
    blocks = [(0, len(x), 0, len(y))]
    if (len(x) + 1) * (len(y) + 1) > CELLS:
        codes = SequenceMatcher(None, p, q, False).get_opcodes()
        blocks = [(i1, i2, j1, j2) for tag, i1, i2, j1, j2 in codes if tag != "equal"]
    changed: list[list[int]] = []
    for i1, i2, j1, j2 in blocks:
        n, m = i2 - i1, j2 - j1
        # Nothing to align where one side is empty, or one word became another.
        whole = not n or not m or n == m == 1 or (n + 1) * (m + 1) > CELLS
        steps = [(0, n, 0, m)][: n + m] if whole else _steps(p[i1:i2], q[j1:j2])
        for s, t, u, v in steps:
            if changed and changed[-1][1] == i1 + s and changed[-1][3] == j1 + u:
                changed[-1][1], changed[-1][3] = i1 + t, j1 + v
            else:
                changed.append([i1 + s, i1 + t, j1 + u, j1 + v])
    return [(low + s, low + t, " ".join(y[u:v])) for s, t, u, v in changed]


def extract_edits(source: Column, target: Column) -> Column:
    """``ARRAY<STRUCT<start, end, seq, repl>>``: edits that turn the words of one text into another's.

    :func:`apply_edits` with them gives the words of ``target`` (the word ``-NONE-`` alone aside, which
    stands for nothing there). NULL counts as empty. Equal texts never reach Python.
    """

    def batch(left: pa.Array, right: pa.Array) -> pa.Array:
        out = []
        for a, b in zip(left.to_pylist(), right.to_pylist()):
            # White space is the same for ``split`` and for ``words``.
            edits = None if a is None else align(a.split(), b.split())
            out.append(None if edits is None else [(s, e, k, r) for k, (s, e, r) in enumerate(edits)])
        edit = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("seq", pa.int32()), ("repl", pa.string())])
        return pa.array(out, pa.list_(edit))

    a, b = F.coalesce(source, F.lit("")), F.coalesce(target, F.lit(""))
    found = F.arrow_udf(batch, EDITS_TYPE)(F.when(a != b, a), F.when(a != b, b))
    return F.coalesce(found, F.array().cast(EDITS_TYPE))
