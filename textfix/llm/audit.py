"""Filter interaction audit with wide packed counters.

Five filters can be applied in 120 orders of five steps. What happens to a document at all 600 steps
follows from the set of filters that it fails (its mask) and its two labels. Each of these 128 cases is
mapped to one wide integer with a field of 64 bits for every outcome of every step, 1 where it occurs.
The integers of a part are added up, equal ones by a multiplication with their number, and the sum is
unpacked into all counts. A field can't overflow: no sum exceeds the rows of the part, a long.
"""

from __future__ import annotations

from functools import cache
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textfix.llm.common import SPACE, attach
from textfix.session import materialize

FILTERS = "ABCDE"
ORDERS = ["".join(order) for order in permutations(FILTERS)]
OUTCOMES = ("kept", "removed", "redundant", "good_lost", "toxic_lost")
FIELDS = len(ORDERS) * len(FILTERS) * len(OUTCOMES) + len(FILTERS)
SCHEMA = (
    "part string, filter_order string, step int, kept long, removed long, redundant long, "
    "unique_fails long, good_lost long, toxic_lost long, shapley long"
)


def outcomes(mask: int, good: bool, toxic: bool) -> list[bool]:
    """Five outcomes for each step of each order, then for each filter whether it alone fails."""
    found: list[bool] = []
    for order in ORDERS:
        gone = False
        for letter in order:
            fails = bool(mask >> FILTERS.index(letter) & 1)
            removed, redundant = fails and not gone, fails and gone
            gone = gone or fails
            found += [not gone, removed, redundant, removed and good, removed and toxic]
    return found + [mask == 1 << k for k in range(len(FILTERS))]


@cache
def packed(mask: int, good: bool, toxic: bool) -> int:
    """The outcomes as one integer of 64 bits a field."""
    return int.from_bytes(np.array(outcomes(mask, good, toxic), "<u8").tobytes(), "little")


def unpacked(total: int) -> np.ndarray:
    """The fields of a sum of packed integers."""
    return np.frombuffer(total.to_bytes(8 * FIELDS, "little"), "<u8").astype(np.int64)


def failures(text: Column) -> Column:
    """The mask of a text for filters A to D; E needs the other texts. NULL counts as empty."""
    text = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(text, f"{SPACE}+"), lambda w: w != "")
    n_words, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    fails = [
        n_words < 200,
        100 * distinct.cast("long") < 50 * n_words.cast("long"),
        100 * capitals.cast("long") > 2 * F.length(text).cast("long"),
        text.rlike("[#$%&*|]"),
    ]
    mask = F.lit(0)
    for k, fail in enumerate(fails):
        mask = mask + F.when(fail, 1 << k).otherwise(0)
    return mask


def masks(df: DataFrame, id_col: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """(id, part, mask) per row of ``df``: the set of filters that its whole text fails.

    Texts are compared by SHA-256, table-wide. Equal texts are counted before they meet, and texts
    that occur often are joined where their rows are.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = df.select(
        F.col(id_col).alias("id"),
        F.coalesce(F.col(part), F.lit("")).alias("part"),
        F.sha2(whole, 256).alias("digest"),
        failures(F.col(text)).alias("mask"),
    )
    rows = materialize(rows, "audit-rows")
    texts = rows.groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    texts = materialize(texts.where(F.col("n") > 1), "audit-texts")
    repeats = F.coalesce(F.col("id") > F.col("first"), F.lit(False))
    return attach(rows, texts, "digest", "n").select(
        "id", "part", (F.col("mask") + F.when(repeats, 16).otherwise(0)).alias("mask")
    )


def audit(
    df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", part: str = "source"
) -> DataFrame:
    """Counts per part, order of the filters and step; zeros are included.

    Ids are longs. NULL texts and parts count as empty. Repeated ids are rows of their own; a row
    fails E if an equal text has a smaller id, so rows that share text and id don't fail it by each
    other and a NULL id neither fails it nor makes others fail. A document is good or toxic if any
    row of ``labels`` for its id says 1. An empty table has no parts and gives no rows.
    """
    marked = masks(df, id_col, text, part)
    known = labels.where((F.col("quality") == 1) | (F.col("toxic") == 1)).where(F.col(id_col).isNotNull())
    known = known.groupBy(F.col(id_col).alias("id")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"),
    )
    # Rows without an id have no labels and would all go to one task.
    some = marked.where(F.col("id").isNotNull()).join(known, "id", "left")
    none = marked.where(F.col("id").isNull()).select("*", F.lit(False).alias("good"), F.lit(False).alias("toxic"))
    cases = some.unionByName(none).groupBy(
        "part", "mask",
        F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"),
    )
    return cases.agg(F.count(F.lit(1)).alias("n")).groupBy("part").applyInArrow(_part_counts, SCHEMA)


def _part_counts(cases: pa.Table) -> pa.Table:
    """All steps of one part, which has at most 128 cases."""
    columns = (cases.column(c).to_pylist() for c in ("mask", "good", "toxic", "n"))
    total = sum(packed(mask, good, toxic) * n for mask, good, toxic, n in zip(*columns, strict=True))
    fields = unpacked(total)
    alone = fields[-len(FILTERS) :]
    steps = fields[: -len(FILTERS)].reshape(len(ORDERS), len(FILTERS), len(OUTCOMES))
    letters = np.array([[FILTERS.index(x) for x in order] for order in ORDERS])
    removed = steps[:, :, OUTCOMES.index("removed")]
    shapley = [sum(map(int, removed[letters == k])) for k in range(len(FILTERS))]
    flat, letters = steps.reshape(-1, len(OUTCOMES)), letters.ravel()
    found = {name: flat[:, k] for k, name in enumerate(OUTCOMES)}
    return pa.table({
        "part": pa.array([cases.column("part")[0].as_py()] * len(flat), pa.string()),
        "filter_order": pa.array(np.repeat(ORDERS, len(FILTERS)).tolist(), pa.string()),
        "step": pa.array(np.tile(np.arange(1, len(FILTERS) + 1), len(ORDERS)), pa.int32()),
        "kept": found["kept"], "removed": found["removed"], "redundant": found["redundant"],
        "unique_fails": alone[letters],
        "good_lost": found["good_lost"], "toxic_lost": found["toxic_lost"],
        "shapley": np.array(shapley, np.int64)[letters],
    })
