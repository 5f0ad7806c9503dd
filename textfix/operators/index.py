"""A dictionary prepared for candidate search: its keys are made and written once."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textfix.functions.distance import places, with_deletion_key, without_char
from textfix.session import computed_once, materialize, shared_dir

# Terms of at least this many characters may be found by their halves if two edits are allowed.
HALVES_FROM = 10
# A half may be common to many terms, so halves serve so many of the longest terms, and all of more characters.
HALVES_FOR = 100
TWICE_TO = 24
MOST_EDITS = 2
# Kinds of keys by the edits they serve: whole words (0 or 1 deletion; exactly 2), halves of words.
WHOLE, TWICE, HALF = 1, 2, 3


@dataclass(frozen=True)
class DictionaryIndex:
    """``terms`` (term, count), ``keys`` (kind, key, term, count, letters), the most edits they serve,
    the length of the longest term and that from which on terms are found by their halves."""

    terms: DataFrame
    keys: DataFrame
    k: int
    longest: int
    halves_from: int = HALVES_FROM


def terms_of(dictionary: DataFrame | DictionaryIndex) -> DataFrame:
    return dictionary.terms if isinstance(dictionary, DictionaryIndex) else dictionary


def letters(word: Column) -> Column:
    """The characters of a word as bits of a long: one for each first use, by code modulo 32, and one for
    each second use. So an insertion sets one bit at most and a deletion clears one at most."""
    chars = F.transform(F.split(word, ""), lambda c: F.ascii(c) % 32)

    def add(found: Column, c: Column) -> Column:
        first = F.call_function("shiftleft", F.lit(1).cast("long"), c)
        again = F.call_function("shiftleft", first, F.lit(32))
        return found.bitwiseOR(F.when(found.bitwiseAND(first) == 0, first).otherwise(again))

    return F.aggregate(F.filter(chars, lambda c: c > 0), F.lit(0).cast("long"), add)


def sizes(dictionary: DataFrame) -> tuple[int, int]:
    """Length of the longest term, and that from which on terms are found by their halves.

    Halves give few keys but meet many words if many terms share them, so only ``HALVES_FOR`` of the
    longest terms use them, and those of more than ``TWICE_TO`` characters, which have too many keys else.
    """
    size = F.length("term")
    bounded = F.least(F.greatest(size, F.lit(HALVES_FROM - 1)), F.lit(TWICE_TO + 1)).alias("size")
    rows = dictionary.where(size > 0).groupBy(bounded).agg(F.count(F.lit(1)).alias("n"), F.max(size).alias("longest"))
    found = sorted((r["size"], r["n"], r["longest"]) for r in rows.collect())
    start, served = TWICE_TO + 1, sum(n for at, n, _ in found if at > TWICE_TO)
    for at in range(TWICE_TO, HALVES_FROM - 1, -1):
        served += sum(n for size, n, _ in found if size == at)
        if served > HALVES_FOR:
            break
        start = at
    return max((longest for *_, longest in found), default=0), start


def term_halves(df: DataFrame, term: str = "term") -> DataFrame:
    """One row per key of the halves of ``term``: each half, and it without one of its characters.

    Two edits leave one half with one edit at most, also if a swap goes across the middle: what else
    happens is in one half only. So a term of L characters needs L + 2 keys.
    """
    text = F.col(term)
    size = F.floor(F.length(text) / 2).cast("int")
    halves = F.array(
        F.struct(F.lit("left").alias("side"), F.left(text, size).alias("text")),
        F.struct(F.lit("right").alias("side"), F.substr(text, size + 1).alias("text")),
    )
    rows = df.withColumn("_half", F.explode(halves))
    part, whole = F.col("_half.text"), F.length("_half.text")
    rows = rows.withColumn("_cut", F.explode(F.sequence(F.lit(0), whole)))
    left = F.when(F.col("_cut") == 0, part).otherwise(without_char(part, F.col("_cut")))
    return rows.withColumn("key", F.xxhash64(F.col("_half.side"), whole, left)).drop("_half", "_cut")


def word_halves(
    df: DataFrame, word: str = "word", longest: int = 1 << 20, halves_from: int = HALVES_FROM
) -> DataFrame:
    """One row per key by which a half of a term within two edits of ``word`` can be met.

    A half of n characters with one edit at most is the first (last) n - 1 characters of the word, or
    its first (last) n or n + 1 without one of them. The halves of all possible terms have three
    lengths on each side, so a word of L characters needs about 6 L keys.
    """
    text, size = F.col(word), F.length(word)
    least = F.greatest(size - MOST_EDITS, F.lit(halves_from))
    most = F.least(size + MOST_EDITS, F.lit(longest))
    low = F.floor(least / 2).cast("int"), F.ceil(least / 2).cast("int")
    high = F.floor(most / 2).cast("int"), F.ceil(most / 2).cast("int")
    possible = least <= most

    def sizes(side: str, a: Column, b: Column) -> Column:
        found = F.when(possible, F.sequence(a, b)).otherwise(F.array().cast("array<int>"))
        return F.transform(found, lambda n: F.struct(F.lit(side).alias("side"), n.alias("n")))

    rows = df.withColumn("_half", F.explode(F.concat(sizes("left", low[0], high[0]), sizes("right", low[1], high[1]))))
    side, n = F.col("_half.side"), F.col("_half.n")

    def piece(length: Column, cuts: Column) -> Column:
        end = F.when(side == "left", F.left(text, length)).otherwise(F.right(text, length))
        return F.struct(end.alias("text"), F.when(length <= size, cuts).alias("cuts"))

    pieces = F.array(
        piece(n - 1, F.array(F.lit(0))), piece(n, places(F.lit(1), n)), piece(n + 1, places(F.lit(1), n + 1))
    )
    rows = rows.withColumn("_piece", F.explode(pieces)).where(F.col("_piece.cuts").isNotNull())
    rows = rows.withColumn("_cut", F.explode("_piece.cuts"))
    part = F.col("_piece.text")
    left = F.when(F.col("_cut") == 0, part).otherwise(without_char(part, F.col("_cut")))
    return rows.withColumn("key", F.xxhash64(side, n, left)).drop("_half", "_piece", "_cut")


def term_keys(dictionary: DataFrame, k: int, halves_from: int = HALVES_FROM) -> DataFrame:
    """(kind, key, term, count, letters): all keys that searches with up to ``k`` edits look for."""
    terms = dictionary.select("term", "count").where(F.length("term") > 0)
    terms = computed_once(terms, "letters", letters(F.col("term")))
    columns = ["kind", "key", "term", "count", "letters"]
    keys = with_deletion_key(terms, "term", min(k, 1), "key").withColumn("kind", F.lit(WHOLE))
    if k < 2:
        return keys.select(columns)
    short, long = F.length("term") < halves_from, F.length("term") >= halves_from
    twice = with_deletion_key(terms.where(short), "term", 2, "key").withColumn("kind", F.lit(TWICE))
    halves = term_halves(terms.where(long)).withColumn("kind", F.lit(HALF))
    return keys.select(columns).unionByName(twice.select(columns)).unionByName(halves.select(columns))


def word_keys(
    words: DataFrame, k: int, longest: int, word: str = "word", halves_from: int = HALVES_FROM
) -> DataFrame:
    """(kind, key, word, letters): the keys by which terms within ``k`` edits are found."""
    marked = computed_once(words, "letters", letters(F.col(word)))
    columns = ["kind", "key", word, "letters"]
    if k < 2:
        keys = with_deletion_key(marked, word, k, "key")
        return keys.withColumn("kind", F.lit(WHOLE)).select(columns)
    short = marked.where(F.length(word) < halves_from + MOST_EDITS)
    twice = with_deletion_key(short, word, 2, "key").withColumn("kind", F.lit(TWICE))
    halves = word_halves(marked.where(F.length(word) >= halves_from - MOST_EDITS), word, longest, halves_from)
    return twice.select(columns).unionByName(halves.withColumn("kind", F.lit(HALF)).select(columns))


def dictionary_index(dictionary: DataFrame, k: int = MOST_EDITS) -> DictionaryIndex:
    """Write terms and keys of ``dictionary`` once, the keys in buckets of their own.

    Searches that are given the index read its buckets and shuffle only the keys of their words. The
    files lie in the shared folder and stay there.
    """
    if not 0 <= k <= MOST_EDITS:
        raise ValueError(f"an index serves up to {MOST_EDITS} edits")
    spark = dictionary.sparkSession
    terms = materialize(dictionary.select("term", "count"), "terms")
    name = f"textfix_keys_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    longest, halves_from = sizes(terms)
    keys = term_keys(terms, k, halves_from).repartition(buckets, "key")
    path = f"{shared_dir(spark).rstrip('/')}/textfix/{name}"
    keys.write.bucketBy(buckets, "key").sortBy("key").option("path", path).saveAsTable(name)
    return DictionaryIndex(terms, spark.table(name), k, longest, halves_from)
