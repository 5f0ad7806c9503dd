"""Exact duplicates through counting quotient filters.

Every partition builds filters of its texts' 64-bit fingerprints, one for each range of leading bits.
A filter keeps the quotient of a fingerprint as a place and only stores the remainder, sorted, with a
count where it is above one. Filters of a range merge without loss, as each lists its fingerprints in
order. Fingerprints that occur once need nothing more. The texts of all others are compared byte by
byte: grouped by the whole normalised text, after each task has dropped its own repeats.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textfix.llm.common import SPACE, attach, without
from textfix.session import materialize


class CountingQuotientFilter:
    """Sorted distinct keys of ``bits`` bits and their counts."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, bits: int):
        self.bits, self.n = bits, len(keys)
        self.q = min(max(int(self.n).bit_length(), 3), bits - 1)
        self.r = bits - self.q
        quotient = keys >> np.uint64(self.r)
        self.remainders = keys & np.uint64((1 << self.r) - 1)
        self.occupied = np.zeros(1 << self.q, bool)
        self.occupied[quotient.astype(np.int64)] = True
        self.run_ends = np.r_[quotient[1:] != quotient[:-1], True][: self.n]
        self.repeated = counts > 1
        self.extra = counts[self.repeated]

    def keys(self) -> np.ndarray:
        """The keys in order: each run of remainders belongs to the next occupied quotient."""
        run = np.cumsum(np.r_[False, self.run_ends[:-1]]) if self.n else np.zeros(0, np.int64)
        quotients = np.flatnonzero(self.occupied).astype(np.uint64)
        return quotients[run] << np.uint64(self.r) | self.remainders

    def counts(self) -> np.ndarray:
        counts = np.ones(self.n, np.int64)
        counts[self.repeated] = self.extra
        return counts

    def to_bytes(self) -> bytes:
        width = (self.r + 7) // 8
        rest = self.remainders.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
        marks = [np.packbits(x).tobytes() for x in (self.occupied, self.run_ends, self.repeated)]
        head = struct.pack("<BBq", self.bits, self.q, self.n)
        return b"".join([head, *marks, rest.tobytes(), self.extra.astype("<i8").tobytes()])

    @classmethod
    def from_bytes(cls, packed: bytes) -> CountingQuotientFilter:
        self = cls.__new__(cls)
        self.bits, self.q, self.n = struct.unpack_from("<BBq", packed)
        self.r, at = self.bits - self.q, struct.calcsize("<BBq")
        marks = []
        for size in (1 << self.q, self.n, self.n):
            raw = np.frombuffer(packed, np.uint8, (size + 7) // 8, at)
            marks.append(np.unpackbits(raw, count=size).astype(bool))
            at += len(raw)
        self.occupied, self.run_ends, self.repeated = marks
        width = (self.r + 7) // 8
        full = np.zeros((self.n, 8), np.uint8)
        full[:, :width] = np.frombuffer(packed, np.uint8, self.n * width, at).reshape(-1, width)
        self.remainders = full.view("<u8").reshape(-1).astype(np.uint64)
        self.extra = np.frombuffer(packed, "<i8", -1, at + self.n * width)
        return self

    @classmethod
    def merge(cls, filters: Iterable[CountingQuotientFilter], bits: int) -> CountingQuotientFilter:
        found = [(f.keys(), f.counts()) for f in filters]
        keys = np.concatenate([k for k, _ in found]) if found else np.zeros(0, np.uint64)
        counts = np.concatenate([c for _, c in found]) if found else np.zeros(0, np.int64)
        return cls(*add_up(keys, counts), bits)


def add_up(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sums of their counts."""
    order = np.argsort(keys, kind="stable")  # merges the sorted runs
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]][: len(keys)])
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def merge_runs(*runs: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return add_up(np.concatenate([k for k, _ in runs]), np.concatenate([c for _, c in runs]))


def repeated_fingerprints(df: DataFrame, fp: str = "fp") -> DataFrame:
    """(fp, n): the fingerprints (long) that occur more than once and how often."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lead = max(parts - 1, 1).bit_length()  # ranges of leading bits, about as many as partitions
    bits = 64 - lead

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            new = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            runs.append(add_up(new, np.ones(len(new), np.int64)))
            # Only runs of like size are merged, so a key is sorted a logarithmic number of times.
            while len(runs) > 1 and 2 * len(runs[-1][0]) >= len(runs[-2][0]):
                runs.append(merge_runs(runs.pop(), runs.pop()))
        while len(runs) > 1:
            runs.append(merge_runs(runs.pop(), runs.pop()))
        if not runs or not len(runs[0][0]):
            return
        keys, counts = runs[0]
        block = (keys >> np.uint64(bits)).astype(np.int64)
        rest = keys & np.uint64((1 << bits) - 1)
        cuts = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
        for lo, hi in zip(cuts, np.r_[cuts[1:], len(block)], strict=True):
            packed = CountingQuotientFilter(rest[lo:hi], counts[lo:hi], bits).to_bytes()
            yield pa.RecordBatch.from_pydict({"block": [int(block[lo])], "filter": [packed]})

    def merge(group: pa.Table) -> pa.Table:
        block = group.column("block")[0].as_py()
        parts = (CountingQuotientFilter.from_bytes(x.as_py()) for x in group.column("filter"))
        whole = CountingQuotientFilter.merge(parts, bits)
        counts = whole.counts()
        many = counts > 1
        fps = whole.keys()[many] | np.uint64(block << bits)
        return pa.table({"fp": pa.array(fps.view(np.int64)), "n": pa.array(counts[many])})

    filters = df.select(fp).mapInArrow(build, "block long, filter binary")
    return filters.groupBy("block").applyInArrow(merge, "fp long, n long")


def normalized(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"{SPACE}+", "")


def exact_duplicates(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256) per row of ``df``.

    Texts are equal when identical without blanks and the controls 0x09 to 0x0D; NULL counts as
    empty. Of equal texts the one with the most code points stays, then the smallest id. Ids are
    longs and a key: rows that repeat an id stay or go together. A NULL id loses every tie and is
    kept only in a group of its own.
    """
    norm = normalized(F.col(text))
    ids = df.select(
        F.col(id_col).alias("id"),
        F.length(F.coalesce(F.col(text), F.lit(""))).alias("points"),
        F.xxhash64(norm).alias("fp"),
        F.sha2(norm, 256).alias("sha"),
    )
    ids = materialize(ids, "exact-ids")
    many = materialize(repeated_fingerprints(ids), "exact-many")
    marked = attach(ids, many.withColumn("w", F.col("n")), "fp", "w")
    routed = marked.where(F.col("n").isNotNull())

    # Bytes: one row for each different text of the routed fingerprints.
    texts = df.select(norm.alias("norm"))
    texts = texts.withColumn("fp", F.xxhash64("norm"))
    texts = attach(texts, many.withColumn("w", F.col("n")), "fp", "w").where(F.col("n").isNotNull())
    classes = texts.groupBy("norm").agg(F.count(F.lit(1)).alias("size"))
    proven = classes.groupBy(F.sha2("norm", 256).alias("sha")).agg(
        F.sum("size").alias("size"), F.count(F.lit(1)).alias("texts")
    )
    proven = proven.select(
        "sha",
        F.when(F.col("texts") == 1, F.col("size"))
        .otherwise(F.raise_error(F.lit("two texts have one SHA-256")).cast("long"))
        .alias("group_size"),
    )
    best = routed.groupBy("sha").agg(F.max(F.struct("points", (-F.col("id")).alias("id"))).alias("best"))
    groups = proven.join(best, "sha").select(
        "sha", "group_size", (-F.col("best.id")).alias("keep_id"), F.col("group_size").alias("w")
    )
    groups = materialize(groups, "exact-groups")
    single = marked.where(F.col("n").isNull()).select(
        "id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), "sha"
    )
    shared = attach(routed, groups, "sha", "w").select("id", "keep_id", "group_size", "sha")
    return single.unionByName(shared).select(
        F.col("id").alias(id_col),
        "keep_id",
        "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def keep_one(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``df`` that ``exact_duplicates`` keeps.

    Rows are told apart by id and text; a kept one that is repeated stays once. Rows whose id is NULL
    stay.
    """
    found = exact_duplicates(df, id_col, text).where(F.col(id_col).isNotNull())
    found = found.select(F.col(id_col).alias("_id"), F.col("text_sha256").alias("_sha"), "kept")
    found = materialize(found.groupBy("_id", "_sha", "kept").agg(F.count(F.lit(1)).alias("n")), "exact-kept")
    drop = materialize(found.where(~F.col("kept")).select("_id", "_sha"), "exact-drop")
    again = found.where(F.col("kept") & (F.col("n") > 1)).select("_id", "_sha")
    sha = F.sha2(normalized(F.col(text)), 256)
    held = df.select(F.struct(*df.columns).alias("_row"), F.col(id_col).alias("_id"), sha.alias("_sha"))
    return without(held, ["_id", "_sha"], drop, again).select("_row.*")
