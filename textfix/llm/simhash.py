"""SimHash near-duplicates through a Gray-order hierarchical index.

Two 64-bit fingerprints that differ in at most 2 bits agree in at least 6 of their 8 bytes. Each
distinct fingerprint is therefore listed under its 28 choices of 6 bytes, and fingerprints meet where
all 48 chosen bits agree. Only 16 bits stay free, so a meeting has at most 65,536 members whatever
the data: no group needs a cap. Inside a meeting the fingerprints are sorted by Gray rank, bit
patterns that neighbours share are factored into upper nodes, and a search adds up differences from
the root down and leaves out whole nodes once they exceed the limit.

Equal fingerprints are one entry of the index. A meeting gives one link per member, to the first
member it is connected with, never all pairs.

``keep_first`` has a rule of its own: a Jaccard similarity of the shingle sets from 0.8 up. Fingerprints
of such pairs differ in about 10 bits, which no key of some bits finds often enough, so its candidates
come from least values of hashed shingles (``near_copies``).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textfix.llm.common import attach, components, without
from textfix.session import materialize

BYTES = list(combinations(range(8), 6))
MAX_BITS = 2
# Children of an index node, queries searched together, words hashed together.
FAN, QUERIES, SLICE_WORDS = 8, 2048, 1 << 15
_LOWER = bytes(range(256)).lower()
_hash = partial(xxhash.xxh64_intdigest, seed=42)


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """SimHash of the shingles of a text, A-Z lower-cased; 0 without words."""
    words = (text or "").encode().translate(_LOWER).split()
    if len(words) <= shingle:
        return _hash(b" ".join(words)) if words else 0
    n = len(words) - shingle + 1
    ones = np.zeros(64, np.int64)
    for start in range(0, n, SLICE_WORDS):
        stop = min(start + SLICE_WORDS, n)
        runs = zip(*(words[start + k : stop + k] for k in range(shingle)), strict=True)
        hashes = np.fromiter(map(_hash, map(b" ".join, runs)), "<u8", stop - start)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(
    df: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = 3, carry: str | None = None
) -> DataFrame:
    """(id, fp): the fingerprint of every whole text as a signed long. NULL texts count as empty.

    ``carry`` names a column of strings that comes along.
    """
    more = [] if carry is None else [carry]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t.as_py(), shingle) for t in batch.column(1)]
            fps = pa.array(np.array(found, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), fps, *batch.columns[2:]], [id_col, "fp", *more])

    kind = df.schema[id_col].dataType.simpleString()
    added = "".join(f", `{c}` string" for c in more)
    return df.select(id_col, text, *more).mapInArrow(run, f"`{id_col}` {kind}, fp long{added}")


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Place of each code in the order in which neighbours differ by one bit."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class GrayIndex:
    """Hierarchies over groups of codes; all groups are built and searched together.

    ``codes`` must be sorted by group and Gray rank. A node holds the bits that all codes below it
    share and its parent doesn't already hold (``mask``) and their values (``pattern``).
    """

    def __init__(self, codes: np.ndarray, groups: np.ndarray):
        self.codes = codes
        self.levels = [(np.full(len(codes), ~np.uint64(0)), codes, None, None)]
        owner = groups
        while len(owner) and (owner[1:] == owner[:-1]).any():
            first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            spot = np.arange(len(owner)) - np.repeat(first, np.diff(np.r_[first, len(owner)]))
            starts = np.flatnonzero(spot % FAN == 0)
            ends = np.r_[starts[1:], len(owner)]
            mask, pattern, lo, hi = self.levels[-1]
            differ = np.bitwise_or.reduceat(pattern, starts) ^ np.bitwise_and.reduceat(pattern, starts)
            shared = np.bitwise_and.reduceat(mask, starts) & ~differ
            self.levels[-1] = (mask & ~np.repeat(shared, ends - starts), pattern, lo, hi)
            self.levels.append((shared, pattern[starts] & shared, starts, ends))
            owner = owner[starts]
        self.roots = owner  # the group of each root, in order

    def within(self, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Blocks of (i, j, differing bits), i < j, for all pairs of a group up to ``limit`` bits."""
        sizes = self._sizes()
        root_of = np.repeat(np.arange(len(self.roots)), sizes)
        for start in range(0, len(self.codes), QUERIES):
            query = np.arange(start, min(start + QUERIES, len(self.codes)))
            node, far = root_of[query], np.zeros(len(query), np.int64)
            for depth in range(len(self.levels) - 1, -1, -1):
                mask, pattern, lo, hi = self.levels[depth]
                far = far + np.bitwise_count((self.codes[query] ^ pattern[node]) & mask[node])
                near = far <= limit
                query, node, far = query[near], node[near], far[near]
                if depth:
                    wide = hi[node] - lo[node]
                    begin = np.repeat(lo[node] - np.r_[0, np.cumsum(wide)[:-1]], wide)
                    query, far = np.repeat(query, wide), np.repeat(far, wide)
                    node = begin + np.arange(len(query))
            later = query < node
            yield query[later], node[later], far[later]

    def _sizes(self) -> np.ndarray:
        """Codes below each root."""
        count = np.ones(len(self.codes), np.int64)
        for _, _, starts, _ in self.levels[1:]:
            count = np.add.reduceat(count, starts)
        return count


def first_connected(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """For each of n places the smallest place it is connected with."""
    label = np.arange(n)
    for a, b in pairs:
        while True:
            low = np.minimum(label[a], label[b])
            old = label.copy()
            np.minimum.at(label, label[a], low)
            np.minimum.at(label, label[b], low)
            while not np.array_equal(label, label[label]):
                label = label[label]
            if np.array_equal(old, label):
                break
    return label


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        met = batch.column(0)
        flat = met.flatten()
        codes = flat.field("fp").to_numpy(zero_copy_only=False).view(np.uint64)
        reps = flat.field("rep").to_numpy(zero_copy_only=False)
        groups = np.repeat(np.arange(len(met)), met.value_lengths().to_numpy(zero_copy_only=False))
        order = np.lexsort((gray_rank(codes), groups))
        codes, reps, groups = codes[order], reps[order], groups[order]
        index = GrayIndex(codes, groups)
        label = first_connected(len(codes), ((a, b) for a, b, _ in index.within(MAX_BITS)))
        linked = np.flatnonzero(label != np.arange(len(label)))
        yield pa.RecordBatch.from_arrays(
            [pa.array(reps[linked]), pa.array(reps[label[linked]])], ["a", "b"]
        )


def links(reps: DataFrame) -> DataFrame:
    """(a, b): links that connect whatever differs by at most 2 bits.

    ``reps`` has one row per fingerprint: fp and its representative rep, both long.
    """
    byte = [F.shiftrightunsigned("fp", 8 * i).bitwiseAND(255) for i in range(8)]
    keys = []
    for table, chosen in enumerate(BYTES):
        key = F.lit(table).cast("long")
        for i in chosen:
            key = F.shiftleft(key, 8).bitwiseOR(byte[i])
        keys.append(key)
    # A fingerprint is few bytes and 28 keys: the rows are dealt out before they multiply.
    tasks = int(reps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    listed = reps.repartition(tasks, "fp").select(F.explode(F.array(*keys)).alias("key"), "fp", "rep")
    met = listed.groupBy("key").agg(F.collect_list(F.struct("fp", "rep")).alias("met"))
    met = met.where(F.size("met") > 1).select("met")
    return met.mapInArrow(_links, "a long, b long").distinct()


def near_duplicates(
    df: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = 3
) -> DataFrame:
    """(id, fingerprint, component_id) per row of ``df``.

    Rows link when their fingerprints differ in at most 2 bits; ``component_id`` is the smallest id
    reached. Ids are longs. NULL, empty and blank texts have fingerprint zero and link like any
    other; repeated ids link only through their texts. A row whose id is NULL is kept, adds no link
    of its own and takes the component of the rows with its fingerprint (NULL if there are none).
    """
    out = classes(df, id_col, text, shingle)
    return out.select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def classes(df: DataFrame, id_col: str, text: str, shingle: int, carry: str | None = None) -> DataFrame:
    """(fp, id, ``carry``, root, component_id) per row of ``df``; see :func:`near_duplicates`.

    ``root`` is a fingerprint that names the component; where ids repeat, two may have one smallest id.
    """
    fps = materialize(fingerprints(df, id_col, text, shingle, carry), "simhash")
    reps = fps.groupBy("fp").agg(F.min(id_col).alias("rep"), F.count(F.lit(1)).alias("n"))
    reps = materialize(reps, "simhash-reps")
    named = reps.where(F.col("rep").isNotNull())
    # Two fingerprints may share a smallest id if ids repeat, so nodes are fingerprints.
    found = components(links(named.select("fp", F.col("fp").alias("rep"))), "simhash")
    rooted = named.join(found, F.col("fp") == F.col("node"), "left").select(
        "fp", "rep", "n", F.coalesce("root", "fp").alias("root")
    )
    rooted = materialize(rooted, "simhash-roots")
    least = rooted.groupBy("root").agg(
        F.min("rep").alias("component_id"), F.count(F.lit(1)).alias("members")
    )
    least = materialize(least, "simhash-least")
    # A fingerprint alone in its component needs no lookup.
    single = F.col("members") == 1
    known = least.where(single).select(F.col("root").alias("fp"), "root", "component_id").unionByName(
        attach(rooted.select("fp", "root"), least.where(~single), "root", "members")
        .where(F.col("component_id").isNotNull())
        .select("fp", "root", "component_id")
    )
    known = materialize(known.join(reps.select("fp", "n"), "fp"), "simhash-known")
    return attach(fps, known, "fp", "n")


def keep_first(df: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = 3) -> DataFrame:
    """One row of ``df`` for each component of near-duplicates: the one with the smallest id.

    Rows are told apart by id and text. If several rows have that id, the one with the least SHA-256 of
    its text stays, once if it is repeated. Rows whose id is NULL stay.
    """
    key = [F.col(id_col).alias("_id"), F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("_sha")]
    found = classes(df.select(*key, F.col(text).alias("_text")), "_id", "_text", shingle, "_sha")
    found = materialize(found.where(F.col("_id").isNotNull()), "simhash-classes")
    own = F.col("_id") == F.col("component_id")
    first = found.where(own).groupBy("_id", "root").agg(F.min("_sha").alias("least"), F.count(F.lit(1)).alias("n"))
    first = materialize(first.where(F.col("n") > 1), "simhash-first")
    other = found.where(own).join(first, ["_id", "root"]).where(F.col("_sha") != F.col("least")).select("_id", "_sha")
    drop = materialize(found.where(~own).select("_id", "_sha").unionByName(other).distinct(), "simhash-drop")
    again = first.select("_id", F.col("least").alias("_sha"))
    held = df.select(F.struct(*df.columns).alias("_row"), *key)
    return without(held, ["_id", "_sha"], drop, again).select("_row.*")
