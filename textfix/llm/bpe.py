"""Byte-level BPE encoding and decoding with a rank queue.

A pre-token is a linked list of byte parts. The queue has a bucket of list positions for each merge
rank and, above the buckets, levels of 64-bit words that say which buckets are in use. Find-first-set
from the top word down gives the smallest rank, whose bucket is emptied from left to right; a position
whose pair has changed since it was queued is skipped. New pre-tokens of a text share one run, so a
bucket is found once for all of them, and a pre-token of n bytes takes O(n log n) steps at any length.
"""

from __future__ import annotations

import base64
import gc
import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import ArrayType, BinaryType, DataType, IntegerType, StructField, StructType

# Pre-tokens remembered per Python worker, and the longest that is.
MEMO_WORDS, MEMO_CHARS = 500_000, 48
# Texts are worked through in slices of about this many characters.
SLICE_CHARS = 1 << 18
# Short texts are encoded together, up to so many characters.
GROUP_CHARS = 1 << 20
# Pre-tokens that share a run of the queue.
RUN_WORDS = 1000


class RankQueue:
    """Buckets of positions by rank; ``pop`` empties the bucket of the smallest rank."""

    def __init__(self, n_ranks: int):
        self.buckets: dict[int, list[int]] = {}
        self.levels: list[list[int]] = []
        size = n_ranks
        while size > 1 or not self.levels:
            size = (size + 63) >> 6
            self.levels.append([0] * size)

    def fill(self, rank: int, positions: list[int]) -> None:
        """Put a bucket in a place that is empty."""
        self.buckets[rank] = positions
        for level in self.levels:
            word = level[rank >> 6]
            level[rank >> 6] = word | 1 << (rank & 63)
            if word:
                return
            rank >>= 6

    def pop(self) -> tuple[int, list[int]] | None:
        spot = 0
        for level in reversed(self.levels):
            bits = level[spot]
            if not bits:
                return None
            spot = spot << 6 | (bits & -bits).bit_length() - 1
        rank = spot
        for level in self.levels:
            level[spot >> 6] &= ~(1 << (spot & 63))
            if level[spot >> 6]:
                break
            spot >>= 6
        return rank, self.buckets.pop(rank)


class BytePairCoder:
    """Encodes and decodes by a table of byte strings and ranks; a rank is also the token's id."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.pattern = regex.compile(pattern)
        self.queue = RankQueue(max(ranks.values(), default=0) + 1)
        self.tokens = dict(zip(ranks.values(), ranks.keys(), strict=True))
        self.memo: dict[str, bytes] = {}
        self.byte_ranks = [ranks.get(bytes([b]), -1) for b in range(256)]
        self.byte_pairs = np.full(1 << 16, -1, np.int32)
        for token, rank in ranks.items():
            if len(token) == 2:
                self.byte_pairs[token[0] << 8 | token[1]] = rank

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """Packed ids of each pre-token. All are merged in one run of the queue.

        ``end[i]`` is where the part that starts at i ends, hence where the next part starts.
        """
        ranks, queue, buckets = self.ranks, self.queue, self.queue.buckets
        whole = [ranks.get(piece) for piece in pieces]
        split = [p for p, rank in zip(pieces, whole, strict=True) if rank is None]
        joined = b"".join(split)
        n, get = len(joined), ranks.get
        starts = np.cumsum([0, *map(len, split)])
        stop = bytearray(n + 1)  # 1 where a pre-token starts: no pair reaches over it
        np.frombuffer(stop, np.uint8)[starts] = 1
        token = list(map(self.byte_ranks.__getitem__, joined))
        pair, before, end = [-1] * n, list(range(-1, n - 1)), list(range(1, n + 1))
        if n > 1:
            codes = np.frombuffer(joined, np.uint8).astype(np.int32)
            first = self.byte_pairs[codes[:-1] << 8 | codes[1:]]
            first[starts[(starts > 0) & (starts < n)] - 1] = -1
            pair[: n - 1] = first.tolist()
            for i, rank in enumerate(pair):
                if rank >= 0:
                    if rank in buckets:
                        buckets[rank].append(i)
                    else:
                        queue.fill(rank, [i])
        while (top := queue.pop()) is not None:
            now, bucket = top
            bucket.sort()
            for done, i in enumerate(bucket, 1):
                if pair[i] != now:  # stale
                    continue
                j = end[i]
                end[i] = k = end[j]
                pair[j] = pair[i] = -1
                token[i] = now
                smaller = False
                if not stop[k]:
                    before[k] = i
                    rank = get(joined[i : end[k]])
                    if rank is not None:
                        pair[i] = rank
                        if rank in buckets:
                            buckets[rank].append(i)
                        else:
                            queue.fill(rank, [i])
                        smaller = rank < now
                if not stop[i]:
                    left = before[i]
                    rank = get(joined[left:k])
                    pair[left] = -1
                    if rank is not None:
                        pair[left] = rank
                        if rank in buckets:
                            buckets[rank].append(left)
                        else:
                            queue.fill(rank, [left])
                        smaller |= rank < now
                if smaller:  # that bucket goes first
                    if done < len(bucket):
                        queue.fill(now, bucket[done:])
                    break
        out, at = [], 0
        for piece, rank in zip(pieces, whole, strict=True):
            if rank is not None:
                ids = [rank]
            else:
                ids, stop_at = [], at + len(piece)
                while at < stop_at:
                    ids.append(token[at])
                    at = end[at]
            out.append(array("I", ids).tobytes())
        return out

    def encode(self, texts: list[str]) -> Iterator[list[bytes]]:
        """Of each text, its slices' ids as little-endian unsigned 32-bit integers.

        ``texts`` are worked through together, so that they share the runs of the queue.
        """
        memo, find = self.memo, self.pattern.findall
        cut = [[find(piece) for piece in safe_slices(text, SLICE_CHARS)] for text in texts]
        seen = [words for pieces in cut for words in pieces]
        new = list(dict.fromkeys(w for words in seen for w in words if w not in memo))
        if len(memo) + len(new) > MEMO_WORDS:
            memo.clear()
            new = list(dict.fromkeys(w for words in seen for w in words))
        for k in range(0, len(new), RUN_WORDS):
            run = new[k : k + RUN_WORDS]
            memo.update(zip(run, self.encode_pieces([w.encode() for w in run]), strict=True))
        for pieces in cut:
            yield [b"".join(map(memo.__getitem__, words)) for words in pieces]
        for word in new:
            if len(word) > MEMO_CHARS:
                del memo[word]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def in_groups(texts: Iterator[str | None]) -> Iterator[list[str]]:
    """Texts in groups of about GROUP_CHARS; NULL becomes empty."""
    group, size = [], 0
    for text in texts:
        group.append(text or "")
        size += len(group[-1])
        if size >= GROUP_CHARS:
            yield group
            group, size = [], 0
    if group:
        yield group


_CUT = regex.compile(r"(?<=\S)\s")


def safe_slices(text: str, size: int) -> Iterator[str]:
    """Cut before white space that follows other characters: there a pre-token always ends."""
    start = 0
    while start < len(text):
        cut = _CUT.search(text, start + size) if start + size < len(text) else None
        end = cut.start() if cut else len(text)
        yield text[start:end]
        start = end


def read_ranks(packed: bytes) -> dict[bytes, int]:
    """Lines of a base64 token and its rank."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, packed.splitlines())}


_coders: dict[tuple[int, str], BytePairCoder] = {}


def _shared_coder(packed: bytes, pattern: str) -> BytePairCoder:
    """One coder per Python worker."""
    key = (hash(packed), pattern)
    if key not in _coders:
        _coders.clear()
        _coders[key] = BytePairCoder(read_ranks(packed), pattern)
    return _coders[key]


def _packed_ranks(spark: SparkSession, ranks_path: str):
    with open(ranks_path, "rb") as file:  # a vocabulary: its size does not follow the data
        return spark.sparkContext.broadcast(file.read())


def _id_lists(sizes: list[int], packed: list[bytes]) -> pa.ListArray:
    flat = pa.array(np.frombuffer(b"".join(packed), "<u4").astype(np.int32))
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]).astype(np.int32)), flat)


def _with(df: DataFrame, name: str, kind: DataType) -> StructType:
    return StructType([*df.schema.fields, StructField(name, kind)])


def encode(
    df: DataFrame, ranks_path: str, pattern: str, text: str = "text", ids: str = "ids"
) -> DataFrame:
    """All columns of ``df`` and ``ids``, array<int>; a column of that name is replaced.

    NULL and empty texts have no ids. Special tokens are ordinary text.
    """
    packed = _packed_ranks(df.sparkSession, ranks_path)
    kept = df.drop(ids)
    place = kept.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()  # nothing here makes cycles, and collections take a quarter of the time
        coder = _shared_coder(packed.value, pattern)
        for batch in batches:
            texts = (t.as_py() for t in batch.column(place))
            coded = [b"".join(x) for group in in_groups(texts) for x in coder.encode(group)]
            column = _id_lists([len(c) // 4 for c in coded], coded)
            yield pa.RecordBatch.from_arrays([*batch.columns, column], [*batch.schema.names, ids])

    return kept.mapInArrow(run, _with(kept, ids, ArrayType(IntegerType())))


def decode(df: DataFrame, ranks_path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """All columns of ``df`` and ``out``, the bytes (binary) of the ids; NULL ids give none."""
    packed = _packed_ranks(df.sparkSession, ranks_path)
    kept = df.drop(out)
    place = kept.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _shared_coder(packed.value, "")
        for batch in batches:
            made = [
                coder.decode(np.array(x.as_py() or [], "<u4").tobytes()) for x in batch.column(place)
            ]
            column = pa.array(made, pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, column], [*batch.schema.names, out])

    return kept.mapInArrow(run, _with(kept, out, BinaryType()))


def round_trip(
    df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text: str = "text",
    keep_ids: bool = False,
) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): every whole text encoded and decoded again.

    One row per input row, repeated ids included. A NULL text counts as empty. ``keep_ids`` adds the
    column ids, array<int>.
    """
    packed = _packed_ranks(df.sparkSession, ranks_path)
    kind = df.schema[id_col].dataType.simpleString()
    names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * keep_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()  # nothing here makes cycles, and collections take a quarter of the time
        coder = _shared_coder(packed.value, pattern)
        for batch in batches:
            n_tokens, coded, back, kept = [], [], [], []
            texts = (t.as_py() for t in batch.column(1))
            for slices in (x for group in in_groups(texts) for x in coder.encode(group)):
                ids_hash, text_hash, n = hashlib.sha256(), hashlib.sha256(), 0
                for ids in slices:
                    ids_hash.update(ids)
                    text_hash.update(coder.decode(ids))
                    n += len(ids) // 4
                n_tokens.append(n)
                coded.append(ids_hash.hexdigest())
                back.append(text_hash.hexdigest())
                if keep_ids:
                    kept += slices
            columns = [
                batch.column(0), pa.array(n_tokens, pa.int64()), pa.array(coded, pa.string()),
                pa.array(back, pa.string()),
            ]
            if keep_ids:
                columns.append(_id_lists(n_tokens, kept))
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return df.select(id_col, text).mapInArrow(run, schema + ", ids array<int>" * keep_ids)
