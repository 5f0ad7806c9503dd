"""Substring dedup by sliding sentence spans.

Sentences of more than WORDS words are cut into smaller pieces at words chosen by their hash, so equal
passages are cut alike wherever they stand. A span is the shortest run of several consecutive pieces
that holds enough words: one starts at every piece and one ends at every piece, so the spans inside any
repeated run cover it. Spans are hashed and joined over all documents. Pieces that any span covers which
has occurred before, in an earlier document or earlier in the same one, are removed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textfix.llm.common import attach
from textfix.session import materialize

SENTENCES, WORDS = 2, 20
# A long sentence is cut at least once in so many consecutive words.
CUT_WORDS = 8
# Texts whose spans are listed together.
SLICE_ROWS = 1000
# A sentence with the white space after it: up to its end marks or the end of its line.
_PIECE = regex.compile(r"[^.!?。！？\n]*+(?:[.!?。！？]++[\"'”’»)\]]*+(?=\s|$)|\n|$|[.!?。！？]++)\s*+")
# Letters and digits; a split gives what is between the words and the words in turn.
_WORD = re.compile(r"([^\W_]+)")


def _fold(piece: str) -> str:
    """Lower case, character by character."""
    low = piece.lower()
    return low if len(low) == len(piece) else "".join(c.lower() if len(c.lower()) == 1 else c for c in piece)


@lru_cache(1 << 17)
def _rank(word: str) -> int:
    return xxhash.xxh32_intdigest(word)


def _cuts(words: list[str]) -> list[int]:
    """The words before which a sentence is cut: of any CUT_WORDS consecutive ones the least by hash."""
    ranks = np.fromiter(map(_rank, words), np.uint64, len(words))
    # Rank and place in one number: the least of a window has the least rank, the first of equal ones.
    low = (ranks << np.uint64(32)) | np.arange(len(words), dtype=np.uint64)
    span = 1
    while span < CUT_WORDS:  # low[i] becomes the least of the ``span`` numbers from i on
        step = min(span, CUT_WORDS - span)
        low = np.minimum(low[:-step], low[step:])
        span += step
    places = low & np.uint64(0xFFFFFFFF)  # never falls, as windows move on
    return places[np.append(True, places[1:] != places[:-1])].tolist()


def _cut(text: str) -> tuple[list[str], list[list[str]]]:
    """Pieces that give the text when joined, and the words of each."""
    pieces, found = [], []
    for piece in filter(None, _PIECE.findall(text)):
        parts = _WORD.split(_fold(piece))
        words = parts[1::2]
        if len(words) <= WORDS:
            pieces.append(piece)
            found.append(words)
            continue
        ends = list(accumulate(map(len, parts)))  # word k begins at ends[2 * k]
        begin = first = 0
        for k in _cuts(words):
            if k:
                pieces.append(piece[begin : ends[2 * k]])
                found.append(words[first:k])
                begin, first = ends[2 * k], k
        pieces.append(piece[begin:])
        found.append(words[first:])
    return pieces, found


def sentences(text: str) -> list[str]:
    """Pieces that give the text when joined: sentences, long ones cut."""
    return _cut(text)[0]


def spans(
    pieces: list[str], least: int = SENTENCES, words: int = WORDS
) -> tuple[list[int], list[int], list[int]]:
    """Start, length and 128-bit hash of the spans that start or end at a piece, each once, in order.

    Only words count, without case. Pieces without words belong to the span that they stand in but
    add nothing to it.
    """
    starts, lengths, hashes = _spans([_WORD.findall(_fold(piece)) for piece in pieces], least, words)
    return starts, lengths, [int.from_bytes(h, "big") for h in hashes]


def _spans(found: list[list[str]], least: int, words: int) -> tuple[list[int], list[int], list[bytes]]:
    solid = [i for i, w in enumerate(found) if w]
    runs = set()
    end = total = 0  # the window is solid[k:end] with ``total`` words
    for k, i in enumerate(solid):
        while end < len(solid) and (total < words or end - k < least):
            total += len(found[solid[end]])
            end += 1
        if total < words or end - k < least:
            break
        runs.add((k, end))
        total -= len(found[i])
    k = total = 0
    for end, i in enumerate(solid, 1):
        total += len(found[i])
        while end - k > least and total - len(found[solid[k]]) >= words:
            total -= len(found[solid[k]])
            k += 1
        if total >= words and end - k >= least:
            runs.add((k, end))
    ordered = sorted(runs)
    digests = b"".join([xxhash.xxh3_128_digest(" ".join(found[i])) for i in solid])
    return (
        [solid[k] for k, _ in ordered],
        [solid[end - 1] - solid[k] + 1 for k, end in ordered],
        [xxhash.xxh3_128_digest(digests[16 * k : 16 * end]) for k, end in ordered],
    )


def span_rows(
    df: DataFrame, id_col: str = "doc_id", text: str = "text", least: int = SENTENCES, words: int = WORDS
) -> DataFrame:
    """(doc, mark, key, check, start, length, ends): the spans of each text; ``mark`` is a hash of the text.

    Spans that repeat an earlier one of the text have no key. A row without start has the number of
    pieces as its length, and the places where they end. Of a row whose id is NULL only what has no key
    is listed.
    """
    names = ["doc", "mark", "key", "check", "start", "length", "ends"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(k, SLICE_ROWS) for whole in batches for k in range(0, len(whole), SLICE_ROWS)):
            # A row for each text, then those of all its spans.
            at, digests, keyless = [], [], []
            starts, lengths, ends = [], [], []
            docs = batch.column(0).to_pylist()
            for row, value in enumerate(batch.column(1)):
                pieces, found = _cut(value.as_py() or "")
                at.append(row)
                digests.append(bytes(16))
                keyless.append(True)
                starts.append(None)
                lengths.append(len(pieces))
                ends.append(list(accumulate(map(len, pieces))))
                seen: set[bytes] = set()
                for start, length, hashed in zip(*_spans(found, least, words), strict=True):
                    again = hashed in seen
                    if again or docs[row] is not None:
                        at.append(row)
                        digests.append(hashed)
                        keyless.append(again)
                        starts.append(start)
                        lengths.append(length)
                        ends.append(None)
                    seen.add(hashed)
            raw, hidden = b"".join(digests), np.array(keyless, bool)
            place, words_of = pa.array(at, pa.int64()), np.frombuffer(raw, "<i8").reshape(-1, 2)
            check = np.frombuffer(raw, "<i4").reshape(-1, 4)[:, 2]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(place), batch.column(2).take(place),
                    pa.array(words_of[:, 0], mask=hidden), pa.array(check, mask=hidden),
                    pa.array(starts, pa.int32()), pa.array(lengths, pa.int32()), pa.array(ends, pa.list_(pa.int32())),
                ],
                names,
            )

    schema = "doc long, mark long, key long, check int, start int, length int, ends array<int>"
    return df.select(F.col(id_col).cast("long"), text, F.xxhash64(text)).mapInArrow(run, schema)


def repeated_spans(rows: DataFrame) -> DataFrame:
    """(doc, mark, start, length) of the spans whose first occurrence is in a document with a smaller id."""
    rows = rows.where(F.col("key").isNotNull())
    many = rows.groupBy("key", "check").agg(F.min("doc").alias("first"), F.count(F.lit(1)).alias("n"))
    many = materialize(many.where(F.col("n") > 1), "spans-many")
    held = attach(rows, many, ["key", "check"], "n").where(F.col("doc") > F.col("first"))
    return held.select("doc", "mark", "start", "length")


def remove_repeats(
    df: DataFrame, id_col: str = "doc_id", text: str = "text", least: int = SENTENCES, words: int = WORDS
) -> DataFrame:
    """(id, text, n_sentences, n_removed, removed, changed) per row of ``df``.

    ``text`` lacks the pieces of repeated spans, ``removed`` lists their numbers from 0 and
    ``n_sentences`` counts all pieces (sentences, long ones cut). Documents are in order of their ids,
    which are longs; rows that repeat an id are one document and lose the same pieces where their texts
    are the same. A row whose id is NULL is compared only with itself. A NULL text stays NULL and has
    no pieces. What has no run of ``least`` pieces and ``words`` words is never removed.
    """
    rows = materialize(span_rows(df, id_col, text, least, words), "spans")
    found = repeated_spans(rows).withColumn("ends", F.lit(None).cast("array<int>"))
    repeats = found.unionByName(rows.where(F.col("key").isNull()).drop("key", "check"))
    repeats = repeats.groupBy("doc", "mark").agg(
        F.max(F.when(F.col("start").isNull(), F.col("length"))).alias("n"),
        F.first("ends", ignorenulls=True).alias("ends"),
        F.collect_set(F.when(F.col("start").isNotNull(), F.struct("start", "length"))).alias("spans"),
    )
    repeats = materialize(repeats, "spans-repeats")
    left = df.select(F.col(id_col).alias("id"), F.col(text).alias("text"), F.xxhash64(text).alias("_mark"))
    joined = left.join(
        repeats, F.col("id").eqNullSafe(F.col("doc")) & (F.col("_mark") == F.col("mark"))
    ).select("id", "text", "n", "spans", "ends")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # Texts that lose nothing stay as they are, in Arrow.
            changed = pc.greater(pc.list_value_length(batch.column(3)), 0)
            texts, gone = [], [[]] * len(batch)
            for row in np.flatnonzero(changed.to_numpy(zero_copy_only=False)).tolist():
                found = batch.column(3)[row].values
                first, size = (found.field(k).to_pylist() for k in ("start", "length"))
                taken = {k for a, n in zip(first, size, strict=True) for k in range(a, a + n)}
                text, bounds = batch.column(1)[row].as_py(), [0, *batch.column(4)[row].as_py()]
                texts.append("".join(text[bounds[i] : bounds[i + 1]] for i in range(len(bounds) - 1) if i not in taken))
                gone[row] = sorted(taken)
            kept = pc.replace_with_mask(batch.column(1), changed, pa.array(texts, pa.string()))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), kept, batch.column(2),
                    pa.array([len(g) for g in gone], pa.int32()), pa.array(gone, pa.list_(pa.int32())),
                    pa.array([bool(g) for g in gone]),
                ],
                [id_col, "text", "n_sentences", "n_removed", "removed", "changed"],
            )

    return joined.mapInArrow(
        run, f"`{id_col}` long, text string, n_sentences int, n_removed int, removed array<int>, changed boolean"
    )
