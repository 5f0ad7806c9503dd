"""Token counts by a finite-state transducer.

A byte-level BPE tokenizer is compiled into a deterministic transducer whose transitions carry the
number of tokens that a character adds (it may be negative: a character can complete a longer token).
A state is what the rest of a text can depend on:

* what kind of pre-token is open,
* the longest end of it that starts some token,
* for each place in that end the last token of the text up to there and how many tokens less that is.

The last token up to a place is the only one whose left neighbour, the last token up to its start,
keeps it apart under the merges. States are made when first reached and held in a bounded table; the
composed transition of a whole word, which starts and ends in the first state, is remembered too.

Texts are cut into chunks. A chunk's map says what it does to any state before it: the characters up
to the first white space after something else, where every state becomes the same, must be read from
the state before; the count from there to the open end is fixed. Maps compose associatively, and a
prefix scan of them gives the count of the text.
"""

from __future__ import annotations

import gc
import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# States held per Python worker, pairs whose neighbourhood is remembered, characters in a chunk.
STATES, PAIRS, CHUNK = 150_000, 500_000, 1 << 14
# Words whose composed transitions are remembered, and the mean length from which they are not.
WORDS, LONG_WORD = 400_000, 48
LETTER, NUMBER, SPACE, OTHER = "LNWP"
_KINDS = [(regex.compile(r"\p{L}"), LETTER), (regex.compile(r"\p{N}"), NUMBER), (regex.compile(r"\s"), SPACE)]
# Words with their white space: each ends where a pre-token ends and every state becomes the first.
_UNIT = regex.compile(r" ?\p{L}++(?!')| ?\S+|\s+(?!\S)|\s+")
_SYNC = regex.compile(r"(?<=\S)\s")
# What can follow an apostrophe that starts a pre-token.
SHORT, LONG = "stmd", {"r": "e", "v": "e", "l": "l"}

Open = tuple[bytes, tuple[int, ...], tuple[int, ...]]  # end of the pre-token, last tokens, counts
NOTHING: Open = (b"", (-1,), (0,))
APOSTROPHE, CONTRACTION, START = "Q", "C", "S"


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in vocabulary files: printable bytes for themselves, the
    others for the letters from 256 on, in order."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


class Transducer:
    """Compiled from the vocabulary and merges of a tokenizer file (JSON) of byte-level BPE."""

    def __init__(self, packed: bytes):
        spec = json.loads(packed)
        model = spec["model"]
        letters = byte_letters()

        def raw(token: str) -> bytes:
            return bytes(letters[c] for c in token)

        self.tokens = {raw(t): i for t, i in model["vocab"].items() if all(c in letters for c in t)}
        self.bytes_of = {i: t for t, i in self.tokens.items()}
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            a, b = raw(a), raw(b)
            self.merges[self.tokens[a], self.tokens[b]] = (rank, self.tokens[a + b])
        self.starts = {t[:n] for t in self.tokens for n in range(1, len(t) + 1)}
        special = [t["content"] for t in spec.get("added_tokens", ())]
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.pairs: dict[tuple[int, int], bool] = {}
        self.ends: dict[bytes, tuple[list[tuple[int, int]], int]] = {}
        self.kinds: dict[str, str] = {}
        self.words: dict[str, int] = {}
        self.clear()

    def clear(self) -> None:
        for row in getattr(self, "states", {}).values():
            row.clear()  # rows refer to each other
        self.states: dict[tuple, dict] = {}
        self.start = self.state((START, NOTHING, None))

    def state(self, key: tuple) -> dict:
        """The transitions of a state by character; under None its key."""
        found = self.states.get(key)
        if found is None:
            found = self.states[key] = {None: key}
        return found

    def merged(self, ids: list[int]) -> list[int]:
        """Plain merging, for a pair of tokens at a time."""
        while len(ids) > 1:
            ranked = [self.merges.get(p, (1 << 60, 0)) for p in zip(ids, ids[1:], strict=False)]
            rank, token = min(ranked)
            if rank == 1 << 60:
                break
            at = ranked.index((rank, token))
            ids = [*ids[:at], token, *ids[at + 2 :]]
        return ids

    def apart(self, left: int, token: int) -> bool:
        """Whether merging gives just these two tokens; without a left one, just the token."""
        found = self.pairs.get((left, token))
        if found is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            before = b"" if left < 0 else self.bytes_of[left]
            single = [self.tokens[bytes([b])] for b in before + self.bytes_of[token]]
            want = [token] if left < 0 else [left, token]
            found = self.pairs[left, token] = self.merged(single) == want
        return found

    def ending(self, end: bytes) -> tuple[list[tuple[int, int]], int]:
        """Tokens (length, id) that ``end`` ends with, and how much of its end starts some token."""
        found = self.ends.get(end)
        if found is None:
            if len(self.ends) >= PAIRS:
                self.ends.clear()
            tails = [(n, end[-n:]) for n in range(len(end), 0, -1)]
            tokens = [(n, self.tokens[t]) for n, t in tails if t in self.tokens]
            found = self.ends[end] = (tokens, next((n for n, t in tails if t in self.starts), 0))
        return found

    def extend(self, open_: Open, byte: int) -> tuple[Open, int]:
        """One more byte of the pre-token and the tokens that it adds."""
        end, last, counts = open_
        end += bytes((byte,))
        tokens, keep = self.ending(end)
        for n, token in tokens:
            left = last[-n]
            apart = self.pairs.get((left, token))
            if apart or apart is None and self.apart(left, token):
                count = counts[-n] + 1
                break
        else:
            raise ValueError("the vocabulary lacks a byte")
        last, counts = (*last, token)[-keep - 1 :], (*counts, count)[-keep - 1 :]
        if count:
            counts = tuple([c - count for c in counts])
        return (end[len(end) - keep :], last, counts), count

    def extended(self, open_: Open, text: str) -> tuple[Open, int]:
        total = 0
        for byte in text.encode():
            open_, more = self.extend(open_, byte)
            total += more
        return open_, total

    def kind(self, char: str) -> str:
        found = self.kinds.get(char)
        if found is None:
            found = next((k for pattern, k in _KINDS if pattern.match(char)), OTHER)
            self.kinds[char] = found
        return found

    def begin(self, char: str, blank: bool = False) -> tuple[tuple, int]:
        """A new pre-token, after a blank that belongs to it or not."""
        open_, count = self.extended(NOTHING, " " + char if blank else char)
        kind = self.kind(char)
        if kind == SPACE:
            return (SPACE, NOTHING, char), count
        return (APOSTROPHE if char == "'" and not blank else kind, open_, None), count

    def advance(self, key: tuple, char: str) -> tuple[tuple, int]:
        """The state after ``char`` and the tokens that it adds, if the text ended there."""
        mode, open_, held = key
        kind = self.kind(char)
        if mode == SPACE:  # ``held`` is the last white space, ``open_`` the run before it
            longer, with_held = self.extended(open_, held)
            if kind == SPACE:
                return (SPACE, longer, char), self.extended(longer, char)[1]
            state, count = self.begin(char, blank=held == " ")
            if held != " ":
                count += self.extended(NOTHING, held)[1]
            return state, count - with_held
        if mode == APOSTROPHE:
            if char in SHORT:
                whole = self.extended(NOTHING, "'" + char)[1]
                return (CONTRACTION, NOTHING, None), whole - self.extended(NOTHING, "'")[1]
            state, count = self.begin(char)
            if char in LONG:
                return (LETTER, state[1], char), count
            if kind != OTHER:
                return state, count
            mode = OTHER
        elif mode == LETTER and held is not None and char == LONG[held]:
            apart = self.extended(NOTHING, "'")[1] + self.extended(NOTHING, held)[1]
            return (CONTRACTION, NOTHING, None), self.extended(NOTHING, "'" + held + char)[1] - apart
        if mode == kind and kind != SPACE:
            longer, more = self.extended(open_, char)
            return (mode, longer, None), more
        return self.begin(char)

    def run(self, text: str) -> int:
        """Tokens of a text without special tokens, from the first state on."""
        words, known = _UNIT.findall(text), self.words
        for word in words:
            if word not in known:
                known[word] = self.walk(word)
        total = sum(map(known.__getitem__, words))
        if len(known) > WORDS or sum(map(len, words)) > LONG_WORD * len(words):
            known.clear()
        if len(self.states) > STATES:
            self.clear()
        return total

    def walk(self, text: str) -> int:
        """The transitions of a text, character by character."""
        state, total = self.start, 0
        for char in text:
            try:
                state, weight = state[char]
            except KeyError:
                key, weight = self.advance(state[None], char)
                state[char] = (self.state(key), weight)
                state = state[char][0]
            total += weight
        return total

    def count(self, text: str) -> int:
        """Tokens of a text; the strings of special tokens are one token each."""
        if self.special is None:
            return self.run(text)
        parts = self.special.split(text)
        return sum(map(self.run, parts)) + len(parts) - 1


@dataclass(frozen=True)
class ChunkMap:
    """What a chunk does to any state before it.

    ``head`` is read from that state. Without ``tail`` the chunk is all head; else ``inner`` tokens
    follow, and ``tail`` is open at the end.
    """

    head: str
    inner: int = 0
    tail: str | None = None


def chunk_map(machine: Transducer, chunk: str) -> ChunkMap:
    cuts = _SYNC.search(chunk)
    if cuts is None:
        return ChunkMap(chunk)
    first = cuts.start()
    last = max(m.start() for m in _SYNC.finditer(chunk, max(first, _last_solid(chunk))))
    return ChunkMap(chunk[:first], machine.count(chunk[first:last]), chunk[last:])


def _last_solid(chunk: str) -> int:
    """A place from which the last cut of the chunk is found."""
    spot, step = len(chunk), 64
    while spot > 0:
        spot = max(len(chunk) - step, 0)
        if _SYNC.search(chunk, spot):
            return spot
        step *= 4
    return 0


def compose(machine: Transducer, a: ChunkMap, b: ChunkMap) -> ChunkMap:
    """Chunk ``a`` and then chunk ``b``; associative."""
    if a.tail is None and b.tail is None:
        return ChunkMap(a.head + b.head)
    if a.tail is None:
        return _cut_head(machine, a.head + b.head, b)
    if b.tail is None:
        return ChunkMap(a.head, a.inner, a.tail + b.head)
    middle = machine.count(a.tail + b.head)
    return ChunkMap(a.head, a.inner + middle + b.inner, b.tail)


def _cut_head(machine: Transducer, head: str, b: ChunkMap) -> ChunkMap:
    """A head that may now hold white space after something else at the seam."""
    cut = _SYNC.search(head)
    if cut is None:
        return ChunkMap(head, b.inner, b.tail)
    return ChunkMap(head[: cut.start()], machine.count(head[cut.start() :]) + b.inner, b.tail)


def scan(machine: Transducer, maps: list[ChunkMap]) -> ChunkMap:
    """Composition of all maps, in rounds over neighbours."""
    while len(maps) > 1:
        paired = [compose(machine, *maps[i : i + 2]) for i in range(0, len(maps) - 1, 2)]
        maps = paired + maps[len(paired) * 2 :]
    return maps[0] if maps else ChunkMap("")


def count_text(machine: Transducer, text: str, chunk: int = CHUNK) -> int:
    """Tokens of a whole text."""
    if len(text) <= chunk:
        return machine.count(text)
    whole = scan(machine, [chunk_map(machine, text[i : i + chunk]) for i in range(0, len(text), chunk)])
    return machine.count(whole.head) + whole.inner + (machine.count(whole.tail) if whole.tail else 0)


_machines: dict[int, Transducer] = {}


def token_counts(
    df: DataFrame, tokenizer_path: str, limit: int = 1024, id_col: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) per row of ``df``.

    Tokens are counted as the tokenizer's own library does without begin and end tokens; the strings
    of its special tokens inside a text are one token each. A NULL text counts as empty.
    """
    with open(tokenizer_path, "rb") as file:  # a vocabulary: its size does not follow the data
        shared = df.sparkSession.sparkContext.broadcast(file.read())
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()  # nothing here makes cycles that grow, and collections walk all states
        key = hash(shared.value)
        if key not in _machines:
            _machines.clear()
            _machines[key] = Transducer(shared.value)
        machine = _machines[key]
        for batch in batches:
            texts = [t.as_py() or "" for t in batch.column(1)]
            sizes = pa.array([len(t.encode()) for t in texts], pa.int64())
            counts = np.array([count_text(machine, t) for t in texts], np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), sizes, pa.array(counts)], [id_col, "n_bytes", "n_tokens"]
            )

    out = df.select(id_col, text).mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
