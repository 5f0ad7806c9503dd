"""Secret scans: fixed patterns, and values in a credential context judged by their guess cost.

Values that follow words such as ``password`` or stand in the user part of an address are split into
dictionary words, dates, repeats, keyboard walks and brute-force spans. Dynamic programming finds the
split that an attacker would need the fewest guesses for; a value is reported if even that split takes
``HARD_BITS`` or more. The dictionary is counted from all texts of the table.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textfix.session import materialize

KINDS = ("assign", "access", "hex", "guess")
# Fixed patterns and least lengths.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_LEAST, ACCESS_LEAST = 6, 20

# Values that the guess cost is asked for: after a credential word and a link, or in an address.
CONTEXT = re.compile(
    r"""(?:(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|credentials?|(?:api|access|private)[_-]?key"""
    r"""|auth(?:orization)?|login)["']?(?:\x20*(?:[:=]=?>?|->)\x20*|\x20(?:is|was)\x20)(?:(?:bearer|basic)\x20+)?"""
    r"""|bearer\x20+)["']?([^\x00-\x20"'<>(){}\[\],;]+)""",
    re.I | re.A,
)
ADDRESS = re.compile(r"""://[^\x00-\x20/@:"'<>]*:([^\x00-\x20/@"'<>]+)@""")
VALUE_LEAST = 6
# 10 ** 10 guesses.
HARD_BITS = 10 * math.log2(10)

# A dictionary word is one of at least 2 ** -DICTIONARY_BITS of all words, so there are at most
# 2 ** DICTIONARY_BITS of them whatever the data.
DICTIONARY_BITS, WORD_LEAST, WORD_MOST = 17, 3, 32
# Passwords that attackers try first, by rank.
COMMON = (
    "password", "qwerty", "abc", "iloveyou", "admin", "welcome", "monkey", "login", "princess", "dragon",
    "letmein", "master", "hello", "freedom", "whatever", "trustno", "root", "test", "guest", "secret",
    "changeme", "default", "pass", "user", "shadow", "sunshine", "football", "baseball", "superman", "batman",
)
# Rows of keys, for walks along or between them, and two sequences.
ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
SHIFTED = ("~!@#$%^&*()_+", "QWERTYUIOP{}|", 'ASDFGHJKL:"', "ZXCVBNM<>?")
SEQUENCES = ("abcdefghijklmnopqrstuvwxyz", "0123456789")
# Characters written for letters.
LOOKALIKE = str.maketrans("@4301$57!", "aaeolssti")

KIND_BITS = math.log2(5)
WALK_START, STEP_ON, STEP_TURN = math.log2(47), 1.0, 3.0
REPEAT_UNIT = 8
DATE = re.compile(
    r"(?:19|20)\d\d([-/._]?)(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12]\d|3[01])"
    r"|(?:0[1-9]|[12]\d|3[01])([-/._]?)(?:0[1-9]|1[0-2])\2(?:19|20)\d\d"
    r"|(?:0[1-9]|1[0-2])([-/._]?)(?:0[1-9]|[12]\d|3[01])\3(?:19|20)\d\d"
)
YEAR = re.compile(r"(?:19|20)\d\d")
DATE_BITS, YEAR_BITS, SEPARATOR_BITS = math.log2(200 * 366 * 3), math.log2(200), 2.0


def _places() -> dict[str, list[tuple[str, float, float]]]:
    """Where each character stands: the layout and its coordinates; rows are shifted by half a key."""
    found: dict[str, list[tuple[str, float, float]]] = {}
    for y, pair in enumerate(zip(ROWS, SHIFTED, strict=True)):
        for row in pair:
            for x, char in enumerate(row):
                found.setdefault(char, []).append(("keys", x + y / 2, y))
    for name, row in zip(("letters", "digits"), SEQUENCES, strict=True):
        for x, char in enumerate(row):
            found.setdefault(char, []).append((name, x, 0))
    return found


_PLACES = _places()


def step(a: str, b: str) -> set[tuple[str, float, float]]:
    """The directions from one character to a neighbour, by layout; empty if there is none."""
    found = set()
    for name, x, y in _PLACES.get(a, ()):
        for other, u, v in _PLACES.get(b, ()):
            if name == other and abs(u - x) <= 1 and abs(v - y) <= 1 and (u, v) != (x, y):
                found.add((name, u - x, v - y))
    return found


def char_bits(char: str) -> float:
    """Guess cost of a character by brute force, from the size of its class."""
    if char.isascii():
        size = 10 if char.isdigit() else 26 if char.isalpha() else 33
    else:
        size = 1 << 11
    return math.log2(size)


def word_bits(piece: str, words: dict[str, float]) -> float | None:
    """Cost of a piece as a dictionary word: its rarity, its capitals and characters for letters."""
    low = piece.lower()
    plain = low.translate(LOOKALIKE)
    bits = words.get(low)
    if bits is None and plain != low:
        bits = words.get(plain)
        if bits is not None:
            bits += sum(a != b for a, b in zip(low, plain, strict=True))
    if bits is None:
        return None
    capitals = sum(c.isupper() for c in piece)
    if capitals:
        bits += 1 if capitals == len(piece) or piece[0].isupper() and capitals == 1 else capitals + 1
    return bits


def date_bits(piece: str) -> float | None:
    """Cost of a piece that is a year or a date as a whole."""
    if YEAR.fullmatch(piece):
        return YEAR_BITS
    match = DATE.fullmatch(piece)
    return None if match is None else DATE_BITS + (SEPARATOR_BITS if any(match.groups()) else 0)


def unit_bits(unit: str, words: dict[str, float]) -> float:
    """Cost of what a repeat repeats: a word or brute force."""
    brute = sum(map(char_bits, unit))
    word = word_bits(unit, words)
    return brute if word is None else min(brute, word)


def guess_bits(value: str, words: dict[str, float], enough: float = math.inf) -> float:
    """Logarithm of the guesses for the cheapest split of a value; each span adds the choice of its kind.

    A repeat is the longest repetition of up to ``REPEAT_UNIT`` characters that ends at its end. Ends
    early with at least ``enough`` once no split can get below it.
    """
    n = len(value)
    best = [0.0] + [math.inf] * n
    brute = walk_one = walk_more = math.inf  # cheapest split whose last span ends here and is of that kind
    ways: set[tuple[str, float, float]] = set()
    same = [0] * (REPEAT_UNIT + 1)  # by unit: how many of the last characters equal those a unit before
    span = max(WORD_MOST, REPEAT_UNIT, 10)
    for i in range(1, n + 1):
        char = value[i - 1]
        brute = min(best[i - 1] + KIND_BITS, brute) + char_bits(char)
        steps = step(value[i - 2], char) if i > 1 else set()
        on = bool(steps & ways)
        walk_more = min(walk_one + STEP_TURN, walk_more + (STEP_ON if on else STEP_TURN)) if steps else math.inf
        walk_one, ways = best[i - 1] + KIND_BITS + WALK_START, steps
        found = min(brute, walk_one, walk_more)
        for size in range(WORD_LEAST, min(WORD_MOST, i) + 1):
            piece = value[i - size : i]
            bits = word_bits(piece, words)
            if bits is not None:
                found = min(found, best[i - size] + KIND_BITS + bits)
            if size in (4, 8, 10) and (bits := date_bits(piece)) is not None:
                found = min(found, best[i - size] + KIND_BITS + bits)
        for unit in range(1, min(REPEAT_UNIT, i - 1) + 1):
            same[unit] = same[unit] + 1 if value[i - 1 - unit] == char else 0
            times = same[unit] // unit + 1
            if times > 1:
                bits = unit_bits(value[i - unit : i], words) + math.log2(times)
                found = min(found, best[i - times * unit] + KIND_BITS + bits)
        best[i] = found
        if i > span and min(best[i - span : i + 1]) >= enough:
            return enough
    return best[n]


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of what the fixed patterns match, by start, then kind."""
    found = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    found += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_LEAST]
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def values(text: str) -> list[tuple[int, int]]:
    """(start, end) of the values in a credential context, without end marks of a sentence."""
    found = {m.span(1) for pattern in (CONTEXT, ADDRESS) for m in pattern.finditer(text)}
    cut = {(a, b - len(text[a:b]) + len(text[a:b].rstrip(".!?:"))) for a, b in found}
    return sorted((a, b) for a, b in cut if b - a >= VALUE_LEAST)


def secret_spans(text: str, words: dict[str, float], hard: float = HARD_BITS) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, bits): the base spans, and hard values that touch none of them.

    ``bits`` is the guess cost up to ``hard`` of a value in a credential context; other spans have 0.
    """
    base = base_spans(text)
    spans, ends = [], []
    for kind, start, end in base:
        value = ASSIGN.match(text, start)[2] if kind == "assign" else ""
        spans.append((kind, start, end, guess_bits(value, words, hard)))
        ends.append(max(end, ends[-1]) if ends else end)  # the furthest end so far
    starts, last = [s[1] for s in base], 0
    for a, b in values(text):
        k = bisect_left(starts, b)
        if a < last or k and ends[k - 1] > a:
            continue
        bits = guess_bits(text[a:b], words, hard)
        if bits >= hard:
            spans.append(("guess", a, b, bits))
            last = b
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def dictionary(df: DataFrame, text: str = "text") -> dict[str, float]:
    """Guess cost in bits of the words that hold at least 2 ** -DICTIONARY_BITS of all words of the table.

    Words are runs of 3 to 32 letters a to z, counted in every whole text, upper case as lower. The
    share bounds the dictionary, not the data. Passwords tried first cost what their rank says.
    """
    pieces = F.explode(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), "[^a-z]+")).alias("word")
    counted = df.select(pieces).where(F.length("word").between(WORD_LEAST, WORD_MOST))
    counted = materialize(counted.groupBy("word").agg(F.count(F.lit(1)).alias("n")), "secret-words")
    total = counted.agg(F.sum("n")).first()[0] or 0
    rows = counted.where(F.col("n") * (1 << DICTIONARY_BITS) >= total).toArrow()
    bits = [math.log2(total / n) for n in rows.column("n").to_pylist()]
    words = dict(zip(rows.column("word").to_pylist(), bits, strict=True))
    for rank, word in enumerate(COMMON, 1):
        words[word] = min(words.get(word, math.inf), math.log2(rank + 1))
    return words


def find_secrets(df: DataFrame, id_col: str = "doc_id", text: str = "text", hard: float = HARD_BITS) -> DataFrame:
    """(id, secrets) per row of ``df``: kind, start and end (code points, end exclusive) and bits.

    Every whole text is read, NULL as empty. ``bits`` is the guess cost of an assigned or found value,
    counted up to ``hard``, and 0 for keys and hex runs. Found values never touch a span of a fixed
    pattern; those stay whatever they cost. Ids may repeat or be NULL: each row gives one row.
    """
    words = df.sparkSession.sparkContext.broadcast(dictionary(df, text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("bits", pa.float64())]))
        for batch in batches:
            found = [
                [dict(zip(("kind", "start", "end", "bits"), s, strict=True)) for s in secret_spans(t.as_py() or "", words.value, hard)]
                for t in batch.column(1)
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], [id_col, "secrets"])

    id_type = df.schema[id_col].dataType.simpleString()
    spans = "array<struct<kind:string,start:bigint,end:bigint,bits:double>>"
    return df.select(id_col, text).mapInArrow(run, f"`{id_col}` {id_type}, secrets {spans}")


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, n_assign, n_access, n_hex, base_sha256, spans) of the result of :func:`find_secrets`."""
    spans = F.col("secrets")
    base = F.filter(spans, lambda s: s["kind"] != "guess")

    def listed(of):
        return F.array_join(F.transform(of, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    kinds = F.transform(spans, lambda s: s["kind"])
    counts = [
        (F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in KINDS[:3]
    ]
    return found.select(id_col, *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(spans).alias("spans"))
