"""Row-local text functions. Each maps Columns to a Column and stays in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from textfix.config import SpellConfig

# The code points counted as white space.
_WS_RANGES = [
    (0x09, 0x0D), (0x1C, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A),
    (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000),
]
WS = "".join(rf"\x{{{lo:x}}}-\x{{{hi:x}}}" for lo, hi in _WS_RANGES)
WS_CHARS = "".join(chr(c) for lo, hi in _WS_RANGES for c in range(lo, hi + 1))
# A character of a word. Classes of many ranges are slow to match: the parts are tried in turn. So visible
# ASCII comes first, and single Latin-1 characters, which Java looks up in a table, settle the usual rest.
NOT_WS = f"[!-~[^{WS}]]"
WS_TABLE = "".join(rf"\x{ord(c):02x}" for c in WS_CHARS if ord(c) < 256)
TOKEN_BODY = f"(?:[!-~]++(?:(?![{WS_TABLE}]){NOT_WS}++)?+|(?![{WS_TABLE}]){NOT_WS}++)"
# A word character, and the brackets, quotes and marks peeled before masking.
WORD = r"\p{L}\p{N}_"
OPENERS = "([{\"'“‘"
CLOSERS = ")]}\"'”’.,;:!?"
# Digit characters outside \p{Nd} (super- and subscripts, circled digits, ...).
OTHER_DIGITS = (
    r"\x{b2}\x{b3}\x{b9}\x{1369}-\x{1371}\x{19da}\x{2070}\x{2074}-\x{2079}\x{2080}-\x{2089}"
    r"\x{2460}-\x{2468}\x{2474}-\x{247c}\x{2488}-\x{2490}\x{24ea}\x{24f5}-\x{24fd}\x{24ff}"
    r"\x{2776}-\x{277e}\x{2780}-\x{2788}\x{278a}-\x{2792}"
)
# The words and contractions (apostrophe removed) that count as a negation.
NEGATION_WORDS = (
    "not no never none nobody nothing nowhere neither nor without cannot"
).split()
NEGATION_CONTRACTIONS = (
    "dont doesnt didnt isnt arent wasnt werent wont cant couldnt shouldnt wouldnt hasnt havent "
    "hadnt aint mustnt neednt wouldve"
).split()

TOKEN_RE = f"{TOKEN_BODY}|[{WS}]+"
PIECE_RE = f"{TOKEN_BODY}[{WS}]*+|[{WS}]+"
WORD_RE = TOKEN_BODY
# Possessive groups keep the matcher iterative on very long tokens.
PLAIN_BODY = r"[A-Za-z]++(?:['\-][A-Za-z]++)*+"
PLAIN_RE = rf"^{PLAIN_BODY}\z"
# Marks around a core; letters, digits and white space of Latin-1 are ruled out by table first.
_NO_MARK = "".join(rf"\x{c:02x}" for c in range(128) if chr(c).isalnum() or chr(c) == "_") + WS_TABLE
MARKS = f"(?:(?![{_NO_MARK}])[^{WORD}{WS}]++)?+"
# The core of a token that is a plain word once the marks around it are peeled off.
PLAIN_CORE_RE = (
    rf"(?:(?<=[{WS_TABLE}])|(?<!{NOT_WS})){MARKS}({PLAIN_BODY}){MARKS}(?:(?=[{WS_TABLE}])|(?!{NOT_WS}))"
)
# A piece (PIECE_RE) whose group is the core of a plain word; other pieces have none.
PIECE_CORE_RE = rf"(?:{MARKS}({PLAIN_BODY}){MARKS}(?:(?=[{WS_TABLE}])|(?!{NOT_WS}))|{TOKEN_BODY})[{WS}]*+|[{WS}]+"
PEEL_RE = rf"(?s)^([^{WORD}]*+)(.*?)([^{WORD}]*)\z"
# A word without anything to peel off.
BARE_RE = r"^[A-Za-z0-9_]++\z"
DOMAIN_RE = r"^(?:[A-Za-z0-9\-]{2,}+\.)++[A-Za-z]{2,6}\z"
DIGIT_RE = rf"[\p{{Nd}}{OTHER_DIGITS}]"
# Found in every text that holds a structured span, and in few others.
MAYBE_STRUCTURED_RE = rf"(?i)[@#/]|http|www\.|[A-Za-z0-9\-]{{2}}\.[A-Za-z]{{2}}|{DIGIT_RE}"
SENTENCE_RE = r"[^.!?]+[.!?]*"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it many times in ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WS_CHARS))


def tokens(text: Column) -> Column:
    """Alternating word and white-space chunks; their concatenation is the text."""
    return F.regexp_extract_all(text, F.lit(TOKEN_RE), F.lit(0))


def is_space(token: Column) -> Column:
    return F.length(strip(token)) == 0


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD_RE), F.lit(0))


def word_count(text: Column) -> Column:
    return F.size(words(text))


def peel(token: Column) -> Column:
    """Split the non-word characters off both ends: STRUCT<pre, core, post>."""
    return F.struct(
        F.regexp_extract(token, PEEL_RE, 1).alias("pre"),
        F.regexp_extract(token, PEEL_RE, 2).alias("core"),
        F.regexp_extract(token, PEEL_RE, 3).alias("post"),
    )


def peel_protect(token: Column) -> Column:
    """Split only brackets, quotes and sentence marks off both ends: STRUCT<pre, core, post>."""
    rest = F.ltrim(token, F.lit(OPENERS))
    core = F.rtrim(rest, F.lit(CLOSERS))
    return F.struct(
        F.left(token, F.length(token) - F.length(rest)).alias("pre"),
        core.alias("core"),
        F.right(rest, F.length(rest) - F.length(core)).alias("post"),
    )


def is_plain_word(core: Column) -> Column:
    return core.rlike(PLAIN_RE)


def plain_cores(text: Column) -> Column:
    """Cores of all tokens that are plain words, in text order, as typed."""
    return F.regexp_extract_all(text, F.lit(PLAIN_CORE_RE), F.lit(1))


def plain_core(token: Column) -> Column:
    """Core of one token if it is a plain word, else the empty string."""
    return F.regexp_extract(token, PLAIN_CORE_RE, 1)


def word_cores(text: Column) -> Column:
    """Set of lower-cased plain words of a text."""
    return F.array_distinct(F.transform(plain_cores(text), F.lower))


def case_allows(core: Column, cfg: SpellConfig) -> Column:
    """Length and capitals rules for a core already known to be a plain word."""
    shouted = (F.upper(core) == core) & (F.length(core) > 1)
    allowed = F.length(core) >= cfg.min_token_len
    if cfg.allcaps_min_len > cfg.min_token_len:
        allowed = allowed & ((F.length(core) >= cfg.allcaps_min_len) | ~shouted)
    if not cfg.correct_capitalized:
        allowed = allowed & (shouted | ~core.rlike("^[A-Z]"))
    return allowed


def is_correctable(core: Column, cfg: SpellConfig | None = None) -> Column:
    return is_plain_word(core) & case_allows(core, cfg or SpellConfig())


def is_structured(core: Column) -> Column:
    """Addresses, handles, tags, links, paths, domains and anything holding a digit."""
    low = F.lower(core)
    return (F.length(core) > 0) & (
        core.contains("@")
        | core.startswith("#")
        | low.startswith("http")
        | low.startswith("www.")
        | core.contains("/")
        | core.rlike(DIGIT_RE)
        | core.rlike(DOMAIN_RE)
    )


def _is_upper(text: Column) -> Column:
    return (F.upper(text) == text) & (F.lower(text) != text)


def match_case(original: Column, replacement: Column) -> Column:
    """Project the capitals of ``original`` on ``replacement``."""
    return (
        F.when(_is_upper(original), F.upper(replacement))
        .when(
            _is_upper(F.left(original, F.lit(1))),
            F.concat(
                F.upper(F.left(replacement, F.lit(1))), F.substr(replacement, F.lit(2))
            ),
        )
        .otherwise(replacement)
    )


def normalize(text: Column) -> Column:
    """Form used for lenient matching: case, spacing and final marks do not count."""
    lowered = F.lower(strip(F.coalesce(text, F.lit(""))))
    return strip(F.rtrim(F.regexp_replace(lowered, f"[{WS}]+", " "), F.lit(".!?")))


def sentences(text: Column) -> Column:
    pieces = F.transform(F.regexp_extract_all(text, F.lit(SENTENCE_RE), F.lit(0)), strip)
    return F.filter(pieces, lambda s: s != "")


def negation_count(text: Column) -> Column:
    bare = F.translate(F.lower(text), "'’`", "")
    found = F.regexp_extract_all(bare, F.lit("[a-z]+"), F.lit(0))
    return F.size(F.filter(found, lambda w: w.isin(NEGATION_WORDS + NEGATION_CONTRACTIONS)))


def replace_first(text: Column, find: Column, replacement: Column) -> Column:
    """Replace the first occurrence of a literal; without one the text is kept."""
    at = F.position(find, text)
    return F.when(
        at > 0,
        F.concat(
            F.left(text, at - 1), replacement, F.substr(text, at + F.length(find))
        ),
    ).otherwise(text)
