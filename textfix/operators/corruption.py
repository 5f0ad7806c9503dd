"""Errors put into clean texts, to a given share of each type."""

from __future__ import annotations

from collections.abc import Callable
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textfix.session import materialize

Corruptor = Callable[[Column], Column]
# Keys are hexadecimal digests; counts by this many more digits narrow a search down at a time.
DIGITS, FEW = 3, 10_000
ALL, NONE = "g", ""


def _rewrite(pattern: str, replacement: str) -> Corruptor:
    return lambda text: F.regexp_replace(text, pattern, replacement)


def _lower_first(text: Column) -> Column:
    pattern = r"(?s)^([^A-Z]*)([A-Z])(.*)$"
    part = [F.regexp_extract(text, pattern, k) for k in (1, 2, 3)]
    return F.when(text.rlike("[A-Z]"), F.concat(part[0], F.lower(part[1]), part[2])).otherwise(text)


# Each makes one error, or returns the text as it is where it has no place for it.
CORRUPTORS: dict[str, Corruptor] = {
    "article": _rewrite(r"(?s)^(.*? )(?:the|an|a) ", "$1"),
    "word_order": _rewrite(r"^([A-Za-z]+) ([A-Za-z]+) ", "$2 $1 "),
    "apostrophe": _rewrite(r"(?s)^(.*?[A-Za-z])['’]([A-Za-z])", "$1$2"),
    "agreement": _rewrite(r"(?s)^(.*?[A-Za-z]{3})s ", "$1 "),
    "punctuation": _rewrite(r"(?s)[.!?,;:]([^.!?,;:]*)$", "$1"),
    "casing": _lower_first,
    "spelling": _rewrite(r"(?s)^(.*?[a-z])([a-z])([a-z])([a-z])", "$1$3$2$4"),
    "spacing": _rewrite(r"(?s)^(.*?[a-z]) ([a-z])", "$1$2"),
}


def quotas(mix: dict[str, float], rows: int) -> dict[str, int]:
    """Rows of each type, shares rounded half up."""
    shares = {kind: Fraction(str(share)) for kind, share in mix.items()}
    if any(s < 0 for s in shares.values()) or sum(shares.values()) > 1:
        raise ValueError("shares must not be negative and add up to one at most")
    return {kind: int(share * rows + Fraction(1, 2)) for kind, share in shares.items()}


def draw_key(kind: str, id_cols: list[str], seed: int) -> Column:
    """The place of a row in the random order of a type."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(kind), *[F.col(c).cast("string") for c in id_cols]))


def smallest(keys: DataFrame, key: str, n: int) -> str:
    """The bound below or at which ``n`` of the keys lie; all if there are no more.

    Keys are counted by their leading digits, deeper and deeper, until few are left to be sorted.
    """
    if n <= 0:
        return NONE
    prefix = ""
    while True:
        head = F.left(key, F.lit(len(prefix) + DIGITS))
        counts = keys.where(F.col(key).startswith(prefix)).groupBy(head.alias("head")).agg(F.count(F.lit(1)).alias("n"))
        for row in counts.orderBy("head").collect():  # 16 ** DIGITS rows at most
            if n <= row["n"]:
                prefix, inside = row["head"], row["n"]
                break
            n -= row["n"]
        else:
            return ALL
        if inside <= FEW or len(prefix) >= 30:
            part = keys.where(F.col(key).startswith(prefix)).select(key).orderBy(key)
            return part.offset(n - 1).limit(1).first()[0]


def corrupt(
    df: DataFrame,
    mix: dict[str, float],
    id_cols: list[str],
    text: str = "text",
    corruptors: dict[str, Corruptor] | None = None,
    seed: int = 0,
) -> DataFrame:
    """Add ``kind``, ``src`` (the text with one error of that type) and ``tgt`` (the clean text).

    ``mix`` gives the share of each type among all texts that are not NULL; the other texts stay as
    they are, with kind NULL. A type takes its quota exactly, in the order of a hash, from the texts
    that no type before it in ``mix`` has taken and that have a place for its error, or all of them if
    they are fewer: name rare types first. ``id_cols`` are a key; the same input and seed give the same
    rows. Only keys and flags are counted, the texts are rewritten where they are.
    """
    known = corruptors or CORRUPTORS
    flags = [(known[kind](F.col(text)) != F.col(text)).alias(f"_fits_{kind}") for kind in mix]
    narrow = materialize(df.where(F.col(text).isNotNull()).select(*id_cols, *flags), "corrupt")
    wanted = quotas(mix, narrow.count())
    taken, bounds = F.lit(False), {}
    for kind in mix:
        key = draw_key(kind, id_cols, seed)
        free = F.col(f"_fits_{kind}") & ~taken
        bounds[kind] = smallest(narrow.where(free).select(key.alias("_key")), "_key", wanted[kind])
        taken = taken | (F.col(f"_fits_{kind}") & (key <= bounds[kind]))
    kind_of, clean = F.lit(None).cast("string"), F.col(text)
    for kind in reversed(mix):
        fits = (known[kind](clean) != clean) & (draw_key(kind, id_cols, seed) <= bounds[kind])
        kind_of = F.when(fits, kind).otherwise(kind_of)
    chosen = df.withColumn("kind", kind_of)
    src = clean
    for kind in mix:
        src = F.when(F.col("kind") == kind, known[kind](clean)).otherwise(src)
    return chosen.withColumns({"src": src, "tgt": clean})


def mix_report(corrupted: DataFrame) -> DataFrame:
    """(kind, n, share) of a corrupted table; kind NULL are the clean texts."""
    kinds = corrupted.where(F.col("tgt").isNotNull()).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
    # A window over one row for each kind.
    return kinds.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))))
