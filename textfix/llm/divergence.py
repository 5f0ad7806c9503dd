"""Source divergence audit: how the words of a source differ from those of its language.

Terms are counted by sorting pointers. A task takes the bytes of a slice of texts as they lie in the
Arrow buffers, makes a pointer to the start of every term and sorts the pointers by multikey quicksort
with eight bytes as one character: each run of pointers with equal characters is a slice of its own,
sorted by the next eight. Runs that stay equal to the end are terms; their lengths and the documents
in them give the counts per source. Slices add up their counts before anything is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textfix.llm.common import attach
from textfix.session import materialize

LEAST_DOCS, SMOOTH, SCALE, TOP = 30, 5, 1_000_000_000, 50
# Bytes of text sorted together (one text is never split), and characters of eight bytes that are
# compared before the rest of long terms is compared as a whole.
SLICE_BYTES, DEEP = 1 << 23, 4
# Sources and terms of a block of the comparison.
TILE, SPAN = 128, 4096

_LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)
# By the number of bytes that belong to the term: the character without those behind it.
_MASKS = np.array([~((1 << 8 * (8 - k)) - 1) & (1 << 64) - 1 for k in range(9)], np.uint64)


def pointers(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, stops) of the terms in lower-cased bytes; no term goes beyond a text."""
    inside = (data >= 0x80) | ((data >= 0x61) & (data <= 0x7A))
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    full = offsets[1:] > offsets[:-1]
    begins, ends = offsets[:-1][full], offsets[1:][full] - 1
    first[begins], last[ends] = inside[begins], inside[ends]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def sort_pointers(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, opens): pointers in the order of their terms, and whether a new term opens at each."""
    n, lengths = len(starts), stops - starts
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    words = np.ndarray(len(data) + 1, ">u8", padded, 0, (1,))

    def character(which: np.ndarray, depth: int) -> np.ndarray:
        left = np.clip(lengths[which] - 8 * depth, 0, 8)
        at = np.minimum(starts[which] + 8 * depth, len(data))
        return words[at].astype(np.uint64) & _MASKS[left]

    order = np.arange(n)
    key = character(order, 0)
    order = np.argsort(key)
    key = key[order]
    opens = np.r_[True, key[1:] != key[:-1]][:n]
    for depth in range(1, DEEP + 1):
        begins = np.flatnonzero(opens)
        if not len(begins):
            break
        # Only runs of several pointers in which a term goes on are sorted further.
        goes_on = np.logical_or.reduceat(lengths[order] > 8 * depth, begins)
        sizes = np.diff(np.r_[begins, n])
        runs = np.repeat(goes_on & (sizes > 1), sizes)
        spots = np.flatnonzero(runs)
        if not len(spots):
            break
        which, run = order[spots], np.cumsum(opens)[spots]
        if depth < DEEP:
            key = character(which, depth)
            again = np.lexsort((key, run))
            key = key[again]
            differs = key[1:] != key[:-1]
        else:
            rest = [data[starts[k] + 8 * depth : stops[k]].tobytes() for k in which]
            again = sorted(range(len(which)), key=lambda k: (run[k], rest[k]))
            differs = np.array([rest[a] != rest[b] for a, b in zip(again[1:], again, strict=False)], bool)
        order[spots] = which[again]
        opens[spots[1:]] |= differs
    return order, opens


def slice_counts(texts: pa.Array, groups: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(terms, which, group, n, docs): for each term and group its occurrences and documents.

    ``texts`` are large strings without NULLs; ``which`` is the place in ``terms``.
    """
    _, bounds, raw = texts.buffers()
    offsets = np.frombuffer(bounds, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    size = int(offsets[-1] - offsets[0])
    data = _LOWER[np.frombuffer(raw, np.uint8, size, int(offsets[0]))] if size else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    starts, stops = pointers(data, offsets)
    order, opens = sort_pointers(data, starts, stops)
    begins = order[opens]
    terms = [data[starts[k] : stops[k]].tobytes() for k in begins]
    # Documents are numbered by group, so that a run in this order has its groups together.
    by_group = np.argsort(groups, kind="stable")
    number = np.empty(len(groups), np.int64)
    number[by_group] = np.arange(len(groups))
    doc = np.searchsorted(offsets, starts, side="right") - 1
    pairs = (np.cumsum(opens) - 1) << 32 | number[doc[order]]
    pairs.sort()
    which, group = pairs >> 32, groups[by_group][pairs & 0xFFFFFFFF]
    begins = np.flatnonzero(np.r_[True, (which[1:] != which[:-1]) | (group[1:] != group[:-1])][: len(pairs)])
    n = np.diff(np.r_[begins, len(pairs)])
    new_doc = np.r_[True, pairs[1:] != pairs[:-1]][: len(pairs)].astype(np.int64)
    docs = np.add.reduceat(new_doc, begins) if len(begins) else n
    return terms, which[begins], group[begins], n, docs


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lang, source = batch.column(0).dictionary_encode(), batch.column(1).dictionary_encode()
        wide = max(len(source.dictionary), 1)
        group = lang.indices.to_numpy().astype(np.int64) * wide + source.indices.to_numpy()
        texts = batch.column(2).cast(pa.large_string())
        ends = np.cumsum(np.diff(np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]))
        start = 0
        while start < len(texts):
            before = ends[start - 1] if start else 0
            stop = max(int(np.searchsorted(ends, before + SLICE_BYTES, side="right")), start + 1)
            terms, which, groups, n, docs = slice_counts(texts.slice(start, stop - start), group[start:stop])
            start = stop
            yield pa.RecordBatch.from_arrays(
                [
                    lang.dictionary.take(pa.array(groups // wide)), source.dictionary.take(pa.array(groups % wide)),
                    pa.array(terms, pa.string()).take(pa.array(which)), pa.array(n, pa.int64()), pa.array(docs, pa.int64()),
                ],
                ["lang", "source", "term", "n", "docs"],
            )


def term_counts(df: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, term, n, docs): occurrences of each term and the rows that hold it.

    Terms are runs of ASCII letters and of characters beyond ASCII, A-Z lower-cased. NULLs count as
    empty; a term may be as long as a text.
    """
    filled = df.select(*[F.coalesce(F.col(c), F.lit("")).alias(k) for k, c in (("lang", lang), ("source", source), ("text", text))])
    found = filled.mapInArrow(_count, "lang string, source string, term string, n long, docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (count + SMOOTH) / (total + SMOOTH * terms)) in whole numbers; NULL without terms."""
    whole = (count + SMOOTH).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)")
    parts = (total + SMOOTH * terms).cast("decimal(20,0)")
    return 1 + F.call_function("div", whole, F.nullif(parts, F.lit(0).cast("decimal(20,0)"))).cast("long")


def divergence(
    df: DataFrame, text: str = "text", lang: str = "lang", source: str = "source",
    least_docs: int = LEAST_DOCS, top: int = TOP,
) -> DataFrame:
    """(lang, source, part, item, value, rank) for each source of each language.

    Part ``pair`` has the distance to each other source of the language, part ``term`` the ``top``
    terms that a source uses more than its language. NULL languages and sources count as empty, and
    every row is a document, also where ids repeat. A language without kept terms has only its pairs,
    of value 0. An empty table gives no rows.
    """
    counts = materialize(term_counts(df, text, lang, source), "divergence-counts")
    groups = df.select(F.coalesce(F.col(lang), F.lit("")).alias("lang"), F.coalesce(F.col(source), F.lit("")).alias("source"))
    kept = counts.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs"))
    kept = materialize(kept.where(F.col("docs") >= least_docs).drop("docs"), "divergence-kept")
    used = materialize(counts.drop("docs").join(kept, ["lang", "term"]), "divergence-used")

    groups = materialize(groups.distinct(), "divergence-groups")
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("lang_n").alias("lang_total"))
    tiles = groups.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("tiles"))
    sizes = used.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("rows"))
    sized = groups.join(sizes, ["lang", "source"], "left").join(tiles.join(langs, "lang", "left"), "lang")
    sized = sized.na.fill(0, ["total", "rows", "terms", "lang_total"])
    sized = materialize(sized, "divergence-sized")
    cells = attach(used, sized, ["lang", "source"], "rows").withColumn("p", share(F.col("n"), F.col("total"), F.col("terms")))
    cells = materialize(cells, "divergence-cells")

    q = share(F.col("lang_n"), F.col("lang_total"), F.col("terms"))
    above = cells.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - q).alias("value"))
    above = _ranked(above.where(F.col("value") > 0)).where(F.col("rank") <= top)
    return _ranked(distances(cells, sized)).unionByName(above)


def _ranked(found: DataFrame) -> DataFrame:
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    return found.withColumn("rank", F.row_number().over(order))


def distances(cells: DataFrame, sized: DataFrame) -> DataFrame:
    """(lang, source, part, item, value): the sum of differences to each other source of the language.

    Sources are dealt to tiles and terms to spans; a task compares two tiles over one span. Each source
    is in every span with its share of absent terms, and terms that occur in neither of two tiles are
    added by their number.
    """
    absent = F.coalesce(share(F.lit(0).cast("long"), F.col("total"), F.col("terms")), F.lit(0).cast("long"))
    spans = F.greatest(F.ceil(F.col("terms") / SPAN), F.lit(1)).cast("int")
    heads = sized.select(
        "lang", "source", F.lit(None).cast("string").alias("term"), absent.alias("p"), "terms", "tiles",
        F.explode(F.sequence(F.lit(0), spans - 1)).alias("span"),
    )
    body = cells.select(
        "lang", "source", "term", "p", "terms", "tiles", F.pmod(F.xxhash64("term"), spans).cast("int").alias("span")
    )
    tile = F.pmod(F.xxhash64("source"), F.col("tiles")).cast("int")
    rows = heads.unionByName(body).withColumn("tile", tile)
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    blocks = rows.groupBy("lang", "span", F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high"))
    part = blocks.applyInArrow(_compare, "lang string, a string, b string, value long, seen long, gap long, terms long")
    absent_in_both = (F.max("terms") - F.sum("seen")) * F.max("gap")
    whole = part.groupBy("lang", "a", "b").agg((F.sum("value") + absent_in_both).alias("value"))
    both = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    return whole.select("lang", both.alias("_s"), "value").select(
        "lang", "_s.source", F.lit("pair").alias("part"), "_s.item", "value"
    )


def _compare(key: tuple[pa.Scalar, ...], block: pa.Table) -> pa.Table:
    """Sums of differences between the sources of two tiles (or of one) over the terms of a span."""
    lang, _, low, high = (k.as_py() for k in key)
    source, term = (block.column(c).combine_chunks().dictionary_encode() for c in ("source", "term"))
    names, tile, p = source.dictionary.to_pylist(), block.column("tile").to_numpy(), block.column("p").to_numpy()
    who, head = source.indices.to_numpy(), np.asarray(term.is_null())
    base, home = np.zeros(len(names), np.int64), np.zeros(len(names), np.int64)
    base[who[head]], home[who[head]] = p[head], tile[head]
    shares = np.repeat(base[:, None], len(term.dictionary), axis=1)
    shares[who[~head], term.indices.filter(pa.array(~head)).to_numpy()] = p[~head]
    found: dict[str, list] = {"a": [], "b": [], "value": [], "gap": []}
    for i, name in enumerate(names):
        others = np.arange(i + 1, len(names)) if low == high else np.flatnonzero(home > home[i])
        if len(others):
            # The rows of a span come in any order: a pair has one direction in all of them.
            pairs = [(name, names[j]) if low != high or name < names[j] else (names[j], name) for j in others]
            found["a"] += [a for a, _ in pairs]
            found["b"] += [b for _, b in pairs]
            found["value"] += np.abs(shares[others] - shares[i]).sum(axis=1).tolist()
            found["gap"] += np.abs(base[others] - base[i]).tolist()
    size = len(found["a"])
    return pa.table({
        "lang": pa.array([lang] * size, pa.string()),
        "a": pa.array(found["a"], pa.string()), "b": pa.array(found["b"], pa.string()),
        "value": pa.array(found["value"], pa.int64()),
        "seen": pa.array([shares.shape[1]] * size, pa.int64()), "gap": pa.array(found["gap"], pa.int64()),
        "terms": pa.array([block.column("terms")[0].as_py()] * size, pa.int64()),
    })
