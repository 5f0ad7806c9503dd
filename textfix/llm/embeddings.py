"""Embedding near-duplicates by iterative quantisation and multi-index Hamming tables.

A rotation is learned that turns centred vectors into balanced binary codes. The code is cut into
disjoint substrings with a table each; vectors of one label meet where a substring is equal, and are
compared by the cosine of the original vectors. A pair that meets in several tables belongs to the
first of them, so links are counted where they are found and no pair leaves its task.

Equal vectors are one entry with a count. An entry of a table that holds many vectors is cut into
tiles, and each two tiles are compared in a place of their own: nothing is capped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textfix.llm.common import attach, components
from textfix.llm.simhash import first_connected
from textfix.session import materialize

# Vectors that the rotation is fitted on at most (those with the smallest hashed id), and its steps.
FIT_ROWS, FIT_STEPS = 20_000, 50
BITS, TABLES = 64, 6
# Vectors in a tile.
TILE = 1024


def learn_rotation(x: np.ndarray, bits: int = BITS, steps: int = FIT_STEPS, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Mean and projection (dimension, bits): principal directions, rotated so that signs lose least.

    Fewer bits are learned if the vectors have fewer dimensions. Without rows the projection is a
    random rotation.
    """
    rng = np.random.default_rng(seed)
    bits = min(bits, x.shape[1])
    mean = x.mean(axis=0) if len(x) else np.zeros(x.shape[1])
    centred = x - mean
    if len(x):
        _, vectors = np.linalg.eigh(centred.T @ centred)
        top = vectors[:, ::-1][:, :bits]
    else:
        top = np.linalg.qr(rng.normal(size=(x.shape[1], bits)))[0]
    turn = np.linalg.qr(rng.normal(size=(bits, bits)))[0]
    flat = centred @ top
    for _ in range(steps if len(x) else 0):
        u, _, v = np.linalg.svd(np.sign(flat @ turn).T @ flat)
        turn = (u @ v).T
    return mean, top @ turn


def codes_of(x: np.ndarray, mean: np.ndarray, projection: np.ndarray) -> np.ndarray:
    """Sign bits of each row, bit 0 first, as unsigned 64-bit numbers."""
    signs = (x - mean) @ projection > 0
    full = np.zeros((len(x), 64), bool)
    full[:, : signs.shape[1]] = signs
    return np.packbits(full, axis=1, bitorder="little").view("<u8").reshape(-1)


def substrings(bits: int = BITS, tables: int = TABLES) -> list[int]:
    """Masks of the disjoint substrings of a code."""
    cuts = np.linspace(0, bits, tables + 1).astype(int)
    return [((1 << int(b)) - 1) ^ ((1 << int(a)) - 1) for a, b in zip(cuts, cuts[1:], strict=False)]


def _usable(df: DataFrame, id_col: str, vector: str, label: str) -> DataFrame:
    """(id, vec, label) of the rows that can link, vectors as doubles."""
    vec = F.col(vector).cast("array<double>")
    big = F.lit(float("inf"))
    finite = F.forall(vec, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < big))
    some = F.exists(vec, lambda v: v != 0)
    rows = df.where(F.col(id_col).isNotNull() & F.col(label).isNotNull() & F.col(vector).isNotNull())
    return rows.where(finite & some).select(
        F.col(id_col).alias("id"), vec.alias("vec"), F.col(label).alias("label")
    )


def near_vectors(
    df: DataFrame, least: float = 0.98, id_col: str = "vec_id", vector: str = "embedding",
    label: str = "label", fit_rows: int = FIT_ROWS, tables: int = TABLES, tile: int = TILE,
) -> DataFrame:
    """(id, n_links, component_id, kept) per row of ``df``.

    Rows link when their labels are equal and the cosine of their vectors is at least ``least``. Rows
    with a NULL id or label, and vectors that are NULL, empty, zero or hold NULL or non-finite
    components link with nothing; nor do vectors of different length. Ids are longs and a key.
    """
    rows = materialize(_usable(df, id_col, vector, label), "vectors")
    classes = rows.groupBy("label", "vec").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n"))
    classes = materialize(classes, "vector-classes")
    widths = classes.groupBy(F.size("vec").alias("width")).count().orderBy(F.desc("count"), "width").first()
    width = widths["width"] if widths else 1
    sample = classes.where(F.size("vec") == width).orderBy(F.xxhash64("rep")).limit(fit_rows)
    fitted = np.array([r[0] for r in sample.select("vec").toLocalIterator()]).reshape(-1, width)
    fitted = fitted / np.linalg.norm(fitted, axis=1, keepdims=True)
    model = learn_rotation(fitted)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column(0).value_lengths().to_numpy(zero_copy_only=False)
            flat = batch.column(0).flatten().to_numpy(zero_copy_only=False)
            ends = np.cumsum(sizes)
            out = np.zeros(len(sizes), np.uint64)
            for w in np.unique(sizes):
                own = np.flatnonzero(sizes == w)
                x = flat[(ends[own] - w)[:, None] + np.arange(w)]
                x = x / np.linalg.norm(x, axis=1, keepdims=True)
                out[own] = codes_of(x, *(model if w == width else learn_rotation(np.zeros((0, int(w))))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out.view(np.int64))], [*batch.schema.names, "code"])

    kind = classes.schema["label"].dataType.simpleString()
    coded = classes.select("vec", "label", "rep", "n").mapInArrow(
        code, f"vec array<double>, label {kind}, rep long, n long, code long"
    )
    coded = materialize(coded, "vector-codes")
    masks = substrings(min(BITS, width), tables)
    found = materialize(_meet(coded, masks, least, tile), "vector-found")

    roots = components(found.where(F.col("rep") != F.col("root")).select(F.col("rep").alias("a"), F.col("root").alias("b")), "vectors")
    linked = found.groupBy("rep").agg(F.sum("links").alias("links"))
    known = classes.join(linked, "rep", "left").join(roots, F.col("rep") == F.col("node"), "left").select(
        "label", "vec", "n",
        (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"),
        F.coalesce("root", "rep").alias("component_id"),
    )
    known = materialize(known.withColumn("w", F.col("n")), "vector-known")
    good = attach(rows, known, ["label", "vec"], "w").select("id", "n_links", "component_id")
    good = materialize(good, "vector-good")
    return (
        df.select(F.col(id_col).alias("_id"))
        .join(good, F.col("_id") == F.col("id"), "left")
        .select(
            F.col("_id").alias(id_col),
            F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
            F.coalesce("component_id", "_id").alias("component_id"),
            F.coalesce("component_id", "_id").eqNullSafe(F.col("_id")).alias("kept"),
        )
    )


def _meet(coded: DataFrame, masks: list[int], least: float, tile: int) -> DataFrame:
    """(rep, links, root) for each place where a class meets others that it links with.

    ``links`` counts the vectors of the other classes of the pairs that belong to this place.
    """
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    entries = F.array(
        *[F.struct(F.lit(t).alias("table"), F.col("code").bitwiseAND(F.lit(m)).alias("part")) for t, m in enumerate(signed)]
    )
    keys = ["label", "width", "table", "part"]
    listed = coded.select("*", F.size("vec").alias("width"), F.explode(entries).alias("e")).select(
        "label", "width", "e.table", "e.part", "rep", "n", "code", "vec"
    )
    sizes = listed.groupBy(*keys).agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > 1)
    sizes = materialize(sizes, "vector-sizes").withColumn("w", F.col("size"))
    listed = attach(listed, sizes, keys, "w").where(F.col("size").isNotNull())
    # The two tiles of a place in order; a vector of tile t goes to every place that holds t.
    n_tiles = F.ceil(F.col("size") / tile).cast("int")
    own = F.pmod(F.xxhash64("rep"), n_tiles.cast("long")).cast("int")
    listed = listed.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), n_tiles - 1)))
    placed = listed.select(
        *keys, F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"),
        F.struct("own", "rep", "n", "code", "vec").alias("v"),
    )
    places = placed.groupBy(*keys, "lo", "hi").agg(F.collect_list("v").alias("vs"))
    places = places.where(F.size("vs") > 1).select("table", "lo", "hi", "vs")
    earlier = [np.uint64(m) for m in masks]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            reps, links, roots = [], [], []
            for k in range(batch.num_rows):
                table, lo, hi = (batch.column(i)[k].as_py() for i in range(3))
                members = batch.column(3)[k].values
                own = members.field("own").to_numpy(zero_copy_only=False)
                rep = members.field("rep").to_numpy(zero_copy_only=False)
                n = members.field("n").to_numpy(zero_copy_only=False)
                code = members.field("code").to_numpy(zero_copy_only=False).view(np.uint64)
                x = members.field("vec").flatten().to_numpy(zero_copy_only=False).reshape(len(rep), -1)
                x = x / np.linalg.norm(x, axis=1, keepdims=True)
                close = x @ x.T >= least
                if lo != hi:  # pairs inside a tile belong to the place of that tile alone
                    close &= own[:, None] != own[None]
                np.fill_diagonal(close, False)
                a, b = np.nonzero(close)
                mine = np.ones(len(a), bool)
                for mask in earlier[:table]:
                    mine &= ((code[a] ^ code[b]) & mask) != 0
                a, b = a[mine], b[mine]
                if not len(a):
                    continue
                count = np.bincount(a, weights=n[b], minlength=len(rep)).astype(np.int64)
                root = first_connected(len(rep), iter([(a, b)]))
                some = count > 0
                reps.append(rep[some])
                links.append(count[some])
                roots.append(rep[root[some]])
            if reps:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(c)) for c in (reps, links, roots)], ["rep", "links", "root"]
                )

    return places.mapInArrow(compare, "rep long, links long, root long")
