import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import __spark_entry__ as entry
from textfix.llm import simhash
from textfix.llm.common import components, table

DATA = "/root/testdata/sf0.001"


def plain_fingerprint(text, shingle=3):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    runs = [words[i : i + shingle] for i in range(len(words) - shingle + 1)] or [words]
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(r).encode(), seed=42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(ids, fps):
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                root[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        least[find(i)] = min(least.get(find(i), d), d)
    return [least[find(i)] for i in range(len(ids))]


def near(text, n, rng):
    words = text.split()
    for _ in range(n):
        words[rng.randrange(len(words))] = "w%d" % rng.randrange(99)
    return " ".join(words)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    texts = [None, "", " \n", "one", "One", "one two", "a b c", "A b\tc", "é È x y"]
    for _ in range(6):
        base = " ".join("w%d" % rng.randrange(3000) for _ in range(rng.choice([30, 200, 900])))
        texts += [base, base.upper(), base] + [near(base, k, rng) for k in (1, 1, 2, 3, 9)]
    texts.append("tie " * 40_000)
    return [(i * 7 + 1, t) for i, t in enumerate(texts)]


def test_near_duplicates_equal_brute_force(docs, rows):
    want_fp = [plain_fingerprint(t) for _, t in rows]
    want = dict(zip([i for i, _ in rows], plain_components([i for i, _ in rows], want_fp), strict=True))
    got = simhash.near_duplicates(docs(rows, "fp string")).collect()
    assert len(got) == len(rows)
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    assert {r["doc_id"]: r["fingerprint"] for r in got} == {
        i: f"{fp:016x}" for (i, _), fp in zip(rows, want_fp, strict=True)
    }


def test_query_equals_brute_force(spark):
    docs = table(spark, DATA, "documents").select("doc_id", "text").collect()
    fps = [plain_fingerprint(r["text"]) for r in docs]
    want = dict(zip([r["doc_id"] for r in docs], plain_components([r["doc_id"] for r in docs], fps), strict=True))
    got = entry.queries()["op2_simhash"](spark, DATA).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want


def test_null_and_repeated_ids_and_empty_table(docs):
    got = simhash.near_duplicates(docs([(None, "x y z"), (5, "x y z"), (5, "x y z"), (None, "u v w"), (5, "q")]))
    assert sorted(map(tuple, got.select("doc_id", "component_id").collect()), key=str) == [
        (5, 5), (5, 5), (5, 5), (None, 5), (None, None)
    ]
    assert simhash.near_duplicates(docs([])).collect() == []


def test_index_finds_every_close_pair_of_large_groups():
    rng = np.random.default_rng(0)
    flips = rng.integers(0, 1 << 12, 700, dtype=np.uint64)
    codes = np.unique(np.r_[flips, flips ^ np.uint64(1 << 60)])
    groups = (codes % np.uint64(3)).astype(np.int64)
    order = np.lexsort((simhash.gray_rank(codes), groups))
    codes, groups = codes[order], groups[order]
    got = {(int(i), int(j)) for a, b, _ in simhash.GrayIndex(codes, groups).within(2) for i, j in zip(a, b)}
    far = np.bitwise_count(codes[:, None] ^ codes[None])
    i, j = np.nonzero((far <= 2) & (groups[:, None] == groups[None]))
    assert got == {(a, b) for a, b in zip(i.tolist(), j.tolist()) if a < b}


def test_gray_neighbours_differ_by_one_bit():
    codes = np.arange(256, dtype=np.uint64)
    ordered = codes[np.argsort(simhash.gray_rank(codes))]
    assert (np.bitwise_count(ordered[1:] ^ ordered[:-1]) == 1).all()


def test_components_of_a_chain_and_a_hub(spark):
    chain = [(i, i + 1) for i in range(40)]
    hub = [(1000, 1001 + i) for i in range(300)]
    edges = spark.createDataFrame(chain + hub + [(7, 7)], "a long, b long").repartition(4)
    got = {r["node"]: r["root"] for r in components(edges, "test").collect()}
    assert got == {i: 0 for i in range(41)} | {i: 1000 for i in range(1000, 1301)}


def test_keep_first(docs):
    df = docs([(3, "a b c d e f"), (2, "a b c d e f"), (9, "other words of no relation at all"), (None, "n")])
    assert sorted(r["doc_id"] or 0 for r in simhash.keep_first(df).collect()) == [0, 2, 9]


def test_keep_first_tells_rows_apart_by_id_and_text(docs):
    rows = [(1, "a b c d"), (1, "a b c d"), (1, "A b c d"), (2, "x y z"), (2, "other words here"), (5, "a b c d"), (2, "x y z"), (7, "x y z")]
    got = simhash.keep_first(docs(rows + [(None, "x y z"), (None, None)], "_sha string")).collect()
    # "A b c d" has the fingerprint of "a b c d"; of the two texts of document 1 one stays.
    least = min(("a b c d", "A b c d"), key=lambda t: hashlib.sha256(t.encode()).hexdigest())
    kept = sorted(((r["doc_id"], r["text"]) for r in got), key=str)
    assert kept == sorted([(1, least), (2, "x y z"), (2, "other words here"), (None, "x y z"), (None, None)], key=str)


def test_keep_first_equals_brute_force(docs, rows):
    fps = [plain_fingerprint(t) for _, t in rows]
    roots = plain_components([i for i, _ in rows], fps)
    got = sorted(r["doc_id"] for r in simhash.keep_first(docs(rows)).collect())
    assert got == sorted(set(roots))


def test_a_very_long_text_and_a_clashing_column(docs):
    long = " ".join(f"w{k % 977}" for k in range(200_000))
    got = simhash.keep_first(docs([(1, long), (2, long + " end"), (3, ""), (4, None)], "_row string"))
    assert sorted(r["doc_id"] for r in got.collect()) == [1, 3] and "_row" in got.columns
