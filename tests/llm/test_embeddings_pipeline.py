import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from textfix.llm import embeddings, quality
from textfix.llm.common import table

DATA = "/root/testdata/sf0.001"


def plain(rows, least=0.98):
    """Links by comparing all pairs, and components."""
    ok = []
    for i, v, label in rows:
        if i is not None and v and label is not None and all(x is not None and np.isfinite(x) for x in v) and any(v):
            ok.append((i, np.array(v, float) / np.linalg.norm(np.array(v, float)), label))
    links = {i: set() for i, _, _ in ok}
    for a, (i, x, k) in enumerate(ok):
        for j, y, m in ok[:a]:
            if k == m and len(x) == len(y) and x @ y >= least:
                links[i].add(j)
                links[j].add(i)
    root = {}
    for i in sorted(links):
        todo = [] if i in root else [i]
        while todo:
            j = todo.pop()
            if j not in root:
                root[j] = i
                todo += links[j]
    return {i: len(s) for i, s in links.items()}, root


def make(rng, n=300, dim=24):
    rows = []
    for i in range(n):
        if i % 3 == 0 or i < 5:
            v = rng.normal(size=dim)
        else:
            v = np.array(rows[-1][1]) + rng.normal(size=dim) * rng.choice([0.02, 0.1, 0.3])
        rows.append((i * 2 + 1, v.astype(np.float32).astype(float).tolist(), i // 3 % 2))
    rows += [(2000 + i, rows[9][1], rows[9][2]) for i in range(40)]
    return rows


SCHEMA = "vec_id long, embedding array<float>, label int, n string"


def test_links_equal_brute_force(spark):
    rng = np.random.default_rng(0)
    rows = make(rng)
    odd = [
        (9001, None, 1), (9002, [], 1), (9003, [0.0] * 24, 1), (9004, [float("nan")] + [1.0] * 23, 1),
        (9005, [float("inf")] + [1.0] * 23, 1), (9006, [None] + [1.0] * 23, 1), (9007, rows[9][1], None),
        (None, rows[9][1], rows[9][2]), (9008, rows[9][1][:20], rows[9][2]), (9009, [2 * x for x in rows[9][1]], rows[9][2]),
    ]
    links, root = plain(rows + odd)
    df = spark.createDataFrame([(*r, "x") for r in rows + odd], SCHEMA).repartition(3)
    got = embeddings.near_vectors(df, tile=16).collect()
    assert len(got) == len(rows) + len(odd)
    found = {r["vec_id"]: r for r in got}
    want, have = sum(links.values()), sum(r["n_links"] for r in got)
    assert 0.95 * want <= have <= want
    assert sum(found[i]["n_links"] == n for i, n in links.items()) >= 0.95 * len(links)
    assert sum(found[i]["component_id"] == c for i, c in root.items()) >= 0.95 * len(root)
    for i in [o[0] for o in odd if o[0] and o[0] < 9008]:
        assert (found[i]["n_links"], found[i]["component_id"], found[i]["kept"]) == (0, i, True)
    assert embeddings.near_vectors(df.limit(0)).collect() == []


def test_tiles_find_the_same_links(spark):
    df = spark.createDataFrame([(*r, "x") for r in make(np.random.default_rng(1))], SCHEMA)
    one = sorted(map(tuple, embeddings.near_vectors(df, tile=10_000).collect()))
    assert one == sorted(map(tuple, embeddings.near_vectors(df, tile=8).collect()))


def test_embedding_query_recall(spark):
    rows = [tuple(r) for r in table(spark, DATA, "embeddings").select("vec_id", "embedding", "label").collect()]
    links, root = plain(rows)
    got = {r["vec_id"]: r for r in entry.queries()["op10_embeddings"](spark, DATA).collect()}
    assert set(got) == {r[0] for r in rows}
    assert sum(r["n_links"] for r in got.values()) >= 0.95 * sum(links.values())
    assert all(got[i]["n_links"] <= n for i, n in links.items())


def test_rotation_balances_and_keeps_near_vectors_near():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(2000, 32)) * np.linspace(0.2, 3, 32)
    mean, turn = embeddings.learn_rotation(x, bits=16)
    bits = (x - mean) @ turn > 0
    assert np.abs(bits.mean(axis=0) - 0.5).max() < 0.1
    a, b = embeddings.codes_of(x, mean, turn), embeddings.codes_of(x + rng.normal(size=x.shape) * 0.01, mean, turn)
    assert np.bitwise_count(a ^ b).mean() < 0.5


def test_pipeline_stages_keep_their_promises(spark):
    docs = table(spark, DATA, "documents")
    columns = docs.columns
    clash = docs.withColumn("score", F.lit("x")).withColumn("fp", F.lit(1))
    labels = table(spark, DATA, "labels")
    good = quality.score(docs, labels)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, DATA)
        if name != "encode":
            assert out.columns == columns
        if name == "quality":
            want = {r["doc_id"] for r in good.where("predicted = 1").collect()}
            assert {r["doc_id"] for r in out.collect()} == want
        if name == "exact":
            before = [r[0] or "" for r in docs.select("text").collect()]
            after = [r[0] or "" for r in out.select("text").collect()]
            squeeze = lambda t: "".join(t.split())
            assert len(after) == len({squeeze(t) for t in before}) == len({squeeze(t) for t in after})
        docs = spark.createDataFrame(out.collect(), out.schema)
    assert docs.count() > 100
    assert corpus_pipeline.keep_good(spark, clash, DATA).columns == clash.columns


def test_pipeline_of_nothing(spark):
    docs = table(spark, DATA, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, DATA)
        assert docs.collect() == []
