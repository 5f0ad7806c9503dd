import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import regex
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as entry
from textfix.llm import counts, quality, spans, toxicity
from textfix.llm.common import table

DATA = "/root/testdata/sf0.001"
LARGER = "/root/testdata/sf0.01"
PATH = P.path("byte_bpe_50k.json")


def auc(scores, y):
    order = np.argsort(scores, kind="stable")
    rank = np.empty(len(y))
    rank[order] = np.arange(len(y))
    n = y.sum()
    return (rank[y == 1].sum() - n * (n - 1) / 2) / n / (len(y) - n)


def held_out_scores(spark, name, label, mod, rest):
    got = {r["doc_id"]: r for r in entry.queries()[name](spark, LARGER).collect()}
    n = table(spark, LARGER, "documents").count()
    assert len(got) == n
    for r in got.values():
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % mod == rest)
        assert 0 <= r["score"] <= 1
    known = [(got[r["doc_id"]], r[label]) for r in table(spark, LARGER, "labels").collect()]
    rows = [(g["score"], g["predicted"], y) for g, y in known if g["held_out"]]
    return np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), np.array([r[2] for r in rows])


def test_quality_on_held_out_rows(spark):
    scores, predicted, y = held_out_scores(spark, "op9_quality", "quality", 4, 2)
    assert auc(scores, y) > 0.9
    assert (predicted == y).mean() > 0.9
    assert ((scores >= 0.7) == predicted).all()


def test_toxicity_on_held_out_rows(spark):
    scores, predicted, y = held_out_scores(spark, "op3_toxicity", "toxic", 5, 0)
    assert auc(scores, y) > 0.75
    assert (predicted == y).mean() > 0.8


ODD = [(1, None), (2, ""), (3, "a b c"), (4, "word " * 60_000), (5, "ABC! 12"), (5, "ABC! 12"), (None, "x y")]


def test_quality_of_odd_rows_and_without_labels(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int")
    one = spark.createDataFrame([(3, 1), (4, None), (None, 0), (5, 1), (5, 0)], "doc_id long, quality int")
    for labels in (none, one):
        got = quality.score(docs(ODD, "upper string"), labels).collect()
        assert len(got) == len(ODD) and all(0 <= r["score"] <= 1 for r in got)
    assert {r["score"] for r in quality.score(docs(ODD), none).collect()} == {0.5}
    kept = quality.keep_good(docs(ODD, "_quality string"), one)
    assert kept.columns == docs(ODD, "_quality string").columns
    assert quality.score(docs([]), one).collect() == []


def test_rules_compile_to_the_same_score(spark):
    rng = np.random.default_rng(4)
    x = rng.random((500, 2))
    y = ((x[:, 0] > 0.5) != (x[:, 1] > 0.4)).astype(float)
    model = quality.RuleEnsemble(["a", "b"], x, y)
    assert 0 < len(model.rules) < 200
    assert ((model.score(x) > 0.5) == y).mean() > 0.95
    df = spark.createDataFrame([tuple(map(float, r)) for r in x[:40]], "a double, b double")
    assert np.allclose([r[0] for r in df.select(model.column()).collect()], model.score(x[:40]))


def test_lasso_drops_what_does_not_help():
    rng = np.random.default_rng(5)
    x = (rng.random((800, 6)) > 0.5).astype(float)
    y = (x[:, 1] > 0).astype(float)
    _, weights = quality.lasso_logistic(x, y, 0.02)
    assert weights[1] > 1 and np.abs(np.delete(weights, 1)).max() < 0.05


def test_gradients_of_the_network():
    net = toxicity.Network(["a", "bb"])
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    rng = np.random.default_rng(0)
    x, _ = net.inputs(["a", "bb", "unknown"])
    ids, mask, y = rng.integers(0, 3, (4, 3)), np.ones((4, 3, 1)), np.array([1.0, 0, 1])
    mask[2:, 1] = 0

    def loss():
        states = [net.layer(d, x[ids] @ net.p[f"{d}_in"] + net.p[f"{d}_bias"], mask)[0] for d in "fb"]
        q = toxicity.sigmoid(net.pool(np.concatenate(states, axis=2), mask)[0])
        return -(y * np.log(q) + (1 - y) * np.log(1 - q)).mean()

    grads, _, _ = net.gradients(x, ids, mask, y)
    for name, grad in grads.items():
        at = tuple(rng.integers(0, n) for n in grad.shape)
        net.p[name][at] += 1e-3
        high = loss()
        net.p[name][at] -= 2e-3
        assert grad[at] == pytest.approx((high - loss()) / 2e-3, abs=2e-4)
        net.p[name][at] += 1e-3


def test_windows_cover_every_word_and_overlap():
    for sizes in ([0], [1], [32], [33], [48, 0, 49, 500]):
        text, first, end = toxicity.windows(np.array(sizes))
        begin = np.cumsum(sizes) - sizes
        for i, n in enumerate(sizes):
            own = [(f - begin[i], min(f + 32, e) - begin[i]) for t, f, e in zip(text, first, end, strict=True) if t == i]
            assert own and set().union(*(range(a, b) for a, b in own)) == set(range(n))
            starts = [f - begin[i] for t, f in zip(text, first, strict=True) if t == i]
            assert starts == list(range(max(n - toxicity.WINDOW, 0) + 1))


def test_windows_that_advance_together_score_like_single_ones():
    rng = np.random.default_rng(6)
    net = toxicity.Network([f"w{i}" for i in range(50)])
    sizes = np.array([5, 0, toxicity.WINDOW, 3 * toxicity.BLOCK, 700, toxicity.WINDOW - 1, toxicity.WINDOW + 1])
    projected = net.project(net.inputs([f"w{i}" for i in range(90)])[0])
    ids = rng.integers(0, 90, sizes.sum())
    _, first, end = toxicity.windows(sizes)
    alone = net.scores(projected, *toxicity.laid_out(ids, first, end))
    assert np.allclose(toxicity._all_scores(net, projected, ids, sizes), alone, atol=1e-5)


def test_a_passage_scores_alike_wherever_it_stands():
    scorer = toxicity.Scorer(toxicity.Network(["bad"]))
    passage = " ".join(f"bad{i}" for i in range(toxicity.WINDOW))
    alone = scorer.scores([passage])[0]
    moved = scorer.scores([("fill " * k) + passage + " fill" * 40 for k in range(20)])
    assert all(m >= alone - 1e-6 for m in moved)


def test_long_texts_score_like_their_worst_piece():
    scorer = toxicity.Scorer(toxicity.Network(["bad"]))
    text = " ".join(f"w{i % 977}" for i in range(toxicity.GROUP_WORDS + 5000))
    words = toxicity.words_of(text)
    got = scorer.scores(["a b", text, None])
    first = np.arange(0, len(words) - 31, 16)
    assert len(got) == 3 and got[1] == pytest.approx(scorer._long(words))
    sample = [scorer._group([words[f : f + 32]])[0] for f in first[::997]]
    assert got[1] >= max(sample) - 1e-6


def test_toxicity_of_odd_rows_and_without_labels(spark, docs):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    got = toxicity.score(docs(ODD, "y string"), none).collect()
    assert {round(r["score"], 6) for r in got} == {0.5} and len(got) == len(ODD)


def test_toxicity_of_odd_rows_with_a_fitted_model(spark, docs):
    rows = [(10 + i, f"{'awful nasty' if i % 2 else 'kind gentle'} words {i}") for i in range(60)]
    labels = spark.createDataFrame([(10 + i, i % 2) for i in range(60)] + [(None, 1), (10, None)], "doc_id long, toxic int")
    got = toxicity.score(docs(rows + ODD, "score string"), labels).collect()
    assert len(got) == len(rows) + len(ODD) and all(0 <= r["score"] <= 1 for r in got)
    same = [r["score"] for r in got if r["doc_id"] == 5]
    assert len(same) == 2 and same[0] == same[1]
    assert toxicity.score(docs([]), labels).collect() == []


def test_counts_equal_library(docs):
    library = Tokenizer.from_file(PATH)
    rng = random.Random(5)
    bits = "a b the | \n é 漢 1 ! 's 're ' 'r 'v 'll \x1c \x85 ing <|endoftext|> \t '' 'S".split(" ") + [" ", "  "]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(30))) for _ in range(1500)]
    texts += ["a" * 4000, "x\n" * 9000 + "y" * 40_000, "it's " * 9000]
    machine = counts.Transducer(open(PATH, "rb").read())
    for t in texts:
        want = len(library.encode(t, add_special_tokens=False).ids)
        assert counts.count_text(machine, t) == want
        assert counts.count_text(machine, t, chunk=7 if len(t) < 100 else 5000) == want
    got = counts.token_counts(docs([*ODD, (9, "é<|endoftext|> x")], "n_bytes string"), PATH, limit=3).collect()
    for r, (i, t) in zip(sorted(got, key=lambda r: str(r[0])), sorted([*ODD, (9, "é<|endoftext|> x")], key=lambda r: str(r[0])), strict=True):
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        assert tuple(r) == (i, len((t or "").encode()), n, n > 3)


def test_maps_compose_associatively():
    machine = counts.Transducer(open(PATH, "rb").read())
    maps = [counts.chunk_map(machine, c) for c in ("ab", "c d", "  ", "e  f'", "s\n", "xyz", " g")]
    left = maps[0]
    for m in maps[1:]:
        left = counts.compose(machine, left, m)
    right = maps[-1]
    for m in maps[-2::-1]:
        right = counts.compose(machine, m, right)
    total = lambda m: machine.count(m.head) + m.inner + machine.count(m.tail or "")
    want = machine.count("abc d  e  f's\nxyz g")
    assert total(left) == total(right) == total(counts.scan(machine, maps)) == want


def plain_removed(rows):
    """Numbers of the removed sentences by the definition, pair by pair."""
    where, gone = {}, {i: set() for i, _ in rows}
    for i, t in sorted(rows):
        for start, length, hashed in zip(*spans.spans(spans.sentences(t or "")), strict=True):
            if hashed in where:
                gone[i].update(range(start, start + length))
            where.setdefault(hashed, i)
    return gone


def test_repeated_spans_equal_brute_force(docs):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    sentence = lambda n: " ".join(word() for _ in range(n)).capitalize() + rng.choice([". ", "! ", ".\n"])
    text = lambda k: "".join(sentence(rng.randint(1, 14)) for _ in range(k))
    passage = "".join(sentence(9) for _ in range(7))
    rows = [(i, text(12)) for i in range(12)]
    rows += [(20 + i, text(3) + passage + text(3)) for i in range(3)]
    rows += [(30, passage.upper()), (31, passage + text(2) + passage), (40, None), (41, ""), (42, "One. " * 30), (43, "x" * 90_000)]
    want = plain_removed(rows)
    got = {r["doc_id"]: r for r in spans.remove_repeats(docs(rows, "start string")).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        pieces = spans.sentences(t or "")
        assert "".join(pieces) == (t or "")
        assert got[i]["removed"] == sorted(want[i])
        assert got[i]["text"] == (None if t is None else "".join(p for k, p in enumerate(pieces) if k not in want[i]))
    assert not any(got[i]["changed"] for i in range(12)) and not got[20]["changed"]
    assert passage.strip() not in got[21]["text"] and len(got[22]["removed"]) == 7 and got[30]["text"] == ""
    assert len(got[31]["removed"]) == 14


def test_spans_query_equals_brute_force(spark):
    rows = [tuple(r) for r in table(spark, DATA, "documents").select("doc_id", "text").collect()]
    want = plain_removed(rows)
    got = entry.queries()["op4_spans"](spark, DATA).collect()
    assert {r["doc_id"]: r["removed"] for r in got} == {i: sorted(s) for i, s in want.items()}


def test_spans_null_and_repeated_ids(docs):
    t = "Some words in a row make a sentence of ten words. And ten more words make a second sentence of it all."
    got = spans.remove_repeats(docs([(None, t), (None, t), (5, t), (5, t), (6, t)])).collect()
    assert sorted((str(r["doc_id"]), r["n_removed"]) for r in got) == [("5", 0), ("5", 0), ("6", 2), ("None", 0), ("None", 0)]
    assert spans.remove_repeats(docs([])).collect() == []


def every_run_removed(rows):
    """Numbers of the removed pieces when every run of two pieces and 20 words is looked up."""
    where, gone = {}, {i: set() for i, _ in rows}
    for i, t in rows:
        words = [regex.findall(r"[\p{L}\p{N}]+", p.lower()) for p in spans.sentences(t)]
        solid = [k for k, w in enumerate(words) if w]
        for a in range(len(solid)):
            for b in range(a + 2, len(solid) + 1):
                run = tuple(tuple(words[k]) for k in solid[a:b])
                if sum(map(len, run)) >= 20:
                    if where.setdefault(run, (i, a)) != (i, a):
                        gone[i].update(range(solid[a], solid[b - 1] + 1))
    return gone


def test_every_repeated_run_is_removed_whole(docs):
    rng = random.Random(4)
    say = lambda n: " ".join("w%d" % rng.randrange(9000) for _ in range(n)) + ". "
    whole = say(15) + say(15) + say(3)
    rows = [(1, whole), (2, whole), (3, say(9) + whole + say(9))]
    for i in range(4, 24, 2):
        part = "".join(say(rng.choice([2, 3, 9, 15])) for _ in range(6))
        rows += [(i, say(9) + part + say(12)), (i + 1, say(30) + part + say(7) + part)]
    want = every_run_removed(rows)
    got = {r["doc_id"]: r for r in spans.remove_repeats(docs(rows)).collect()}
    assert {i: r["removed"] for i, r in got.items()} == {i: sorted(s) for i, s in want.items()}
    assert got[2]["text"] == "" and whole.strip() not in got[3]["text"] and got[3]["n_removed"] == 3


def test_passages_inside_one_sentence_are_found(docs):
    rng = random.Random(6)
    say = lambda n: " ".join("w%d" % rng.randrange(9000) for _ in range(n))
    rows, passages = [], [say(60) for _ in range(20)]
    for i, passage in enumerate(passages):
        rows += [(2 * i, say(70) + " " + passage + " " + say(50)), (2 * i + 1, say(40) + " " + passage.upper() + " " + say(90))]
    got = {r["doc_id"]: r for r in spans.remove_repeats(docs(rows)).collect()}
    for i, passage in enumerate(passages):
        assert got[2 * i]["text"] == rows[2 * i][1]
        lost = set(rows[2 * i + 1][1].split()) - set(got[2 * i + 1]["text"].split())
        assert len(lost) >= 20 and lost <= set(passage.upper().split())


@pytest.mark.parametrize("word", ["a" * 16 + "b", "x_" * 5000, "\u6f22\u5b57\u304b\u306a" * 2000, "a\U0001f600\u00e9" * 300])
def test_long_words_are_read_whole(word):
    pieces = toxicity.words_of(word)
    raw = word.strip(toxicity.EDGES).encode()
    triples = lambda b: {b[i : i + 3] for i in range(len(b) - 2)}
    assert all(len(p.encode()) <= toxicity.PIECE_BYTES for p in pieces)
    assert triples(raw) == set().union(*(triples(p.encode()) for p in pieces))
    assert (toxicity.trigram_rows(pieces)[1].sum(axis=1) == [len(p.encode()) for p in pieces]).all()
    assert "".join(pieces[:1]) == word[: len(pieces[0])] and raw.decode().endswith(pieces[-1])


def test_a_change_anywhere_in_a_long_word_changes_the_inputs():
    net, word = toxicity.Network(["bad"]), "\u6f22\u5b57\u4eee\u540d" * 800
    plain = toxicity.Scorer(net).scores([word])[0]
    changed = [word[:at] + "\u6bd2\u6bd2\u6bd2" + word[at + 3 :] for at in range(0, len(word), 211)]
    table = [net.inputs(toxicity.words_of(t))[0].sum() for t in [word, *changed]]
    assert plain > 0 and all(abs(x - table[0]) > 1e-6 for x in table[1:])


def test_keep_good_computes_each_statistic_once(spark):
    docs, labels = table(spark, DATA, "documents"), table(spark, DATA, "labels")
    kept = quality.keep_good(docs, labels)
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    once = quality.score(docs, labels)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_distinct") == 2 and plan.count("split(") == once.count("split(")
    want = {r["doc_id"] for r in quality.score(docs, labels).where("predicted = 1").collect()}
    assert {r["doc_id"] for r in kept.collect()} == want and kept.columns == docs.columns


def test_cut_words_are_the_least_of_every_window():
    words = [f"w{i * i % 37}" for i in range(200)]
    ranks = [spans._rank(w) for w in words]
    n = spans.CUT_WORDS
    want = {min(range(k, k + n), key=lambda i: (ranks[i], i)) for k in range(len(words) - n + 1)}
    assert spans._cuts(words) == sorted(want)
    text = "-- " + ", ".join(words) + " x_y İ. Short one!  "
    pieces, found = spans._cut(text)
    assert "".join(pieces) == text and len(pieces) > 20
    assert [w for part in found for w in part] == spans._WORD.findall(spans._fold(text))
    assert all(spans._WORD.findall(spans._fold(p)) == w for p, w in zip(pieces, found, strict=True))
