from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from textfix import session
from textfix.config import CorrectionConfig, SpellConfig
from textfix.operators.lookup import lookup_join
from textfix.plans import correct as job
from textfix.plans.correct import batch_corrector, correct, example_report, grammar_cards, identity, review
from textfix.streaming.chunks import idle_chunks, idle_chunks_stream
from textfix.streaming.correct import stream_correct

TERMS = [(w, 10**8) for w in "give my best please write to know it i do the team works".split()]
CASES = [
    # text, answer of the model, final, fell_back, guarded
    ("please write to a@b.com", "please write to __0__.", "please write to a@b.com.", False, False),
    ("please write to a@b.com", "Please write to ____", "Please write to a@b.com", False, False),
    ("please write to a@b.com", "please write", "please write to a@b.com", True, False),
    ("give demra my best", "give me my best", "give demra my best", False, True),
    ("i do not know", "i do know", "i do not know", False, True),
    ("the team works", "it", "the team works", False, True),
    ("the team works", "The team works.", "The team works.", False, False),
    ("the taem works", "the team works", "the team works", False, False),
    ("", "", "", False, False),
]


@pytest.fixture(scope="module")
def terms(spark):
    return spark.createDataFrame(TERMS, "term string, count long")


@pytest.fixture(scope="module")
def rows(spark):
    cases = [(i, c[0], c[1]) for i, c in enumerate(CASES)] + [(99, None, None)]
    return spark.createDataFrame(cases, "id long, text string, answer string").repartition(4)


CFG = CorrectionConfig(speller=SpellConfig(dominance_ratio=1.0))


def results(df):
    return {r["id"]: r["correction"] for r in df.collect()}


def check(found):
    assert found.pop(99) is None
    for i, (text, _, final, fell_back, guarded) in enumerate(CASES):
        r = found[i]
        assert (r["final"], r["fell_back"], r["meaning_guarded"]) == (final, fell_back, guarded), text
        assert r["original"] == text and r["changed"] == (final != text)


def test_every_branch(rows, terms):
    check(results(correct(rows, terms, lambda masked: F.col("answer"), CFG, id_cols=["id"])))


def test_stages_can_be_switched_off(rows, terms):
    answer = lambda masked: F.col("answer")
    open_ = results(correct(rows, None, answer, CorrectionConfig(use_speller=False, meaning_guard=False), id_cols=["id"]))
    assert open_[3]["final"] == "give me my best" and open_[5]["final"] == "it"
    bare = results(correct(rows, None, identity, CorrectionConfig(use_speller=False, use_protector=False), id_cols=["id"]))
    assert bare[0]["masked"] == CASES[0][0] and not bare[0]["changed"]


def test_batch_corrector(rows, terms):
    def factory():
        return lambda texts: [t + "." for t in texts]

    found = results(correct(rows, terms, batch_corrector(factory), CFG, id_cols=["id"]))
    assert found[0]["final"] == "please write to a@b.com."
    assert found[99] is None
    plan = correct(rows, terms, batch_corrector(factory), CFG, id_cols=["id"])._jdf.queryExecution().executedPlan()
    assert "ArrowEvalPython" in plan.toString()


def test_wrong_number_of_answers_fails(rows, terms):
    broken = batch_corrector(lambda: lambda texts: texts[:-1])
    with pytest.raises(Exception, match="corrector returned"):
        correct(rows.coalesce(1), terms, broken, CFG, id_cols=["id"]).collect()


def test_review(spark, terms):
    text = "the team works. i do not know! please write"
    df = spark.createDataFrame([(7, text), (8, None), (9, "")], "id long, text string")
    model = batch_corrector(lambda: lambda ts: [t.replace("team", "Team").replace("write", "write it") for t in ts])
    cards = {r["sent_no"]: r for r in review(df, terms, model, CFG).collect()}
    assert set(cards) == {0, 2} and {r["id"] for r in cards.values()} == {7}
    assert cards[2]["raw"] == "please write" and cards[2]["final"] == "please write it"
    assert [tuple(d) for d in cards[2]["diff"]] == [("please", False), ("write", False), ("it", True)]
    assert not any(d["c"] for d in cards[0]["diff"]) and not cards[0]["guarded"]


def test_filters_do_not_repeat_the_work(rows, terms):
    model = batch_corrector(lambda: lambda ts: ts)
    plan = grammar_cards(correct(rows, terms, model, CFG, id_cols=["id"]))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("run(") <= 2  # the answer and, once, the similarity


def test_example_report(spark, terms):
    examples = spark.createDataFrame(
        [(10, "A", "n", "the team"), (30, "A", "n", "to a@b.com"), (20, "B", "n", "it")],
        "line_no long, category string, note string, input string",
    )
    lose = batch_corrector(lambda: lambda ts: [t.replace("__0__", "") for t in ts])
    out = example_report(examples, terms, lose, CFG, chunk_rows=15).orderBy("n").collect()
    assert [(r["n"], r["category"], r["header"], r["fell_back"]) for r in out] == [
        (1, "A", True, False), (2, "B", True, False), (3, "A", True, True)
    ]


def test_stream_equals_batch(spark, rows, terms, tmp_path):
    plain = rows.select("id", "text")
    plain.write.parquet(str(tmp_path / "in"))
    model = batch_corrector(lambda: lambda ts: [t.replace("best", "best one") for t in ts])
    stream = spark.readStream.schema(plain.schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    for _ in range(2):  # the second run finds nothing new
        done = stream_correct(
            stream, terms, str(tmp_path / "out"), str(tmp_path / "state"), model, CFG, id_cols=["id"], available_now=True
        )
        done.awaitTermination()
    got = results(spark.read.parquet(str(tmp_path / "out")))
    assert got == results(correct(plain, terms, model, CFG, id_cols=["id"]))


def test_idle_chunks(spark, tmp_path):
    base = "2024-01-01 00:00:"
    hits = [("a", "00"), ("a", "00"), ("a", "05"), ("a", "14.5"), ("a", "30"), ("b", "01")]
    df = spark.createDataFrame([(k, base + s) for k, s in hits], "k string, t string").select(
        "k", F.col("t").cast("timestamp").alias("ts")
    )
    cut = ["k", F.date_format("chunk_start", "ss").alias("s"), F.date_format("chunk_end", "ss").alias("e"), "n"]
    want = {("a", "00", "14", 4), ("a", "30", "30", 1), ("b", "01", "01", 1)}
    for micros in (86_400_000_000, 1_000_000):
        got = idle_chunks(df, ["k"], "ts", 10, micros).select(*cut).collect()
        assert {tuple(r) for r in got} == want
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    late = spark.createDataFrame([("z", "2024-01-02 00:00:00")], "k string, t string").select(
        "k", F.col("t").cast("timestamp").alias("ts")
    )
    late.write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    chunks = idle_chunks_stream(stream, ["k"], "ts", "10 seconds", "1 seconds")
    query = (
        chunks.writeStream.format("memory").queryName("chunks").outputMode("append")
        .option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    assert {tuple(r) for r in spark.table("chunks").select(*cut).collect()} >= want


def test_model_is_loaded_once_per_worker(spark, tmp_path):
    def factory():
        import os
        import uuid

        (tmp_path / f"{os.getpid()}-{uuid.uuid4().hex}").touch()
        return lambda texts: [t.upper() for t in texts]

    df = spark.range(64, numPartitions=32).select(F.concat(F.lit("t"), "id").alias("text"))
    model = batch_corrector(factory)
    for _ in range(2):
        out = df.select(model(F.col("text")).alias("out")).collect()
        assert sorted(r["out"] for r in out) == sorted(f"T{i}" for i in range(64))
    pids = [p.name.split("-")[0] for p in tmp_path.iterdir()]
    assert len(pids) == len(set(pids)) < 32


def test_scratch_tables_go_with_their_block(spark, tmp_path):
    import os

    from textfix.session import materialize, scratch

    kept = materialize(spark.range(3), "kept")
    with scratch(spark):
        gone = materialize(spark.range(5), "gone")
        assert gone.count() == 5
    path = gone.inputFiles()[0].removeprefix("file:")
    assert not os.path.exists(os.path.dirname(path)) and kept.count() == 3


def test_lost_words_are_found_as_the_texts_are_written(spark, monkeypatch):
    left = []
    monkeypatch.setattr(job, "lookup_join", lambda words, *args: left.append(words) or lookup_join(words, *args))
    rows = spark.createDataFrame([(1, "Quux likes cats very much"), (2, "cats like cats")], "id long, text string")
    terms = spark.createDataFrame([("cats", 10), ("like", 10)], "term string, count long")
    done = correct(rows, terms, lambda m: F.replace(m, F.lit("Quux "), F.lit("")), CFG, id_cols=["id"])
    assert {r["id"]: r["correction"]["meaning_guarded"] for r in done.collect()} == {1: True, 2: False}
    assert len(left) == 1 and "regexp" not in left[0]._jdf.queryExecution().optimizedPlan().toString()


def test_texts_are_written_where_they_differ_only(spark, monkeypatch):
    written = []

    def kept(df, name):
        written.append((name, df))
        return session.materialize(df, name)

    monkeypatch.setattr(job, "materialize", kept)
    rows = [(1, "the receiver is here"), (2, "teh receiver"), (3, "mail a@b.com"), (4, None)]
    df = spark.createDataFrame(rows, "id int, body string")
    words = [("the", 5), ("receiver", 5), ("is", 5), ("here", 5), ("mail", 5)]
    terms = spark.createDataFrame(words, "term string, count long")
    cfg = CorrectionConfig(speller=SpellConfig(min_suggestion_count=1))
    done = job.correct(df, terms, lambda m: F.when(m.startswith("mail"), F.concat(m, F.lit("!"))).otherwise(m), cfg, "body", id_cols=["id"])
    base = next(df for name, df in written if name == "candidates")
    assert set(base.columns) == {"id", "body", "_ok", "_words", "_spelled", "_masked", "_cand"}
    found = {r["id"]: tuple(r[c] and r[c]["v"] for c in ("_spelled", "_masked", "_cand")) for r in base.collect()}
    assert found == {1: (None,) * 3, 2: ("the receiver", None, None), 3: (None, "mail __0__", "mail a@b.com!"), 4: (None,) * 3}
    out = {r["id"]: r["correction"] and tuple(r["correction"][c] for c in ("spell_corrected", "masked", "final")) for r in done.collect()}
    assert out == {
        1: (rows[0][1],) * 3, 2: ("the receiver",) * 3, 3: ("mail a@b.com", "mail __0__", "mail a@b.com!"), 4: None
    }
