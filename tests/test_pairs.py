import pytest
from pyspark.sql import functions as F

from textfix.operators import pairs
from textfix.sources import readers, writers

M2 = """S This are a sentence .
A 1 2|||R:VERB|||is|||REQUIRED|||-NONE-|||0
A 2 3|||R:DET|||the|||REQUIRED|||-NONE-|||1

S all fine here
A -1 -1|||noop|||-NONE-|||REQUIRED|||-NONE-|||0

S cut short
S out of  order
A 2 3|||U:X||||||REQUIRED|||-NONE-|||0
A 0 1|||R:X|||in the|||REQUIRED|||-NONE-|||0
   
A 0 1|||R:X|||ignored|||REQUIRED|||-NONE-|||0

S last one
A 2 2|||M:X|||here|||REQUIRED|||-NONE-|||0"""
WANT = {
    ("This are a sentence .", "This is a sentence ."), ("all fine here", "all fine here"),
    ("out of order", "in the of"), ("last one", "last one here"),
}


def as_set(df):
    return {(r["src"], r["tgt"]) for r in df.collect()}


@pytest.fixture
def m2_file(tmp_path):
    (tmp_path / "a.m2").write_text(M2)
    return str(tmp_path / "*.m2")


def test_m2_lines(spark, m2_file):
    lines = readers.read_lines(spark, m2_file)
    for chunk in (3, 100_000):
        blocks = pairs.m2_blocks(lines, chunk_rows=chunk)
        assert as_set(pairs.m2_pairs(blocks)) == WANT
    other = pairs.m2_pairs(pairs.m2_blocks(lines, annotator=1))
    assert ("This are a sentence .", "This are the sentence .") in as_set(other)
    assert len(as_set(pairs.prepare_m2(blocks))) == 3
    assert len(as_set(pairs.prepare_m2(blocks, keep_identity=True))) == 4
    assert pairs.prep_counters(blocks).first().asDict() == {
        "files": 1, "broken": 0, "pairs": 3, "identities": 1
    }


BROKEN = """S one two
A 0 1|||R:X|||x|||REQUIRED|||-NONE-

S three four
A 0 b|||R:X|||x|||REQUIRED|||-NONE-|||0
A 1 2|||R:X|||y|||REQUIRED|||-NONE-|||0

S five six
A 0 1|||R:X|||x|||REQUIRED|||-NONE-|||0

"""


def test_blocks_with_malformed_lines_are_dropped_and_counted(spark, tmp_path):
    (tmp_path / "a.m2").write_text(BROKEN)
    path = str(tmp_path / "*.m2")
    for blocks in (pairs.m2_blocks(readers.read_lines(spark, path)), readers.read_m2_blocks(spark, path)):
        assert as_set(pairs.m2_pairs(blocks)) == {("five six", "x six")}
        assert pairs.prep_counters(blocks).first().asDict() == {
            "files": 1, "broken": 2, "pairs": 1, "identities": 0
        }


def test_m2_blocks_of_clean_files(spark, tmp_path):
    (tmp_path / "a.m2").write_text("S a b\nA 0 1|||R|||x|||R|||-|||0\nA 0 0|||M|||y|||R|||-|||0\n\nS c\n\n")
    (tmp_path / "b.m2").write_text("S a b\nA 0 1|||R|||x|||R|||-|||0\nA 0 0|||M|||y|||R|||-|||0\n")
    clean = readers.read_m2_blocks(spark, str(tmp_path / "*.m2"))
    assert as_set(pairs.m2_pairs(clean)) == {("a b", "y x b"), ("c", "c")}
    assert clean.count() == 3
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        readers.read_lines(spark, str(tmp_path / "*.none"))


def test_lang8(spark):
    rows = [
        "1\ts\tu\t1\the go\the goes", " +1_0 \ts\tu\t1\t a b \ta c\tmore", "0\ts\tu\t1\tx\ty",
        "x\ts\tu\t1\tx\ty", "1\ts\tu\t1\tonly", "-1\ts\tu\t1\tx\ty", "1\ts\tu\t1\tsame\tsame",
        "2\ts\tu\t1\tone\tone two three four", "2\ts\tu\t1\tone\tone two three",
        "1\ts\tu\t1\the go\the goes", "1\ts\tu\t1\t \ty", "", "1_\ts\tu\t1\tx\ty", "00\ts\tu\t1\tx\ty",
        "1\ts\tu\t1\ta b c d e\tv w x y e",
    ]
    lines = spark.createDataFrame(list(enumerate(rows)), "line_no long, line string").repartition(3)
    got = pairs.prepare_lang8(lines).orderBy("line_no").collect()
    assert [(r["line_no"], r["src"], r["tgt"]) for r in got] == [
        (0, "he go", "he goes"), (1, "a b", "a c"), (8, "one", "one two three"),
        (14, "a b c d e", "v w x y e"),
    ]
    assert len(as_set(pairs.prepare_lang8(lines, max_edits=2))) == 3
    assert as_set(pairs.prepare_lang8(lines, limit=2)) == {("he go", "he goes"), ("a b", "a c")}
    assert len(as_set(pairs.prepare_lang8(lines, keep_identity=True))) == 5
    assert len(as_set(pairs.prepare_lang8(lines, max_ratio=4.0))) == 5


def test_mix(spark):
    clean = spark.createDataFrame([("a", "b")], "src string, tgt string")
    noisy = spark.createDataFrame([(i, "a", "b") for i in range(9)], "line_no long, src string, tgt string")
    assert pairs.mix_corpora(clean, noisy, 4).count() == 5


def test_pair_files(spark, tmp_path):
    rows = [('"hi" he say', "x"), ("  a", "b "), ("tab", "q\"q")]
    df = spark.createDataFrame(rows, "src string, tgt string")
    writers.write_pairs(df, str(tmp_path / "out"))
    assert as_set(readers.read_pairs(spark, str(tmp_path / "out"))) == set(rows)
    (tmp_path / "q.tsv").write_text('"hi" x\ty\n\tz\na\t \none\nk\tl\tm\n')
    assert as_set(readers.read_pairs(spark, str(tmp_path / "q.tsv"))) == {('"hi" x', "y"), ("k", "l")}
    (tmp_path / "r.tsv").write_text('"a\nb"\tc\nd\te\n')
    assert as_set(readers.read_pairs(spark, str(tmp_path / "r.tsv"), quoted=True)) == {("a\nb", "c"), ("d", "e")}


def test_eval_csv(spark, tmp_path):
    path = tmp_path / "e.csv"
    path.write_bytes(
        b'id,input,Correct Sentence,Use Case,actual_output\n1,"a, ""b""\nc",g,Punctuation,r\n2,\xff x,g2,,\n'
    )
    got = readers.read_eval_csv(spark, str(path)).collect()
    assert tuple(got[0]) == ('a, "b"\nc', "g", "Punctuation", "r")
    assert got[1]["input"].endswith(" x") and tuple(got[1])[1:] == ("g2", "", "")
    path.write_text("input,Correct Sentence\na,b\n")
    assert tuple(readers.read_eval_csv(spark, str(path)).first()) == ("a", "b", "?", "")


def test_dictionary_files(spark, tmp_path):
    (tmp_path / "d.txt").write_text("the 23135851162\nof 13151942776\n\nbad\n")
    (tmp_path / "x.txt").write_text("demra 5\nof 1\n")
    table = readers.read_dictionary(spark, str(tmp_path / "d.txt"), [str(tmp_path / "x.txt")])
    assert {r["term"]: r["count"] for r in table.collect()} == {
        "the": 23135851162, "of": 13151942777, "demra": 5
    }
    (tmp_path / "none.txt").write_text("\n")
    with pytest.raises(FileNotFoundError):
        readers.read_dictionary(spark, str(tmp_path / "none.txt"))


def test_metric_files(spark, tmp_path):
    df = spark.createDataFrame(
        [("throughput", "mini", 1, 4, 47.2), ("speller_only", None, None, None, 6480.0)],
        "metric string, model string, beam int, batch int, value double",
    )
    writers.write_metrics(df.coalesce(1), str(tmp_path / "m"))
    text = "".join(p.read_text() for p in (tmp_path / "m").glob("part-*"))
    assert "speller_only,-,-,-,6480.0" in text
    assert readers.read_metrics(spark, str(tmp_path / "m")).drop("seq").exceptAll(df).count() == 0
    regs = df.select(
        F.lit('say "x"').alias("input"), F.lit("o").alias("model_output"), F.lit("g").alias("gold"),
        F.lit(0.5).alias("sim_in"), F.lit(0.25).alias("sim_out"),
    ).limit(1)
    writers.write_regressions(regs, str(tmp_path / "r"))
    text = "".join(p.read_text() for p in (tmp_path / "r").glob("part-*"))
    assert text.splitlines() == ["input,model_output,gold,sim_in,sim_out", '"say ""x""",o,g,0.5,0.25']


def test_files_without_blocks_are_counted(spark, tmp_path):
    from textfix.operators.pairs import m2_blocks, prep_counters
    from textfix.sources.readers import matched_files, read_lines

    (tmp_path / "a.m2").write_text("S a b\nA 0 1|||R|||x|||REQUIRED|||-NONE-|||0\n\n")
    (tmp_path / "b.m2").write_text("nothing here\n")
    (tmp_path / "c.m2").write_text("")
    path = f"{tmp_path}/*.m2"
    blocks = m2_blocks(read_lines(spark, path))
    got = prep_counters(blocks, files=matched_files(spark, path)).first()
    assert (got["files"], got["pairs"]) == (3, 1)
    assert prep_counters(blocks).first()["files"] == 1


def test_counters_come_with_the_write(spark, tmp_path):
    lines = ["S a b", "A 0 1|||R|||x|||REQUIRED|||-NONE-|||0", "", "S same", "", "S a b", "A 0 1|||R|||x|||REQUIRED|||-NONE-|||0", "", "S bad", "A q 1|||R|||x|||REQUIRED|||-NONE-|||0", ""]
    df = spark.createDataFrame([("f", i, x) for i, x in enumerate(lines)], "file string, line_no long, line string")
    blocks = pairs.m2_blocks(df)
    made, counters = pairs.prepare_m2_counted(blocks)
    made.write.parquet(str(tmp_path / "m2"))
    assert counters.get() == {"identities": 1, "broken": 1, "pairs": 1}
    assert {k: v for k, v in pairs.prep_counters(blocks).first().asDict().items() if k != "files"} == counters.get()
    assert sorted(map(tuple, made.collect())) == sorted(map(tuple, pairs.prepare_m2(blocks).collect()))
    entry = "1\t1\tu\t1\t{}\t{}"
    rows = [entry.format("a b", "a c"), entry.format("s", "s"), entry.format("a b", "a c"), "short", "x\t1\tu\t1\tp\tq", entry.format("", "z")]
    lang8 = spark.createDataFrame(list(enumerate(rows)), "line_no long, line string")
    made, counters = pairs.prepare_lang8_counted(lang8)
    made.write.parquet(str(tmp_path / "lang8"))
    assert counters.get() == {"identities": 1, "broken": 2, "pairs": 1}
    assert sorted(map(tuple, made.collect())) == sorted(map(tuple, pairs.prepare_lang8(lang8).collect()))
