"""Some registered queries against their SQL; the full set is checked by the driver."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from textfix.functions import similarity as sim
from textfix.operators import scoring
from textfix.plans import fixtures
from textfix.plans.registry import QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "documents pages benchmark conversations events"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for table in TABLES.split():
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    return con


@pytest.mark.parametrize("name", ["spell_correct", "correct", "unmask", "regressions", "m2_pairs", "idle_sessions", "meaning_guard", "word_diff", "model_correct", "m2_files", "bigram_rerank", "analyze_tokens", "spell_correct_context", "context_fixes"])
def test_query_equals_sql(spark, duck, name):
    got = entry.queries()[name](spark, DATA)
    want = duck.sql(entry.oracle_sql()[name])
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    key = lambda row: tuple(str(v) for v in row)
    left = sorted((tuple(r) for r in got.select(*cols).collect()), key=key)
    right = sorted(want.select(*[f'"{c}"' for c in cols]).fetchall(), key=key)
    assert left == right


def test_every_query_has_sql():
    # The corpus operators have tests of their own where SQL can't express them.
    assert set(QUERIES) <= set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    rows = entry.entry(spark)
    assert rows.columns == ["doc_id", "original", "corrected", "changed"]
    assert rows.where("changed").count() > 0


def test_most_comparisons_reach_the_udf(spark):
    rows = scoring.with_norms(fixtures.eval_rows(spark, DATA))
    gold = F.col("n_gold")
    pairs = [sim.compare(F.col(c), gold)["done"].isNull() for c in ("n_in", "n_out", "n_ref")]
    counts = rows.select(*pairs, (F.length("gold") >= 200).alias("long")).toDF("a", "b", "c", "long")
    done = counts.agg(
        F.count(F.lit(1)).alias("n"),
        sum(F.count_if(c) for c in "abc").alias("udf"),
        F.count_if(F.col("long") & F.col("a")).alias("long_udf"),
    ).first()
    assert done["udf"] >= 0.5 * 3 * done["n"] and done["long_udf"] > 0
    meant = fixtures.word_pairs(spark, DATA).where(F.col("src") != F.col("tgt"))
    assert meant.where(~F.col("tgt").startswith(F.col("src"))).count() >= 0.5 * meant.count()


def test_stream_reads_a_table_in_a_folder(spark, tmp_path):
    for name in ("conversations", "documents"):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").repartition(2).write.parquet(str(tmp_path / f"{name}.parquet"))
    got, want = (QUERIES["stream_correct"](spark, p).collect() for p in (str(tmp_path), "/root/testdata/sf0.001"))
    assert got and len(got) == len(want)
    assert {r["conv_id"] for r in got} == {r["conv_id"] for r in want}


@pytest.mark.parametrize("name, most", [("minimal_edit", 4), ("length_cap", 3)])
def test_texts_are_split_into_words_once(spark, name, most):
    plan = QUERIES[name](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < plan.count("regexp_extract_all") - plan.count("[^.!?]+[.!?]*") <= most


@pytest.mark.parametrize("name", ["lang8_pairs", "m2_blocks"])
def test_lines_are_split_into_fields_once(spark, name):
    plan = QUERIES[name](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1


def test_halves_of_a_text_are_found_once(spark):
    rows = fixtures.eval_rows(spark, DATA)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("instr(") == 1
    short = rows.select("use_case")._jdf.queryExecution().optimizedPlan().toString()
    assert "instr(" not in short
