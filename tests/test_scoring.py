import re
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from textfix.operators import scoring

ROWS = [
    # input, gold, pred, ref, use_case
    ("he go home", "He goes home.", "he goes home", "he go home", "Basic Typos"),  # improved, match
    ("he go home", "He goes home.", "HE GO HOME!", "he goes home", "Punctuation"),  # unchanged
    ("he goes home", "He goes home.", "she went away", "he goes home", "Agreement Errors"),  # regressed
    ("abcd xy", "abcd", "abcd xz", "", "Basic Commas"),  # lateral
    ("one tow", "one two", "one two", None, "Incorrect Dates"),
    ("x", "x", "x", "x", "Repetition"),
    ("a", "b", "a", "b", "no such label"),
    (None, "b", None, "b", None),
]


@pytest.fixture(scope="module")
def scored(spark):
    df = spark.createDataFrame(
        [(i, *r) for i, r in enumerate(ROWS)],
        "id long, input string, gold string, pred string, ref string, use_case string",
    )
    return scoring.scored(df).cache()


def norm(s):
    return re.sub(r"\s+", " ", (s or "").strip().lower()).rstrip(".!?").strip()


def sim(a, b):
    return SequenceMatcher(None, norm(a), norm(b)).ratio()


def test_rates(scored):
    got = scoring.match_rate(scored).first()
    n = len(ROWS)
    assert got["our_exact"] == pytest.approx(100 * sum((r[2] or "") == r[1] for r in ROWS) / n)
    assert got["our_norm"] == pytest.approx(100 * sum(norm(r[2]) == norm(r[1]) for r in ROWS) / n)
    assert got["ref_norm"] == pytest.approx(100 * sum(norm(r[3]) == norm(r[1]) for r in ROWS) / n)
    means = scoring.mean_similarity(scored).first()
    for name, k in (("sim_in", 0), ("sim_out", 2), ("sim_ref", 3)):
        assert means[name] == pytest.approx(sum(sim(r[k], r[1]) for r in ROWS) / n)
    moves = [sim(r[2], r[1]) - sim(r[0], r[1]) for r in ROWS]
    assert scoring.direction(scored).first().asDict() == {
        "better": sum(m > 1e-9 for m in moves), "same": sum(abs(m) <= 1e-9 for m in moves),
        "worse": sum(m < -1e-9 for m in moves),
    }


def test_error_profile(scored):
    got = scoring.error_profile(scored).first().asDict()
    assert {k: got[k] for k in ("n", "unchanged", "edited", "improved", "regressed", "lateral", "exact_edits")} == {
        "n": 4, "unchanged": 1, "edited": 3, "improved": 1, "regressed": 1, "lateral": 1, "exact_edits": 1
    }
    assert got["edit_precision"] == pytest.approx(100 / 3) and got["edited_pct"] == 75.0
    assert not scoring.model_profile(scored).first()["suspect_run"]
    broken = scoring.model_profile(scored.where("id = 2")).first()
    assert broken["suspect_run"] and broken["match_pct"] == 0
    none = scoring.error_profile(scored.where("id = 6")).first()
    assert (none["n"], none["edited_pct"], none["improved_pct"]) == (0, None, 0.0)


def test_regressions(scored):
    row = scoring.regressions(scored).first()
    assert (row["id"], row["model_output"]) == (2, "she went away")
    assert row["sim_in"] == 1.0 and row["sim_out"] == round(sim(ROWS[2][2], ROWS[2][1]), 3)


def test_scope(scored):
    got = [(r["bucket"], r["n"]) for r in scoring.by_scope(scored).collect()]
    assert got == [
        ("CORE (in-scope)", 4), ("FORMATTING (out of scope)", 1), ("STYLE/NAMES (out of scope)", 1),
        ("UNCLASSIFIED", 2),
    ]
    nets = {r["bucket"]: r["net"] for r in scoring.by_scope(scored).collect()}
    assert nets["STYLE/NAMES (out of scope)"] == "net+"
    assert {r["bucket"]: r["n"] for r in scoring.scope_counts(scored).collect()} == dict(got)
    two = scored.groupBy(scoring.in_or_out(F.col("use_case")).alias("b")).count().collect()
    assert {r["b"]: r["count"] for r in two} == {"CORE (in-scope)": 4, "OUT (out of scope)": 4}


def test_by_use_case(scored):
    got = scoring.by_use_case(scored).collect()
    assert len(got) == len(ROWS) and all(r["n"] == 1 for r in got)


def test_taxonomy_sizes():
    assert [len(x) for x in (scoring.CORE_LABELS, scoring.FORMATTING_LABELS, scoring.STYLE_LABELS)] == [16, 6, 7]


def test_report_of_all_levels_equals_the_single_reports(spark, scored):
    report = scoring.evaluate_report(scored)
    rows = {(r["level"], r["label"]): r.asDict() for r in report.collect()}
    whole = rows["all", None]
    assert {k: whole[k] for k in ("our_exact", "our_norm", "ref_exact", "ref_norm")} == scoring.match_rate(scored).first().asDict()
    assert {k: whole[k] for k in ("sim_in", "sim_out", "sim_ref")} == pytest.approx(scoring.mean_similarity(scored).first().asDict())
    assert {k: whole[k] for k in ("better", "same", "worse")} == scoring.direction(scored).first().asDict()
    for r in scoring.by_scope(scored).collect():
        assert (rows["bucket", r["bucket"]]["n"], rows["bucket", r["bucket"]]["our_norm"]) == (r["n"], r["ours"])
    for r in scoring.by_use_case(scored).collect():
        assert (rows["use_case", r["use_case"]]["n"], rows["use_case", r["use_case"]]["ref_norm"]) == (r["n"], r["ref"])
    core, profile = rows["bucket", scoring.CORE], scoring.error_profile(scored).first()
    for name in ("n", "unchanged", "improved", "regressed", "lateral", "exact_edits"):
        assert core[name] == profile[name]
    assert len(rows) == report.count() == 1 + scored.select("bucket").distinct().count() + scored.select("use_case").distinct().count()


def test_report_reads_its_rows_once(spark, tmp_path):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(ROWS)], "id long, input string, gold string, pred string, ref string, use_case string")
    df.write.parquet(str(tmp_path / "rows"))
    report = scoring.evaluate_report(scoring.scored(spark.read.parquet(str(tmp_path / "rows"))))
    plan = report._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("ArrowEvalPython") == 1
    empty = scoring.evaluate_report(scoring.scored(df.limit(0)))
    assert [(r["level"], r["n"]) for r in empty.collect()] == [("all", 0)]
