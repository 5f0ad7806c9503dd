"""Time the headline jobs; prints one JSON line.

BENCH_SF_DIR names the tables, BENCH_CPUS the local cores. Each job runs once after one warm-up of
the session, on copies of the tables in one file per core (made before, not timed); the time includes
building its plan, its dictionary and all intermediate tables.
"""

from __future__ import annotations

import json
import os
import time
import uuid

from pyspark.sql import functions as F

from textfix.operators.spelling import spell_correct
from textfix.plans import correct as job
from textfix.plans import fixtures as fx
from textfix.plans.registry import QUERIES
from textfix.session import local_session, materialize, shared_dir

HEADLINE = [
    "word_frequencies", "fuzzy_candidates", "spell_correct", "analyze_tokens", "mask", "unmask",
    "similarity", "correct", "review", "error_profile", "by_scope", "m2_pairs", "lang8_pairs",
    "latency_percentiles", "idle_sessions",
]


def timed(make) -> float:
    start = time.perf_counter()
    make().write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def dealt(spark, sf_dir: str, files: int) -> str:
    """Copy of the tables in as many files as cores: the given ones are one row group, hence one task."""
    folder = f"{shared_dir(spark)}/textfix/bench-tables-{uuid.uuid4().hex}"
    for name in ("documents", "pages", "benchmark", "conversations", "events"):
        table = fx.load(spark, sf_dir, name).repartition(files)
        table.write.parquet(f"{folder}/{name}.parquet")
    return folder


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, "textfix-bench")
    spark.sparkContext.setLogLevel("ERROR")
    given, sf_dir = sf_dir, dealt(spark, sf_dir, int(cpus))
    timed(lambda: fx.doc_sentences(spark, sf_dir).groupBy("sentence").count())

    times = {name: round(timed(lambda: QUERIES[name](spark, sf_dir)), 3) for name in HEADLINE}

    # Rates comparable with a per-sentence engine: sentences in, corrected sentences out.
    sents = materialize(fx.doc_sentences(spark, sf_dir), "bench-sentences")
    sents = sents.repartition(int(cpus)) if sents.rdd.getNumPartitions() < int(cpus) else sents
    n = sents.count()
    terms = fx.dictionary(spark, sf_dir)

    def spell():
        return spell_correct(sents, terms, fx.SPELL, "sentence", id_cols=["sid"])

    cold = timed(spell)
    ready = spell()
    warm = timed(lambda: ready)
    guards = timed(lambda: job.correct(sents, terms, job.identity, fx.CORRECTION, "sentence", id_cols=["sid"]))
    rates = {
        "sentences": n,
        "spell_sentences_per_sec": round(n / cold),
        "spell_apply_sentences_per_sec": round(n / warm),
        "correct_identity_sentences_per_sec": round(n / guards),
        "words": sents.agg(F.sum(F.size(F.split("sentence", " ")))).first()[0],
    }
    print(
        json.dumps(
            {
                "metric": "total_time_headline_jobs",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": given.rstrip("/").rsplit("sf", 1)[-1],
                "cpus": int(cpus),
                "rates": rates,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
