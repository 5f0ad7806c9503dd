"""Registered queries of the corpus operators, one per operator, over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from textfix.llm import (
    audit, bpe, counts, divergence, embeddings, exact, mixing, quality, secrets, simhash, spans, toxicity, urls,
)
from textfix.llm.common import table


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.round_trip(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.remove_repeats(table(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op6_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    return counts.token_counts(table(spark, sf_dir, "documents"), path)


def op7_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(table(spark, sf_dir, "pages"))


def op8_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_duplicates(table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_vectors(table(spark, sf_dir, "embeddings"))


def op11_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.find_secrets(table(spark, sf_dir, "documents")))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(table(spark, sf_dir, "documents"))


LLM_QUERIES = {
    f.__name__: f
    for f in (
        op1_bpe, op2_simhash, op3_toxicity, op4_spans, op5_mixing, op6_counts, op7_urls, op8_exact,
        op9_quality, op10_embeddings, op11_audit, op12_secrets, op13_divergence,
    )
}

LLM_SQL = {
    "op8_exact": r"""
        WITH t AS (
            SELECT doc_id, length(coalesce(text, '')) AS points,
                   regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
            FROM documents
        ), r AS (
            SELECT doc_id, norm, count(*) OVER (PARTITION BY norm) AS group_size,
                   first_value(doc_id) OVER (PARTITION BY norm ORDER BY points DESC, doc_id) AS keep_id
            FROM t
        )
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM r
    """,
    "op11_audit": r"""
        WITH t AS (
            SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
                   regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
                   min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first
            FROM documents
        ), m AS (
            SELECT doc_id, part,
                   (len(words) < 200)::INT AS a,
                   (100 * len(list_distinct(words)) < 50 * len(words))::INT AS b,
                   (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text))::INT AS c,
                   regexp_matches(text, '[#$%&*|]')::INT AS d,
                   (doc_id > first)::INT AS e
            FROM t
        ), l AS (
            SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY 1
        ), n AS (
            SELECT part, [a, b, c, d, e] AS fails, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, count(*) AS n
            FROM m LEFT JOIN l USING (doc_id) GROUP BY ALL
        ), f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x, unnest([1, 2, 3, 4, 5]) AS k),
        o AS (
            SELECT f1.x || f2.x || f3.x || f4.x || f5.x AS filter_order, [f1.k, f2.k, f3.k, f4.k, f5.k] AS ks
            FROM f f1, f f2, f f3, f f4, f f5
            WHERE len(list_distinct([f1.k, f2.k, f3.k, f4.k, f5.k])) = 5
        ), s AS (SELECT filter_order, ks, step, ks[step] AS k FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
        r AS (
            SELECT part, filter_order, step, k,
                   list_sum(list_transform(ks[:step - 1], lambda i: fails[i])) AS before, fails[k] AS now,
                   list_sum(fails) AS failed, good, toxic, n
            FROM s, n
        ), c AS (
            SELECT part, filter_order, step, k,
                   sum(n * (coalesce(before, 0) + now = 0)::INT)::BIGINT AS kept,
                   sum(n * (coalesce(before, 0) = 0 AND now = 1)::INT)::BIGINT AS removed,
                   sum(n * (before > 0 AND now = 1)::INT)::BIGINT AS redundant,
                   sum(n * (now = 1 AND failed = 1)::INT)::BIGINT AS unique_fails,
                   sum(n * (coalesce(before, 0) = 0 AND now = 1 AND good = 1)::INT)::BIGINT AS good_lost,
                   sum(n * (coalesce(before, 0) = 0 AND now = 1 AND toxic = 1)::INT)::BIGINT AS toxic_lost
            FROM r GROUP BY ALL
        )
        SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
               (sum(removed) OVER (PARTITION BY part, k))::BIGINT AS shapley
        FROM c
    """,
    "op13_divergence": r"""
        WITH d AS (
            SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                   regexp_extract_all(coalesce(text, ''), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS found
            FROM documents
        ), t AS (
            SELECT doc, lang, source,
                   translate(unnest(found), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term
            FROM d
        ), c AS (
            SELECT lang, source, term, count(*) AS n, count(DISTINCT doc) AS docs FROM t GROUP BY ALL
        ), k AS (
            SELECT lang, term, sum(n)::HUGEINT AS lang_n FROM c GROUP BY ALL HAVING sum(docs) >= 30
        ), v AS (SELECT lang, count(*) AS v, sum(lang_n) AS lang_total FROM k GROUP BY 1),
        g AS (SELECT DISTINCT lang, source FROM d),
        cells AS (
            SELECT g.lang, g.source, k.term, coalesce(c.n, 0)::HUGEINT AS n, lang_n
            FROM g JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
        ), p AS (
            SELECT lang, source, term, n,
                   1 + 1000000000::HUGEINT * (n + 5) // (sum(n) OVER (PARTITION BY lang, source) + 5 * v) AS p,
                   1 + 1000000000::HUGEINT * (lang_n + 5) // (lang_total + 5 * v) AS q
            FROM cells JOIN v USING (lang)
        ), pairs AS (
            SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0) AS value
            FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
            LEFT JOIN (
                SELECT a.lang, a.source AS one, b.source AS two, sum(abs(a.p - b.p)) AS value
                FROM p a JOIN p b USING (lang, term) GROUP BY ALL
            ) x ON x.lang = a.lang AND x.one = a.source AND x.two = b.source
        ), found AS (
            SELECT * FROM pairs
            UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q
        ), ranked AS (
            SELECT lang, source, part, item, value::BIGINT AS value,
                   (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank
            FROM found
        )
        SELECT * FROM ranked WHERE part = 'pair' OR rank <= 50
    """,
}
