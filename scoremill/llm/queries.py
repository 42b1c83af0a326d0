"""Registered queries of this subpackage: each operator over its whole table, and its SQL twin where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from scoremill.llm import (
    alignment,
    attention,
    filter_audit,
    fingerprints,
    language,
    licenses,
    mixing,
    neardup,
    neighbours,
    pieces,
    secrets,
    toxicity,
    warc,
)
from scoremill.llm.words import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def registered(name: str, sql: str | None = None):
    def add(query):
        QUERIES[name] = query
        if sql is not None:
            SQL[name] = sql
        return query

    return add


MIX_SQL = r"""
WITH sizes AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5('7:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS k
  FROM documents),
s1 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sizes GROUP BY source),
s2 AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rk,
         CAST(sum(source_size) OVER () AS BIGINT) * CAST(1.5 AS DOUBLE) AS budget FROM s1),
s3 AS (SELECT *, CASE rk % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w, 2 * source_size AS cap FROM s2),
s4 AS (SELECT *, cap / w AS ratio FROM s3),
s5 AS (SELECT *, (budget - coalesce(CAST(sum(cap) OVER (ORDER BY ratio, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0))
         / CAST(sum(w) OVER (ORDER BY ratio, rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS level FROM s4),
s6 AS (SELECT level AS final FROM s5 WHERE level <= ratio ORDER BY ratio, rk LIMIT 1),
t AS (SELECT source, rk, source_size, budget,
        least(CAST(cap AS DOUBLE), coalesce(w * (SELECT final FROM s6), CAST(cap AS DOUBLE))) AS target FROM s5),
q AS (SELECT d.doc_id, d.source, d.size, t.rk, t.source_size, t.target, t.budget,
        CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY k, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS ends
      FROM sizes AS d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (SELECT doc_id, size, rk, budget, (source_size * n + ends) / target AS finish
      FROM q, (VALUES (0), (1)) AS turns(n) WHERE size > 0),
r AS (SELECT doc_id, size, budget, sum(size) OVER (ORDER BY finish, rk ROWS UNBOUNDED PRECEDING) AS running FROM e),
c AS (SELECT doc_id, CAST(count(*) AS INTEGER) AS copies FROM r WHERE running <= budget GROUP BY doc_id)
SELECT q.doc_id, q.source, q.size, q.source_size, q.target, q.size * coalesce(c.copies, 0) AS taken,
       coalesce(c.copies, 0) AS copies
FROM q LEFT JOIN c ON q.doc_id = c.doc_id"""


@registered("op5_mix_sources", MIX_SQL)
def op5_mix_sources(spark, d):
    return mixing.mix(table(spark, d, "documents"))


@registered("op4_secret_scan")
def op4_secret_scan(spark, d):
    return secrets.report(table(spark, d, "documents"))


@registered("op6_language_id")
def op6_language_id(spark, d):
    return language.identify(table(spark, d, "documents"))


@registered("op10_near_duplicates")
def op10_near_duplicates(spark, d):
    return neardup.near_duplicates(table(spark, d, "documents"))


@registered("op7_fingerprints")
def op7_fingerprints(spark, d):
    return fingerprints.fingerprint(table(spark, d, "documents"))


@registered("op2_license_scan", licenses.sql())
def op2_license_scan(spark, d):
    return licenses.scan(table(spark, d, "documents"))


@registered("op3_sentence_pieces")
def op3_sentence_pieces(spark, d):
    return pieces.encode(table(spark, d, "documents"))


@registered("op9_nearest_vectors")
def op9_nearest_vectors(spark, d):
    return neighbours.nearest(table(spark, d, "embeddings"))


@registered("op1_warc_derivatives")
def op1_warc_derivatives(spark, d):
    return warc.derive(warc.responses(table(spark, d, "pages")))


@registered("op8_toxicity_chain")
def op8_toxicity_chain(spark, d):
    return toxicity.score(table(spark, d, "documents"), table(spark, d, "labels"))


@registered("op13_token_alignment")
def op13_token_alignment(spark, d):
    return alignment.align(table(spark, d, "documents"))


@registered("op11_filter_audit", filter_audit.SQL)
def op11_filter_audit(spark, d):
    return filter_audit.audit(spark, f"{d}/documents.parquet", table(spark, d, "labels"))


@registered("op12_attention_scores")
def op12_attention_scores(spark, d):
    return attention.score(table(spark, d, "documents"))
