"""Registered queries of this subpackage: each operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cutline.llm import decontaminate, html, licences, lines, ngram_join, packing, quality, quotes, repair, toxicity, urls, vectors, whitening

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_best_fit_packing(spark, folder):
    return packing.pack_documents(table(spark, folder, "documents"))


def op2_quote_linking(spark, folder):
    return quotes.link_quotes(table(spark, folder, "conversations"))


def op3_decontamination(spark, folder):
    return decontaminate.contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op4_ngram_join(spark, folder):
    return ngram_join.near_copies(table(spark, folder, "documents"), size=4, percent=85)


def op5_licence_scan(spark, folder):
    return licences.scan_licences(table(spark, folder, "documents"))


def op6_toxicity(spark, folder):
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    model = toxicity.learn(toxicity.training_rows(docs, labels))
    return toxicity.score(docs, model).select(
        "doc_id",
        toxicity.held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def op7_line_dedup(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return lines.dedup_lines(docs)


def op8_main_text(spark, folder):
    return html.extract(table(spark, folder, "pages"))


def op9_near_vectors(spark, folder):
    return vectors.near_vectors(table(spark, folder, "embeddings"))


def op10_url_filter(spark, folder):
    return urls.judge(table(spark, folder, "pages"))


def op11_conversation_repair(spark, folder):
    return repair.repair(table(spark, folder, "conversations"))


def op12_byte_quality(spark, folder):
    docs = table(spark, folder, "documents")
    model = quality.learn(docs, table(spark, folder, "labels"))
    return quality.score(docs, model).select(
        "doc_id",
        quality.held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def op13_embedding_whitening(spark, folder):
    return whitening.whiten(table(spark, folder, "embeddings"))


def queries() -> dict[str, Query]:
    own = (
        op1_best_fit_packing, op2_quote_linking, op3_decontamination, op4_ngram_join, op5_licence_scan,
        op6_toxicity, op7_line_dedup, op8_main_text, op9_near_vectors, op10_url_filter,
        op11_conversation_repair, op12_byte_quality, op13_embedding_whitening,
    )
    return {f.__name__: f for f in own}


#: The same damage, order and costs, with whole audits carried by a recursive query; crc32 is folded over bytes.
_REPAIR_SQL = r"""
WITH RECURSIVE keyed AS (
  SELECT coalesce(conv_id::VARCHAR, ' ') AS k, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda ch: unicode(ch)::UBIGINT) AS bytes
  FROM conversations),
kinds AS (
  SELECT k, turn, role, text, xor(4294967295::UBIGINT, list_reduce(list_prepend(4294967295::UBIGINT, bytes), lambda c, b:
    list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::UBIGINT) ELSE v >> 1 END))) % 20 AS kind
  FROM keyed),
damaged AS (
  SELECT k, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
    unnest(CASE kind WHEN 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM kinds WHERE kind <> 0),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY k ORDER BY turn NULLS FIRST, sha256(length(role)::VARCHAR || ':' || role || ':' || text), copy) AS rn,
    rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body
  FROM damaged),
judged AS (
  SELECT k, turn, role, text, rn, left(role, 1) AS i,
    CASE WHEN body = '' THEN 'b' WHEN row_number() OVER (PARTITION BY k, role, text ORDER BY rn) > 1 THEN 'd'
      WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault,
    lag(left(role, 1)) OVER (PARTITION BY k ORDER BY rn) || left(role, 1) AS pair
  FROM placed),
counted AS (
  SELECT k, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
    count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM judged GROUP BY k),
ways(k, rn, g0, g1, g2, g3) AS (
  SELECT k, n + 1, {'c': 0, 'a': '', 't': ''}, {'c': 6, 'a': 'II', 't': chr(10) || 'user:' || chr(10) || 'assistant:'},
    {'c': 3, 'a': 'I', 't': chr(10) || 'assistant:'}, {'c': 0, 'a': '', 't': ''} FROM counted
  UNION ALL
  SELECT k, rn, list_min([o0, {'c': 3 + g2.c, 'a': 'I' || g2.a, 't': chr(10) || 'user:' || g2.t}]),
    list_min([o1, {'c': 3 + g2.c, 'a': 'I' || g2.a, 't': chr(10) || 'user:' || g2.t}]), g2, g3
  FROM (
    SELECT k, rn, o0, o1, list_min([o2, {'c': 3 + o3.c, 'a': 'I' || o3.a, 't': chr(10) || 'assistant:' || o3.t}]) AS g2,
      list_min([o3, {'c': 3 + o2.c, 'a': 'I' || o2.a, 't': chr(10) || 'user:' || o2.t}]) AS g3
    FROM (
      SELECT j.k, j.rn,
        list_min([d0, rr, CASE WHEN i = 's' THEN {'c': k1.c, 'a': k1.a, 't': k1.t} WHEN i = 'u' THEN k2 END]) AS o0,
        list_min([d1, rr, CASE WHEN i = 'u' THEN k2 END]) AS o1,
        list_min([d2, ra, CASE WHEN i = 'a' THEN k3 END]) AS o2,
        list_min([d3, rr, CASE WHEN i = 'u' THEN k2 END]) AS o3
      FROM (
        SELECT j.k, j.rn, CASE WHEN fault IN ('', 't') THEN i END AS i,
          {'c': 4 + g0.c, 'a': 'D' || g0.a, 't': g0.t} AS d0, {'c': 4 + g1.c, 'a': 'D' || g1.a, 't': g1.t} AS d1,
          {'c': 4 + g2.c, 'a': 'D' || g2.a, 't': g2.t} AS d2, {'c': 4 + g3.c, 'a': 'D' || g3.a, 't': g3.t} AS d3,
          {'c': x + g1.c, 'a': 'K' || g1.a, 't': line || g1.t} AS k1, {'c': x + g2.c, 'a': 'K' || g2.a, 't': line || g2.t} AS k2,
          {'c': x + g3.c, 'a': 'K' || g3.a, 't': line || g3.t} AS k3,
          CASE WHEN fault IN ('', 't') THEN {'c': 3 + x + g2.c, 'a': 'R' || g2.a, 't': chr(10) || 'user:' || text || g2.t} END AS rr,
          CASE WHEN fault IN ('', 't') THEN {'c': 3 + x + g3.c, 'a': 'R' || g3.a, 't': chr(10) || 'assistant:' || text || g3.t} END AS ra
        FROM (SELECT *, chr(10) || role || ':' || text AS line, CASE fault WHEN 't' THEN 3 ELSE 0 END AS x FROM judged) AS j
        JOIN ways AS w ON w.k = j.k AND w.rn = j.rn + 1) AS j)))
SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
  coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(g0.c, 0)::BIGINT AS cost,
  coalesce(g0.a, '') AS audit, sha256(coalesce(substr(g0.t, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, coalesce(conv_id::VARCHAR, ' ') AS k FROM conversations)
LEFT JOIN counted USING (k) LEFT JOIN (SELECT k, g0 FROM ways WHERE rn = 1) USING (k)
"""


def oracle_sql() -> dict[str, str]:
    """Twins of what SQL can express; learned models, packings and similarity joins are tested against brute force."""
    return {"op11_conversation_repair": _REPAIR_SQL}
