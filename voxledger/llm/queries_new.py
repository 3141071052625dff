"""Queries of language identification, embedding whitening and the conversation trie."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from voxledger.llm import compression_language, embedding_whitening, prefix_trie
from voxledger.llm.tables import table
from voxledger.plans.registry import query


@query("op11_embedding_whitening")
def op11_embedding_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return embedding_whitening.whiten(table(spark, folder, "embeddings").select("vec_id", "embedding"))


@query("op13_compression_language")
def op13_compression_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return compression_language.predict(docs, compression_language.fit(docs))


OP12_SQL = """
WITH RECURSIVE table_of AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i::UBIGINT, [0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[]),
    lambda a, b: xor(a >> 1, CASE WHEN a & 1 = 1 THEN 3988292384 ELSE 0 END::UBIGINT))) AS t),
named AS (
  SELECT conv_id, turn, substring(sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')), 1, 32)
    || printf('%010X', strlen(coalesce(text, ''))) AS id, strlen(coalesce(text, '')) AS size
  FROM conversations WHERE conv_id IS NOT NULL),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, id) AS i FROM named),
every AS (
  SELECT conv_id, conv_id - conv_id % 5 AS base,
    xor(4294967295::UBIGINT, list_reduce(list_prepend(4294967295::UBIGINT,
      list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::UBIGINT)),
      lambda a, b: xor(a >> 8, t[(xor(a, b) & 255)::BIGINT + 1]))) % 9 AS h
  FROM (SELECT DISTINCT conv_id FROM placed), table_of),
rebuilt AS (
  SELECT e.conv_id, 0 AS part, p.i, p.id, p.size FROM every e JOIN placed p ON p.conv_id = e.base AND p.i <= e.h
  UNION ALL SELECT e.conv_id, 1, p.i, p.id, p.size FROM every e JOIN placed p ON p.conv_id = e.conv_id AND p.i > e.h),
turns AS (
  SELECT conv_id, id, size, row_number() OVER (PARTITION BY conv_id ORDER BY part, i) AS d FROM rebuilt),
path AS (
  SELECT conv_id, 0 AS d, '' AS key, 0 AS size FROM every
  UNION ALL SELECT t.conv_id, t.d, p.key || t.id, t.size FROM path p JOIN turns t ON t.conv_id = p.conv_id AND t.d = p.d + 1),
ends AS (SELECT conv_id, max(d) AS d FROM path GROUP BY conv_id),
nodes AS (
  SELECT key, any_value(d) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(size) AS own
  FROM path p GROUP BY key),
below AS (
  SELECT a.key, n.key AS down FROM nodes n JOIN path p ON p.conv_id = n.conv_id AND p.d <= n.depth JOIN nodes a ON a.key = p.key),
children AS (SELECT substring(key, 1, length(key) - 42) AS key, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1),
subtree AS (
  SELECT b.key, sum(n.own) AS saved, count(*) FILTER (c.n IS NULL) AS leaves
  FROM below b JOIN nodes n ON n.key = b.down LEFT JOIN children c ON c.key = b.down GROUP BY b.key),
ending AS (
  SELECT p.key, sha256(string_agg(p.conv_id::VARCHAR, ',' ORDER BY p.conv_id)) AS digest
  FROM path p JOIN ends e ON e.conv_id = p.conv_id AND e.d = p.d GROUP BY p.key)
SELECT n.conv_id, n.depth::BIGINT AS depth, up.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n, 0) AS n_children,
  s.leaves AS n_leaves, s.saved::BIGINT AS saved_tokens, coalesce(e.digest, sha256('')) AS ends_sha256
FROM nodes n JOIN subtree s ON s.key = n.key LEFT JOIN children c ON c.key = n.key LEFT JOIN ending e ON e.key = n.key
LEFT JOIN nodes up ON n.depth > 0 AND up.key = substring(n.key, 1, length(n.key) - 42)
"""


@query("op12_prefix_trie", OP12_SQL)
def op12_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    turns = prefix_trie.numbered(table(spark, folder, "conversations"))
    return prefix_trie.trie(prefix_trie.with_shared_heads(turns)).drop("last_turn")
