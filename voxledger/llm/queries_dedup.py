"""Queries of the two de-duplication operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxledger.llm import line_dedup, minmax_dedup
from voxledger.llm.tables import table
from voxledger.plans.registry import query

WORD = r"[^\x20\x09-\x0D]+"
ASCII_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
BLANK_CHARS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

OP8_SQL = f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents),
keyed AS (
  SELECT *, {ASCII_LOWER.format(f"trim(line, {BLANK_CHARS})")} AS key FROM lines),
shared AS (
  SELECT key, min(doc_id) AS first_doc FROM keyed WHERE length(key) >= 10
  GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
marked AS (
  SELECT k.doc_id, k.pos, k.line, s.key IS NOT NULL AND k.doc_id <> s.first_doc AS gone
  FROM keyed k LEFT JOIN shared s ON k.key = s.key AND length(k.key) >= 10)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


@query("op8_line_dedup", OP8_SQL)
def op8_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    cut = line_dedup.dedup_lines(table(spark, folder, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


OP7_SQL = f"""
WITH RECURSIVE spelled AS (
  SELECT doc_id, regexp_extract_all({ASCII_LOWER.format("coalesce(text, '')")}, '{WORD}') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]]
    ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM spelled),
alike AS (SELECT s, min(doc_id) AS rep, len(s) AS n FROM sets WHERE len(s) > 0 GROUP BY s),
items AS (SELECT rep, n, unnest(s) AS item FROM alike),
ranked AS (
  SELECT i.rep, i.n, i.item, row_number() OVER (PARTITION BY i.rep ORDER BY f.df, i.item) AS r
  FROM items i JOIN (SELECT item, count(*) AS df FROM items GROUP BY item) f ON i.item = f.item),
prefix AS (SELECT rep, n, item FROM ranked WHERE r <= n - (80 * n + 99) // 100 + 1),
candidates AS (
  SELECT DISTINCT x.rep AS a, y.rep AS b FROM prefix x JOIN prefix y ON x.item = y.item
  WHERE x.rep < y.rep AND 100 * least(x.n, y.n) >= 80 * greatest(x.n, y.n)),
common AS (
  SELECT c.a, c.b, count(*) AS k FROM candidates c
  JOIN items x ON x.rep = c.a JOIN items y ON y.rep = c.b AND y.item = x.item GROUP BY c.a, c.b),
links AS (
  SELECT c.a, c.b FROM common c JOIN alike x ON x.rep = c.a JOIN alike y ON y.rep = c.b
  WHERE 100 * c.k >= 80 * (x.n + y.n - c.k)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (
  SELECT rep AS node, rep AS seen FROM alike
  UNION SELECT r.node, l.b FROM reach r JOIN both_ways l ON l.a = r.seen),
class AS (SELECT node, min(seen) AS component_id FROM reach GROUP BY node)
SELECT d.doc_id, len(d.s) AS n_shingles, coalesce(c.component_id, d.doc_id) AS component_id,
       coalesce(c.component_id, d.doc_id) = d.doc_id AS kept
FROM sets d LEFT JOIN alike a ON d.s = a.s AND len(d.s) > 0 LEFT JOIN class c ON c.node = a.rep
"""


@query("op7_minmax_dedup", OP7_SQL)
def op7_minmax_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return minmax_dedup.near_classes(docs, minmax_dedup.Parameters(width=2))
