"""Queries of decontamination and of the tokenizer operators."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from voxledger.llm import count_viterbi, elias_fano_ids, piece_transducer, template_decontam
from voxledger.llm.tables import table
from voxledger.plans.registry import query

PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")


_UPPER = "".join(map(chr, [*range(0x41, 0x5B), *range(0xC0, 0xD7), *range(0xD8, 0xDF)]))
_LOWER = "".join(map(chr, [*range(0x61, 0x7B), *range(0xE0, 0xF7), *range(0xF8, 0xFF)]))
_MARKS = r"[!-/:-@\[-`{-~]+"
_UNITS = ", ".join(f"'{u}'" for u in template_decontam.UNITS)



def _ahead(column: str) -> str:
    """SQL: a window's values of a column from this row on, joined."""
    rest = [f"CASE WHEN width > {j} THEN lead({column}, {j}) OVER w END" for j in range(1, 8)]
    return f"concat_ws(chr(31), {', '.join([column, *rest])})"


OP1_SQL = rf"""
WITH texts AS (
  SELECT 'd' AS side, doc_id AS id, text FROM documents UNION ALL SELECT 'b', item_id, text FROM benchmark),
parts AS (
  SELECT side, id, unnest(p) AS raw, generate_subscripts(p, 1) AS i
  FROM (SELECT side, id, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]+|[^\x20\x09-\x0D]+') AS p FROM texts)),
lined AS (
  SELECT *, regexp_replace(regexp_replace(raw, '^{_MARKS}', ''), '{_MARKS}$', '') AS core,
    sum(length(raw) - length(replace(raw, chr(10), ''))) OVER (PARTITION BY side, id ORDER BY i) AS line
  FROM parts),
cores AS (SELECT * FROM lined WHERE core <> '' AND NOT regexp_matches(raw, '^[\x20\x09-\x0D]')),
placed AS (
  SELECT side, id, core, translate(core, '{_UPPER}', '{_LOWER}') AS word,
    row_number() OVER w AS n, lag(raw) OVER w AS before, lag(line) OVER w AS line_before, line,
    regexp_full_match(core, '[0-9][0-9.,:/-]*') AS number, lag(core) OVER w AS core_before
  FROM cores WINDOW w AS (PARTITION BY side, id ORDER BY i)),
kinds AS (
  SELECT side, id, n, word, regexp_matches(core, '^[A-ZÀ-ÖØ-Þ][a-zà-ÿ]') AS capital, CASE
    WHEN number THEN 'number' WHEN regexp_matches(core, '^[0-9]') THEN 'quantity'
    WHEN word IN ({_UNITS}) AND regexp_full_match(core_before, '[0-9][0-9.,:/-]*') THEN 'unit'
    WHEN regexp_matches(core, '^[A-ZÀ-ÖØ-Þ][a-zà-ÿ]') AND before IS NOT NULL AND line = line_before
      AND NOT regexp_matches(before, '[.!?:;]$') THEN 'name' END AS kind
  FROM placed),
twice AS (SELECT *, CASE WHEN kind IS NULL AND capital THEN 'name' ELSE kind END AS wide FROM kinds),
lists AS (
  SELECT side, id, list(coalesce('<' || kind || '>', word) ORDER BY n) AS codes, list(word ORDER BY n) AS words,
    list(coalesce('<' || wide || '>', word) ORDER BY n) AS wide_codes,
    list(kind IS NOT NULL ORDER BY n) AS slots, list(wide IS NOT NULL ORDER BY n) AS wide_slots, count(*) AS size FROM twice GROUP BY side, id),
widths AS (SELECT DISTINCT least(size, 8) AS width FROM lists WHERE side = 'b'),
spots AS (
  SELECT t.side, t.id, n AS k, width, size, coalesce('<' || kind || '>', word) AS c, coalesce('<' || wide || '>', word) AS wc, word,
    (kind IS NULL)::INT AS literal
  FROM twice t JOIN lists l ON l.side = t.side AND l.id IS NOT DISTINCT FROM t.id
  JOIN widths ON size >= width AND (t.side = 'd' OR width = least(size, 8))),
cut AS (
  SELECT side, id, width, k, size, {_ahead("c")} AS code, {_ahead("wc")} AS wide_code, {_ahead("word")} AS plain,
    side = 'b' AND sum(literal) OVER (w ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) >= CASE WHEN width = 8 THEN 4 ELSE least(3, width) END AS rich
  FROM spots WINDOW w AS (PARTITION BY side, id, width ORDER BY k) QUALIFY k <= size - width + 1),
readings AS (
  SELECT side, id, width, k, 'first' AS kind, 'template' AS space, code FROM cut WHERE rich OR side = 'd'
  UNION ALL SELECT side, id, width, k, 'wide', 'template', wide_code FROM cut WHERE (rich OR side = 'd') AND wide_code <> code
  UNION ALL SELECT side, id, width, k, 'plain', 'verbatim', plain FROM cut WHERE NOT rich),
totals AS (SELECT id, count(*) AS n_windows FROM cut WHERE side = 'b' GROUP BY id),
near AS (
  SELECT d.id AS doc_id, b.id AS item_id, d.k AS dk, b.k, d.kind AS d_kind, b.kind AS b_kind, b.width
  FROM readings d JOIN readings b
    ON d.side = 'd' AND b.side = 'b' AND d.space = b.space AND d.width = b.width AND d.code = b.code),
met AS (
  SELECT DISTINCT doc_id, item_id, dk - k AS shift, k,
    CASE b_kind WHEN 'plain' THEN [] ELSE list_filter(b.words[k : k + width - 1], lambda x, j: CASE b_kind WHEN 'wide' THEN b.wide_slots[k + j - 1] ELSE b.slots[k + j - 1] END) END AS ours,
    CASE d_kind WHEN 'plain' THEN [] ELSE list_filter(d.words[dk : dk + width - 1], lambda x, j: CASE d_kind WHEN 'wide' THEN d.wide_slots[dk + j - 1] ELSE d.slots[dk + j - 1] END) END AS theirs
  FROM near JOIN lists d ON d.side = 'd' AND d.id = doc_id JOIN lists b ON b.side = 'b' AND b.id = item_id),
pairs AS (
  SELECT doc_id, item_id, shift, o, t, 2 * count(*) + (o = t)::INT AS score
  FROM (SELECT doc_id, item_id, shift, unnest(ours) AS o, unnest(theirs) AS t FROM met)
  GROUP BY doc_id, item_id, shift, o, t),
ahead AS (
  SELECT doc_id, item_id, shift, list(o || chr(30) || t) AS known FROM pairs p
  WHERE NOT EXISTS (SELECT 1 FROM pairs q WHERE q.doc_id = p.doc_id AND q.item_id = p.item_id AND q.shift = p.shift
    AND (q.o = p.o) <> (q.t = p.t) AND q.score >= p.score)
  GROUP BY ALL),
steady AS (
  SELECT m.doc_id, m.item_id, m.k, m.ours = m.theirs AS same FROM met m
  LEFT JOIN ahead a ON a.doc_id = m.doc_id AND a.item_id = m.item_id AND a.shift = m.shift
  WHERE m.ours = m.theirs
    OR list_has_all(coalesce(a.known, []), list_transform(m.ours, lambda x, j: x || chr(30) || m.theirs[j])))
SELECT doc_id, item_id, count(DISTINCT k) AS n_matched, n_windows,
  count(DISTINCT k) FILTER (same) >= 0.5 * n_windows AS exact
FROM steady JOIN totals ON id = item_id GROUP BY doc_id, item_id, n_windows
HAVING count(DISTINCT k) >= 0.5 * n_windows
"""


@query("op1_template_decontam", OP1_SQL)
def op1_template_decontam(spark: SparkSession, folder: str) -> DataFrame:
    """By the rules of the pipeline's stage: all windows, both readings, clashes cost their windows only."""
    return template_decontam.leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"), template_decontam.WHOLE)


@query("op9_piece_transducer")
def op9_piece_transducer(spark: SparkSession, folder: str) -> DataFrame:
    """Digests of ids and decoded texts; ``round_trip`` tells whether decoding gives the text back."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return piece_transducer.digests(docs, PIECE_MODEL)


WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


@query("op3_elias_fano_ids")
def op3_elias_fano_ids(spark: SparkSession, folder: str) -> DataFrame:
    return elias_fano_ids.encode_and_read(table(spark, folder, "documents").select("doc_id", "text"), WORD_TOKENIZER, end_id=2)


@query("op10_count_viterbi")
def op10_count_viterbi(spark: SparkSession, folder: str) -> DataFrame:
    """Token counts with the pieces and scores of the model file as a unigram vocabulary."""
    return count_viterbi.token_counts(table(spark, folder, "documents"), count_viterbi.vocabulary(PIECE_MODEL))
