"""Registered queries: lookups, mixing, nesting, roll-ups of non-text tables, inference."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxledger.functions import text
from voxledger.operators import inference, lookup, mixing, nested, rollup
from voxledger.operators.ordering import with_ordinal
from voxledger.plans.registry import query
from voxledger.plans.workload import ISO3, PAIRS_SQL, UTTERANCES_SQL, pairs, strip_sql, table, utterances
from voxledger.session import scratch_path
from voxledger.sources.readers import normalize_corpus

# ---------------------------------------------------------------- lookups


def _wav_info(spark, d):
    """Labels as a recording dimension: two neighbouring documents share a recording name."""
    even = F.col("doc_id") - F.col("doc_id") % 2
    return table(spark, d, "labels").select(
        F.concat(F.lit("test/"), even, F.lit(".wav")).alias("wav_codes"),
        (F.col("doc_id") * 100 + F.col("quality") * 10 + F.col("toxic")).alias("codes"),
        F.col("doc_id").alias("pos"),
    )


@query(
    "gold_codes",
    """SELECT d.doc_id, coalesce(l.codes, -d.doc_id) AS code FROM documents d LEFT JOIN (
      SELECT doc_id - doc_id % 2 AS k, doc_id * 100 + quality * 10 + toxic AS codes FROM labels
      QUALIFY row_number() OVER (PARTITION BY doc_id - doc_id % 2 ORDER BY doc_id DESC) = 1) l ON l.k = d.doc_id""",
)
def gold_codes(spark, d):
    recordings = table(spark, d, "documents").select(
        "doc_id", F.concat(F.lit("test/"), "doc_id", F.lit(".wav")).alias("file_name"), (-F.col("doc_id")).alias("code")
    )
    return lookup.gold_codes(recordings, _wav_info(spark, d)).select("doc_id", "code")


@query(
    "gold_text",
    """SELECT l.doc_id AS code, l.quality, t.text AS gold_translation FROM labels l LEFT JOIN (
      SELECT doc_id - doc_id % 3 AS k, text FROM documents
      QUALIFY row_number() OVER (PARTITION BY doc_id - doc_id % 3 ORDER BY doc_id DESC) = 1) t ON t.k = l.doc_id""",
)
def gold_text(spark, d):
    sentences = table(spark, d, "documents").select(
        (F.col("doc_id") - F.col("doc_id") % 3).alias("codes"), F.col("text").alias("transcript"), F.col("doc_id").alias("pos")
    )
    records = table(spark, d, "labels").select(F.col("doc_id").alias("code"), "quality")
    return lookup.gold_text(records, sentences, "Translation")


@query(
    "ref_join",
    PAIRS_SQL
    + """ SELECT pos, sys_uni, gold_transcript AS reference FROM pairs JOIN labels USING (doc_id) WHERE sys_uni IS NOT NULL""",
)
def ref_join(spark, d):
    df = pairs(spark, d)
    info = df.join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_semi").select(
        F.col("file_name").alias("wav_codes"), F.col("gold_transcript").alias("transcript"), "pos"
    )
    records = df.select("pos", "file_name", "sys_uni")
    return lookup.reference_join(records, info, "sys_uni").select("pos", "sys_uni", "reference")


@query(
    "translation_lookup",
    """SELECT d.doc_id AS id, coalesce(t.v, '') AS translation FROM documents d LEFT JOIN (
      SELECT doc_id - doc_id % 3 AS k, concat('quality ', quality) AS v FROM labels WHERE toxic = 0
      QUALIFY row_number() OVER (PARTITION BY doc_id - doc_id % 3 ORDER BY doc_id DESC) = 1) t ON t.k = d.doc_id""",
)
def translation_lookup(spark, d):
    translations = table(spark, d, "labels").select(
        (F.col("doc_id") - F.col("doc_id") % 3).alias("codes"),
        F.when(F.col("toxic") == 0, F.concat(F.lit("quality "), "quality")).alias("transcript"),
        F.col("doc_id").alias("pos"),
    )
    records = table(spark, d, "documents").select(F.col("doc_id").alias("id"))
    return lookup.translation_lookup(records, translations)


@query(
    "zip_predictions",
    PAIRS_SQL
    + f""", lines AS (
      SELECT language, pos * 2 AS line_no, concat('  ', sys_plus, ' ') AS value FROM pairs UNION ALL
      SELECT language, pos * 2 + 1, '  ' FROM pairs WHERE pos % 5 = 0),
    l AS (SELECT language, {strip_sql('value')} AS line, row_number() OVER (PARTITION BY language ORDER BY line_no) AS n
      FROM lines WHERE trim(value) <> ''),
    r AS (SELECT pos, language, row_number() OVER (PARTITION BY language ORDER BY pos) AS n FROM pairs)
    SELECT pos, language, line AS asr_corrector_pred FROM r JOIN l USING (language, n)""",
)
def zip_predictions(spark, d):
    df = pairs(spark, d)
    lines = df.select("language", (F.col("pos") * 2).alias("at"), F.concat(F.lit("  "), "sys_plus", F.lit(" ")).alias("value"))
    blanks = df.filter(F.col("pos") % 5 == 0).select("language", (F.col("pos") * 2 + 1).alias("at"), F.lit("  ").alias("value"))
    return mixing.zip_predictions(
        df.select("pos", "language"), lines.unionByName(blanks), record_order=["pos"], line_order=["at"], group=["language"]
    )


_ISO3_VALUES = ", ".join(f"('{a}', '{b}')" for a, b in ISO3.items())


@query(
    "match_files",
    f"""SELECT concat('predictions/', iso3, '_preds.txt') AS pred_file, concat('results/', source, '/', lang, '.json') AS json_file
    FROM (SELECT DISTINCT lang, source FROM documents) JOIN (VALUES {_ISO3_VALUES}) m(lang, iso3) USING (lang)""",
)
def match_files(spark, d):
    listed = table(spark, d, "documents").select("lang", "source").distinct()
    results = listed.select(F.concat(F.lit("results/"), "source", F.lit("/"), "lang", F.lit(".json")).alias("json_file"))
    iso3 = F.element_at(F.create_map(*[F.lit(x) for kv in ISO3.items() for x in kv]), F.col("lang"))
    preds = listed.select("lang").distinct().select(F.concat(F.lit("predictions/"), iso3, F.lit("_preds.txt")).alias("pred_file"))
    left = preds.withColumn("iso3", F.regexp_replace(text.base_name("pred_file", F.lit(0)), r"_preds\.txt$", ""))
    right = results.withColumn("code", text.file_language("json_file"))
    back = {v: k for k, v in ISO3.items()}
    return rollup.match_by_language(left, right, back, left_code="iso3", right_code="code").select("pred_file", "json_file")


# ---------------------------------------------------------------- mixing

_TURNS_SQL = "SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY role ORDER BY conv_id, turn) AS rn FROM conversations"


def _turns(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", "role", "text")


def _interleave_sql(roles: list[str]) -> str:
    case = "CASE role " + " ".join(f"WHEN '{r}' THEN {i}" for i, r in enumerate(roles)) + " END"
    return f"""WITH n AS (SELECT *, {case} AS i FROM ({_TURNS_SQL}) WHERE {case} IS NOT NULL),
    e AS (SELECT rn AS er, i AS ei FROM n QUALIFY row_number() OVER (PARTITION BY i ORDER BY rn DESC) = 1 ORDER BY er, ei LIMIT 1)
    SELECT conv_id, turn, role, text, CAST((rn - 1) * {len(roles)} + i AS BIGINT) AS mix_pos FROM n, e WHERE rn < er OR (rn = er AND i <= ei)"""


@query("interleave", _interleave_sql(["user", "assistant", "system"]))
def interleave(spark, d):
    return mixing.interleave(_turns(spark, d), "role", ["user", "assistant", "system"], ["conv_id", "turn"])


@query("interleave_splits", _interleave_sql(["user", "assistant"]))
def interleave_splits(spark, d):
    return mixing.interleave_splits(_turns(spark, d), "user+assistant", ["conv_id", "turn"], column="role")


@query(
    "repeat_to_n",
    """WITH b AS (SELECT item_id, text, row_number() OVER (ORDER BY item_id) - 1 AS seq, count(*) OVER () AS size FROM benchmark),
    d AS (SELECT count(*) AS n FROM documents), e AS (SELECT unnest(range(0, (SELECT n FROM d))) AS epoch)
    SELECT item_id, text, CAST(epoch * size + seq AS BIGINT) AS repeat_pos FROM b, e, d WHERE epoch * size + seq < n""",
)
def repeat_to_n(spark, d):
    """Cycle the short table until it has as many rows as the long one."""
    n = table(spark, d, "documents").agg(F.count("*")).scalar()
    return mixing.repeat_to_n(table(spark, d, "benchmark").select("item_id", "text"), n, ["item_id"])


@query(
    "cap_per_source",
    f"SELECT conv_id, turn, role, text FROM ({_TURNS_SQL}) WHERE role = 'system' OR (role = 'user' AND rn <= 1750) OR (role = 'assistant' AND rn <= 2525)",
)
def cap_per_source(spark, d):
    return mixing.cap_per_source(_turns(spark, d), "role", {"user": 1750, "assistant": 2525, "system": None}, ["conv_id", "turn"])


# ---------------------------------------------------------------- nesting


@query(
    "build_pairs",
    PAIRS_SQL
    + f""" SELECT pos, concat('{{"', language, '":', to_json(sys_uni), ',"', iso3, '":', to_json(gold_transcript), '}}') AS translation
    FROM pairs JOIN (VALUES {_ISO3_VALUES}) m(language, iso3) USING (language) WHERE sys_uni IS NOT NULL""",
)
def build_pairs(spark, d):
    built = nested.build_pairs(pairs(spark, d), "sys_uni", "gold_transcript", target_keys=ISO3)
    return built.select("pos", F.to_json("translation").alias("translation"))


@query(
    "read_pairs",
    PAIRS_SQL + " SELECT pos, sys_uni AS source_text, gold_transcript AS target_text FROM pairs WHERE sys_uni IS NOT NULL AND language <> 'es'",
)
def read_pairs(spark, d):
    built = nested.build_pairs(pairs(spark, d), "sys_uni", "gold_transcript", target_keys=ISO3)
    asked = F.element_at(
        F.create_map(*[F.lit(x) for kv in ISO3.items() if kv[0] != "es" for x in kv]), F.col("language")
    )
    return nested.read_pairs(built.select("pos", "language", "translation"), F.col("language"), asked).select(
        "pos", "source_text", "target_text"
    )


_IDS = r"list_transform(list_filter(regexp_split_to_array(gold, '\s+'), lambda w: w <> ''), lambda w: CAST(length(w) AS INTEGER))"


def _ids():
    return F.transform(text.tokenize("gold"), lambda w: F.char_length(w))


@query(
    "label_batch",
    "WITH "
    + UTTERANCES_SQL
    + f""", i AS (SELECT doc_id, utt, doc_id AS batch_id, {_IDS}[1:384] AS ids FROM u),
    s AS (SELECT batch_id, max(len(ids)) AS longest, bool_and(coalesce(ids[1] = 3, false)) AS started FROM i GROUP BY ALL),
    p AS (SELECT doc_id, utt, started, list_resize(ids, longest, -100) AS padded FROM i JOIN s USING (batch_id))
    SELECT doc_id, utt, array_to_string(CASE WHEN started THEN padded[2:] ELSE padded END, ',') AS labels FROM p""",
)
def label_batch(spark, d):
    df = utterances(spark, d).select("doc_id", "utt", F.col("doc_id").alias("batch_id"), _ids().alias("ids"))
    labelled = nested.label_batch(df, "ids", start_id=3, max_length=384)
    return labelled.select("doc_id", "utt", F.array_join(F.transform("labels", lambda x: x.cast("string")), ",").alias("labels"))


@query(
    "mask_swap",
    "WITH " + UTTERANCES_SQL + f" SELECT doc_id, utt, array_to_string(list_transform({_IDS}, lambda x: CASE WHEN x = 2 THEN -100 ELSE x END), ',') AS ids FROM u",
)
def mask_swap(spark, d):
    df = utterances(spark, d).select("doc_id", "utt", nested.swap_ids(_ids(), 2, nested.IGNORE_INDEX).alias("ids"))
    return df.select("doc_id", "utt", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"))


# ---------------------------------------------------------------- roll-ups

# Embeddings stand for decoded audio at 16 to 64 samples a second; some do not decode.
_AUDIO_SQL = """SELECT vec_id, label, CASE WHEN vec_id % 13 = 0 THEN NULL ELSE len(embedding) / (16.0::DOUBLE * (1 + vec_id % 4)) END AS s
    FROM embeddings"""


def _audio(spark, d):
    return table(spark, d, "embeddings").select(
        "vec_id",
        "label",
        F.when(F.col("vec_id") % 13 != 0, F.col("embedding")).alias("arr"),
        (F.col("vec_id") % 4 * 16 + 16).cast("int").alias("rate"),
    )


@query(
    "audio_hours",
    f"""SELECT label, count(*) AS n_total, count(s) AS n_decoded, round(sum(s), 6) AS total_seconds, round(sum(s) / 60, 6) AS total_minutes,
      round(sum(s) / 3600, 6) AS total_hours, round(avg(s), 6) AS avg_seconds, min(s) AS min_seconds, max(s) AS max_seconds
    FROM ({_AUDIO_SQL}) GROUP BY ALL""",
)
def audio_hours(spark, d):
    out = rollup.audio_hours(_audio(spark, d), "arr", "rate", "label")
    return out.withColumns({c: F.round(c, 6) for c in ("total_seconds", "total_minutes", "total_hours", "avg_seconds")})


@query(
    "running_hours",
    f"""SELECT n_processed, round(hours, 9) AS hours FROM (
      SELECT row_number() OVER (ORDER BY vec_id) AS n_processed, sum(s) OVER (ORDER BY vec_id) / 3600 AS hours
      FROM ({_AUDIO_SQL})) WHERE n_processed % 100 = 0""",
)
def running_hours(spark, d):
    return rollup.running_hours(_audio(spark, d), "arr", "rate", ["vec_id"]).withColumn("hours", F.round("hours", 9))


@query(
    "step_budget",
    "SELECT lang AS language, count(*) AS n_rows, CAST(floor(count(*) * 10 / 32) AS BIGINT) AS max_steps FROM documents GROUP BY ALL",
)
def step_budget(spark, d):
    return rollup.step_budget(table(spark, d, "documents").withColumnRenamed("lang", "language"), "language")


@query(
    "tag_list",
    "SELECT string_agg(lang, ',' ORDER BY first_doc) AS tags FROM (SELECT lang, min(doc_id) AS first_doc FROM documents GROUP BY lang)",
)
def tag_list(spark, d):
    return rollup.tag_list(table(spark, d, "documents"), "lang", "doc_id")


@query(
    "best_run",
    """SELECT user_id, event_id AS best_step, value AS best_value, n_evals FROM (
      SELECT *, count(*) OVER (PARTITION BY user_id) AS n_evals, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS r
      FROM events WHERE value IS NOT NULL) WHERE r = 1""",
)
def best_run(spark, d):
    return rollup.best_run(table(spark, d, "events"), "user_id", "event_id", "value")


@query(
    "early_stop",
    """WITH e AS (SELECT user_id, event_id, value, row_number() OVER w - 1 AS seq,
        max(value) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM events
        WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
    g AS (SELECT *, max(CASE WHEN best IS NULL OR value > best THEN seq END) OVER (PARTITION BY user_id ORDER BY seq) AS last FROM e),
    s AS (SELECT user_id, event_id AS stop_step, seq + 1 AS n_evals, best FROM g WHERE seq - last >= 2
      QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY seq) = 1),
    a AS (SELECT user_id, count(*) AS n, max(value) AS overall FROM events GROUP BY ALL)
    SELECT user_id, stop_step, coalesce(n_evals, n) AS n_evals, coalesce(best, overall) AS best_value FROM a LEFT JOIN s USING (user_id)""",
)
def early_stop(spark, d):
    return rollup.early_stop(table(spark, d, "events"), "user_id", "event_id", "value")


@query(
    "last_checkpoints",
    """SELECT user_id, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 3""",
)
def last_checkpoints(spark, d):
    events = table(spark, d, "events").select("user_id", "event_id", "value")
    return rollup.last_checkpoints(events, "user_id", "event_id", 3)


# ---------------------------------------------------------------- corpora

_CORPORA_SQL = """SELECT 'fleurs' AS corpus, doc_id AS id, text AS sentence FROM documents UNION ALL
    SELECT 'common_voice', conv_id * 1000 + turn, text FROM conversations UNION ALL
    SELECT 'naijavoices', item_id, text FROM benchmark UNION ALL SELECT 'yo_speech', page_id, url FROM pages"""


def _corpus_tables(spark, d):
    audio = table(spark, d, "embeddings").select(
        F.col("vec_id").alias("id"),
        F.struct(F.col("embedding").alias("array"), F.lit(16).alias("sampling_rate"), F.lit(None).cast("string").alias("path")).alias("audio"),
    )
    texts = {
        "fleurs": table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("transcription")),
        "common_voice": table(spark, d, "conversations").select(
            (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("text").alias("sentence")
        ),
        "naijavoices": table(spark, d, "benchmark").select(F.col("item_id").alias("id"), "text"),
        "yo_speech": table(spark, d, "pages").select(F.col("page_id").alias("id"), F.col("url").alias("transcript")),
    }
    return {name: df.join(audio, "id", "left") for name, df in texts.items()}


@query(
    "normalize_corpus",
    f"""SELECT corpus, sentence, CASE WHEN embedding IS NULL THEN NULL ELSE 16 END AS sampling_rate,
      CAST(len(embedding) AS BIGINT) AS n_samples, round(embedding[1]::DOUBLE, 5) AS first_sample
    FROM ({_CORPORA_SQL}) LEFT JOIN embeddings ON vec_id = id""",
)
def normalize_corpora(spark, d):
    parts = [
        normalize_corpus(df, name).select(
            F.lit(name).alias("corpus"),
            "sentence",
            "sampling_rate",
            F.array_size("audio_array").cast("bigint").alias("n_samples"),
            F.round(F.get("audio_array", F.lit(0)).cast("double"), 5).alias("first_sample"),
        )
        for name, df in _corpus_tables(spark, d).items()
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# ---------------------------------------------------------------- inference


def _stand_in():
    """A deterministic model: reverses the text; fails on any batch that holds a table row."""

    def predict(texts):
        if any(" | " in t for t in texts):
            raise ValueError("unsupported layout")
        return [t[::-1] for t in texts]

    return predict


@query(
    "score_rows",
    """SELECT doc_id, CASE WHEN contains(text, ' | ') THEN NULL ELSE reverse(text) END AS prediction,
      CASE WHEN contains(text, ' | ') THEN 'ValueError: unsupported layout' END AS error FROM documents""",
)
def score_rows(spark, d):
    return inference.score_rows(table(spark, d, "documents").select("doc_id", "text"), "text", _stand_in).drop("text")


@query(
    "fill_missing",
    PAIRS_SQL + " SELECT pos, CASE WHEN sys_uni IS NOT NULL THEN sys_uni WHEN contains(sys_plus, ' | ') THEN '' ELSE reverse(sys_plus) END AS sys_uni FROM pairs",
)
def fill_missing(spark, d):
    df = pairs(spark, d).select("pos", "sys_plus", "sys_uni")
    return inference.fill_missing(df, "sys_plus", "sys_uni", _stand_in).select("pos", "sys_uni")


@query(
    "fill_resumed",
    PAIRS_SQL
    + """ SELECT pos, CASE WHEN sys_uni IS NOT NULL THEN sys_uni WHEN contains(sys_plus, ' | ') THEN '' ELSE reverse(sys_plus) END AS sys_uni,
      CASE WHEN sys_uni IS NULL AND sys_plus IS NOT NULL THEN 1 ELSE 0 END AS n_scored FROM pairs""",
)
def fill_resumed(spark, d):
    """A run that got as far as one language, a run over all rows, and one that finds nothing to do."""
    df = pairs(spark, d).select("pos", "language", "sys_plus", "sys_uni")
    path = scratch_path(spark, "outcomes")
    for part in (df.filter("language = 'de'"), df, df):
        inference.score_pending(part, "pos", "sys_plus", "sys_uni", _stand_in, path)
    scored = inference.stored_outcomes(df, "pos", "sys_uni", path).groupBy("pos").agg(F.count("*").cast("int").alias("n"))
    filled = inference.fill_stored(df, "pos", "sys_plus", "sys_uni", path)
    return filled.join(scored, "pos", "left").select("pos", "sys_uni", F.coalesce("n", F.lit(0)).alias("n_scored"))


@query(
    "request_table",
    """SELECT doc_id, concat('{"model":"stand-in","text":"Translate this audio from ', lang, ' to English.","input_audio":{"data":"',
      to_base64(encode(text)), '","format":"wav"}}') AS request FROM documents""",
)
def request_table(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", F.encode("text", "UTF-8").alias("audio"))
    return inference.request_table(docs, "audio", F.col("lang"), model="stand-in").select("doc_id", "request")


@query(
    "numbered_lines",
    PAIRS_SQL + " SELECT pos, language, row_number() OVER (PARTITION BY language ORDER BY pos) - 1 AS line FROM pairs",
)
def numbered_lines(spark, d):
    return with_ordinal(pairs(spark, d).select("pos", "language"), ["pos"], ["language"], "line")
