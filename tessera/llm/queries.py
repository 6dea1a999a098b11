"""The registered queries of this subpackage and their SQL, one query for each operator."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import align, codes, jaccard, langid, lm, mixing, passages, pieces, pii, quality, templates, toxicity, vectors
from tessera.llm.tables import crc_part

#: Folder of the public tokenizers' files; a parameter of the queries that use one.
TOKENIZERS = "/opt/tokenizers"
PIECES = "piece_bpe_32k.model"
BYTES = "byte_bpe_50k.json"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated passages to remove, by sentence and line, with their offsets and the place of the copy that stays."""
    return passages.removals(_table(spark, sf_dir, "documents")).drop("text_key")


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(_table(spark, sf_dir, "documents"), crc_part(F.col("doc_id"), 7) == 2)


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(_table(spark, sf_dir, "documents"))


def op4_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op5_sentencepiece(spark: SparkSession, sf_dir: str, tokenizers: str = TOKENIZERS) -> DataFrame:
    return pieces.encode(_table(spark, sf_dir, "documents"), os.path.join(tokenizers, PIECES))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.summary(pii.spans(_table(spark, sf_dir, "documents")))


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.per_document(*mixing.mix(_table(spark, sf_dir, "documents")))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of recurring templates, by document and line number."""
    dropped = templates.dropped_lines(_table(spark, sf_dir, "documents"))
    return dropped.select("doc_id", F.col("no").alias("line_no"), "documents")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held_out = F.coalesce(crc_part(F.col("doc_id"), 4) == 2, F.lit(False))
    found = langid.predict(docs, langid.fit(docs, use=~held_out))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.quality(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.compress(_table(spark, sf_dir, "embeddings"))


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, part = _table(spark, sf_dir, "documents"), crc_part(F.col("doc_id"), 3)
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels"), use=part != 1)
    return toxicity.score(docs, model).select("doc_id", F.coalesce(part == 1, F.lit(False)).alias("held_out"), "score",
                                              (F.col("score") >= toxicity.TOXIC_AT).cast("int").alias("predicted"))


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str, tokenizers: str = TOKENIZERS) -> DataFrame:
    aligned = align.Alignment(_table(spark, sf_dir, "documents"), os.path.join(tokenizers, BYTES), os.path.join(tokenizers, PIECES))
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))
    return aligned.documents().withColumn("groups_sha256", digest).drop("groups")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_substring_dedup, op2_lm_scoring, op3_ngram_jaccard_join, op4_embedding_near_dedup, op5_sentencepiece, op6_pii,
                            op7_source_mixing, op8_line_dedup, op9_language_id, op10_quality_rules, op11_vector_codes, op12_toxicity, op13_tokenizer_alignment)}

_WORD = r"[^\x20\x09-\x0D]+"


def _stop_list() -> str:
    return ", ".join(f"'{w}'" for w in sorted({w for words in quality.STOP_WORDS.values() for w in words}))



def _codes_sql(parts: int = codes.PARTS, entries: int = codes.ENTRIES, rounds: int = codes.ROUNDS, scale: int = codes.SCALE) -> str:
    """Lloyd's rounds over whole numbers, one pair of steps a round."""
    steps = []
    for k in range(rounds + 1):
        steps.append(f"""
        a{k} AS MATERIALIZED (SELECT row_id, part, min_by(entry, d * {entries} + entry) AS entry, min(d) AS d FROM (
              SELECT p.row_id, p.part, b.entry, CAST(list_sum(list_transform(list_zip(p.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d
              FROM p JOIN b{k} b ON p.part = b.part) GROUP BY row_id, part)""")
        if k < rounds:
            steps.append(f"""
        b{k + 1} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(m.x, b.x) AS x FROM b{k} b LEFT JOIN (
              SELECT part, entry, list(v ORDER BY i) AS x FROM (
                  SELECT p.part, a.entry, i.i, CAST(floor(sum(p.x[i.i]) / CAST(count(*) AS DOUBLE)) AS BIGINT) AS v
                  FROM p JOIN a{k} a ON p.row_id = a.row_id AND p.part = a.part, (SELECT unnest(generate_series(1, (SELECT max(len(x)) FROM p))) AS i) i GROUP BY p.part, a.entry, i.i)
              GROUP BY part, entry) m ON b.part = m.part AND b.entry = m.entry)""")
    return f"""
        WITH v AS (SELECT vec_id, label, embedding AS e FROM embeddings
                   WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        q AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id, label) AS row_id, vec_id, label, list_transform(e, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM v),
        p AS MATERIALIZED (SELECT row_id, vec_id, j AS part, x[CAST(1 + j * (len(x) // {parts}) AS BIGINT):CAST((j + 1) * (len(x) // {parts}) AS BIGINT)] AS x
              FROM q, (SELECT unnest(generate_series(0, {parts - 1})) AS j)),
        f AS (SELECT row_id, row_number() OVER (ORDER BY vec_id, row_id) - 1 AS entry FROM q QUALIFY entry < {entries}),
        b0 AS MATERIALIZED (SELECT p.part, f.entry, p.x FROM p JOIN f ON p.row_id = f.row_id),{",".join(steps)},
        r AS (SELECT row_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY row_id)
        SELECT q.vec_id, r.code, r.error, CAST(sum(r.error) OVER (PARTITION BY q.label) AS BIGINT) AS label_error,
               (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) FROM b{rounds}) AS codebooks_sha256
        FROM q JOIN r ON q.row_id = r.row_id"""


ORACLE: dict[str, str] = {
    "op3_ngram_jaccard_join": rf"""
        WITH RECURSIVE t AS (SELECT doc_id, list_transform(regexp_extract_all(coalesce(text, ''), '{_WORD}'), lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS ws FROM documents),
        s AS (SELECT doc_id, CASE WHEN len(ws) >= 5 THEN list_distinct(list_transform(generate_series(1, len(ws) - 4), lambda i: array_to_string(ws[i:i + 4], ' ')))
                                  WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE CAST([] AS VARCHAR[]) END AS g FROM t),
        u AS (SELECT doc_id, len(g) AS n, unnest(g) AS x FROM s),
        i AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS n, b.n AS m, count(*) AS k FROM u a JOIN u b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
        l AS (SELECT a, b FROM i WHERE 100 * k >= 80 * (n + m - k)),
        e AS (SELECT a AS x, b AS y FROM l UNION ALL SELECT b, a FROM l),
        r(doc_id, c) AS (SELECT doc_id, doc_id FROM s UNION SELECT e.y, r.c FROM r JOIN e ON r.doc_id = e.x)
        SELECT s.doc_id, CAST(len(g) AS BIGINT) AS n_shingles, min(c) AS component_id FROM s JOIN r ON s.doc_id = r.doc_id GROUP BY s.doc_id, g""",
    "op4_embedding_near_dedup": """
        WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
                   WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id < b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
        e AS (SELECT a AS x, b AS y FROM l UNION ALL SELECT b, a FROM l),
        r(vec_id, c) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT e.y, r.c FROM r JOIN e ON r.vec_id = e.x),
        k AS (SELECT x, count(*) AS n FROM e GROUP BY x), m AS (SELECT vec_id, min(c) AS c FROM r GROUP BY vec_id)
        SELECT m.vec_id, coalesce(n, 0) AS n_links, c AS component_id, m.vec_id = c AS kept FROM m LEFT JOIN k ON k.x = m.vec_id""",
    "op11_vector_codes": _codes_sql(),
    "op10_quality_rules": rf"""
        WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
        w AS (SELECT doc_id, text, regexp_extract_all(text, '{_WORD}') AS ws,
                     list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS lines FROM t),
        g AS (SELECT *, list_transform(generate_series(1, len(ws) - 2), lambda i: ws[i] || chr(0) || ws[i + 1] || chr(0) || ws[i + 2]) AS grams FROM w),
        p AS (SELECT doc_id, unnest(grams) AS gram, unnest(generate_series(1, len(grams))) AS i FROM g),
        d AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM p) WHERE n > 1),
        r AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM d, (VALUES (0), (1), (2)) v(k) GROUP BY doc_id),
        f AS (SELECT g.doc_id, CAST(len(ws) AS BIGINT) AS n_words,
                     CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
                     CAST(length(text) - length(translate(text, '{quality.SYMBOLS}', '')) AS BIGINT) AS n_symbols,
                     CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
                     CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
                     len(list_filter(ws, lambda x: lower(x) IN ({_stop_list()}))) AS n_stop
              FROM g LEFT JOIN r ON g.doc_id = r.doc_id),
        v AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
               NOT base_failed AND n_words <= 1000000 AND word_chars >= 2.0 * n_words AND word_chars <= 14.0 * n_words
               AND n_symbols <= 0.05 * greatest(word_chars, 1) AND n_stop >= 0.01 * n_words
               AND n_dup_lines <= 0.5 * greatest(n_lines, 1) AND n_repeat_words <= 0.5 * n_words AS kept
        FROM v""",
    "op8_line_dedup": rf"""
        WITH s AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
        l AS (SELECT doc_id, unnest(ls) AS line, CAST(unnest(generate_series(0, len(ls) - 1)) AS BIGINT) AS no FROM s),
        t AS (SELECT doc_id, no, list_transform(regexp_extract_all(lower(line), '{_WORD}'), lambda w: CASE WHEN regexp_matches(w, '[0-9]') THEN '{templates.FIELD}' ELSE w END) AS tokens
              FROM l WHERE regexp_matches(line, '{_WORD}')),
        p AS (SELECT *, len(tokens) AS n, tokens[1:{templates.DEPTH}] AS lead_tokens FROM t),
        a AS (SELECT n, lead_tokens, min(doc_id) AS first_id, count(DISTINCT doc_id) AS holders FROM p GROUP BY n, lead_tokens),
        g AS (SELECT p.doc_id, a.first_id, sum(p.n) AS words, sum(CASE WHEN a.holders = 1 THEN p.n ELSE 0 END) AS own
              FROM p JOIN a ON p.n = a.n AND p.lead_tokens = a.lead_tokens GROUP BY p.doc_id, a.first_id),
        h AS (SELECT doc_id, CASE WHEN {templates.OWN_ONE_IN} * sum(own) >= sum(words) THEN doc_id ELSE (list(first_id ORDER BY words DESC, first_id))[1] END AS voice FROM g GROUP BY doc_id),
        k AS (SELECT DISTINCT n, lead_tokens, tokens FROM p),
        e AS (SELECT n, lead_tokens, unnest(tokens) AS token, unnest(generate_series(1, len(tokens))) AS place FROM k),
        m AS (SELECT n, lead_tokens, place, token FROM (SELECT n, lead_tokens, place, token, row_number() OVER (PARTITION BY n, lead_tokens, place ORDER BY count(*) DESC, token DESC) AS r
              FROM e GROUP BY n, lead_tokens, place, token) WHERE r = 1),
        x AS (SELECT n, lead_tokens, list(token ORDER BY place) AS shape FROM m GROUP BY n, lead_tokens),
        q AS (SELECT p.doc_id, p.no, CASE WHEN len(list_filter(generate_series(1, p.n), lambda i: p.tokens[i] = x.shape[i])) >= {templates.SIMILAR} * p.n
                     THEN [CAST(p.n AS VARCHAR)] || p.lead_tokens ELSE [''] || p.tokens END AS template
              FROM p JOIN x ON p.n = x.n AND p.lead_tokens = x.lead_tokens),
        u AS (SELECT template, count(DISTINCT h.voice) AS documents FROM q JOIN h ON q.doc_id = h.doc_id GROUP BY template HAVING count(DISTINCT h.voice) >= {templates.MIN_DOCUMENTS})
        SELECT DISTINCT doc_id, no AS line_no, CAST(documents AS BIGINT) AS documents FROM q JOIN u ON q.template = u.template""",
    "op1_substring_dedup": rf"""
        WITH a AS (SELECT doc_id, string_split(regexp_replace(coalesce(text, ''), '([.!?])[\x20\x09\x0B-\x0D]', '\1' || chr(10), 'g'), chr(10)) AS ls FROM documents),
        s AS (SELECT doc_id, string_split(array_to_string(list_transform(ls, lambda x: CASE WHEN len(regexp_extract_all(x, '{_WORD}')) > {passages.LONG_UNIT}
                     THEN regexp_replace(x, '([^\x20\x09-\x0D]{{10,}})[\x20\x09\x0B-\x0D]', '\1' || chr(10), 'g') ELSE x END), chr(10)), chr(10)) AS ls FROM a),
        l AS (SELECT doc_id, unnest(ls) AS line, unnest(generate_series(1, len(ls))) AS no FROM s),
        o AS (SELECT doc_id, no, line, CAST(coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS place FROM l),
        w AS (SELECT doc_id, no, place, line, list_transform(regexp_extract_all(line, '{_WORD}'), lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS ws
              FROM o WHERE regexp_matches(line, '{_WORD}')),
        u AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY no) - 1 AS BIGINT) AS unit,
                     CAST(place + length(line) - length(ltrim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13))) AS BIGINT) AS start,
                     CAST(place + length(rtrim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13))) AS BIGINT) AS "end",
                     CAST(len(ws) AS BIGINT) AS n_words, array_to_string(ws, ' ') AS digest FROM w),
        f AS (SELECT *, first_value(doc_id) OVER g AS kept_doc_id, first_value(unit) OVER g AS kept_unit, first_value(start) OVER g AS kept_start
              FROM u WINDOW g AS (PARTITION BY digest ORDER BY doc_id, unit ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
        d AS (SELECT *, unit - row_number() OVER (PARTITION BY doc_id ORDER BY unit) AS island FROM f WHERE NOT (doc_id = kept_doc_id AND unit = kept_unit)),
        r AS (SELECT *, CAST(sum(n_words) OVER (PARTITION BY doc_id, island) AS BIGINT) AS run_words FROM d)
        SELECT doc_id, unit, start, "end", n_words, run_words, kept_doc_id, kept_start FROM r WHERE run_words >= {passages.MIN_WORDS}""",
}
