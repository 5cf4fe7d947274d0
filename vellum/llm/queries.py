"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _util, chat_tools, decontamination, ngram_join, packing, pii, quality_classifier, quality_rules, token_counts, toxicity, url_filter

#: Token limit of the count query.
BUDGET = 1024


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(_util.read_table(spark, sf_dir, "pages"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(_util.read_table(spark, sf_dir, "documents"))
    base = F.filter("found", lambda s: s["kind_no"] < len(pii.BASE_KINDS))
    return found.select(
        "doc_id",
        *[F.size(f"{k}_spans").cast("long").alias(f"n_{k}") for k in pii.BASE_KINDS],
        F.sha2(pii.joined(base), 256).alias("base_sha256"),
        pii.joined(F.col("found")).alias("spans"),
    )


def op3_chat_tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_tools.format_conversations(_util.read_table(spark, sf_dir, "conversations"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_util.read_table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.json"), BUDGET)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = (_util.read_table(spark, sf_dir, t) for t in ("documents", "benchmark"))
    return decontamination.find(docs, benchmark)


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (_util.read_table(spark, sf_dir, t) for t in ("documents", "labels"))
    return quality_classifier.classify(docs, labels)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_util.read_table(spark, sf_dir, "documents"), _vocabulary("word_bpe_49k.json"))


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.link(_util.read_table(spark, sf_dir, "documents"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (_util.read_table(spark, sf_dir, t) for t in ("documents", "labels"))
    kept = quality_rules.filter_by_rules(docs, labels)
    return kept.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "broken_rules")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (_util.read_table(spark, sf_dir, t) for t in ("documents", "labels"))
    return toxicity.classify(docs, labels)


QUERIES = {
    f.__name__: f
    for f in (
        op1_url_filter, op2_pii, op3_chat_tools, op4_token_counts, op5_decontamination,
        op6_quality_classifier, op7_packing, op8_ngram_join, op9_quality_rules, op10_toxicity,
    )
}

#: Whole sets meet shingle by shingle; the smallest id is found by following links until nothing new is reached.
_JOIN_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM words, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS t(i) WHERE len(w) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM shingles x JOIN shingles y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached(doc_id, other) AS (SELECT DISTINCT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.b FROM reached r JOIN edges e ON e.a = r.other)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, m.component_id
FROM documents d LEFT JOIN sizes s USING (doc_id) LEFT JOIN (SELECT doc_id, min(other) AS component_id FROM reached GROUP BY doc_id) m USING (doc_id)
"""

#: Calls are the users' messages, each after that of two turns before; results are the assistants', one turn later.
_CHAT_SQL = r"""
WITH RECURSIVE calls AS (SELECT DISTINCT conv_id, turn, text FROM conversations WHERE role = 'user'),
nodes AS (SELECT conv_id, turn, count(*) AS same FROM calls GROUP BY ALL),
levels(conv_id, turn, level) AS (
  SELECT conv_id, turn, CAST(0 AS BIGINT) FROM nodes n WHERE NOT EXISTS (SELECT 1 FROM nodes p WHERE p.conv_id = n.conv_id AND p.turn = n.turn - 2 AND n.turn >= 2)
  UNION ALL SELECT n.conv_id, n.turn, l.level + 1 FROM levels l JOIN nodes n ON n.conv_id = l.conv_id AND n.turn = l.turn + 2),
results AS (SELECT conv_id, turn - 1 AS turn, min(text) AS result, min(text) <> max(text) AS several FROM conversations WHERE role = 'assistant' GROUP BY ALL),
faults AS (
  SELECT c.conv_id, c.turn, c.text, l.level, r.turn IS NOT NULL AS linked, r.result,
    concat_ws(',', CASE WHEN c.text IS NULL THEN 'text: missing' END, CASE WHEN same > 1 THEN 'duplicate id' END, CASE WHEN several THEN 'several results' END) AS errors
  FROM calls c JOIN nodes n USING (conv_id, turn) JOIN levels l USING (conv_id, turn) LEFT JOIN results r USING (conv_id, turn))
SELECT conv_id, conv_id || ':' || turn AS call_id, turn, 'call' AS kind, level, linked, errors = '' AS valid, errors,
  '{"after":' || CASE WHEN turn >= 2 THEN '"' || conv_id || ':' || (turn - 2) || '"' ELSE 'null' END || ',"arguments":{"role":"user"' || coalesce(',"text":' || to_json(text), '') || ',"turn":' || turn || '},"call_id":"'
    || conv_id || ':' || turn || '","name":"ask","result":' || coalesce(CAST(to_json(result) AS VARCHAR), 'null') || '}' AS message
FROM faults
UNION ALL
SELECT DISTINCT conv_id, conv_id || ':' || (turn - 1), NULL, 'result', NULL, false, false, 'no call',
  '{"after":null,"arguments":null,"call_id":"' || conv_id || ':' || (turn - 1) || '","name":null,"result":' || coalesce(CAST(to_json(text) AS VARCHAR), 'null') || '}'
FROM conversations a WHERE role = 'assistant' AND NOT EXISTS (SELECT 1 FROM nodes n WHERE n.conv_id = a.conv_id AND n.turn = a.turn - 1)
UNION ALL
SELECT conv_id, NULL, turn, 'message', NULL, false, true, '',
  '{"role":' || coalesce(CAST(to_json(role) AS VARCHAR), 'null') || ',"text":' || coalesce(CAST(to_json(text) AS VARCHAR), 'null') || ',"turn":' || coalesce(CAST(turn AS VARCHAR), 'null') || '}'
FROM conversations WHERE role IS NULL OR role NOT IN ('user', 'assistant')
"""

#: What has no SQL here rests on offsets of matches, token vocabularies or learned models.
ORACLE_SQL: dict[str, str] = {"op3_chat_tools": _CHAT_SQL, "op8_ngram_join": _JOIN_SQL}
