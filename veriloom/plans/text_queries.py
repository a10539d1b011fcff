"""Scans and text."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from .registry import query

WS = r"[\t\n\v\f\r \x1c-\x1f\x{85}\p{Z}]"


def norm_sql(column: str) -> str:
    return f"coalesce(trim(regexp_replace(lower({column}), '{WS}+', ' ', 'g'), ' '), '')"



@query("FN1 FN5", f"SELECT row_id, {norm_sql('text')} AS norm FROM sentences")
def normalize_text(t):
    return t("sentences").select("row_id", T.normalize_text(F.col("text")).alias("norm"))


@query("FN3", """
WITH l AS (SELECT doc_id, i - 1 AS line_no, parts[i] AS line, string_split(parts[i], chr(9)) AS f FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents))),
n AS (SELECT *, CASE WHEN len(f) >= 2 AND regexp_full_match(trim(f[1], ' '), '[+-]?[0-9]+(_[0-9]+)*') THEN TRY_CAST(replace(trim(f[1], ' '), '_', '') AS BIGINT) END AS number FROM l WHERE line <> '')
SELECT doc_id, CAST(line_no AS BIGINT) AS line_no, trim(line, ' ') AS line, number AS sentence_id, CASE WHEN number IS NOT NULL THEN f[2] END AS sentence, number IS NULL AS malformed FROM n""")
def wiki_line_explode(t):
    lines = t("documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("p", "line")).filter("line <> ''")
    return lines.select("doc_id", F.col("p").cast("long").alias("line_no"), F.trim("line").alias("line"), T.wiki_line(F.col("line")).alias("w")).select("doc_id", "line_no", "line", "w.*")


@query("FN3", """
SELECT doc_id, count(*) AS n_lines, count(CASE WHEN number IS NOT NULL THEN 1 END) AS n_sentences, count(CASE WHEN number IS NULL THEN 1 END) AS n_malformed
FROM (SELECT doc_id, CASE WHEN contains(line, chr(9)) AND regexp_full_match(trim(string_split(line, chr(9))[1], ' '), '[+-]?[0-9]+(_[0-9]+)*') THEN TRY_CAST(replace(trim(string_split(line, chr(9))[1], ' '), '_', '') AS BIGINT) END AS number
FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE line <> '') GROUP BY doc_id""")
def wiki_line_counts(t):
    return T.wiki_line_counts(wiki_line_explode(t), ["doc_id"])


@query("PR7 FN6", """
SELECT row_id, CAST(len(cells) AS INTEGER) AS n_cells, array_to_string(cells, '|') AS joined
FROM (SELECT row_id, coalesce(list_filter(list_transform(string_split(text, ', '), lambda x: trim(x, ' ')), lambda x: x <> ''), []) AS cells FROM sentences)""")
def split_list_cells(t):
    cells = T.split_cells(F.col("text"), ", ")
    return t("sentences").select("row_id", F.size(cells).alias("n_cells"), F.array_join(cells, "|").alias("joined"))


@query("AG16 ST2", """
SELECT record_id, CAST(len(list_intersect(list_distinct(string_split(lower(hypothesis), ' ')), list_distinct(string_split(lower(premise_text), ' ')))) AS INTEGER) AS shared_words
FROM pool_records WHERE hypothesis IS NOT NULL AND premise_text IS NOT NULL""")
def shared_words(t):
    words = lambda c: F.split(F.lower(c), " ")
    rows = t("pool_records").filter("hypothesis IS NOT NULL AND premise_text IS NOT NULL")
    return rows.select("record_id", F.size(F.array_intersect(words(F.col("hypothesis")), words(F.col("premise_text")))).alias("shared_words"))


@query("FN14", """
SELECT event_type, count(*) AS n, count(CASE WHEN json_valid(props) THEN 1 END) AS n_valid, CAST(sum(TRY_CAST(json_extract_string(CASE WHEN json_valid(props) THEN props END, '$.k') AS BIGINT)) AS BIGINT) AS sum_k
FROM events GROUP BY event_type""")
def sniff_json_props(t):
    parsed = F.from_json("props", "k bigint")
    return t("events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count(F.try_parse_json("props")).alias("n_valid"), F.sum(parsed["k"]).alias("sum_k"))


@query("PR13", r"""
SELECT record_id, list_filter(string_split(trim(source_id, ' '), '_'), lambda x: regexp_matches(x, '^[0-9]+$'))[1] AS number FROM pool_records""")
def extract_numeric_token(t):
    return t("pool_records").select("record_id", T.first_number(F.col("source_id")).alias("number"))


@query("SK7 FN15", "SELECT doc_id, sha256(text) AS digest, octet_length(encode(text)) AS n_bytes FROM documents WHERE text IS NOT NULL")
def content_hash_manifest(t):
    return t("documents").filter("text IS NOT NULL").select("doc_id", F.sha2("text", 256).alias("digest"), F.octet_length("text").cast("long").alias("n_bytes"))


@query("FN14", """
SELECT key, count(*) AS n FROM (SELECT unnest(json_keys(payload)) AS key FROM pipeline_results WHERE json_valid(payload) AND json_type(payload) = 'OBJECT') GROUP BY key""")
def json_key_profile(t):
    valid = t("pipeline_results").filter(F.try_parse_json("payload").isNotNull())
    return valid.select(F.explode(F.json_object_keys("payload")).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n"))


@query("FN4 PR24 PR25", """
SELECT analysis_id, substring(coalesce(answer_preview, ''), 1, 40) AS preview, CAST(length(coalesce(answer_preview, '')) AS INTEGER) AS n_chars FROM rag_error_analysis""")
def answer_previews(t):
    c = F.coalesce("answer_preview", F.lit(""))
    return t("rag_error_analysis").select("analysis_id", F.substring(c, 1, 40).alias("preview"), F.length(c).alias("n_chars"))


@query("FN2 UD10", "SELECT row_id, nfc_normalize(text) AS composed FROM sentences WHERE text IS NOT NULL")
def unicode_composed(t):
    return t("sentences").filter("text IS NOT NULL").select("row_id", T.unicode_form(F.col("text")).alias("composed"))


@query("FN2", """
SELECT count(*) AS n, count(CASE WHEN nfc_normalize(text) <> text THEN 1 END) AS n_recomposed FROM sentences""")
def unicode_recoverability(t):
    rows = t("sentences").select("text", T.unicode_form(F.col("text")).alias("c"))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("c") != F.col("text")).alias("n_recomposed"))
