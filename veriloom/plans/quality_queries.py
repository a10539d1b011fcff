"""Validators and profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import quality as Q
from .registry import query
from .shape_queries import label_sql
from .text_queries import norm_sql


def _rules_sql(source: str, key: str, rules: dict[str, str], extra: str = "") -> str:
    return " UNION ALL ".join(f"SELECT {key}, '{code}' AS issue FROM {source} WHERE {broken}" for code, broken in rules.items()) + extra


@query("VA1 AG13 FN13", _rules_sql("pool_records", "record_id", {
    "empty_claim": f"{norm_sql('hypothesis')} = ''",
    "invalid_label": f"coalesce({label_sql('label')} NOT IN ('entailment', 'contradiction', 'neutral'), true)",
    "decided_without_evidence": f"{label_sql('label')} IN ('entailment', 'contradiction') AND source_dataset = 'fever' AND coalesce(premise_reference, '[]') = '[]'",
    "neutral_with_evidence": f"{label_sql('label')} = 'neutral' AND coalesce(premise_reference, '[]') <> '[]'",
}))
def validate_claims(t):
    label, refs = T.clean_label(F.col("label")), F.coalesce("premise_reference", F.lit("[]"))
    return Q.issues(t("pool_records"), ["record_id"], {
        "empty_claim": T.normalize_text(F.col("hypothesis")) == "",
        "invalid_label": F.coalesce(~label.isin("entailment", "contradiction", "neutral"), F.lit(True)),
        "decided_without_evidence": label.isin("entailment", "contradiction") & (F.col("source_dataset") == "fever") & (refs == "[]"),
        "neutral_with_evidence": (label == "neutral") & (refs != "[]"),
    })


@query("AG13", _rules_sql("generation_results", "generation_id", {
    "empty_response": f"{norm_sql('generated_text')} = ''", "missing_context": "system_instruction IS NULL", "missing_prompt": f"{norm_sql('user_input')} = ''",
    "config_not_json": "generation_config IS NULL OR NOT json_valid(generation_config)", "late_row": "ingested_at > created_at + INTERVAL 1 DAY",
}))
def validate_pairs(t):
    return Q.issues(t("generation_results"), ["generation_id"], {
        "empty_response": T.normalize_text(F.col("generated_text")) == "", "missing_context": F.col("system_instruction").isNull(), "missing_prompt": T.normalize_text(F.col("user_input")) == "",
        "config_not_json": F.try_parse_json("generation_config").isNull(), "late_row": F.col("ingested_at") > F.col("created_at") + F.expr("INTERVAL 1 DAY"),
    })


@query("VA3 AG15", """
WITH r AS (SELECT row_number() OVER () AS r, generation_id, generated_text AS body FROM generation_results),
w AS (SELECT r, unnest(string_split(body, ' ')) AS span, unnest(range(1, len(string_split(body, ' ')) + 1)) AS i FROM r WHERE body IS NOT NULL),
s AS (SELECT r, span, sum(length(span) + 1) OVER (PARTITION BY r ORDER BY i) - length(span) - 1 AS start FROM w),
c AS (SELECT r.r, generation_id, body, count(CASE WHEN span <> '' THEN 1 END) AS n, count(CASE WHEN span <> '' AND start + length(span) <= length(body) AND substring(body, CAST(start + 1 AS BIGINT), length(span)) = span THEN 1 END) AS m, count(CASE WHEN span <> '' AND start + length(span) > length(body) THEN 1 END) AS o FROM r LEFT JOIN s ON s.r = r.r GROUP BY ALL)
SELECT generation_id, CAST(n AS INTEGER) AS n_spans, CAST(m AS INTEGER) AS n_match, CAST(n - m - o AS INTEGER) AS n_mismatch, CAST(o AS INTEGER) AS n_out_of_bounds, coalesce(body, '') = '' AS empty_text FROM c""")
def validate_spans(t):
    rows = t("generation_results").select("generation_id", F.col("generated_text").alias("body"), T.word_spans(F.col("generated_text")).alias("spans"))
    found = rows.select("generation_id", "body", F.coalesce(Q.span_statuses(F.col("body"), F.col("spans")), F.array().cast("array<string>")).alias("s"))
    n = lambda status: F.size(F.filter("s", lambda x: x == status))
    return found.select("generation_id", F.size("s").alias("n_spans"), n("match").alias("n_match"), n("offset_text_mismatch").alias("n_mismatch"), n("offset_out_of_bounds").alias("n_out_of_bounds"), (F.coalesce("body", F.lit("")) == "").alias("empty_text"))


@query("AG14", """
SELECT attempt_id, CAST(len(list_filter(evidence, lambda e: e IS NULL)) AS INTEGER) AS n_null, CAST(len(list_filter(evidence, lambda e: e.entailment_probability < 0 OR e.entailment_probability > 1)) AS INTEGER) AS n_outside,
  len(list_filter(evidence, lambda e: e.entailment_probability >= e.contradiction_probability)) > 0 AS any_supporting FROM attempt_records WHERE evidence IS NOT NULL""")
def evidence_ranges(t):
    p = lambda e: e["entailment_probability"]
    rows = t("attempt_records").filter("evidence IS NOT NULL")
    n = lambda f: F.size(F.filter("evidence", f))
    return rows.select("attempt_id", n(lambda e: e.isNull()).alias("n_null"), n(lambda e: (p(e) < 0) | (p(e) > 1)).alias("n_outside"), (n(lambda e: p(e) >= e["contradiction_probability"]) > 0).alias("any_supporting"))


@query("AG2 AG17", "SELECT page_id, sentence_id, count(*) AS n FROM sentences GROUP BY ALL HAVING count(*) > 1")
def duplicate_keys(t):
    return Q.duplicate_keys(t("sentences"), ["page_id", "sentence_id"])


@query("AG17", f"SELECT norm, count(*) AS n, count(DISTINCT text) AS n_exact FROM (SELECT {norm_sql('text')} AS norm, text FROM sentences WHERE text IS NOT NULL) WHERE norm <> '' GROUP BY norm HAVING count(*) > 1")
def duplicate_texts(t):
    rows = t("sentences").filter("text IS NOT NULL").select(T.normalize_text(F.col("text")).alias("norm"), "text").filter("norm <> ''")
    return rows.groupBy("norm").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("text").alias("n_exact")).filter("n > 1")


@query("AG10", "SELECT count(*) AS n, (SELECT count(*) FROM (SELECT DISTINCT page_id, sentence_id, text, corpus_version FROM sentences)) AS n_distinct FROM sentences")
def duplicate_rows(t):
    per = t("sentences").groupBy("page_id", "sentence_id", "text", "corpus_version").agg(F.count(F.lit(1)).alias("n"))
    return per.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_distinct"))


_PROFILED = ["category", "response_id", "task_type", "model", "attempt0_mapped_decision", "attempt0_confidence", "final_decision", "termination_reason", "answer_preview"]


@query("AG7 AG9", " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(CASE WHEN {c} IS NULL THEN 1 END) AS n_null, count(CASE WHEN {c} IS NOT NULL AND {norm_sql(f'CAST({c} AS VARCHAR)')} = '' THEN 1 END) AS n_blank, count(DISTINCT {c}) AS n_distinct FROM rag_error_analysis" for c in _PROFILED))
def column_profile(t):
    return Q.column_profile(t("rag_error_analysis"), _PROFILED)


@query("AG11", "SELECT rows_per_key, count(*) AS n_keys FROM (SELECT page_id, count(*) AS rows_per_key FROM sentences GROUP BY page_id) GROUP BY rows_per_key")
def fanout_histogram(t):
    return Q.fan_out(t("sentences"), "page_id")


_LINKS = ["example_id", "source_id", "source_subset", "hypothesis"]


@query("JN15", " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) AS n_distinct, count(k) AS n_found, round(count(k) / count(*), 6) AS share FROM (SELECT DISTINCT CAST({c} AS VARCHAR) AS v FROM verifier_examples WHERE {c} IS NOT NULL) LEFT JOIN (SELECT DISTINCT source_id AS k FROM pool_records) ON v = k" for c in _LINKS))
def link_field_overlap(t):
    return Q.key_overlap(t("verifier_examples"), _LINKS, t("pool_records"), "source_id")


@query("AG18 WN10", f"""
WITH s AS (SELECT page_id, sentence_id, any_value({norm_sql('text')} = '') AS blank FROM (SELECT page_id, sentence_id, text FROM (SELECT *, row_number() OVER (PARTITION BY page_id, sentence_id ORDER BY row_id) AS r FROM sentences) WHERE r = 1) GROUP BY ALL),
l AS (SELECT *, lag(sentence_id, 1, -1) OVER (PARTITION BY page_id ORDER BY sentence_id) + 1 <> sentence_id AS jump FROM s)
SELECT page_id, count(*) AS n_sentences, min(sentence_id) AS first_sid, max(sentence_id) AS last_sid, count(CASE WHEN jump THEN 1 END) AS n_jumps, count(CASE WHEN blank THEN 1 END) AS n_blank FROM l GROUP BY page_id""")
def wiki_line_profile(t):
    return Q.sequence_profile(t("sentences"), "page_id", "sentence_id", "row_id", "text")
