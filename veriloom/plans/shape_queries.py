"""Claims, evidence sets, label maps and lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import claims as C
from ..operators import shape as S
from ..operators.skew import lookup_join
from .registry import query
from .text_queries import norm_sql

REFS = """refs AS (
  SELECT record_id, CAST(s - 1 AS BIGINT) AS set_pos, CAST(r - 1 AS BIGINT) AS ref_pos, sets[s][r].wiki_url AS page_id, sets[s][r].sentence_id AS sentence_id
  FROM (SELECT record_id, sets, s, unnest(range(1, len(sets[s]) + 1)) AS r FROM (SELECT record_id, sets, unnest(range(1, len(sets) + 1)) AS s
    FROM (SELECT record_id, from_json(premise_reference, '[[{"wiki_url":"VARCHAR","sentence_id":"BIGINT"}]]') AS sets FROM pool_records WHERE premise_reference IS NOT NULL)))),
idx AS (SELECT page_id, sentence_id, arg_min(struct_pack(t := text), row_id).t AS text FROM sentences GROUP BY page_id, sentence_id)"""
STATUS = f"""pages AS (SELECT page_id, arg_min(struct_pack(t := text), doc_id).t AS page_text FROM documents WHERE page_id IS NOT NULL GROUP BY page_id),
listed AS (SELECT page_id FROM sentences WHERE page_id IS NOT NULL UNION SELECT page_id FROM pages),
asked AS (SELECT DISTINCT page_id FROM refs WHERE page_id <> ''),
found AS (SELECT a.page_id, coalesce(e.page_id, n.page_id) AS found_page FROM asked a LEFT JOIN listed e ON e.page_id = a.page_id LEFT JOIN listed n ON n.page_id = nfc_normalize(a.page_id)),
resolved AS (SELECT r.*, CASE WHEN r.sentence_id = -1 THEN p.page_text ELSE i.text END AS text,
    CASE WHEN f.found_page IS NULL THEN 'missing_page' WHEN r.sentence_id = -1 THEN CASE WHEN {norm_sql('p.page_text')} = '' THEN 'empty_resolved_text' ELSE 'resolved' END
    WHEN i.sentence_id IS NULL THEN 'missing_sentence_id' WHEN {norm_sql('i.text')} = '' THEN 'empty_resolved_text' ELSE 'resolved' END AS status
  FROM refs r LEFT JOIN found f ON r.page_id = f.page_id LEFT JOIN pages p ON p.page_id = f.found_page LEFT JOIN idx i ON i.page_id = f.found_page AND i.sentence_id = r.sentence_id)"""
CHOSEN = f"""{STATUS}, sets AS (SELECT record_id, set_pos, bool_and(status = 'resolved') AS whole, count(*) AS n_refs, string_agg(text, ' ' ORDER BY ref_pos) AS premise FROM resolved GROUP BY record_id, set_pos),
chosen AS (SELECT record_id, set_pos, n_refs, premise FROM (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY set_pos) AS r FROM sets WHERE whole) WHERE r = 1)"""


def label_sql(column: str) -> str:
    return rf"lower(regexp_replace({column}, '^[\s\x22\x27.]+|[\s\x22\x27.]+$', '', 'g'))"



def _references(t):
    return C.evidence_references(t("pool_records"), "record_id", "premise_reference")


@query("AG1 SO1 PR1", f"WITH {REFS} SELECT record_id, count(DISTINCT set_pos) AS n_sets, count(*) AS n_refs, min(page_id) AS first_page FROM refs GROUP BY record_id")
def claims_group_evidence(t):
    return _references(t).groupBy("record_id").agg(F.count_distinct("set_pos").alias("n_sets"), F.count(F.lit(1)).alias("n_refs"), F.min("page_id").alias("first_page"))


@query("PR4 PR5 PR6", """
SELECT analysis_id, 'first' AS stage, attempt0_mapped_decision AS decision FROM rag_error_analysis UNION ALL SELECT analysis_id, 'final', final_decision FROM rag_error_analysis""")
def pair_expand(t):
    return C.pair_expansion(t("rag_error_analysis"), ["analysis_id"], ("first", "attempt0_mapped_decision"), ("final", "final_decision"), "stage", "decision")


@query("PR2 PR3", f"""
SELECT CASE {label_sql('label')} WHEN 'entailment' THEN 'SUPPORTS' WHEN 'contradiction' THEN 'REFUTES' WHEN 'neutral' THEN 'NOT ENOUGH INFO' END AS mapped, count(*) AS n, count(DISTINCT label) AS n_spellings FROM pool_records GROUP BY 1""")
def label_mapping(t):
    mapped = F.create_map(*[F.lit(x) for x in ("entailment", "SUPPORTS", "contradiction", "REFUTES", "neutral", "NOT ENOUGH INFO")])[T.clean_label(F.col("label"))]
    return t("pool_records").groupBy(mapped.alias("mapped")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("label").alias("n_spellings"))


@query("JN1", """
SELECT e.example_id, p.record_id, p.record_id IS NULL AS orphan FROM verifier_examples e LEFT JOIN (SELECT source_dataset, source_subset, source_id, max(record_id) AS record_id FROM pool_records GROUP BY ALL) p
ON e.source_dataset IS NOT DISTINCT FROM p.source_dataset AND e.source_subset IS NOT DISTINCT FROM p.source_subset AND e.source_id IS NOT DISTINCT FROM p.source_id""")
def left_join_orphans(t):
    keys = ["source_dataset", "source_subset", "source_id"]
    whole = S.one_key(*keys).alias("k")  # null equals null
    last = t("pool_records").groupBy(whole).agg(F.max("record_id").alias("record_id"))
    found = lookup_join(t("verifier_examples").select("example_id", whole), last, "k", "left")
    return found.select("example_id", "record_id", F.col("record_id").isNull().alias("orphan"))


@query("JN2", """
SELECT p.record_id, coalesce(v.example_id, -1) AS example_id, v.example_id IS NOT NULL AS in_examples FROM pool_records p LEFT JOIN (SELECT hypothesis, max(example_id) AS example_id FROM verifier_examples WHERE hypothesis IS NOT NULL GROUP BY hypothesis) v ON p.hypothesis = v.hypothesis""")
def left_join_flag(t):
    last = t("verifier_examples").filter("hypothesis IS NOT NULL").groupBy("hypothesis").agg(F.max("example_id").alias("e"))
    return t("pool_records").select("record_id", "hypothesis").join(last, "hypothesis", "left").select("record_id", F.coalesce("e", F.lit(-1)).cast("long").alias("example_id"), F.col("e").isNotNull().alias("in_examples"))


@query("SK5", """
SELECT page_id, sentence_id, min(row_id) AS row_id, count(*) - 1 AS n_duplicates FROM sentences GROUP BY page_id, sentence_id""")
def wiki_index_dedup(t):
    return t("sentences").groupBy("page_id", "sentence_id").agg(F.min("row_id").alias("row_id"), (F.count(F.lit(1)) - 1).alias("n_duplicates"))


@query("JN3", f"""
WITH {REFS}, {STATUS} SELECT a.page_id AS asked, f.found_page AS resolved, CASE WHEN f.found_page IS NULL THEN 'missing' WHEN f.found_page = a.page_id THEN 'exact' ELSE 'composed' END AS how FROM asked a JOIN found f ON a.page_id = f.page_id""")
def resolve_page_fallback(t):
    asked = _references(t).select("page_id").filter(C.has_evidence(F.col("page_id"))).distinct()
    found = asked.join(C.resolve_pages(asked, _pages(t).names), "page_id", "left")
    how = F.when(F.col("found_page").isNull(), "missing").when(F.col("found_page") == F.col("page_id"), "exact").otherwise("composed")
    return found.select(F.col("page_id").alias("asked"), F.col("found_page").alias("resolved"), how.alias("how"))


def _pages(t):
    return C.Pages(t("sentences"), t("documents"))


@query("JN4 SC8", f"WITH {REFS}, {STATUS} SELECT record_id, set_pos, ref_pos, status FROM resolved")
def resolve_sentence_join(t):
    return C.resolve_sentences(_references(t), _pages(t)).select("record_id", "set_pos", "ref_pos", "status")


# The same references, each of which also cites its page as a whole: no given record does.
@query("JN4", f"""
WITH {REFS.replace('sets[s][r].sentence_id AS sentence_id', '-1 AS sentence_id')}, {STATUS} SELECT record_id, set_pos, ref_pos, status, length(text) AS n_chars FROM resolved""")
def resolve_whole_pages(t):
    pages = _pages(t)
    found = C.resolve_sentences(_references(t).withColumn("sentence_id", F.lit(C.WHOLE_PAGE).cast("long")), pages)
    lengths = pages.texts.select("_row", F.length("text").cast("long").alias("n_chars"))
    return lookup_join(found, lengths, "_row", "left").select("record_id", "set_pos", "ref_pos", "status", "n_chars")


@query("JN5 FN6", f"WITH {REFS}, {CHOSEN} SELECT record_id, set_pos, n_refs, premise FROM chosen")
def claim_premise_resolution(t):
    pages = _pages(t)
    return C.first_resolved_set(C.resolve_sentences(_references(t), pages), pages, "record_id")


_LABEL = "upper(trim(original_label, ' '))"


@query("JN5 AG4", f"""
WITH {REFS}, {CHOSEN} SELECT p.record_id, CASE WHEN {_LABEL} = 'NOT ENOUGH INFO' THEN 'no_evidence_annotation' WHEN coalesce({_LABEL} NOT IN ('SUPPORTS', 'REFUTES'), true) THEN 'unknown_label' WHEN c.set_pos IS NOT NULL THEN 'resolved' ELSE 'unresolved' END AS resolution_status,
CASE WHEN {_LABEL} IN ('SUPPORTS', 'REFUTES') THEN c.set_pos END AS set_pos FROM pool_records p LEFT JOIN chosen c ON c.record_id = p.record_id""")
def claim_resolution_status(t):
    label = F.upper(F.trim("original_label"))
    chosen = claim_premise_resolution(t).select("record_id", "set_pos")
    rows = t("pool_records").select("record_id", label.alias("l")).join(chosen, "record_id", "left")
    return rows.select("record_id", C.resolution_status(F.col("l"), F.col("set_pos")).alias("resolution_status"), F.when(F.col("l").isin(*C.RESOLVABLE), F.col("set_pos")).alias("set_pos"))


@query("AG4 AG51", f"""
SELECT {label_sql('label')} AS clean_label, resolution_status, count(*) AS n, count(CASE WHEN premise_text_available THEN 1 END) AS n_usable FROM pool_records GROUP BY 1, 2""")
def resolution_coverage(t):
    return t("pool_records").groupBy(T.clean_label(F.col("label")).alias("clean_label"), "resolution_status").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("premise_text_available")).alias("n_usable"))


@query("AG51", f"WITH {REFS}, {STATUS} SELECT status, count(*) AS n, count(DISTINCT record_id) AS n_records FROM resolved GROUP BY status")
def resolution_reasons(t):
    return C.resolve_sentences(_references(t), _pages(t)).groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("record_id").alias("n_records"))
