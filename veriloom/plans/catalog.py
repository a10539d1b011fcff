"""Registry of the core queries: name, callable, and SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import nested
from . import decision_queries, leakage_queries, loop_queries, metric_queries, pair_queries, quality_queries, report_queries, retrieval_queries, scorer_queries, shape_queries, source_queries, text_queries  # noqa: F401  (registers)
from .registry import REGISTRY, Query, query


_KEY = "coalesce(nullif(json_extract_string(c, '$.corpus_id'), ''), coalesce(json_extract_string(c, '$.page_id'), json_extract_string(c, '$.provenance.page_id')) || '::' || coalesce(json_extract_string(c, '$.sentence_id'), json_extract_string(c, '$.provenance.sentence_id')))"
_EVIDENCE_KEY = "coalesce(nullif(e.corpus_id, ''), e.page_id || '::' || CAST(e.sentence_id AS VARCHAR))"
CANDIDATES = """SELECT result_id, i, list[i] AS c FROM (SELECT result_id, list, unnest(range(1, len(list) + 1)) AS i FROM (
    SELECT result_id, CASE json_type(v) WHEN 'ARRAY' THEN json_extract(v, '$[*]') WHEN 'OBJECT' THEN CASE WHEN json_extract(v, '$.items') IS NULL THEN [v] ELSE json_extract(v, '$.items[*]') END END AS list FROM (
      SELECT result_id, CASE WHEN json_type(v) = 'VARCHAR' THEN CAST(json_extract_string(v, '$') AS JSON) ELSE v END AS v FROM (SELECT result_id, json_extract(payload, '$.verified_candidates') AS v FROM pipeline_results WHERE json_valid(payload)))))"""
CHILDREN = f"""
SELECT 'attempt_records' AS parent_table, attempt_id AS parent_id, 'evidence' AS child, CAST(i - 1 AS BIGINT) AS pos, {_EVIDENCE_KEY} AS child_key FROM (SELECT attempt_id, evidence[i] AS e, i FROM (SELECT attempt_id, evidence, unnest(range(1, len(evidence) + 1)) AS i FROM attempt_records)) WHERE e IS NOT NULL
UNION ALL SELECT 'attempt_records', attempt_id, 'selected_evidence', 0, {_EVIDENCE_KEY} FROM (SELECT attempt_id, selected_evidence AS e FROM attempt_records) WHERE e IS NOT NULL
{" ".join(f"UNION ALL SELECT 'attempt_records', attempt_id, 'latency', 0, '{p}_seconds' FROM attempt_records WHERE latency.{p}_seconds IS NOT NULL" for p in ("generation", "retrieval", "reranking", "verification"))}
UNION ALL SELECT 'pipeline_results', result_id, 'verified_candidate', CAST(i - 1 AS BIGINT), {_KEY} FROM ({CANDIDATES}) WHERE json_type(c) <> 'NULL'"""


@query("P4", CHILDREN)
def p4_found(t) -> DataFrame:
    return nested.linked_children(t("attempt_records"), t("pipeline_results"))


def _either(name: str, *paths: str) -> str:
    return "coalesce(" + ", ".join(f"json_extract_string(c, '$.{p}')" for p in (name, *paths)) + ")"


@query("P4", f"""SELECT result_id, CAST(i - 1 AS BIGINT) AS pos, {_either('corpus_id')} AS corpus_id, {_either('page_id', 'provenance.page_id')} AS page_id, CAST({_either('sentence_id', 'provenance.sentence_id')} AS BIGINT) AS sentence_id,
CAST({_either('entailment_probability', 'scores.verifier.entailment_probability')} AS DOUBLE) AS entailment_probability, {_either('text')} AS text FROM ({CANDIDATES}) WHERE json_type(c) <> 'NULL'""")
def p4_candidates(t) -> DataFrame:
    names = ["corpus_id", "page_id", "sentence_id", "entailment_probability", "text"]
    rows = nested.explode_json_fields(t("pipeline_results"), "result_id", "payload", "verified_candidates", names)
    return rows.select(F.col("parent_id").alias("result_id"), "pos", "corpus_id", "page_id", F.expr("try_cast(sentence_id AS bigint)").alias("sentence_id"), F.expr("try_cast(entailment_probability AS double)").alias("entailment_probability"), "text")


_NESTED = [("provenance", "$.provenance"), ("scores", "$.scores"), ("scores.verifier", "$.scores.verifier"), ("scores.faiss", "$.scores.faiss"), ("scores.reranker", "$.scores.reranker")]


@query("P4", f"""WITH c AS (SELECT result_id, i - 1 AS pos, c FROM ({CANDIDATES}) WHERE json_type(c) = 'OBJECT'), h AS (""" + " UNION ALL ".join(f"SELECT result_id, pos, '{h}' AS holder, json_extract(c, '{p}') AS o FROM c" for h, p in _NESTED) + """)
SELECT result_id, CAST(pos AS BIGINT) AS pos, holder, key AS name, json_extract_string(o, '$."' || key || '"') AS value FROM (SELECT *, unnest(json_keys(o)) AS key FROM h WHERE json_type(o) = 'OBJECT') WHERE json_type(json_extract(o, '$."' || key || '"')) NOT IN ('OBJECT', 'ARRAY', 'NULL')""")
def p4_nested(t) -> DataFrame:
    """The objects below the candidates, one row a scalar, linked by result and place."""
    rows = nested.explode_json_nested(t("pipeline_results"), "result_id", "payload", "verified_candidates")
    return rows.select(F.col("parent_id").alias("result_id"), "pos", "holder", "name", "value")


_ITEM = ["corpus_id", "text", "page_id", "sentence_id", "original_rank", "reranked_rank", "entailment_probability", "contradiction_probability"]


@query("P4", f"SELECT attempt_id, CAST(i - 1 AS BIGINT) AS pos, {', '.join(f'e.{c} AS {c}' for c in _ITEM)} FROM (SELECT attempt_id, evidence[i] AS e, i FROM (SELECT attempt_id, evidence, unnest(range(1, len(evidence) + 1)) AS i FROM attempt_records)) WHERE e IS NOT NULL")
def p4_evidence(t) -> DataFrame:
    return nested.child_table(t("attempt_records"), "attempt_id", "evidence")


def queries() -> dict[str, Query]:
    return dict(REGISTRY)


def oracle_sql() -> dict[str, str]:
    return {name: q.sql for name, q in REGISTRY.items() if q.sql}
