"""Reports: structure of fields and spans, whole classification reports, the manifest of sources and the final tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import claims as C
from ..operators import leakage as L
from ..operators import metrics as M
from ..operators import quality as Q
from ..operators import shape as S
from .decision_queries import EV, evidence
from .metric_queries import CONF, DETECT, KNOWN, known, stages, stages_sql
from .quality_queries import _PROFILED, validate_spans
from .registry import REGISTRY, query
from .retrieval_queries import CORPUS, RERANKED, reranked
from .shape_queries import REFS, label_sql
from .text_queries import norm_sql

_PROFILE_SQL = REGISTRY["column_profile"].sql


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


@query("AG8", """
WITH o AS (SELECT payload FROM pipeline_results WHERE json_valid(payload) AND json_type(payload) = 'OBJECT'), k AS (SELECT payload, unnest(json_keys(payload)) AS key FROM o),
v AS (SELECT key, CASE json_type(json_extract(payload, '$."' || key || '"')) WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'NULL' THEN 'null' ELSE 'number' END AS kind FROM k)
SELECT key, count(*) AS n, count(*) = (SELECT count(*) FROM o) AS in_all, array_to_string(list_sort(list_distinct(list(kind))), ',') AS kinds FROM v GROUP BY key""")
def json_key_kinds(t):
    """Union and intersection of the keys of all payloads and the kinds of their values."""
    return Q.json_keys(t("pipeline_results"), "payload")


@query("AG9", f"SELECT column_name, n_distinct FROM ({_PROFILE_SQL}) WHERE n_distinct <= 10 AND n_distinct > 0")
def label_like_columns(t):
    return Q.label_like(Q.column_profile(t("rag_error_analysis"), _PROFILED))


@query("AG14", """
SELECT coalesce(step16_decision, '') AS decision, count(*) AS n, count(CASE WHEN evidence IS NULL THEN 1 END) AS n_none, count(CASE WHEN len(evidence) = 0 THEN 1 END) AS n_empty, count(CASE WHEN len(evidence) > 0 THEN 1 END) AS n_filled, CAST(coalesce(sum(len(evidence)), 0) AS BIGINT) AS n_items FROM attempt_records GROUP BY 1""")
def span_structure(t):
    """How many records hold no list, an empty one and a filled one, by label."""
    n = F.size("evidence")
    return t("attempt_records").groupBy(F.coalesce("step16_decision", F.lit("")).alias("decision")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("evidence").isNull()).alias("n_none"), F.count_if(F.col("evidence").isNotNull() & (n == 0)).alias("n_empty"), F.count_if(F.col("evidence").isNotNull() & (n > 0)).alias("n_filled"),
        F.coalesce(F.sum(F.when(F.col("evidence").isNotNull(), n)), F.lit(0)).cast("long").alias("n_items"),
    )


@query("AG15", f"SELECT count(*) AS n_texts, CAST(sum(n_spans) AS BIGINT) AS n_spans, CAST(sum(n_match) AS BIGINT) AS n_match, CAST(sum(n_mismatch) AS BIGINT) AS n_mismatch, CAST(sum(n_out_of_bounds) AS BIGINT) AS n_out_of_bounds FROM ({REGISTRY['validate_spans'].sql})")
def span_totals(t):
    return validate_spans(t).agg(F.count(F.lit(1)).alias("n_texts"), *[F.sum(c).alias(c) for c in ("n_spans", "n_match", "n_mismatch", "n_out_of_bounds")])


_LINK_COLUMNS = ["attempt_id", "attempt_number", "run_id"]


@query("JN15", "WITH o AS (" + " UNION ALL ".join(f"SELECT '{c}' AS column_name, round(count(k) / count(*), 6) AS share FROM (SELECT DISTINCT {c} AS v FROM attempt_records WHERE {c} IS NOT NULL) LEFT JOIN (SELECT DISTINCT run_id AS k FROM pipeline_results) ON v = k" for c in _LINK_COLUMNS) + ") SELECT column_name, share FROM o WHERE share > 0.8 ORDER BY share DESC, column_name LIMIT 1")
def link_field_choice(t):
    """The column of the attempts that leads to the results, if four fifths of its values are known there."""
    return Q.link_choice(Q.key_overlap(t("attempt_records"), _LINK_COLUMNS, t("pipeline_results"), "run_id"), 0.8)


@query("JN14", """
WITH a AS (SELECT DISTINCT run_id FROM attempt_records WHERE attempt_number = 0), b AS (SELECT DISTINCT run_id FROM pipeline_results)
SELECT *, n_first = n_shared AND n_second = n_shared AS equal FROM (SELECT (SELECT count(*) FROM a) AS n_first, (SELECT count(*) FROM b) AS n_second, (SELECT count(*) FROM a JOIN b ON a.run_id IS NOT DISTINCT FROM b.run_id) AS n_shared)""")
def run_sets_compared(t):
    """Whether two outputs cover the same runs."""
    mark = lambda df, a, b: df.select("run_id", F.lit(a).alias("a"), F.lit(b).alias("b"))
    rows = mark(t("attempt_records").filter("attempt_number = 0"), 1, 0).unionAll(mark(t("pipeline_results"), 0, 1))
    per = rows.groupBy("run_id").agg(F.max("a").alias("a"), F.max("b").alias("b"))
    n = per.agg(F.count_if(F.col("a") == 1).alias("n_first"), F.count_if(F.col("b") == 1).alias("n_second"), F.count_if((F.col("a") == 1) & (F.col("b") == 1)).alias("n_shared"))
    return n.withColumn("equal", (F.col("n_first") == F.col("n_shared")) & (F.col("n_second") == F.col("n_shared")))


@query("AG52 JN3", f"""
WITH {REFS}, asked AS (SELECT DISTINCT page_id FROM refs WHERE page_id <> ''), listed AS (SELECT DISTINCT page_id FROM sentences WHERE page_id IS NOT NULL),
m AS (SELECT page_id FROM asked WHERE page_id NOT IN (SELECT page_id FROM listed)), d AS (SELECT DISTINCT nfc_normalize(page_id) AS c FROM listed)
SELECT (SELECT count(*) FROM asked) AS n_asked, count(*) AS n_missing, count(CASE WHEN nfc_normalize(page_id) IN (SELECT page_id FROM listed) THEN 1 END) AS n_composed, count(CASE WHEN nfc_normalize(page_id) IN (SELECT c FROM d) THEN 1 END) AS n_any_form FROM m""")
def page_recoverability(t):
    """Cited pages that are not listed, and how many of them are in composed form, or in any form (both sides decomposed)."""
    asked = C.evidence_references(t("pool_records"), "record_id", "premise_reference").select("page_id").filter(C.has_evidence(F.col("page_id"))).distinct()
    listed = t("sentences").select("page_id").filter("page_id IS NOT NULL").distinct()
    missing = asked.join(listed, "page_id", "left_anti").select(T.unicode_form(F.col("page_id")).alias("c"), T.unicode_form(F.col("page_id"), "NFD").alias("d"))
    composed = listed.select(F.col("page_id").alias("c"), F.lit(1).alias("as_composed"))
    decomposed = listed.select(T.unicode_form(F.col("page_id"), "NFD").alias("d")).distinct().withColumn("in_any", F.lit(1))
    found = missing.join(composed, "c", "left").join(decomposed, "d", "left").agg(F.count(F.lit(1)).alias("n_missing"), F.count("as_composed").alias("n_composed"), F.count("in_any").alias("n_any_form"))
    return asked.agg(F.count(F.lit(1)).alias("n_asked")).join(F.broadcast(found))


_LABELS = ["ACCEPT", "CORRECT", "ABSTAIN"]
_D = f"d AS (SELECT task_type, attempt0_mapped_decision AS t, final_decision AS p FROM rag_error_analysis WHERE {KNOWN})"


def _summary_sql(by: str | None) -> str:
    k, g, on = (f"{by}, ", f"GROUP BY {by}", f"AND d.{by} IS NOT DISTINCT FROM g.{by}") if by else ("", "", "")
    grid = f"(SELECT DISTINCT {by} FROM d)" if by else "(SELECT 1)"
    return f"""WITH {_D}, l AS (SELECT unnest({_LABELS}) AS label), n AS (SELECT {f'g.{by}, ' if by else ''}label, count(CASE WHEN t = label THEN 1 END) AS s, count(CASE WHEN p = label THEN 1 END) AS q, count(CASE WHEN t = label AND p = label THEN 1 END) AS c FROM l CROSS JOIN {grid} g JOIN d ON true {on} GROUP BY ALL),
f AS (SELECT *, coalesce(2 * c / nullif(CAST(q + s AS DOUBLE), 0), 0) AS f1 FROM n), r AS (SELECT {k}count(*) AS n, avg(CASE WHEN t = p THEN 1.0 ELSE 0.0 END) AS accuracy FROM d {g}),
m AS (SELECT {k}sum(f1) / {len(_LABELS)} AS macro_f1, coalesce(sum(f1 * s) / nullif(CAST(sum(s) AS DOUBLE), 0), 0) AS weighted_f1 FROM f {g})
SELECT {f'r.{by}, ' if by else ''}n, round(accuracy, 6) AS accuracy, round(macro_f1, 6) AS macro_f1, round(weighted_f1, 6) AS weighted_f1 FROM r JOIN m ON {f'r.{by} IS NOT DISTINCT FROM m.{by}' if by else 'true'}"""


@query("AG21 AG54", _summary_sql(None))
def classification_summary(t):
    return M.summary(known(t), "attempt0_mapped_decision", "final_decision", labels=_LABELS)


@query("AG22 PR16", _summary_sql("task_type"))
def classification_summary_by_group(t):
    return M.summary(known(t), "attempt0_mapped_decision", "final_decision", ["task_type"], _LABELS)


@query("AG21 AG54", f"WITH {_D} SELECT a.x AS truth, b.y AS predicted, count(d.t) AS n FROM (SELECT unnest({_LABELS}) AS x) a CROSS JOIN (SELECT unnest({_LABELS}) AS y) b LEFT JOIN d ON d.t = a.x AND d.p = b.y GROUP BY ALL")
def confusion_matrix(t):
    return M.confusion_matrix(known(t), "attempt0_mapped_decision", "final_decision", _LABELS)


@query("AG46", f"WITH {stages_sql('category')}, c AS ({CONF.format(keys='stage, category')}) SELECT stage, category, tp, fp, fn, tn, CASE WHEN tp + fp + fn + tn < 15 THEN 'small sample' END AS note, {DETECT}")
def breakdown_by_category(t):
    per = stages(t, "category").groupBy("stage", "category").agg(*M.confusion(F.col("gold"), F.col("flagged")))
    return M.detection(per.withColumn("note", F.when(F.expr("tp + fp + fn + tn") < 15, "small sample")))


_AT = [0.5, 0.7, 0.9]


@query("AG44", f"""
WITH {EV}, s AS (SELECT coalesce(a.step16_decision, '') AS decision, ent FROM ev JOIN attempt_records a ON a.attempt_id = ev.attempt_id)
SELECT decision, count(*) AS n, round(avg(ent), 6) AS mean, round(median(ent), 6) AS median, """ + ", ".join(f"round(avg(CASE WHEN ent >= {x} THEN 1.0 ELSE 0.0 END), 6) AS above_{int(x * 100)}" for x in _AT) + " FROM s GROUP BY decision")
def score_diagnostics(t):
    """Mean, median and shares above several thresholds, by decision."""
    named = t("attempt_records").select("attempt_id", F.coalesce("step16_decision", F.lit("")).alias("decision"))
    rows = evidence(t).select("attempt_id", F.col("entailment_probability").alias("p")).join(named, "attempt_id").select("decision", "p")
    per = rows.groupBy("decision").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("p"), 6).alias("mean"), *[F.round(F.avg(F.when(F.col("p") >= x, 1.0).otherwise(0.0)), 6).alias(f"above_{int(x * 100)}") for x in _AT])
    return per.join(S.medians(rows, ["decision"], "p"), "decision").withColumn("median", F.round("median", 6))


_SOURCE = "concat_ws('.', source_dataset, lower(trim(source_subset, ' ')))"
_ROLE = f"CASE WHEN split <> 'train' THEN 'evaluation' WHEN {_SOURCE} IN ('fever.train', 'halueval.qa', 'halueval.dialogue', 'halueval.summarization') THEN 'training' ELSE 'excluded' END"


@query("AG49 SK3", f"""
WITH leaked AS (SELECT DISTINCT {norm_sql('hypothesis')} AS norm FROM pool_records WHERE split <> 'train'), p AS (SELECT *, {_SOURCE} AS source, {_ROLE} AS role, {label_sql('label')} AS l, {norm_sql('hypothesis')} AS norm FROM pool_records)
SELECT source, coalesce(split, '') AS split, role, count(*) AS raw_size, count(CASE WHEN premise_text IS NOT NULL THEN 1 END) AS usable, count(CASE WHEN resolution_status = 'no_evidence_annotation' THEN 1 END) AS no_evidence, count(CASE WHEN resolution_status IN ('unresolved', 'missing_page', 'missing_sentence_id') THEN 1 END) AS unresolved,
count(CASE WHEN role = 'training' AND norm IN (SELECT norm FROM leaked) THEN 1 END) AS contaminated, {", ".join(f"count(CASE WHEN l = '{x}' THEN 1 END) AS n_{x}" for x in ("entailment", "contradiction", "neutral"))}, role = 'training' AS eligible_for_training, role = 'evaluation' AS eligible_for_evaluation FROM p GROUP BY 1, 2, 3""")
def source_manifest(t):
    """Of each source and split: its role, sizes, exclusions by reason and labels."""
    p = t("pool_records").withColumn("norm", T.normalize_text(F.col("hypothesis"))).withColumn("l", T.clean_label(F.col("label")))
    source = F.concat_ws(".", "source_dataset", F.lower(F.trim("source_subset")))
    role = F.when(F.col("split") != "train", "evaluation").when(L.allowed_source(F.col("source_dataset"), F.col("source_subset")), "training").otherwise("excluded")
    leaked = p.filter("split <> 'train'").select("norm").distinct().withColumn("leaked", F.lit(True))
    rows = p.select(source.alias("source"), F.coalesce("split", F.lit("")).alias("split"), role.alias("role"), "premise_text", "resolution_status", "norm", "l").join(leaked, "norm", "left")
    n = lambda c, name: F.count_if(c).alias(name)
    status = F.col("resolution_status")
    per = rows.groupBy("source", "split", "role").agg(
        F.count(F.lit(1)).alias("raw_size"), n(F.col("premise_text").isNotNull(), "usable"), n(status == "no_evidence_annotation", "no_evidence"), n(status.isin("unresolved", "missing_page", "missing_sentence_id"), "unresolved"),
        n((F.col("role") == "training") & F.col("leaked"), "contaminated"), *[n(F.col("l") == x, f"n_{x}") for x in ("entailment", "contradiction", "neutral")],
    )
    return per.withColumn("eligible_for_training", F.col("role") == "training").withColumn("eligible_for_evaluation", F.col("role") == "evaluation")


def _long(table: int, row: DataFrame) -> DataFrame:
    """The one row of a table as (table_no, metric, value)."""
    cells = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in row.columns])
    return row.select(F.lit(table).alias("table_no"), F.inline(cells))


_AVG = lambda c: f"avg(CASE WHEN {c} THEN 1.0 ELSE 0.0 END)"
_FINAL = {
    1: f"SELECT count(*) AS pool_records, count(CASE WHEN premise_text IS NOT NULL THEN 1 END) AS usable_records, count(CASE WHEN split = 'train' THEN 1 END) AS train_records, count(CASE WHEN split = 'dev' THEN 1 END) AS dev_records, (SELECT count(DISTINCT response_id) FROM rag_error_analysis) AS responses, (SELECT count(*) FROM eval_items) AS questions, (SELECT {_AVG('gold_has_hallucination')} FROM rag_error_analysis WHERE {KNOWN}) AS prevalence FROM pool_records",
    2: f"SELECT n AS dev_examples, accuracy, macro_f1, weighted_f1 FROM ({_summary_sql(None)})",
    3: f"WITH {CORPUS}, {RERANKED}, h AS (SELECT q, min(CASE WHEN gold THEN rank END) AS f, min(CASE WHEN gold THEN reranked_rank END) AS r FROM reranked GROUP BY q) SELECT (SELECT count(*) FROM corpus) AS corpus_sentences, (SELECT max(len(embedding)) FROM embeddings) AS dimension, avg(CASE WHEN f <= 5 THEN 1.0 ELSE 0.0 END) AS recall_at_5, avg(CASE WHEN r <= 5 THEN 1.0 ELSE 0.0 END) AS reranked_recall_at_5 FROM h",
    4: f"SELECT count(*) AS responses, {_AVG('gold_has_hallucination')} AS prevalence, 1 - {_AVG('gold_has_hallucination')} AS majority_baseline, {_AVG('(attempt0_mapped_decision <> ' + chr(39) + 'ACCEPT' + chr(39) + ') = gold_has_hallucination')} AS first_accuracy, {_AVG('(final_decision <> ' + chr(39) + 'ACCEPT' + chr(39) + ') = gold_has_hallucination')} AS final_accuracy FROM rag_error_analysis WHERE {KNOWN}",
    5: "SELECT n AS questions, top_right, mean_mass FROM (" + REGISTRY["mc_scores"].sql + ")",
    6: "SELECT " + ", ".join(f"coalesce(sum(CASE WHEN mode = '{m}' AND decision = '{d}' THEN n END), 0) AS {m}_{d.lower()}" for m in ("reranked", "no_reranker", "top1") for d in ("SUPPORTED", "CONTRADICTED", "ABSTAIN")) + " FROM (" + REGISTRY["evidence_modes"].sql + ")",
    7: f"SELECT avg(CASE WHEN attempt0_mapped_decision = 'ACCEPT' AND gold_has_hallucination THEN attempt0_confidence END) AS confidence_of_missed, avg(CASE WHEN attempt0_mapped_decision = 'CORRECT' AND NOT gold_has_hallucination THEN attempt0_confidence END) AS confidence_of_false_alarms, {_AVG('attempt0_num_evidence = 0')} AS without_evidence FROM rag_error_analysis WHERE {KNOWN}",
}
_FINAL_COLUMNS = {
    1: ["pool_records", "usable_records", "train_records", "dev_records", "responses", "questions", "prevalence"], 2: ["dev_examples", "accuracy", "macro_f1", "weighted_f1"], 3: ["corpus_sentences", "dimension", "recall_at_5", "reranked_recall_at_5"],
    4: ["responses", "prevalence", "majority_baseline", "first_accuracy", "final_accuracy"], 5: ["questions", "top_right", "mean_mass"], 6: [f"{m}_{d}" for m in ("reranked", "no_reranker", "top1") for d in ("supported", "contradicted", "abstain")],
    7: ["confidence_of_missed", "confidence_of_false_alarms", "without_evidence"],
}


@query("AG50 SK4", "WITH " + ", ".join(f"f{k} AS ({sql})" for k, sql in _FINAL.items()) + " SELECT table_no, metric, round(value, 6) AS value FROM (" + " UNION ALL ".join(f"SELECT {k} AS table_no, '{c}' AS metric, CAST({c} AS DOUBLE) AS value FROM f{k}" for k, columns in _FINAL_COLUMNS.items() for c in columns) + ")")
def final_tables(t):
    """The seven tables of the final report, one row a figure."""
    p, k, e = t("pool_records"), known(t), t("rag_error_analysis")
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    gold = F.col("gold_has_hallucination")
    one = p.agg(F.count(F.lit(1)).alias("pool_records"), F.count("premise_text").alias("usable_records"), F.count_if(F.col("split") == "train").alias("train_records"), F.count_if(F.col("split") == "dev").alias("dev_records"))
    one = one.join(F.broadcast(e.agg(F.count_distinct("response_id").alias("responses")))).join(F.broadcast(t("eval_items").agg(F.count(F.lit(1)).alias("questions")))).join(F.broadcast(k.agg(share(gold).alias("prevalence"))))
    two = M.summary(k, "attempt0_mapped_decision", "final_decision", labels=_LABELS, digits=17).withColumnRenamed("n", "dev_examples")
    r = reranked(t).groupBy("q").agg(F.min(F.when(F.col("gold"), F.col("rank"))).alias("f"), F.min(F.when(F.col("gold"), F.col("reranked_rank"))).alias("r")).agg(share(F.col("f") <= 5).alias("recall_at_5"), share(F.col("r") <= 5).alias("reranked_recall_at_5"))
    sized = REGISTRY["corpus_build"].run(t).agg(F.count(F.lit(1)).alias("corpus_sentences")).join(F.broadcast(t("embeddings").agg(F.max(F.size("embedding")).alias("dimension"))))
    four = k.agg(F.count(F.lit(1)).alias("responses"), share(gold).alias("prevalence"), (1 - share(gold)).alias("majority_baseline"), share((F.col("attempt0_mapped_decision") != "ACCEPT") == gold).alias("first_accuracy"), share((F.col("final_decision") != "ACCEPT") == gold).alias("final_accuracy"))
    five = REGISTRY["mc_scores"].run(t).withColumnRenamed("n", "questions")
    modes = REGISTRY["evidence_modes"].run(t)
    six = modes.agg(*[F.coalesce(F.sum(F.when((F.col("mode") == m) & (F.col("decision") == d), F.col("n"))), F.lit(0)).alias(f"{m}_{d.lower()}") for m in ("reranked", "no_reranker", "top1") for d in ("SUPPORTED", "CONTRADICTED", "ABSTAIN")])
    sure = lambda d, g: F.avg(F.when((F.col("attempt0_mapped_decision") == d) & g, F.col("attempt0_confidence")))
    seven = k.agg(sure("ACCEPT", gold).alias("confidence_of_missed"), sure("CORRECT", ~gold).alias("confidence_of_false_alarms"), share(F.col("attempt0_num_evidence") == 0).alias("without_evidence"))
    tables = {1: one, 2: two, 3: sized.join(F.broadcast(r)), 4: four, 5: five, 6: six, 7: seven}
    return _union([_long(n, df.select(*_FINAL_COLUMNS[n])) for n, df in tables.items()]).withColumn("value", F.round("value", 6))


@query("IT10", REGISTRY["dataset_manifest"].sql)
def staged_manifest(t):
    """The manifest as the stage runner writes it: the query run by its stage, stored, and read from there."""
    from . import runner
    from .source_queries import folder

    rows = REGISTRY["dataset_manifest"].run(t)
    path = folder(rows, "stages")
    stage = runner.chosen(only="manifest")[0]
    runner.store(rows, path, stage, "dataset_manifest")
    return rows.sparkSession.read.schema(rows.schema).parquet(f"{path}/{stage}/dataset_manifest")
