"""Answer pairs of the raw subsets, their rules, and what may be trained on.

Raw pair records are put together from the pool: of one raw number the answer labelled right and the one labelled wrong.
Raw general records are the responses with their verdict.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import claims as C
from ..operators import leakage as L
from ..operators import quality as Q
from .registry import query
from .shape_queries import label_sql
from .text_queries import norm_sql

_NUMBER = "TRY_CAST(list_filter(string_split(trim(source_id, ' '), '_'), lambda x: regexp_matches(x, '^[0-9]+$'))[1] AS BIGINT)"
RAW = f"""nums AS (SELECT *, {_NUMBER} AS raw_index, lower(trim(source_subset, ' ')) AS subset, {label_sql('label')} AS l FROM pool_records WHERE source_dataset = 'halueval'),
raw AS (SELECT subset, raw_index, min(premise_text) AS context, min(CASE WHEN l = 'entailment' THEN hypothesis END) AS good, min(CASE WHEN l = 'contradiction' THEN hypothesis END) AS bad FROM nums WHERE raw_index IS NOT NULL AND subset IN ('qa', 'dialogue', 'summarization') GROUP BY ALL),
fields(subset, good_field, bad_field) AS (VALUES ('qa', 'right_answer', 'hallucinated_answer'), ('dialogue', 'right_response', 'hallucinated_response'), ('summarization', 'right_summary', 'hallucinated_summary')),
general AS (SELECT row_number() OVER () - 1 AS raw_index, answer_preview, gold_has_hallucination AS gold, attempt0_num_evidence AS k, category, response_id FROM rag_error_analysis),
pairs AS (SELECT subset || '_' || raw_index || '_not_hallucinated' AS example_id, subset, coalesce(context, '') AS context, coalesce(good, '') AS candidate_response, 'not_hallucinated' AS label, good_field AS source_field, NULL AS spans, NULL AS raw_id, raw_index FROM raw JOIN fields USING (subset)
  UNION ALL SELECT subset || '_' || raw_index || '_hallucinated', subset, coalesce(context, ''), coalesce(bad, ''), 'hallucinated', bad_field, NULL, NULL, raw_index FROM raw JOIN fields USING (subset)
  UNION ALL SELECT 'general_' || raw_index, 'general', '', coalesce(answer_preview, ''), CASE WHEN gold THEN 'hallucinated' WHEN NOT gold THEN 'not_hallucinated' END, 'chatgpt_response', CASE WHEN k = 0 THEN '[]' WHEN k IS NULL THEN '{{}}' END, CASE WHEN category = 'max_attempts_examples' THEN 'ID' ELSE response_id END, raw_index FROM general)"""


def raw_subsets(t):
    """The raw records of every subset, by name."""
    p = t("pool_records").filter("source_dataset = 'halueval'")
    label = T.clean_label(F.col("label"))
    rows = p.select(F.expr("lower(trim(source_subset))").alias("subset"), T.first_number(F.col("source_id")).try_cast("long").alias("raw_index"), label.alias("l"), "hypothesis", "premise_text").filter("raw_index IS NOT NULL")
    answer = lambda l: F.min(F.when(F.col("l") == l, F.col("hypothesis")))
    raw = rows.groupBy("subset", "raw_index").agg(F.min("premise_text").alias("context"), answer("entailment").alias("good"), answer("contradiction").alias("bad"))
    out = {}
    for name, spec in C.PAIR_SUBSETS.items():
        context = [F.col("context").alias(spec["context"][0]), *[F.lit(None).cast("string").alias(c) for c in spec["context"][1:]]]
        out[name] = raw.filter(F.col("subset") == name).select("raw_index", *context, F.lit(None).cast("string").alias("question"), F.col("good").alias(spec["right"]), F.col("bad").alias(spec["hallucinated"]))
    g = C.positional_index(t("rag_error_analysis"))
    verdict = F.when(F.col("gold_has_hallucination"), "yes").when(~F.col("gold_has_hallucination"), "no")
    spans = F.when(F.col("attempt0_num_evidence") == 0, "[]").when(F.col("attempt0_num_evidence").isNull(), "{}")
    raw_id = F.when(F.col("category") == "max_attempts_examples", "ID").otherwise(F.col("response_id"))
    out[C.GENERAL] = g.select("raw_index", F.lit(None).cast("string").alias("user_query"), F.col("answer_preview").alias("chatgpt_response"), verdict.alias("hallucination"), spans.alias("hallucination_spans"), raw_id.alias("ID"))
    return out


@query("PR6", "SELECT record_id, row_number() OVER () - 1 AS raw_index FROM pool_records")
def positional_rows(t):
    return C.positional_index(t("pool_records")).select("record_id", "raw_index")


@query("PR4 PR5 PR6", f"WITH {RAW} SELECT example_id, subset, context, candidate_response, label, source_field, raw_index FROM pairs")
def pair_records(t):
    return C.expand_all(raw_subsets(t)).select("example_id", "subset", "context", "candidate_response", "label", "source_field", "raw_index")


@query("PR10 PR11", f"WITH {RAW} SELECT example_id AS source_id, candidate_response AS hypothesis, CASE label WHEN 'hallucinated' THEN 'contradiction' ELSE 'entailment' END AS label, label AS original_label, subset AS source_subset, context AS premise_text, raw_index FROM pairs WHERE subset <> 'general'")
def pair_pool(t):
    pool = C.pool_of_pairs(C.expand_all(raw_subsets(t)))
    return pool.select("source_id", "hypothesis", "label", "original_label", "source_subset", "premise_text", "raw_index")


def _coded(rules: dict[str, tuple[str, str | None]], source: str, key: str) -> str:
    code = lambda c, v: f"'{c}'" if v is None else f"'{c}:' || coalesce('''' || {v} || '''', 'None')"
    return " UNION ALL ".join(f"SELECT {key}, {code(c, v)} AS issue FROM {source} WHERE {w}" for c, (w, v) in rules.items())


@query("VA2 FN13", f"WITH {RAW} " + _coded({
    "empty_or_missing_candidate_response": ("candidate_response = ''", None), "invalid_label": ("coalesce(label NOT IN ('hallucinated', 'not_hallucinated'), true)", "label"), "missing_context": ("subset <> 'general' AND context = ''", None),
    "hallucination_spans_not_a_list": ("spans IS NOT NULL AND json_type(spans) <> 'ARRAY'", None), "hallucinated_with_no_spans": ("subset = 'general' AND label = 'hallucinated' AND json_type(spans) = 'ARRAY' AND json_array_length(spans) = 0", None),
    "suspicious_raw_id": ("raw_id IN ('', 'ID')", "raw_id"),
}, "pairs", "example_id"))
def validate_pair_records(t):
    rows = C.expand_all(raw_subsets(t))
    return Q.coded_issues(rows, ["example_id"], Q.pair_rules(*[F.col(c) for c in ("candidate_response", "label", "subset", "context", "spans", "raw_id")]))


@query("VA4 FN13", "WITH r AS (SELECT analysis_id, answer_preview AS t, CASE WHEN category LIKE 'false%' THEN 'test' WHEN category LIKE 'harm%' THEN NULL ELSE 'dev' END AS split, response_id IS NULL AS missing, lower(task_type) AS task, CASE WHEN attempt0_confidence > 0.7 THEN 'good' WHEN attempt0_confidence > 0.4 THEN final_decision END AS quality FROM rag_error_analysis) " + _coded({
    "empty_or_missing_response_text": ("coalesce(t, '') = ''", None), "invalid_split": ("coalesce(split NOT IN ('train', 'test'), true)", "split"), "source_missing": ("missing", None),
    "unexpected_task_type": ("task NOT IN ('Summary', 'Data2txt', 'QA')", "task"), "unexpected_quality": ("quality NOT IN ('good', 'truncated', 'incorrect_refusal')", "quality"),
}, "r", "analysis_id"))
def validate_responses(t):
    """The rules of responses; the given table lacks split and quality, so other columns stand in for them, and a task in lower case is none of the known ones."""
    r = t("rag_error_analysis")
    split = F.when(F.col("category").startswith("false"), "test").when(F.col("category").startswith("harm"), F.lit(None)).otherwise("dev")
    quality = F.when(F.col("attempt0_confidence") > 0.7, "good").when(F.col("attempt0_confidence") > 0.4, F.col("final_decision"))
    rows = r.select("analysis_id", F.col("answer_preview").alias("t"), split.alias("split"), F.col("response_id").isNull().alias("missing"), F.lower("task_type").alias("task"), quality.alias("quality"))
    return Q.coded_issues(rows, ["analysis_id"], Q.response_rules(*[F.col(c) for c in ("t", "split", "missing", "task", "quality")]))


_TARGETS = {"mc0_targets": "query", "mc1_targets": "selected_evidence", "mc2_targets": "verified_candidates"}
_NUM = "json_type(x) IN ('UBIGINT', 'BIGINT', 'DOUBLE', 'BOOLEAN', 'HUGEINT')"


def _target_sql(name: str) -> str:
    vals = f"(CASE WHEN json_valid({name}) AND json_type({name}) = 'OBJECT' THEN json_extract({name}, '$.*') ELSE [] END)"
    number = "CASE WHEN json_type(x) = 'BOOLEAN' THEN CASE WHEN CAST(x AS VARCHAR) = 'true' THEN 1.0 ELSE 0.0 END ELSE TRY_CAST(CAST(x AS VARCHAR) AS DOUBLE) END"
    is_one = lambda wanted: f"coalesce({_NUM} AND {number} IN ({wanted}), false)"
    return " UNION ALL ".join([
        f"SELECT result_id, 'missing_{name}_despite_has_mc_data' AS issue FROM m WHERE {name} IS NULL AND expected", f"SELECT result_id, '{name}_not_a_nonempty_dict' FROM m WHERE {name} IS NOT NULL AND len({vals}) = 0",
        f"SELECT result_id, '{name}_has_non_binary_values' FROM m WHERE len(list_filter({vals}, lambda x: NOT {is_one('0.0, 1.0')})) > 0", f"SELECT result_id, '{name}_has_no_correct_option' FROM m WHERE len({vals}) > 0 AND len(list_filter({vals}, lambda x: {is_one('1.0')})) = 0",
    ])


# Three fields of the payload stand for the three targets; the whole payload as a flat object is the fourth case: most values are no 0 or 1.
@query("VA5", """WITH m AS (SELECT result_id, payload IS NOT NULL AS expected, CASE WHEN json_valid(payload) THEN CAST(json_extract(payload, '$.selected_evidence') AS VARCHAR) END AS mc0_targets, payload AS mc1_targets,
CASE WHEN attempt_number = 0 THEN '{"a": 1, "b": 0}' WHEN attempt_number = 1 THEN '{"a": 0, "b": false}' WHEN attempt_number = 2 THEN '{"a": true, "b": 2}' ELSE '{}' END AS mc2_targets FROM pipeline_results) """ + " UNION ALL ".join(_target_sql(n) for n in _TARGETS))
def validate_mc_targets(t):
    n = F.col("attempt_number")
    own = F.when(n == 0, '{"a": 1, "b": 0}').when(n == 1, '{"a": 0, "b": false}').when(n == 2, '{"a": true, "b": 2}').otherwise("{}")
    first = F.to_json(F.try_variant_get(F.try_parse_json("payload"), "$.selected_evidence", "variant"))
    rows = t("pipeline_results").select("result_id", F.col("payload").isNotNull().alias("expected"), first.alias("mc0_targets"), F.col("payload").alias("mc1_targets"), own.alias("mc2_targets"))
    rules = {}
    for name in _TARGETS:
        rules |= Q.target_rules(name, F.col(name), F.col("expected"))
    return Q.coded_issues(rows, ["result_id"], rules)


_QUESTION = {"empty_or_missing_question": "user_input", "empty_or_missing_category": "model_identifier", "empty_or_missing_best_answer": "generated_text", "empty_correct_answers_list": "system_instruction"}


@query("VA5", " UNION ALL ".join(f"SELECT generation_id, '{code}' AS issue FROM generation_results WHERE coalesce({c}, '') = ''" for code, c in _QUESTION.items()) + " UNION ALL SELECT generation_id, 'unexpected_type:' || coalesce('''' || model_identifier || '''', 'None') FROM generation_results WHERE coalesce(model_identifier NOT IN ('gen/base-4b'), true)")
def validate_questions(t):
    empty = lambda c: F.coalesce(F.col(c) == "", F.lit(True))
    rules = {code: (empty(c), None) for code, c in _QUESTION.items()} | {"unexpected_type": (Q.unknown(F.col("model_identifier"), ("gen/base-4b",)), F.col("model_identifier"))}
    return Q.coded_issues(t("generation_results"), ["generation_id"], rules)


_GROUP = "CASE WHEN source_dataset = 'halueval' THEN concat_ws('.', source_dataset, lower(trim(source_subset, ' '))) ELSE source_dataset END"


@query("PR16", f"SELECT {_GROUP} AS source_group, count(*) AS n FROM verifier_examples GROUP BY 1")
def source_groups(t):
    return t("verifier_examples").groupBy(L.source_group(F.col("source_dataset"), F.col("source_subset")).alias("source_group")).agg(F.count(F.lit(1)).alias("n"))


_SOURCE = "concat_ws('.', source_dataset, lower(trim(source_subset, ' ')))"
_ALLOWED = "('fever.train', 'halueval.qa', 'halueval.dialogue', 'halueval.summarization')"
_POOL = f"""leaked AS (SELECT DISTINCT {norm_sql('hypothesis')} AS norm FROM pool_records WHERE split <> 'train'),
safe AS (SELECT p.*, {_SOURCE} AS source FROM pool_records p WHERE split = 'train' AND {_SOURCE} IN {_ALLOWED} AND {norm_sql('hypothesis')} NOT IN (SELECT norm FROM leaked))"""


def _safe(t):
    """The training rows of the allowed sources among those that the table names, without contaminated ones; the plan fails on an unsafe row."""
    p = t("pool_records")
    norm = T.normalize_text(F.col("hypothesis"))
    blocked = p.filter("split <> 'train'").select(norm.alias("norm")).distinct().withColumn("contaminated", F.lit(True))
    rows = p.filter("split = 'train'").withColumn("norm", norm).join(blocked, "norm", "left").withColumn("contaminated", F.coalesce("contaminated", F.lit(False)))
    present = p.select("source_dataset", F.lower(F.trim("source_subset")).alias("s")).distinct().filter(L.allowed_source(F.col("source_dataset"), F.col("s"))).collect()  # four allowed sources at most
    return L.training_pool(rows, [(r["source_dataset"], r["s"]) for r in present], F.col("contaminated"), F.col("record_id"))


@query("PR9 PR12 VA13", f"WITH {_POOL} SELECT source, count(*) AS n FROM safe GROUP BY source")
def safe_training_pool(t):
    return _safe(t).groupBy(F.concat_ws(".", "source_dataset", F.lower(F.trim("source_subset"))).alias("source")).agg(F.count(F.lit(1)).alias("n"))


@query("PR15", f"WITH {_POOL} SELECT record_id, {label_sql('label')} AS clean_label FROM safe WHERE {label_sql('label')} IN ('entailment', 'contradiction')")
def binary_training_pool(t):
    rows = _safe(t).withColumn("clean_label", T.clean_label(F.col("label")))
    kept = rows.filter(F.col("clean_label").isin(*L.TRAINED_LABELS))
    return L.guarded(kept, {"label outside the binary space": ~F.col("clean_label").isin(*L.TRAINED_LABELS)}, F.col("record_id")).select("record_id", "clean_label")


@query("PR9 VA13", f"SELECT {_SOURCE} AS source, split, count(*) AS n, {_SOURCE} IN {_ALLOWED} AS allowed FROM pool_records GROUP BY 1, 2")
def role_boundary(t):
    """What each source of the table may be used for; a pool of sources that may not be trained on is refused before planning."""
    source = F.concat_ws(".", "source_dataset", F.lower(F.trim("source_subset")))
    per = t("pool_records").groupBy("source_dataset", F.lower(F.trim("source_subset")).alias("s"), "split").agg(F.count(F.lit(1)).alias("n"), F.first(source).alias("source"))
    return per.select("source", "split", "n", L.allowed_source(F.col("source_dataset"), F.col("s")).alias("allowed"))


@query("AG3", "SELECT coalesce(group_key.id, '') AS g, min(CASE WHEN split = 'train' THEN 'train' ELSE 'held out' END) AS part FROM (SELECT *, count(DISTINCT CASE WHEN split = 'train' THEN 'train' ELSE 'held out' END) OVER (PARTITION BY coalesce(group_key.id, '')) AS n FROM pool_records) WHERE n = 1 GROUP BY 1")
def leak_free_groups(t):
    """The groups that stand on one side only, passed through the check that fails on any other."""
    part = F.when(F.col("split") == "train", "train").otherwise("held out")
    rows = t("pool_records").select(F.coalesce("group_key.id", F.lit("")).alias("g"), part.alias("part"))
    torn = rows.groupBy("g").agg(F.count_distinct("part").alias("n")).filter("n > 1").select("g")
    return L.one_split_each(rows.join(torn, "g", "left_anti"), "g", "part")
