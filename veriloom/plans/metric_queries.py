"""Detection, classification, rates, latencies, breakdowns and error analysis."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics as M
from ..operators import shape as S
from .decision_queries import EV, evidence
from .registry import query

KNOWN = "gold_has_hallucination IS NOT NULL AND attempt0_mapped_decision IS NOT NULL AND final_decision IS NOT NULL"
CONF = "SELECT {keys}, count(CASE WHEN gold AND flagged THEN 1 END) AS tp, count(CASE WHEN NOT gold AND flagged THEN 1 END) AS fp, count(CASE WHEN gold AND NOT flagged THEN 1 END) AS fn, count(CASE WHEN NOT gold AND NOT flagged THEN 1 END) AS tn FROM stages GROUP BY {keys}"


def stages_sql(by: str = "task_type") -> str:
    """Both stages of each response: its group, the truth and whether it was flagged."""
    return f"stages AS (SELECT 'first' AS stage, {by}, gold_has_hallucination AS gold, attempt0_mapped_decision <> 'ACCEPT' AS flagged FROM rag_error_analysis WHERE {KNOWN} UNION ALL SELECT 'final', {by}, gold_has_hallucination, final_decision <> 'ACCEPT' FROM rag_error_analysis WHERE {KNOWN})"


STAGES = stages_sql()
DETECT = """round((tp + tn) / nullif(CAST(tp + fp + fn + tn AS DOUBLE), 0), 6) AS accuracy, round(a, 6) AS f1, round(b, 6) AS f1_other, round((a + b) / 2, 6) AS macro_f1
FROM (SELECT *, CASE WHEN p1 IS NULL OR r1 IS NULL THEN NULL WHEN p1 + r1 = 0 THEN 0 ELSE 2 * p1 * r1 / (p1 + r1) END AS a, CASE WHEN p2 IS NULL OR r2 IS NULL THEN NULL WHEN p2 + r2 = 0 THEN 0 ELSE 2 * p2 * r2 / (p2 + r2) END AS b
FROM (SELECT *, tp / nullif(CAST(tp + fp AS DOUBLE), 0) AS p1, tp / nullif(CAST(tp + fn AS DOUBLE), 0) AS r1, tn / nullif(CAST(tn + fn AS DOUBLE), 0) AS p2, tn / nullif(CAST(tn + fp AS DOUBLE), 0) AS r2 FROM c))"""


def known(t):
    return t("rag_error_analysis").filter(KNOWN)


def stages(t, by: str = "task_type"):
    both = F.array(F.struct(F.lit("first").alias("stage"), (F.col("attempt0_mapped_decision") != "ACCEPT").alias("flagged")), F.struct(F.lit("final").alias("stage"), (F.col("final_decision") != "ACCEPT").alias("flagged")))
    return known(t).select(by, F.col("gold_has_hallucination").alias("gold"), F.inline(both))


@query("AG19 AG20 PR21", f"WITH {STAGES}, c AS ({CONF.format(keys='stage')}) SELECT stage, tp, fp, fn, tn, {DETECT}")
def detection_metrics(t):
    return M.detection(stages(t).groupBy("stage").agg(*M.confusion(F.col("gold"), F.col("flagged"))))


@query("AG45", f"WITH {STAGES}, c AS ({CONF.format(keys='stage, task_type')}) SELECT stage, task_type, tp, fp, fn, tn, CASE WHEN tp + fp + fn + tn < 30 THEN 'small sample' END AS note, {DETECT}")
def breakdown_by_key(t):
    per = stages(t).groupBy("stage", "task_type").agg(*M.confusion(F.col("gold"), F.col("flagged")))
    return M.detection(per.withColumn("note", F.when(F.expr("tp + fp + fn + tn") < 30, "small sample")))


def _report_sql(keys: str) -> str:
    k, on = (f"{keys}, ", f"AND x.{keys} IS NOT DISTINCT FROM s.{keys} ") if keys else ("", "")
    return f"""WITH d AS (SELECT task_type, attempt0_mapped_decision AS t, final_decision AS p FROM rag_error_analysis WHERE {KNOWN}),
labels AS (SELECT {k}t AS label FROM d UNION SELECT {k}p FROM d),
n AS (SELECT {k}label, count(CASE WHEN t = label THEN 1 END) AS support, count(CASE WHEN p = label THEN 1 END) AS n_predicted, count(CASE WHEN t = label AND p = label THEN 1 END) AS n_correct FROM (SELECT s.*, d.t, d.p FROM labels s JOIN d ON {f's.{keys} IS NOT DISTINCT FROM d.{keys}' if keys else 'true'}) GROUP BY {k}label)
SELECT {k}label, support, n_predicted, n_correct, round(coalesce(n_correct / nullif(CAST(n_predicted AS DOUBLE), 0), 0), 6) AS precision, round(coalesce(n_correct / nullif(CAST(support AS DOUBLE), 0), 0), 6) AS recall, round(coalesce(2 * n_correct / nullif(CAST(n_predicted + support AS DOUBLE), 0), 0), 6) AS f1 FROM n"""


@query("AG21", _report_sql(""))
def classification_report(t):
    return M.report(known(t), "attempt0_mapped_decision", "final_decision")


@query("AG22", _report_sql("task_type"))
def metrics_by_group(t):
    return M.report(known(t), "attempt0_mapped_decision", "final_decision", ["task_type"])


_CORRECTED = "termination_reason = 'max_attempts_reached' OR attempt0_mapped_decision <> final_decision"
_SHARES = {
    "first_accept": "attempt0_mapped_decision = 'ACCEPT'", "first_correct": "attempt0_mapped_decision = 'CORRECT'", "first_abstain": "attempt0_mapped_decision = 'ABSTAIN'", "final_accept": "final_decision = 'ACCEPT'",
    "final_abstain": "final_decision = 'ABSTAIN'", "corrected": _CORRECTED, "max_attempts": "termination_reason = 'max_attempts_reached'", "no_evidence": "attempt0_num_evidence = 0",
}


@query("AG23 AG48", "SELECT count(*) AS n, " + ", ".join(f"round(avg(CASE WHEN {w} THEN 1.0 ELSE 0.0 END), 6) AS {n}" for n, w in _SHARES.items()) + f", round(avg(attempt0_num_evidence), 6) AS mean_evidence FROM rag_error_analysis WHERE {KNOWN}")
def decision_rates(t):
    return known(t).agg(F.count(F.lit(1)).alias("n"), *[F.round(F.avg(F.when(F.expr(w), 1.0).otherwise(0.0)), 6).alias(n) for n, w in _SHARES.items()], F.round(F.avg("attempt0_num_evidence"), 6).alias("mean_evidence"))


_OUTCOMES = ["false_alarm", "missed", "right_accept", "right_flag"]
_OUTCOME = "CASE WHEN attempt0_mapped_decision = 'ACCEPT' AND gold_has_hallucination THEN 'missed' WHEN attempt0_mapped_decision = 'ACCEPT' THEN 'right_accept' WHEN attempt0_mapped_decision = 'CORRECT' AND gold_has_hallucination THEN 'right_flag' WHEN attempt0_mapped_decision = 'CORRECT' THEN 'false_alarm' END"


@query("AG24", f"""
WITH d AS (SELECT {_OUTCOME} AS outcome, attempt0_confidence AS c FROM rag_error_analysis WHERE {KNOWN})
SELECT g.outcome, count(d.c) AS n, round(avg(d.c), 6) AS mean, round(median(d.c), 6) AS median FROM (VALUES {", ".join(f"('{x}')" for x in _OUTCOMES)}) g(outcome) LEFT JOIN d ON g.outcome = d.outcome GROUP BY g.outcome""")
def confidence_by_outcome(t):
    rows = known(t).select(F.expr(_OUTCOME).alias("outcome"), F.col("attempt0_confidence").alias("c")).filter("outcome IS NOT NULL")
    per = rows.groupBy("outcome").agg(F.count("c").alias("n"), F.round(F.avg("c"), 6).alias("mean"))
    md = S.medians(rows, ["outcome"], "c")
    grid = rows.sparkSession.createDataFrame([(x,) for x in _OUTCOMES], "outcome string")
    return S.dense(per, "outcome", grid).join(md, "outcome", "left").select("outcome", F.coalesce("n", F.lit(0)).cast("long").alias("n"), "mean", F.round("median", 6).alias("median"))


@query("AG25", f"""
WITH {EV}, s AS (SELECT a.run_id, a.attempt_number, a.attempt_id, list_sort(list_distinct(list(coalesce(ev.corpus_id, '')))) AS ids FROM attempt_records a JOIN ev USING (attempt_id) GROUP BY ALL),
f AS (SELECT run_id, attempt_number, arg_min(ids, attempt_id) AS ids FROM s GROUP BY ALL)
SELECT count(*) AS n_pairs, count(CASE WHEN a.ids <> b.ids THEN 1 END) AS n_changed, round(count(CASE WHEN a.ids <> b.ids THEN 1 END) / nullif(CAST(count(*) AS DOUBLE), 0), 6) AS rate FROM f a JOIN f b ON a.run_id = b.run_id AND b.attempt_number = a.attempt_number + 1""")
def evidence_movement(t):
    ids = evidence(t).groupBy("attempt_id").agg(F.array_sort(F.collect_set(F.coalesce("corpus_id", F.lit("")))).alias("ids"))
    own = t("attempt_records").select("attempt_id", "run_id", "attempt_number").join(ids, "attempt_id")
    f = own.groupBy("run_id", "attempt_number").agg(F.min_by("ids", "attempt_id").alias("ids"))
    nxt = f.select("run_id", (F.col("attempt_number") - 1).alias("attempt_number"), F.col("ids").alias("later"))
    changed = F.col("ids") != F.col("later")
    return f.join(nxt, ["run_id", "attempt_number"]).agg(F.count(F.lit(1)).alias("n_pairs"), F.count_if(changed).alias("n_changed"), F.round(S.ratio(F.count_if(changed), F.count(F.lit(1))), 6).alias("rate"))


@query("AG26 AG27 AG28", f"""
WITH {EV}, c AS (SELECT attempt_id, pos, ln(ent) AS ll, orank <= 5 AS good FROM ev WHERE ent > 0 AND orank IS NOT NULL), m AS (SELECT *, exp(ll - max(ll) OVER (PARTITION BY attempt_id)) AS w FROM c),
s AS (SELECT attempt_id, arg_max(good, {{'l': ll, 'p': -pos}}) AS best, sum(CASE WHEN good THEN w ELSE 0 END) / sum(w) AS mass FROM m GROUP BY attempt_id)
SELECT count(*) AS n, round(avg(CASE WHEN best THEN 1.0 ELSE 0.0 END), 6) AS top_right, round(avg(mass), 6) AS mean_mass FROM s""")
def mc_scores(t):
    c = evidence(t).filter("entailment_probability > 0 AND original_rank IS NOT NULL").select("attempt_id", "pos", F.ln("entailment_probability").alias("ll"), (F.col("original_rank") <= 5).alias("good"))
    return M.choice_scores(c, "attempt_id", "ll", "pos", "good").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.when(F.col("best_right"), 1.0).otherwise(0.0)), 6).alias("top_right"), F.round(F.avg("mass"), 6).alias("mean_mass"))


@query("AG33", """
WITH o AS (SELECT model_identifier, latency_seconds AS x, row_number() OVER (PARTITION BY model_identifier ORDER BY latency_seconds) - 1 AS i, count(*) OVER (PARTITION BY model_identifier) AS n FROM generation_results WHERE latency_seconds IS NOT NULL)
SELECT model_identifier, count(*) AS n, round(avg(x), 6) AS mean, round(median(x), 6) AS median, round(min(CASE WHEN i = n // 2 THEN x END), 6) AS p50, round(min(CASE WHEN i = CAST(floor(n * 0.95) AS BIGINT) THEN x END), 6) AS p95, round(min(x), 6) AS low, round(max(x), 6) AS high, round(sum(x), 4) AS total FROM o GROUP BY model_identifier""")
def latency_stats(t):
    g = t("generation_results").filter("latency_seconds IS NOT NULL").select("model_identifier", F.col("latency_seconds").alias("x"))
    r = lambda c, name, d=6: F.round(c, d).alias(name)
    one = g.groupBy("model_identifier").agg(F.count(F.lit(1)).alias("n"), r(F.avg("x"), "mean"), r(F.min("x"), "low"), r(F.max("x"), "high"), r(F.sum("x"), "total", 4)).withColumn("_m", F.col("model_identifier"))
    q = S.index_percentiles(g, ["model_identifier"], "x", {"p50": 0.5, "p95": 0.95}).withColumnRenamed("model_identifier", "_k")
    md = S.medians(g, ["model_identifier"], "x").withColumnRenamed("model_identifier", "_l")
    both = one.join(q, F.col("_m").eqNullSafe(F.col("_k"))).join(md, F.col("_m").eqNullSafe(F.col("_l")))
    return both.select("model_identifier", "n", "mean", r("median", "median"), r("p50", "p50"), r("p95", "p95"), "low", "high", "total")


_CATEGORY = f"""CASE WHEN final_decision <> 'ACCEPT' AND gold_has_hallucination THEN 'still_flagged' WHEN final_decision <> 'ACCEPT' THEN 'degraded' WHEN gold_has_hallucination AND ({_CORRECTED}) THEN 'fixed' WHEN gold_has_hallucination THEN 'missed' ELSE 'preserved' END"""


@query("PR22 PR23 AG47", f"SELECT {_CATEGORY} AS outcome, count(*) AS n, count(CASE WHEN NOT gold_has_hallucination AND ({_CORRECTED}) THEN 1 END) AS n_unnecessary FROM rag_error_analysis WHERE {KNOWN} GROUP BY 1")
def correction_outcomes(t):
    return known(t).groupBy(F.expr(_CATEGORY).alias("outcome")).agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("gold_has_hallucination") & F.expr(_CORRECTED)).alias("n_unnecessary"))


@query("WN7", "SELECT category, response_id, analysis_id, CAST(r AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY coalesce(attempt0_confidence, 0) DESC, analysis_id) AS r FROM rag_error_analysis) WHERE r <= 10")
def error_analysis_topn(t):
    return S.top_n(t("rag_error_analysis"), ["category"], [F.coalesce("attempt0_confidence", F.lit(0.0)).desc(), F.col("analysis_id")], 10, "place").select("category", "response_id", "analysis_id", "place")


@query("JN13 AG53", """
WITH d AS (SELECT run_id, attempt_number, min(attempt_id) AS a, max(attempt_id) AS b FROM attempt_records GROUP BY ALL HAVING count(*) > 1)
SELECT count(*) AS n_pairs, count(CASE WHEN x.step16_decision IS NOT DISTINCT FROM y.step16_decision AND x.candidate_answer IS NOT DISTINCT FROM y.candidate_answer THEN 1 END) AS n_same FROM d JOIN attempt_records x ON x.attempt_id = d.a JOIN attempt_records y ON y.attempt_id = d.b""")
def cross_run_match(t):
    a = t("attempt_records")
    v = F.struct("step16_decision", "candidate_answer")
    d = a.groupBy("run_id", "attempt_number").agg(F.count(F.lit(1)).alias("n"), F.min_by(v, "attempt_id").alias("x"), F.max_by(v, "attempt_id").alias("y")).filter("n > 1")
    return d.agg(F.count(F.lit(1)).alias("n_pairs"), F.count_if(F.col("x").eqNullSafe(F.col("y"))).alias("n_same"))


@query("AG50", f"""
SELECT model, count(*) AS n, round(avg(CASE WHEN gold_has_hallucination THEN 1.0 ELSE 0.0 END), 6) AS prevalence, round(1 - avg(CASE WHEN gold_has_hallucination THEN 1.0 ELSE 0.0 END), 6) AS majority_accuracy,
round(avg(CASE WHEN (attempt0_mapped_decision <> 'ACCEPT') = gold_has_hallucination THEN 1.0 ELSE 0.0 END), 6) AS first_accuracy, round(avg(CASE WHEN (final_decision <> 'ACCEPT') = gold_has_hallucination THEN 1.0 ELSE 0.0 END), 6) AS final_accuracy FROM rag_error_analysis WHERE {KNOWN} GROUP BY model""")
def final_summary(t):
    gold = F.col("gold_has_hallucination")
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    return known(t).groupBy("model").agg(
        F.count(F.lit(1)).alias("n"), F.round(share(gold), 6).alias("prevalence"), F.round(1 - share(gold), 6).alias("majority_accuracy"),
        F.round(share((F.col("attempt0_mapped_decision") != "ACCEPT") == gold), 6).alias("first_accuracy"), F.round(share((F.col("final_decision") != "ACCEPT") == gold), 6).alias("final_accuracy"),
    )
