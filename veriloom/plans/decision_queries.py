"""Selecting evidence, deciding, and how decisions change with thresholds. Candidates are the evidence items of the attempts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import decide as D
from ..operators import shape as S
from .registry import query
from .retrieval_queries import RERANKED, reranked

ITEMS = """items AS (SELECT attempt_id, e, i - 1 AS pos FROM (SELECT attempt_id, evidence[i] AS e, i FROM (SELECT attempt_id, evidence, unnest(range(1, len(evidence) + 1)) AS i FROM attempt_records)))"""
EV = f"""{ITEMS}, ev AS (SELECT attempt_id, pos, e.corpus_id AS corpus_id, e.page_id AS page_id, e.entailment_probability AS ent, e.contradiction_probability AS con, e.original_rank AS orank, e.reranked_rank AS rrank
FROM items WHERE e.entailment_probability IS NOT NULL AND e.contradiction_probability IS NOT NULL)"""
AGG = f"""{EV}, agg AS (SELECT attempt_id, max(ent) AS max_ent, list_sort(list(ent), 'DESC')[2] AS second_ent, max(con) AS max_con, count(*) AS num FROM ev GROUP BY attempt_id)"""
P_ENT = "1 / (1 + exp(-(CASE WHEN (q // 20) % 3 <> 0 THEN 1 ELSE -1 END * 6 * (score - 0.25) + (((c * 31 + q * 17) % 100) / CAST(100 AS DOUBLE) - 0.5) * 2)))"


def items(t):
    rows = t("attempt_records").select("attempt_id", F.posexplode("evidence").alias("pos", "e")).filter("e IS NOT NULL")
    return rows.select("attempt_id", F.col("pos").cast("long").alias("pos"), "e.corpus_id", "e.page_id", "e.entailment_probability", "e.contradiction_probability", "e.original_rank", "e.reranked_rank")


def evidence(t):
    return items(t).filter("entailment_probability IS NOT NULL AND contradiction_probability IS NOT NULL")


def aggregates(t, policy: D.Policy = D.Policy()):
    return D.query_aggregates(evidence(t), ["attempt_id"], policy)


@query("PR18", f"WITH {ITEMS} SELECT count(*) AS n, count(CASE WHEN e.entailment_probability IS NULL OR isnan(e.entailment_probability) OR isinf(e.entailment_probability) THEN 1 END) AS n_ent, count(CASE WHEN e.contradiction_probability IS NULL OR isnan(e.contradiction_probability) OR isinf(e.contradiction_probability) THEN 1 END) AS n_con FROM items WHERE e IS NOT NULL")
def nonfinite_guard(t):
    return items(t).agg(F.count(F.lit(1)).alias("n"), F.count_if(D.not_finite(F.col("entailment_probability"))).alias("n_ent"), F.count_if(D.not_finite(F.col("contradiction_probability"))).alias("n_con"))


@query("WN4", f"WITH {EV} SELECT attempt_id, arg_max(pos, {{'p': ent, 'r': -pos}}) AS selected FROM ev GROUP BY attempt_id")
def select_evidence(t):
    return D.select_evidence(evidence(t), ["attempt_id"], "entailment_probability", "pos", F.col("pos"))


@query("WN5", f"WITH {AGG} SELECT attempt_id, round(max_ent, 9) AS max_ent, round(second_ent, 9) AS second_ent, round(max_ent - second_ent, 9) AS margin, round(max_con, 9) AS max_con, num AS num_candidates FROM agg")
def query_aggregates(t):
    r = lambda c: F.round(c, 9).alias(c)
    return aggregates(t).select("attempt_id", r("max_ent"), r("second_ent"), r("margin"), r("max_con"), "num_candidates")


def _decision_sql(ent: str, con: str, t_ent: str, t_con: str, margin: str = "true") -> str:
    return f"CASE WHEN {ent} >= {t_ent} AND {margin} THEN 'SUPPORTED' WHEN {con} >= {t_con} THEN 'CONTRADICTED' ELSE 'ABSTAIN' END"


@query("IT4 IT5 PR19", f"""
WITH {AGG} SELECT attempt_id, {_decision_sql('max_ent', 'max_con', '0.6', '0.6')} AS decision, {_decision_sql('max_ent', 'max_con', '0.6', '0.6', 'coalesce(max_ent - second_ent >= 0.1, false)')} AS strict_decision FROM agg""")
def decision_policy(t):
    loose, strict = D.Policy(0.6, 0.6), D.Policy(0.6, 0.6, 0.1)
    return D.decide(aggregates(t, loose), loose).withColumn("strict_decision", D.decision(strict, F.col("max_ent"), F.col("max_con"), F.col("margin"))).select("attempt_id", "decision", "strict_decision")


def verified(t):
    """The best five reranked candidates with stand-in probabilities of a verifier."""
    return reranked(t, 5).withColumn("entailment_probability", F.expr(P_ENT.replace("//", "div"))).withColumn("contradiction_probability", 1 - F.col("entailment_probability"))


VERIFIED = f"""{RERANKED}, verified AS (SELECT *, 1 - ent AS con FROM (SELECT *, {P_ENT} AS ent FROM reranked WHERE reranked_rank <= 5)),
decided AS (SELECT q, arg_max(c, {{'p': ent, 'r': -reranked_rank}}) AS best, max(ent) AS max_ent, max(con) AS max_con FROM verified GROUP BY q)"""


@query("WN4", f"WITH {VERIFIED} SELECT q, best, round(max_ent, 6) AS max_ent, {_decision_sql('max_ent', 'max_con', '0.7', '0.7')} AS decision FROM decided")
def verify_pipeline(t):
    policy = D.Policy(0.7, 0.7)
    v = verified(t)
    agg = D.decide(D.query_aggregates(v, ["q"], policy), policy)
    best = D.select_evidence(v, ["q"], "entailment_probability", "reranked_rank", F.col("c")).withColumnRenamed("selected", "best")
    return agg.join(best, "q").select("q", "best", F.round("max_ent", 6).alias("max_ent"), "decision")


THRESHOLDS = [0.5, 0.6, 0.7, 0.8, 0.9, 0.95]
GRID = "(VALUES " + ", ".join(f"(CAST({x} AS DOUBLE))" for x in THRESHOLDS) + ") g(threshold)"


def at_thresholds(df):
    """Each row at each of the six thresholds."""
    return df.withColumn("threshold", F.explode(F.array(*[F.lit(x) for x in THRESHOLDS])))


_RATES = "round(tp / nullif(CAST(tp + fp AS DOUBLE), 0), 6) AS precision, round(tp / nullif(CAST(tp + fn AS DOUBLE), 0), 6) AS recall, round(fp / nullif(CAST(fp + tn AS DOUBLE), 0), 6) AS fpr, round(fn / nullif(CAST(tp + fn AS DOUBLE), 0), 6) AS fnr"


@query("AG34", f"""
WITH {EV}, s AS (SELECT attempt_id, max(ent) AS p FROM ev GROUP BY attempt_id), m AS (SELECT a.attempt_id, s.p, a.step16_decision = 'SUPPORTED' AS pos FROM attempt_records a JOIN s USING (attempt_id) WHERE a.step16_decision IS NOT NULL),
n AS (SELECT threshold, count(CASE WHEN pos AND p >= threshold THEN 1 END) AS tp, count(CASE WHEN NOT pos AND p >= threshold THEN 1 END) AS fp, count(CASE WHEN pos AND p < threshold THEN 1 END) AS fn, count(CASE WHEN NOT pos AND p < threshold THEN 1 END) AS tn FROM m, {GRID} GROUP BY threshold)
SELECT threshold, tp, fp, fn, tn, {_RATES} FROM n""")
def threshold_sweep(t):
    from ..operators import metrics as M

    best = evidence(t).groupBy("attempt_id").agg(F.max("entailment_probability").alias("p"))
    rows = t("attempt_records").filter("step16_decision IS NOT NULL").select("attempt_id", (F.col("step16_decision") == "SUPPORTED").alias("pos")).join(best, "attempt_id")
    n = at_thresholds(rows).groupBy("threshold").agg(*M.confusion(F.col("pos"), F.col("p") >= F.col("threshold")))
    return M.binary_rates(n).select("threshold", "tp", "fp", "fn", "tn", "precision", "recall", "fpr", "fnr")


@query("AG35", f"""
WITH {VERIFIED} SELECT threshold, count(*) AS n, round(count(CASE WHEN max_ent >= threshold THEN 1 END) / CAST(count(*) AS DOUBLE), 6) AS coverage,
round(count(CASE WHEN max_ent >= threshold AND gold THEN 1 END) / nullif(CAST(count(CASE WHEN max_ent >= threshold THEN 1 END) AS DOUBLE), 0), 6) AS precision FROM (SELECT d.*, r.gold FROM decided d JOIN reranked r ON d.q = r.q AND d.best = r.c), {GRID} GROUP BY threshold""")
def selective_coverage(t):
    v = verified(t)
    best = v.groupBy("q").agg(F.max("entailment_probability").alias("p"), F.max_by("gold", F.struct("entailment_probability", -F.col("reranked_rank"))).alias("gold"))
    taken = F.col("p") >= F.col("threshold")
    n = at_thresholds(best).groupBy("threshold").agg(F.count(F.lit(1)).alias("n"), F.count_if(taken).alias("k"), F.count_if(taken & F.col("gold")).alias("g"))
    return n.select("threshold", "n", F.round(S.ratio(F.col("k"), F.col("n")), 6).alias("coverage"), F.round(S.ratio(F.col("g"), F.col("k")), 6).alias("precision"))


@query("AG36", f"WITH {AGG} SELECT threshold, {_decision_sql('max_ent', 'max_con', 'threshold', 'threshold')} AS decision, count(*) AS n FROM agg, {GRID} GROUP BY 1, 2")
def policy_sweep(t):
    ent, con, x = F.col("max_ent"), F.col("max_con"), F.col("threshold")
    d = F.when(ent >= x, "SUPPORTED").when(con >= x, "CONTRADICTED").otherwise("ABSTAIN")
    return at_thresholds(aggregates(t)).groupBy("threshold", d.alias("decision")).agg(F.count(F.lit(1)).alias("n"))


@query("AG37", f"""
WITH {AGG}, m AS (SELECT attempt_id, max_ent - second_ent AS margin, max_ent FROM agg WHERE second_ent IS NOT NULL), md AS (SELECT median(margin) AS x FROM m)
SELECT CASE WHEN margin >= x THEN 'high' ELSE 'low' END AS half, count(*) AS n, round(avg(max_ent), 6) AS mean_ent FROM m, md GROUP BY 1""")
def margin_split(t):
    m = aggregates(t).filter("margin IS NOT NULL").select("attempt_id", "margin", "max_ent")
    md = S.medians(m, [], "margin").withColumnRenamed("median", "x")
    return m.join(F.broadcast(md)).groupBy(F.when(F.col("margin") >= F.col("x"), "high").otherwise("low").alias("half")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("max_ent"), 6).alias("mean_ent"))


@query("AG32", f"""
WITH {EV}, o AS (SELECT ent, row_number() OVER (ORDER BY ent) - 1 AS i, count(*) OVER () AS n FROM ev)
SELECT count(*) AS n, round(avg(ent), 6) AS mean, round(median(ent), 6) AS median, round(coalesce(stddev_samp(ent), 0), 6) AS stdev, round(min(CASE WHEN i = CAST(floor(n * 0.1) AS BIGINT) THEN ent END), 6) AS p10, round(min(CASE WHEN i = CAST(floor(n * 0.9) AS BIGINT) THEN ent END), 6) AS p90,
round(min(ent), 6) AS low, round(max(ent), 6) AS high, round(avg(CASE WHEN ent >= 0.5 THEN 1.0 ELSE 0.0 END), 6) AS share_above FROM o""")
def score_distribution(t):
    e, p = evidence(t), F.col("entailment_probability")
    r = lambda c, name: F.round(c, 6).alias(name)
    one = e.agg(F.count(F.lit(1)).alias("n"), r(F.avg(p), "mean"), r(F.coalesce(F.stddev_samp(p), F.lit(0.0)), "stdev"), r(F.min(p), "low"), r(F.max(p), "high"), r(F.avg(F.when(p >= 0.5, 1.0).otherwise(0.0)), "share_above"))
    q = S.index_percentiles(e, [], "entailment_probability", {"p10": 0.1, "p90": 0.9})
    md = S.medians(e, [], "entailment_probability")
    return one.join(F.broadcast(q)).join(F.broadcast(md)).select("n", "mean", F.round("median", 6).alias("median"), "stdev", F.round("p10", 6).alias("p10"), F.round("p90", 6).alias("p90"), "low", "high", "share_above")


POINTS = """points AS (SELECT attempt0_confidence AS conf, CASE WHEN (attempt0_mapped_decision = 'ACCEPT') = (NOT gold_has_hallucination) THEN 1 ELSE 0 END AS ok FROM rag_error_analysis WHERE attempt0_confidence IS NOT NULL AND attempt0_mapped_decision IS NOT NULL AND gold_has_hallucination IS NOT NULL)"""


def points(t):
    rows = t("rag_error_analysis").filter("attempt0_confidence IS NOT NULL AND attempt0_mapped_decision IS NOT NULL AND gold_has_hallucination IS NOT NULL")
    return rows.select(F.col("attempt0_confidence").alias("conf"), ((F.col("attempt0_mapped_decision") == "ACCEPT") == ~F.col("gold_has_hallucination")).cast("int").alias("ok"))


@query("AG38 AG41", f"""
WITH {POINTS}, b AS (SELECT CAST(least(floor(conf * 10), 9) AS BIGINT) AS bin, count(*) AS n, avg(ok) AS acc, avg(conf) AS mean_conf FROM points GROUP BY 1)
SELECT g.bin AS bin, coalesce(n, 0) AS n, round(acc, 6) AS accuracy, round(mean_conf, 6) AS mean_confidence, round(coalesce(n, 0) / CAST((SELECT count(*) FROM points) AS DOUBLE), 6) AS fraction FROM (SELECT unnest(range(0, 10)) AS bin) g LEFT JOIN b ON g.bin = b.bin""")
def reliability_bins(t):
    from ..operators import metrics as M

    return M.reliability(points(t), "conf", "ok")


@query("AG39 AG40 AG42 AG43", f"""
WITH {POINTS}, b AS (SELECT least(floor(conf * 10), 9) AS bin, count(*) AS n, avg(ok) AS acc, avg(conf) AS c FROM points GROUP BY 1), t AS (SELECT sum(n) AS n FROM b)
SELECT CAST((SELECT n FROM t) AS BIGINT) AS n, round(sum(b.n / CAST((SELECT n FROM t) AS DOUBLE) * abs(acc - c)), 6) AS ece, (SELECT round(avg(pow(conf - ok, 2)), 6) FROM points) AS brier,
CASE WHEN sum(CASE WHEN c > acc THEN b.n ELSE 0 END) / CAST((SELECT n FROM t) AS DOUBLE) > 0.5 THEN 'overconfident' ELSE 'not_overconfident' END AS verdict FROM b""")
def ece_brier(t):
    from ..operators import metrics as M

    return M.calibration(points(t), "conf", "ok")
