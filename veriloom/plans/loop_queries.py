"""The correction loop, its conditions and its evidence modes. A new answer moves the question's vector half-way to its best candidate's."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import decide as D
from ..operators import loop as L
from ..operators import retrieval as R
from .decision_queries import P_ENT, _decision_sql
from .registry import query
from .retrieval_queries import RERANKED, RSCORE, reranked

POLICY = D.Policy(0.7, 0.7)
FACTS = "(SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)"


def _probabilities(df):
    return df.withColumn("entailment_probability", F.expr(P_ENT.replace("//", "div"))).withColumn("contradiction_probability", 1 - F.col("entailment_probability"))


def _loop(t, corrections: int):
    e = t("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector"))

    def verify(live):
        top = R.top_k(e, live.select(F.col("q").alias("id"), "vector"), 20)
        return _probabilities(R.rerank(top, F.expr(RSCORE), 5))

    def regenerate(live, found):
        best = D.select_evidence(found, ["q"], "entailment_probability", "reranked_rank", F.col("c"))
        moved = live.join(best, "q").join(e.select(F.col("id").alias("selected"), F.col("vector").alias("to")), "selected")
        return moved.select("q", F.zip_with("vector", "to", lambda a, b: (a + b) / 2).alias("vector"))

    return L.run_loop(e.filter("id % 20 = 0").select(F.col("id").alias("q"), "vector"), verify, regenerate, POLICY, corrections)


def _loop_sql(corrections: int) -> str:
    ctes = [f"v AS {FACTS}", "live0 AS (SELECT vec_id AS q, e FROM v WHERE vec_id % 20 = 0)"]
    ends = []
    for k in range(corrections + 1):
        ctes += [
            f"cand{k} AS (SELECT * FROM (SELECT l.q, c.vec_id AS c, list_inner_product(l.e, c.e) AS score, row_number() OVER (PARTITION BY l.q ORDER BY list_inner_product(l.e, c.e) DESC, c.vec_id) AS rank FROM live{k} l JOIN v c ON l.q <> c.vec_id) WHERE rank <= 20)",
            f"re{k} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY {RSCORE} DESC, rank) AS rr FROM cand{k}) WHERE rr <= 5)",
            f"ver{k} AS (SELECT *, {P_ENT} AS ent FROM re{k})",
            f"dec{k} AS (SELECT q, arg_max(c, {{'p': ent, 'r': -rr}}) AS best, {_decision_sql('max(ent)', 'max(1 - ent)', '0.7', '0.7')} AS decision FROM ver{k} GROUP BY q)",
        ]
        end = "" if k == corrections else " WHERE decision <> 'CONTRADICTED'"
        ends.append(f"SELECT q, CASE WHEN decision = 'SUPPORTED' THEN 'ACCEPT' ELSE 'ABSTAIN' END AS final_decision, CASE decision WHEN 'SUPPORTED' THEN 'accepted' WHEN 'ABSTAIN' THEN 'policy_abstained' ELSE 'max_attempts_reached' END AS termination_reason, {'true' if k else 'false'} OR decision = 'CONTRADICTED' AS correction_occurred, CAST({k} AS INTEGER) AS n_regenerations, CAST({k + 1} AS INTEGER) AS attempts FROM dec{k}{end}")
        if k < corrections:
            ctes.append(f"live{k + 1} AS (SELECT l.q, list_transform(list_zip(l.e, b.e), lambda z: (z[1] + z[2]) / 2) AS e FROM live{k} l JOIN dec{k} d ON l.q = d.q AND d.decision = 'CONTRADICTED' JOIN v b ON b.vec_id = d.best)")
    return f"WITH {', '.join(ctes)} " + " UNION ALL ".join(ends)


@query("IT1 IT2 PR20", _loop_sql(2))
def correction_loop(t):
    return _loop(t, 2)


@query("IT7", f"SELECT condition, final_decision, termination_reason, count(*) AS n FROM (SELECT 'verify_only' AS condition, final_decision, termination_reason FROM ({_loop_sql(0)}) UNION ALL SELECT 'corrected', final_decision, termination_reason FROM ({_loop_sql(2)})) GROUP BY ALL")
def conditions_compare(t):
    both = _loop(t, 0).withColumn("condition", F.lit("verify_only")).unionByName(_loop(t, 2).withColumn("condition", F.lit("corrected")))
    return both.groupBy("condition", "final_decision", "termination_reason").agg(F.count(F.lit(1)).alias("n"))


class UnknownMode(ValueError):
    """No such way to choose evidence."""


def in_mode(name: str):
    """Which candidates a mode keeps, as SQL; raises for a mode that does not exist."""
    if name not in _MODES:
        raise UnknownMode(f"{name!r} is none of {', '.join(_MODES)}")
    return _MODES[name]


_MODES = {"reranked": "reranked_rank <= 5", "no_reranker": "rank <= 5", "top1": "rank = 1"}


@query("PR28 PR29 IT8", f"WITH {RERANKED}, ver AS (SELECT *, {P_ENT} AS ent FROM reranked) " + " UNION ALL ".join(f"SELECT '{m}' AS mode, {_decision_sql('e', 'c', '0.7', '0.7')} AS decision, count(*) AS n FROM (SELECT q, max(ent) AS e, max(1 - ent) AS c FROM ver WHERE {w} GROUP BY q) GROUP BY 2" for m, w in _MODES.items()))
def evidence_modes(t, modes=tuple(_MODES)):
    found = _probabilities(reranked(t))
    chosen = F.explode(F.array_compact(F.array(*[F.when(F.expr(in_mode(m)), F.lit(m)) for m in modes])))
    agg = D.decide(D.query_aggregates(found.withColumn("mode", chosen), ["mode", "q"], POLICY), POLICY)
    return agg.groupBy("mode", "decision").agg(F.count(F.lit(1)).alias("n"))


@query("PR27", """
SELECT attempt_id, md5('Question:' || chr(10) || CAST(run_id AS VARCHAR) || chr(10) || chr(10) || 'Earlier answer:' || chr(10) || candidate_answer || chr(10) || chr(10) || 'Passages:' || chr(10)
  || CASE WHEN coalesce(array_to_string(list_transform(list_filter(list_transform(evidence, lambda e: e.text), lambda x: x IS NOT NULL), lambda x: '* ' || x), chr(10)), '') = '' THEN 'none were found' ELSE array_to_string(list_transform(list_filter(list_transform(evidence, lambda e: e.text), lambda x: x IS NOT NULL), lambda x: '* ' || x), chr(10)) END
  || chr(10) || chr(10) || 'Rewrite the answer so that the passages support all of it. Give the answer only.') AS prompt_digest FROM attempt_records WHERE candidate_answer IS NOT NULL""")
def correction_prompt(t):
    texts = F.coalesce(F.col("evidence.text"), F.array().cast("array<string>"))
    rows = t("attempt_records").filter("candidate_answer IS NOT NULL")
    return rows.select("attempt_id", F.md5(D.correction_prompt(F.col("run_id").cast("string"), F.col("candidate_answer"), texts).cast("binary")).alias("prompt_digest"))


@query("IT2 PR20", """
SELECT run_id, attempts, CASE mapped_decision WHEN 'ACCEPT' THEN 'accepted' WHEN 'ABSTAIN' THEN 'policy_abstained' WHEN 'CORRECT' THEN 'max_attempts_reached' ELSE 'failed' END AS termination_reason FROM
(SELECT run_id, mapped_decision, count(DISTINCT attempt_number) OVER (PARTITION BY run_id) AS attempts, row_number() OVER (PARTITION BY run_id ORDER BY attempt_number DESC, attempt_id DESC) AS r FROM attempt_records) WHERE r = 1""")
def run_outcomes(t):
    last = t("attempt_records").groupBy("run_id").agg(F.count_distinct("attempt_number").alias("attempts"), F.max_by(F.struct("mapped_decision"), F.struct("attempt_number", "attempt_id")).alias("r"))
    d = F.col("r.mapped_decision")
    return last.select("run_id", "attempts", F.when(d == "ACCEPT", "accepted").when(d == "ABSTAIN", "policy_abstained").when(d == "CORRECT", "max_attempts_reached").otherwise("failed").alias("termination_reason"))
