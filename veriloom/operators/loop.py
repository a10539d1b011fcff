"""The bounded correct-and-recheck loop over all questions at once.

Rounds follow one another, at most 1 + corrections of them; within a round all open
questions are searched, reranked, verified and decided in parallel. Questions that
ended leave the open set, and each round ends with a written table, so the plan does
not grow.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written
from .decide import Policy, decide, query_aggregates

ACTION = {"SUPPORTED": "ACCEPT", "CONTRADICTED": "CORRECT", "ABSTAIN": "ABSTAIN"}


def action(decision):
    return F.create_map(*[F.lit(x) for pair in ACTION.items() for x in pair])[decision]


def run_loop(
    questions: DataFrame,
    verify: Callable[[DataFrame], DataFrame],
    regenerate: Callable[[DataFrame, DataFrame], DataFrame],
    policy: Policy,
    corrections: int = 2,
) -> DataFrame:
    """(q, final_decision, termination_reason, correction_occurred, n_regenerations, attempts).

    ``questions`` has q and whatever ``verify`` needs; ``verify`` gives candidates of the
    open questions with their probabilities; ``regenerate`` gives new questions from the
    open ones and their candidates. Reaching the limit counts as corrected even where no
    correction ran; ``n_regenerations`` tells how many did.
    """
    out, live = None, questions
    for attempt in range(corrections + 1):
        candidates = written(verify(live), f"round{attempt}")
        decided = decide(query_aggregates(candidates, ["q"], policy), policy)
        state = live.select("q").join(decided.select("q", "decision"), "q", "left").withColumn("act", action(F.coalesce("decision", F.lit("ABSTAIN"))))
        state = written(state, f"state{attempt}")
        last = attempt == corrections
        reason = F.when(F.col("act") == "ACCEPT", "accepted").when(F.col("act") == "ABSTAIN", "policy_abstained").otherwise("max_attempts_reached")
        ended = state if last else state.filter("act <> 'CORRECT'")
        done = ended.select(
            "q",
            F.when(F.col("act") == "ACCEPT", "ACCEPT").otherwise("ABSTAIN").alias("final_decision"),
            reason.alias("termination_reason"),
            (F.lit(attempt > 0) | (F.col("act") == "CORRECT")).alias("correction_occurred"),
            F.lit(attempt).alias("n_regenerations"),
            F.lit(attempt + 1).alias("attempts"),
        )
        out = done if out is None else out.unionAll(done)
        if last:
            break
        open_ = live.join(state.filter("act = 'CORRECT'").select("q"), "q", "left_semi")
        live = written(regenerate(open_, candidates), f"open{attempt}")
        if live.isEmpty():
            break
    return out
