"""Runs named stages in order and writes each result: python -m veriloom.plans.runner TABLES OUT [--from S] [--only S] [--fast] [--dry-run]."""

from __future__ import annotations

import argparse
import time

from pyspark.sql import DataFrame, SparkSession

from ..session import ship_package

STAGES: dict[str, list[str]] = {
    "manifest": ["dataset_manifest", "source_manifest", "column_profile", "duplicate_rows"],
    "validate": ["validate_claims", "validate_pair_records", "validate_responses", "validate_spans", "validate_mc_targets", "pool_validate", "corpus_validate"],
    "resolve": ["claim_premise_resolution", "claim_resolution_status", "resolution_reasons"],
    "pool": ["contamination_sweep", "contamination_exclude", "safe_training_pool", "binary_training_pool", "group_split", "split_disjointness"],
    "retrieve": ["corpus_of_cited_pages", "dense_topk", "rerank", "recall_at_k", "rank_shift"],
    "decide": ["verify_claims", "verify_pipeline", "decision_policy", "policy_sweep", "threshold_sweep", "ece_brier"],
    "loop": ["correction_loop", "conditions_compare", "evidence_modes"],
    "report": ["detection_metrics", "breakdown_by_key", "correction_outcomes", "error_analysis_topn", "classification_summary", "confusion_matrix", "final_tables"],
}
#: Left out by --fast.
SLOW = {"loop"}


def chosen(start: str | None = None, only: str | None = None, fast: bool = False) -> list[str]:
    names = list(STAGES)
    for name in (start, only):
        if name is not None and name not in names:
            raise ValueError(f"no stage {name}; there are {', '.join(names)}")
    if only:
        return [only]
    return [n for n in names[names.index(start) if start else 0 :] if not (fast and n in SLOW)]


def store(rows: DataFrame, out: str, stage: str, name: str) -> None:
    """Where a query's rows go; a stage that runs again replaces its own."""
    rows.write.mode("overwrite").parquet(f"{out}/{stage}/{name}")


def run(spark: SparkSession, tables: str, out: str, stages: list[str], say=print) -> None:
    from . import catalog

    ship_package(spark)
    queries = catalog.queries()
    for stage in stages:
        for name in STAGES[stage]:
            began = time.time()
            store(queries[name](spark, tables), out, stage, name)
            say(f"{stage}/{name}: {time.time() - began:.1f} s")


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("tables")
    p.add_argument("out")
    p.add_argument("--from", dest="start")
    p.add_argument("--only")
    p.add_argument("--fast", action="store_true")
    p.add_argument("--dry-run", action="store_true")
    a = p.parse_args(args)
    stages = chosen(a.start, a.only, a.fast)
    if a.dry_run:
        print("\n".join(f"{s}: {', '.join(STAGES[s])}" for s in stages))
        return
    run(SparkSession.builder.appName("veriloom").getOrCreate(), a.tables, a.out, stages)


if __name__ == "__main__":
    main()
