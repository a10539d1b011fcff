"""Every core query against its SQL, on the smallest tables."""

import pytest
from harness import compare, connect

from veriloom.plans import catalog

NAMES = sorted(catalog.oracle_sql())


@pytest.fixture(scope="module")
def sql(data):
    return connect(data)


@pytest.mark.parametrize("name", NAMES)
def test_same_as_sql(spark, data, sql, name):
    compare(catalog.queries()[name](spark, data), catalog.oracle_sql()[name], sql)


def test_entry(spark, data):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns == ["q", "best", "max_ent", "decision"] and df.count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_recall_grows_with_k_and_survives_reranking(spark, data):
    q = catalog.queries()
    recall = {r["k"]: r["recall"] for r in q["recall_at_k"](spark, data).collect()}
    assert recall[1] <= recall[5] <= recall[10] <= recall[20]
    outcomes = q["correction_outcomes"](spark, data).collect()
    known = spark.read.parquet(f"{data}/rag_error_analysis.parquet").filter("gold_has_hallucination IS NOT NULL AND attempt0_mapped_decision IS NOT NULL AND final_decision IS NOT NULL").count()
    assert sum(r["n"] for r in outcomes) == known


def test_loop_is_bounded(spark, data):
    rows = catalog.queries()["correction_loop"](spark, data).collect()
    assert len({r["q"] for r in rows}) == len(rows) and all(1 <= r["attempts"] <= 3 and r["n_regenerations"] == r["attempts"] - 1 for r in rows)
