"""The queries with SQL against it, all others for their columns and against brute force on the smallest tables."""

import re
from collections import defaultdict

import pytest
from harness import compare, connect

from veriloom.llm import catalog, confusables, leakage, overlap

COLUMNS = {
    "p1_found": ["first_record_id", "member_table", "member_id"], "p2_found": ["table_name", "row_key", "field"], "p3_found": ["kept_id", "copy_id"], "p5_found": ["generation_id", "defect"],
    "p6_found": ["train_id", "eval_table", "eval_id"], "p8_found": ["doc_id", "item_id"], "p9_found": ["doc_id"],
}


@pytest.fixture(scope="module")
def sql(data):
    return connect(data)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_same_as_sql(spark, data, sql, name):
    compare(catalog.queries()[name](spark, data), catalog.oracle_sql()[name], sql)


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns(spark, data, name):
    df = catalog.queries()[name](spark, data)
    assert df.columns == COLUMNS[name]
    assert df.count() == df.distinct().count()


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(COLUMNS)))
def test_runs(spark, data, name):
    rows = catalog.queries()[name](spark, data)
    assert rows.columns and (rows.count() > 0 or name == "p8_paraphrases")  # the given documents hold equal runs only


def test_overlaps_against_all_pairs(spark, data):
    pool = spark.read.parquet(f"{data}/pool_records.parquet")
    responses = spark.read.parquet(f"{data}/rag_error_analysis.parquet")
    got = {tuple(r) for r in overlap.found(pool, responses).collect()}
    words = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    rows = pool.select("record_id", "hypothesis", "split").collect()
    train = [(r[0], words(r[1])) for r in rows if r[2] == "train"]
    other = {("pool_records", str(r[0]), tuple(words(r[1]))) for r in rows if r[2] != "train"} | {("rag_error_analysis", r[0], tuple(words(r[1]))) for r in responses.select("response_id", "answer_preview").collect()}
    want = set()
    for i, a in train:
        for table, key, b in other:
            n = max(len(a), len(b))
            if b and len(set(a) & set(b)) >= 0.5 * len(set(b)) and overlap.common_length(a, list(b)) >= 0.8 * n - 1e-9:
                want.add((i, table, key))
    assert got == want and want


def test_leaks_against_sets_of_runs(spark, data):
    docs, items = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/eval_items.parquet")
    runs = defaultdict(set)
    for i, t in items.select("item_id", "text").collect():
        w = leakage.words_of(t)
        for k in range(len(w) - 11):
            runs[tuple(w[k : k + 12])].add(i)
    want = set()
    for d, t in docs.select("doc_id", "text").collect():
        w = leakage.words_of(t or "")
        for k in range(len(w) - 11):
            want |= {(d, i) for i in runs.get(tuple(w[k : k + 12]), ())}
    assert {tuple(r) for r in leakage.leaked(docs, items).collect()} == want and want


def test_the_pattern_lets_no_deviating_value_pass(spark, data):
    """Against every value read whole: one deviates if its plain form is another text of its class, however its characters look."""
    rows = confusables.values(spark.read.parquet(f"{data}/sentences.parquet"), "sentences", "row_id", ["text"])
    got = {r["row_key"] for r in confusables.deviating(rows).collect()}
    want = set()
    for r in rows.collect():
        if r["text"] is not None and (plain := confusables.canonical(r["text"])) != r["text"]:
            assert confusables.skeleton(plain) == confusables.skeleton(r["text"])
            want.add(r["row_key"])
    assert got == want and want
