import math

import numpy as np
import pytest

from veriloom.functions import text as T
from veriloom.operators import claims, decide, leakage, loop, metrics, quality, retrieval, scorers, shape, skew
from pyspark.sql import functions as F


def one(df):
    return [tuple(r) for r in df.collect()]


def test_text_functions(spark):
    df = spark.createDataFrame([(" A 　b\t",), (None,), (" ",), ("'Neutral.' ",)], "t string")
    got = df.select(T.normalize_text(F.col("t")), T.is_blank(F.col("t")), T.clean_label(F.col("t"))).collect()
    assert [r[0] for r in got] == ["a b", "", "", "'neutral.'"] and [r[1] for r in got] == [False, True, True, False] and got[3][2] == "neutral"
    df = spark.createDataFrame([("qa_12_x",), ("x",), (None,)], "t string")
    assert [r[0] for r in df.select(T.first_number(F.col("t"))).collect()] == ["12", None, None]
    df = spark.createDataFrame([(" a; ;b ",), (None,), ("",)], "t string")
    assert [r[0] for r in df.select(T.split_cells(F.col("t"), ";")).collect()] == [["a", "b"], [], []]
    df = spark.createDataFrame([("é",), (None,)], "t string")
    assert [r[0] for r in df.select(T.unicode_form(F.col("t"))).collect()] == ["é", None]


def test_which_duplicate_wins(spark):
    df = spark.createDataFrame([("a", 2, "y"), ("a", 1, "x"), (None, 3, "n"), (None, 4, None)], "k string, i int, v string")
    assert sorted(one(shape.first_wins(df, ["k"], "i")), key=repr) == [("a", 1, "x"), (None, 3, "n")]
    assert sorted(one(shape.last_wins(df, ["k"], "i")), key=repr) == [("a", 2, "y"), (None, 4, None)]


def test_index_percentiles(spark):
    values = [3.0, 1.0, 2.0, 2.0, 9.0, None]
    df = spark.createDataFrame([("g", v) for v in values] + [("h", 5.0)], "k string, v double")
    got = {r["k"]: (r["p50"], r["p95"]) for r in shape.index_percentiles(df, ["k"], "v", {"p50": 0.5, "p95": 0.95}).collect()}
    s = sorted(v for v in values if v is not None)
    assert got == {"g": (s[int(5 * 0.5)], s[int(5 * 0.95)]), "h": (5.0, 5.0)}


def test_order_statistics_of_large_groups(spark):
    import random

    rnd = random.Random(2)
    values = [round(rnd.gauss(0, 1), rnd.choice([1, 6])) for _ in range(4001)]
    df = spark.createDataFrame([(None if i % 2 else "k", v) for i, v in enumerate(values)], "k string, v double")
    for key, own in ((None, values[1::2]), ("k", values[0::2])):
        own = sorted(own)
        row = next(r for r in shape.index_percentiles(df, ["k"], "v", {"a": 0.0, "b": 0.37, "c": 1.0}).collect() if r["k"] == key)
        assert (row["a"], row["b"], row["c"]) == (own[0], own[int(len(own) * 0.37)], own[-1])
    own = sorted(values)
    assert shape.order_statistics(df, [], "v", {"x": (0.5, lambda n: F.floor(n / 2))}, accuracy=50).first()["x"] == own[len(own) // 2]
    assert shape.medians(df.filter("k = 'k'"), [], "v").first()["median"] == sorted(values[0::2])[1000]
    assert shape.medians(df.limit(0), ["k"], "v").count() == 0


def test_lookup_join_with_a_hot_key(spark):
    rows = spark.range(3000).select(F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, F.col("id").cast("string")).alias("k"), "id")
    side = rows.select("k").filter("k IS NOT NULL").distinct().withColumn("v", F.length("k"))
    for how, n in (("inner", 2000), ("left", 3000), ("left_semi", 2000)):
        got = skew.lookup_join(rows, side, "k", how, least=500)
        assert got.count() == n == rows.join(side, "k", how).count()
    assert sorted(map(str, one(skew.lookup_join(rows, side, "k", "left_anti", least=500)))) == sorted(map(str, one(rows.join(side, "k", "left_anti"))))


def test_issues_and_profile(spark):
    df = spark.createDataFrame([(1, None), (2, " "), (3, "x")], "id int, t string")
    got = one(quality.issues(df, ["id"], {"no_text": F.col("t").isNull(), "blank": F.col("t") == " "}))
    assert sorted(got) == [(1, "no_text"), (2, "blank")]
    assert one(quality.column_profile(df, ["t"])) == [("t", 1, 1, 2)]
    assert one(quality.checks([("a", df.agg(F.count_if(F.col("t").isNull()).alias("violations")))])) == [("a", 1, "FAIL")]
    assert sorted(one(quality.fan_out(df.withColumn("k", F.lit(1)), "k"))) == [(3, 1)]


def test_sequence_profile(spark):
    rows = [(1, "a", 0, "x"), (2, "a", 1, " "), (3, "a", 1, "late"), (4, "a", 4, None), (5, "b", 2, "x"), (6, None, 0, "x"), (7, None, 1, "y")]
    df = spark.createDataFrame(rows, "r long, p string, i long, t string")
    got = {r["p"]: tuple(r)[1:] for r in quality.sequence_profile(df, "p", "i", "r", "t").collect()}
    assert got == {"a": (3, 0, 4, 1, 2), "b": (1, 2, 2, 1, 0), None: (2, 0, 1, 0, 0)}


def test_evidence_resolution(spark):
    refs = '[[{"wiki_url":"P","sentence_id":1},{"wiki_url":"P","sentence_id":9}],[{"sentence_id":2,"wiki_url":"P"},{"wiki_url":"P","sentence_id":1}],[]]'
    df = spark.createDataFrame([(1, refs), (2, "[]"), (3, None), (4, "broken"), (5, '[[{"wiki_url":"Q","sentence_id":1}]]'), (6, '[[{"wiki_url":null,"sentence_id":-1}]]'), (7, '[[{"wiki_url":"P","sentence_id":3}]]')], "id long, r string")
    s = spark.createDataFrame([(1, "P", 1, "one"), (2, "P", 1, "late"), (3, "P", 2, "two"), (4, "P", 3, " ")], "row_id long, page_id string, sentence_id long, text string")
    docs = spark.createDataFrame([(1, "P", "the whole page"), (2, "P", "late"), (3, "E", " "), (4, "Caf\u00e9", "coffee"), (5, None, "x")], "doc_id long, page_id string, text string")
    more = spark.createDataFrame([(8, '[[{"wiki_url":"P","sentence_id":-1}],[{"wiki_url":"P","sentence_id":1}]]'), (9, '[[{"wiki_url":"E","sentence_id":-1}]]'), (10, '[[{"wiki_url":"Cafe\u0301","sentence_id":-1}]]'), (11, '[[{"wiki_url":"P","sentence_id":null}]]'), (12, '[[{"wiki_url":"","sentence_id":1}]]'), (13, '[[{"wiki_url":"None","sentence_id":-1}]]')], "id long, r string")
    pages = claims.Pages(s, docs)
    resolved = claims.resolve_sentences(claims.evidence_references(df.unionAll(more), "id", "r"), pages)
    status = {(r["id"], r["set_pos"], r["ref_pos"]): r["status"] for r in resolved.collect()}
    assert status == {
        (1, 0, 0): "resolved", (1, 0, 1): "missing_sentence_id", (1, 1, 0): "resolved", (1, 1, 1): "resolved", (5, 0, 0): "missing_page", (6, 0, 0): "missing_page", (7, 0, 0): "empty_resolved_text", (8, 0, 0): "resolved", (8, 1, 0): "resolved",
        (9, 0, 0): "empty_resolved_text", (10, 0, 0): "resolved", (11, 0, 0): "missing_sentence_id", (12, 0, 0): "missing_page", (13, 0, 0): "missing_page",
    }
    assert sorted(one(claims.first_resolved_set(resolved, pages, "id"))) == [(1, 1, 2, "two one"), (8, 0, 1, "the whole page"), (10, 0, 1, "coffee")]


def test_subsets_expand_and_unknown_ones_are_refused(spark):
    raw = spark.createDataFrame([(0, "k", "", "q", "yes", "no"), (1, None, "h", None, None, "x")], "raw_index long, knowledge string, dialogue_history string, question string, right_response string, hallucinated_response string")
    rows = {r["example_id"]: (r["context"], r["candidate_response"], r["label"], r["source_field"]) for r in claims.expand_subset(raw, "dialogue").collect()}
    assert rows == {"dialogue_0_not_hallucinated": ("k", "yes", "not_hallucinated", "right_response"), "dialogue_0_hallucinated": ("k", "no", "hallucinated", "hallucinated_response"), "dialogue_1_not_hallucinated": ("h", "", "not_hallucinated", "right_response"), "dialogue_1_hallucinated": ("h", "x", "hallucinated", "hallucinated_response")}
    with pytest.raises(claims.UnknownSubset):
        claims.expand_subset(raw, "poems")


def test_rows_keep_their_place_over_files(spark, tmp_path):
    for k, (a, b) in enumerate(((0, 5), (5, 8), (8, 20))):
        spark.range(a, b, 1, 1).write.parquet(str(tmp_path / f"part={k}"))
    got = claims.positional_index(spark.read.parquet(str(tmp_path))).collect()
    assert len(got) == 20 and all(r["id"] == r["raw_index"] for r in got)


def test_guards_fail_inside_the_plan(spark):
    df = spark.createDataFrame([(1, "fever", "train", False), (2, "halueval", " QA ", False)], "id long, source_dataset string, source_subset string, bad boolean")
    pool = lambda rows, requested: leakage.training_pool(rows, requested, F.col("bad"), F.col("id"), False)
    assert pool(df, [("fever", "train"), ("halueval", "qa")]).count() == 2
    with pytest.raises(leakage.RoleViolation):
        pool(df, [("ragtruth", "test")])
    with pytest.raises(Exception, match="contaminated record: 3"):
        pool(df.unionAll(spark.createDataFrame([(3, "fever", "train", True)], df.schema)), [("fever", "train")]).collect()
    rules = leakage.training_rules(F.col("source_dataset"), F.col("source_subset"), F.col("bad"))
    for source, name in (("ragtruth", "forbidden source"), ("other", "unknown source")):
        with pytest.raises(Exception, match=f"{name}: 9"):
            leakage.guarded(spark.createDataFrame([(9, source, "train", False)], df.schema), rules, F.col("id")).collect()
    with pytest.raises(Exception, match="several splits"):
        leakage.one_split_each(spark.createDataFrame([("g", "a"), ("g", "b")], "g string, s string"), "g", "s").collect()
    for value in (float("nan"), float("inf"), None):
        rows = spark.createDataFrame([("q", value, 0.5)], "q string, entailment_probability double, contradiction_probability double")
        with pytest.raises(Exception, match="NotFinite"):
            decide.query_aggregates(rows, ["q"]).collect()


def test_rules_of_responses_pairs_and_targets(spark):
    df = spark.createDataFrame([(1, "t", "train", False, "QA", "good"), (2, "", "dev", True, "Poem", "bad"), (3, None, None, False, None, None)], "id int, t string, s string, m boolean, k string, q string")
    got = sorted(one(quality.coded_issues(df, ["id"], quality.response_rules(*[F.col(c) for c in "tsmkq"]))))
    assert got == [(2, "empty_or_missing_response_text"), (2, "invalid_split:'dev'"), (2, "source_missing"), (2, "unexpected_quality:'bad'"), (2, "unexpected_task_type:'Poem'"), (3, "empty_or_missing_response_text"), (3, "invalid_split:None")]
    df = spark.createDataFrame([(1, "t", "hallucinated", "general", "", "[]", "ID"), (2, "", "x", "qa", None, "{}", "7"), (3, "t", "hallucinated", "general", "", '[{"a":1}]', ""), (4, "t", "not_hallucinated", "qa", "c", None, None), (5, "t", "hallucinated", "general", "", "broken", "1")], "id int, t string, l string, s string, c string, j string, r string")
    got = sorted(one(quality.coded_issues(df, ["id"], quality.pair_rules(*[F.col(c) for c in "tlscjr"]))))
    assert got == [(1, "hallucinated_with_no_spans"), (1, "suspicious_raw_id:'ID'"), (2, "empty_or_missing_candidate_response"), (2, "hallucination_spans_not_a_list"), (2, "invalid_label:'x'"), (2, "missing_context"), (3, "suspicious_raw_id:''"), (5, "hallucination_spans_not_a_list")]
    df = spark.createDataFrame([(1, '{"a":1,"b":0}'), (2, None), (3, "{}"), (4, "[1]"), (5, '{"a":0}'), (6, '{"a":2,"b":1}'), (7, '{"a":"1"}'), (8, '{"a":null,"b":1}'), (9, "no json")], "id int, t string")
    got = sorted(one(quality.coded_issues(df, ["id"], quality.target_rules("mc", F.col("t"), F.lit(True)))))
    assert got == [(2, "missing_mc_despite_has_mc_data"), (3, "mc_not_a_nonempty_dict"), (4, "mc_not_a_nonempty_dict"), (5, "mc_has_no_correct_option"), (6, "mc_has_non_binary_values"), (7, "mc_has_no_correct_option"), (7, "mc_has_non_binary_values"), (8, "mc_has_non_binary_values"), (9, "mc_not_a_nonempty_dict")]


def test_roles_and_split(spark):
    with pytest.raises(leakage.RoleViolation):
        leakage.require_roles({"a", "b"}, {"a"})
    df = spark.range(200).select("id", (F.col("id") % 50).cast("string").alias("g"))
    got = leakage.group_split(df, F.col("g"), 0.1).collect()
    by = {}
    for r in got:
        by.setdefault(r["g"], set()).add(r["part"])
    assert len(got) == 200 and all(len(v) == 1 for v in by.values()) and sum(v == {"dev"} for v in by.values()) == 5
    assert leakage.group_split(df.limit(0), F.col("g"), 0.1).count() == 0
    assert sum(r["part"] == "dev" for r in leakage.group_split(df.filter("g = '1'"), F.col("g"), 0.1).collect()) == 4


def test_policy_rules(spark):
    rows = [("s", 0.9, 0.1), ("s", 0.3, 0.7), ("one", 0.9, 0.1), ("c", 0.2, 0.8), ("a", 0.55, 0.45)]
    df = spark.createDataFrame(rows, "q string, entailment_probability double, contradiction_probability double")
    loose, strict = decide.Policy(0.6, 0.6), decide.Policy(0.6, 0.6, 0.1)
    run = lambda p: {r["q"]: r["decision"] for r in decide.decide(decide.query_aggregates(df, ["q"], p), p).collect()}
    assert run(loose) == {"s": "SUPPORTED", "one": "SUPPORTED", "c": "CONTRADICTED", "a": "ABSTAIN"}
    assert run(strict) == {"s": "SUPPORTED", "one": "ABSTAIN", "c": "CONTRADICTED", "a": "ABSTAIN"}
    bad = spark.createDataFrame([(float("nan"),)], "p double")
    with pytest.raises(decide.NotFinite):
        decide.require_finite(bad, ["p"])
    decide.require_finite(df, ["entailment_probability"])


def test_evidence_ties_go_to_the_better_rank(spark):
    df = spark.createDataFrame([("q", 0.5, 2, "b"), ("q", 0.5, 1, "a"), ("q", 0.4, 0, "c")], "q string, p double, r int, c string")
    assert one(decide.select_evidence(df, ["q"], "p", "r", F.col("c"))) == [("q", "a")]


def test_prompt(spark):
    df = spark.createDataFrame([("q", "a", ["x", None, "y"]), ("q", "a", [])], "q string, a string, e array<string>")
    first, second = (r[0] for r in df.select(decide.correction_prompt(F.col("q"), F.col("a"), F.col("e"))).collect())
    assert "* x\n* y" in first and "none were found" in second


def test_top_k_against_brute_force(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((300, 8)).astype(np.float32)
    x[7] = x[8]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<float>")
    got = retrieval.top_k(df.repartition(5), df.filter("id % 20 = 0"), 7, block_bytes=200).collect()
    for q in range(0, 300, 20):
        s = x.astype(np.float64) @ x[q].astype(np.float64)
        want = [i for i in sorted(range(300), key=lambda i: (-s[i], i)) if i != q][:7]
        assert [r["c"] for r in sorted((r for r in got if r["q"] == q), key=lambda r: r["rank"])] == want
    assert retrieval.top_k(df, df.limit(0), 7).count() == 0


def test_undefined_measures(spark):
    df = spark.createDataFrame([(0, 0, 0, 5), (0, 2, 3, 0), (4, 1, 1, 4)], "tp long, fp long, fn long, tn long")
    got = metrics.binary_rates(df).select("precision", "recall", "f1").collect()
    assert [tuple(r) for r in got] == [(None, None, None), (0.0, 0.0, 0.0), (0.8, 0.8, 0.8)]
    df = spark.createDataFrame([("a", "b"), ("a", "a"), ("c", "b")], "t string, p string")
    got = {r["label"]: (r["support"], r["precision"], r["recall"], r["f1"]) for r in metrics.report(df, "t", "p").collect()}
    assert got == {"a": (2, 1.0, 0.5, round(2 / 3, 6)), "b": (0, 0.0, 0.0, 0.0), "c": (1, 0.0, 0.0, 0.0)}


def test_calibration_over_nothing(spark):
    df = spark.createDataFrame([], "c double, ok int")
    assert [r["n"] for r in metrics.reliability(df, "c", "ok").collect()] == [0] * 10
    assert one(metrics.calibration(df, "c", "ok"))[0][:3] == (None, None, None)
    full = spark.createDataFrame([(1.0, 1), (0.0, 0), (0.95, 0)], "c double, ok int")
    assert {r["bin"]: r["n"] for r in metrics.reliability(full, "c", "ok").collect() if r["n"]} == {0: 1, 9: 2}


def test_choice_scores(spark):
    df = spark.createDataFrame([("k", 0.0, 0, True), ("k", 0.0, 1, False)], "k string, ll double, p int, r boolean")
    assert one(metrics.choice_scores(df, "k", "ll", "p", "r")) == [("k", True, 0.5)]


def test_scorers(spark):
    df = spark.createDataFrame([(1, "a b", "a b"), (2, None, "a"), (3, "x", None)], "id int, p string, h string")
    got = df.select("id", scorers.pair_column(F.col("p"), F.col("h")).alias("s")).collect()
    assert all(math.isclose(r["s"]["entailment_probability"] + r["s"]["contradiction_probability"], 1) for r in got)
    assert [r["s"]["verifier_label"] for r in got] == ["entailment", "contradiction", "contradiction"]
    v = df.select(scorers.embedding_column(F.col("p")).alias("v")).collect()
    assert len(v[0]["v"]) == 64 and math.isclose(sum(x * x for x in v[0]["v"]), 1, rel_tol=1e-5)


def test_failing_items_are_recorded(spark):
    def make():
        base = scorers.hashed_embedder(4)

        def embed(texts):
            if any(t == "bad" for t in texts):
                raise ValueError("bad")
            return base(texts)

        return embed

    df = spark.createDataFrame([(1, "a"), (2, "bad")], "id long, t string").coalesce(1)
    got = {r["id"]: (r["vector"] is None, r["error"]) for r in scorers.embed_with_failures(df, "id", "t", make).collect()}
    assert got == {1: (False, None), 2: (True, "ValueError")}


def test_loop_ends(spark):
    df = spark.createDataFrame([(1, 0.9), (2, 0.1), (3, 0.5)], "q long, p double")
    verify = lambda live: live.select("q", F.col("p").alias("entailment_probability"), (1 - F.col("p")).alias("contradiction_probability"))
    better = lambda live, found: live.select("q", (F.col("p") + 0.35).alias("p"))
    run = lambda n: {r["q"]: (r["final_decision"], r["termination_reason"], r["correction_occurred"], r["n_regenerations"]) for r in loop.run_loop(df, verify, better, decide.Policy(0.7, 0.6), n).collect()}
    assert run(0) == {1: ("ACCEPT", "accepted", False, 0), 2: ("ABSTAIN", "max_attempts_reached", True, 0), 3: ("ABSTAIN", "policy_abstained", False, 0)}
    assert run(2)[2] == ("ABSTAIN", "policy_abstained", True, 1)


def test_span_issues(spark):
    import json

    ok = {"start": 6, "end": 11, "text": "wörld"}
    spans = [ok, {"start": 0, "end": 3, "text": "xyz"}, {"start": -1, "end": 2, "text": "h"}, {"start": 0, "end": 12, "text": "h"}, {"start": 3, "end": 2}, {"start": "0", "end": 2}, {"start": 1.0, "end": 2}, {"end": 2}, "span", None, 7, {"start": 0, "end": 5}, {"start": 0, "end": 5, "text": 5}, {"start": 0, "end": 10**20}, {"start": False, "end": True, "text": "h"}]
    rows = [(1, "hello wörld", json.dumps(spans), "QA"), (2, None, json.dumps([ok]), "QA"), (3, "", None, "QA"), (4, "x", "{}", "QA"), (5, "x", "[", None), (6, "x", "[]", "Poem")]
    df = spark.createDataFrame(rows, "k long, body string, spans string, task string")
    got = {}
    for r in quality.span_issues(df, ["k"], "body", "spans", {"unknown_task_type": ~F.col("task").isin("QA", "Summary")}).collect():
        got.setdefault(r["k"], []).append((r["span_no"], r["issue"]))
    assert got.pop(1) == [(1, "offset_text_mismatch"), *[(i, "offset_out_of_bounds") for i in (2, 3, 4)], *[(i, "offset_not_int") for i in (5, 6, 7)], *[(i, "label_not_a_dict") for i in (8, 9, 10)], (12, "offset_text_mismatch"), (13, "offset_out_of_bounds")]
    assert got == {2: [(None, "empty_text"), (None, "text_not_a_string")], 3: [(None, "empty_text")], 4: [(None, "labels_not_a_list")], 5: [(None, "labels_not_a_list")], 6: [(None, "unknown_task_type")]}
    typed = spark.createDataFrame([(1, "ab cd", [(0, 2, "ab"), (3, 5, "ce"), (3, 6, "cd"), None])], "k long, body string, spans array<struct<start:int,end:int,text:string>>")
    assert one(quality.span_issues(typed, ["k"], "body", "spans")) == [(1, 1, "offset_text_mismatch"), (1, 2, "offset_out_of_bounds"), (1, 3, "label_not_a_dict")]
    words = spark.createDataFrame([(" é  b c d e ",), (None,)], "t string").select(T.word_spans(F.col("t"))).collect()
    assert [tuple(x) for x in words[0][0]][-1] == (10, 11, "e") and len(words[0][0]) == 5 and words[1][0] is None


def test_wiki_lines(spark):
    from veriloom.plans import text_queries

    texts = [(1, "wiki_page", "0\tFirst .\tlink\tlink\n\n 12 \tSecond\n3\nx\tThird\n1.0\tFourth\n-1_0\t\n \n99999999999999999999\tBig"), (2, "data_record", "plain"), (3, "dialogue", None)]
    docs = spark.createDataFrame(texts, "doc_id long, doc_kind string, text string")
    lines = {(r["doc_id"], r["line_no"]): (r["sentence_id"], r["sentence"], r["malformed"]) for r in text_queries.wiki_line_explode(lambda name: docs).collect()}
    bad = (None, None, True)
    assert lines == {(1, 0): (0, "First .", False), (1, 2): (12, "Second", False), (1, 3): bad, (1, 4): bad, (1, 5): bad, (1, 6): (-10, "", False), (1, 7): bad, (1, 8): bad, (2, 0): bad}
    assert sorted(one(text_queries.wiki_line_counts(lambda name: docs))) == [(1, 8, 3, 5), (2, 1, 0, 1)]


def test_models_are_checked_when_loaded():
    assert scorers.verified(scorers.hashed_embedder, 64)()(["a b"]).shape == (1, 64)
    for make, dimensions in ((scorers.hashed_embedder, 32), (lambda: lambda texts: np.full((len(texts), 8), np.nan), 8), (lambda: lambda texts: np.zeros((len(texts), 8), int), 8), (lambda: lambda texts: np.random.default_rng().random((len(texts), 8)), 8)):
        with pytest.raises(scorers.ModelMismatch):
            scorers.verified(make, dimensions)()


def test_unknown_modes_are_refused():
    from veriloom.plans import loop_queries

    with pytest.raises(loop_queries.UnknownMode):
        loop_queries.in_mode("nearest")


def test_numeric_functions(spark):
    from veriloom.functions import numeric

    df = spark.createDataFrame([([1.0, 800.0], [1.0, 800.0]), ([1.0, 2.0], [1.0, 2.1]), ([1.0], [1.0, 2.0]), ([float("nan")], [1.0])], "a array<double>, b array<double>")
    a, b = F.col("a"), F.col("b")
    assert [r[0] for r in df.select(numeric.allclose(a, b, 1e-3)).collect()] == [True, False, False, False]
    row = df.limit(1).select(numeric.softmax_of_two(a[0], a[1]), numeric.log_softmax(a), numeric.sigmoid(F.lit(0.0))).first()
    assert row[0] == 0.0 and row[1] == [-799.0, 0.0] and row[2] == 0.5


def test_searches_in_several_blocks_of_queries(spark):
    rnd = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rnd.integers(-2, 3, 4)]) for i in range(300)]
    e = spark.createDataFrame(rows, "id long, vector array<double>").repartition(5)
    want = {}
    for q, v in rows[::7]:
        ranked = sorted((-float(np.dot(v, w)), c) for c, w in rows if c != q)[:6]
        want[q] = [c for _, c in ranked]
    for block in (1 << 20, 300):
        got = {}
        for r in sorted(retrieval.top_k(e, e.filter("id % 7 = 0"), 6, block).collect(), key=lambda r: r["rank"]):
            got.setdefault(r["q"], []).append(r["c"])
        assert got == want
    assert retrieval.top_k(e, e.limit(0), 3).count() == 0


def test_labels_of_models():
    assert scorers.label_rows({0: "Entailment", 1: "x"}, {"entailment"}) == {"entailment": 0}
    scorers.check_head({"0": "ENTAILMENT", "1": "contradiction"})
    for names in ({0: "entailment"}, {0: "contradiction", 1: "entailment"}, {0: "entailment", 1: "contradiction", 2: "neutral"}):
        with pytest.raises(scorers.ModelMismatch):
            scorers.check_head(names)
    with pytest.raises(scorers.ModelMismatch):
        scorers.label_rows({0: "neutral"}, {"entailment"})
