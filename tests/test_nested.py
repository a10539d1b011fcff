import json
import random

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veriloom.operators import nested


def expected(text):
    """The same by a parser."""
    try:
        value = json.loads(text)
    except ValueError:
        return []
    found = value.get("c") if isinstance(value, dict) else None
    if isinstance(found, str):
        try:
            found = json.loads(found)
        except ValueError:
            return []
    if isinstance(found, dict):
        own = {"corpus_id", "page_id", "sentence_id", "text", "provenance"} & set(found)
        if own:
            found = [found]
        else:
            lists = [v for v in found.values() if isinstance(v, list)]
            found = lists[0] if lists else [v for v in found.values() if isinstance(v, dict)]
    return [(i, key(x)) for i, x in enumerate(found) if x is not None] if isinstance(found, list) else []


def key(x):
    if not isinstance(x, dict):
        return None
    inner = x.get("provenance") if isinstance(x.get("provenance"), dict) else {}
    pick = lambda n: x.get(n) if x.get(n) is not None else inner.get(n)
    if pick("corpus_id"):
        return str(pick("corpus_id"))
    return f"{pick('page_id')}::{pick('sentence_id')}" if pick("page_id") is not None and pick("sentence_id") is not None else None


def indexed(texts):
    out = {i: [] for i in range(len(texts))}
    for d, p, k in nested.json_children([t.encode() for t in texts], b"c"):
        out[d].append((p, k))
    return [sorted(out[i]) for i in range(len(texts))]


name = st.text(alphabet='ab"\\{}[]:, é\n', max_size=6)
candidate = st.fixed_dictionaries({}, optional={"corpus_id": st.one_of(st.none(), name), "page_id": st.one_of(st.none(), name), "sentence_id": st.integers(0, 9), "text": name, "other": st.lists(st.integers(0, 3), max_size=2)}).filter(lambda d: set(d) & {"corpus_id", "page_id", "sentence_id", "text"})
held = st.one_of(st.none(), st.lists(st.one_of(st.none(), candidate), max_size=4), candidate, st.fixed_dictionaries({"items": st.lists(candidate, max_size=3), "count": st.integers(0, 9)}))


@settings(max_examples=150, deadline=None, suppress_health_check=[HealthCheck.too_slow])
@given(st.lists(st.tuples(held, st.booleans(), st.integers(0, 3), name), min_size=1, max_size=6))
def test_index_agrees_with_parser(records):
    texts = []
    for value, as_text, form, other in records:
        value = json.dumps(value) if as_text and value is not None else value
        texts.append(json.dumps({"query": other, "c": value, "end": {"d": other}}, indent=[None, 1, 2, None][form], ensure_ascii=form == 0))
    assert indexed(texts) == [sorted(expected(t)) for t in texts]


def test_broken_missing_and_odd_payloads():
    texts = ["", "null", "[]", "{", '{"c":[{"corpus_id":"a"}', '{"c":NaN}', '{"c":[]}', '{"x":1}', '{"c":[null,{"corpus_id":"k"}]}', '{"c":"not json"}', '{"c":[{"corpus_id":"x"}],"c":[{"corpus_id":"y"}]}', '{"c" : [ { "corpus_id" : "\\u00e9\\"" } ] }']
    assert indexed(texts) == [[], [], [], [], [], [], [], [], [(1, "k")], [], [(0, "y")], [(0, 'é"')]]


def test_deep_and_long_payloads():
    deep = '{"c":[{"corpus_id":"a","x":' + "[" * 5000 + "]" * 5000 + "}]}"
    long = json.dumps({"c": [{"corpus_id": f"k{i}", "text": "x" * 50} for i in range(20_000)]})
    assert indexed([deep])[0] == [(0, "a")]
    assert len(indexed([long, '{"c":[{"corpus_id":"z"}]}'])[0]) == 20_000


def _attempts(spark, rows):
    item = T.StructType([T.StructField("corpus_id", T.StringType()), T.StructField("page_id", T.StringType()), T.StructField("sentence_id", T.LongType())])
    latency = T.StructType([T.StructField("retrieval_seconds", T.DoubleType()), T.StructField("verification_seconds", T.DoubleType())])
    schema = T.StructType([T.StructField("attempt_id", T.LongType()), T.StructField("evidence", T.ArrayType(item)), T.StructField("selected_evidence", item), T.StructField("latency", latency), T.StructField("pos", T.StringType())])
    return spark.createDataFrame(rows, schema)


def test_linked_children(spark):
    attempts = _attempts(spark, [
        (1, [("a", "p", 1), None, (None, "p", 2), ("", "p", 3)], (None, "p", None), (0.1, None), "clash"),
        (1, [("a", "p", 1)], None, None, None),
        (2, [], ("b", None, None), (None, None), None), (3, None, None, None, None), (None, [("z", None, None)], None, None, None),
    ])
    results = spark.createDataFrame([(7, '{"verified_candidates":{"items":[{"page_id":"p","sentence_id":"4"}]}}', 1), (8, None, 2), (9, "broken", 3)], "result_id long, payload string, child string")
    got = sorted((tuple(r) for r in nested.linked_children(attempts, results).filter("parent_id IS NOT NULL").collect()), key=repr)
    assert got == sorted([
        ("attempt_records", 1, "evidence", 0, "a"), ("attempt_records", 1, "evidence", 2, "p::2"), ("attempt_records", 1, "evidence", 3, "p::3"), ("attempt_records", 1, "evidence", 0, "a"),
        ("attempt_records", 1, "selected_evidence", 0, None), ("attempt_records", 2, "selected_evidence", 0, "b"), ("attempt_records", 1, "latency", 0, "retrieval_seconds"), ("pipeline_results", 7, "verified_candidate", 0, "p::4"),
    ], key=repr)


def test_empty_tables(spark):
    results = spark.createDataFrame([], "result_id long, payload string")
    assert nested.linked_children(_attempts(spark, []), results).count() == 0


def test_child_table_renames_clashes(spark):
    df = spark.createDataFrame([(1, [(5, 6)])], "id long, items array<struct<id: long, x: long>>")
    assert [tuple(r) for r in nested.child_table(df, "id", "items").collect()] == [(1, 0, 5, 6)]
    assert nested.child_table(df, "id", "items").columns == ["id", "pos", "child_id", "x"]


def test_fields_of_children(spark):
    payload = json.dumps({"c": [{"id": 1, "in": {"x": "deep", "y": {"z": 0.5}}}, {"x": None, "in": {"x": "inner"}}, {"x": "outer", "in": {"x": "inner"}}, None, "text"]})
    df = spark.createDataFrame([(1, payload), (2, None), (3, "x")], "pos long, p string")
    got = [tuple(r) for r in nested.explode_json_fields(df, "pos", "p", "c", ["x", "z", "id"]).collect()]
    assert got == [(1, 0, "deep", "0.5", "1"), (1, 1, "inner", None, None), (1, 2, "outer", None, None), (1, 4, None, None, None)]


def test_blocks_cover_everything(spark):
    rows = [(i, json.dumps({"verified_candidates": [{"corpus_id": f"{i}-{j}", "text": "y" * random.randint(0, 4000)} for j in range(3)]})) for i in range(600)]
    df = spark.createDataFrame(rows, "result_id long, payload string")
    got = nested.explode_json(df, "result_id", "payload", "verified_candidates")
    assert got.agg(F.count_distinct("child_key")).first()[0] == 1800


def test_all_arrays_of_a_holder():
    texts = ['{"c":{"supporting":[{"corpus_id":"a"}],"contradicting":[{"corpus_id":"b"},{"corpus_id":"d"}]}}', '{"c":[[{"corpus_id":"a"},[{"corpus_id":"b"}]],{"corpus_id":"d"}]}']
    assert indexed(texts) == [[(0, "a"), (1, "b"), (2, "d")]] * 2


def parses(text):
    def strict(name):
        raise ValueError(name)

    try:
        json.loads(text, parse_constant=strict)
    except ValueError:
        return False
    return True


PIECES = ["{", "}", "[", "]", ",", ":", '"a"', '"', "\\", '"\\u00e9"', '"\\x"', '"\\u12"', "1", "-", "0", "01", "1.5", ".", "1e9", "e", "true", "null", "nul", "tru", "NaN", " ", "\n", "\t", "\x0b", '"b\\""', '"\n"', "{}", "[]", '{"a":1}', "1.", "-0.0E+1", "+1", "12345678901234567890123456789012", "1e", "\x00"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PIECES), max_size=9).map("".join), min_size=1, max_size=8))
def test_validity_agrees_with_parser(texts):
    ix = nested.StructuralIndex([t.encode() for t in texts])
    assert ix.valid.tolist() == [parses(t) for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.recursive(st.one_of(st.none(), st.booleans(), st.integers(), st.floats(allow_nan=False, allow_infinity=False), name), lambda x: st.one_of(st.lists(x, max_size=3), st.dictionaries(name, x, max_size=3)), max_leaves=12), st.integers(0, 60), st.sampled_from("{}[],:\"a1 "))
def test_validity_of_near_misses(value, at, other):
    text = json.dumps(value, ensure_ascii=False)
    changed = text[: at % (len(text) + 1)] + other + text[at % (len(text) + 1) + 1 :]
    assert [nested.valid_json(t.encode()) for t in (text, changed)] == [True, parses(changed)]


def test_deep_text_that_is_broken_has_no_children():
    for tail in ("]" * 4999 + "}]}", "]" * 5000 + "]]}", "]" * 5000 + "}]"):
        assert indexed(['{"c":[{"corpus_id":"a","x":' + "[" * 5000 + tail]) == [[]]


def test_tables_below_children(spark):
    payload = json.dumps({"c": [{"id": 1, "in": {"x": "deep", "y": {"z": 0.5, "n": None}}}, None, {"list": [{"q": 1}], "in": {"x": "b"}}]})
    df = spark.createDataFrame([(1, payload), (2, None), (3, "x"), (4, json.dumps({"c": json.loads(payload)["c"][:1]}))], "id long, p string")
    got = sorted(map(tuple, nested.explode_json_nested(df, "id", "p", "c").collect()))
    assert got == [(1, 0, "in", "x", "deep"), (1, 0, "in.y", "z", "0.5"), (1, 2, "in", "x", "b"), (4, 0, "in", "x", "deep"), (4, 0, "in.y", "z", "0.5")]
