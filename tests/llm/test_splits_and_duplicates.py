import random

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from veriloom.llm import duplicates, splits

POOL = "record_id long, source_dataset string, source_subset string, source_id string, group_key struct<dataset: string, subset: string, id: string>, member_id string, root string"
EXAMPLES = "example_id long, source_dataset string, source_subset string, source_id string, a string"


def components(edges):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        root[find(a)] = find(b)
    out = {}
    for x in list(root):
        out.setdefault(find(x), set()).add(x)
    return sorted(sorted(c) for c in out.values())


def test_forest_spans_the_components(spark):
    rnd = random.Random(3)
    edges = {(f"v{rnd.randint(0, 60)}", f"v{rnd.randint(0, 60)}") for _ in range(45)} | {(f"c{i}", f"c{i + 1}") for i in range(40)} | {("hub", f"h{i}") for i in range(50)}
    edges = {e for e in edges if e[0] != e[1]}
    forest, labels = splits.spanning_forest(spark.createDataFrame(sorted(edges), "u string, v string"))
    by = {}
    for r in labels.collect():
        by.setdefault(r["root"], set()).add(r["vertex"])
    want = components(edges)
    assert sorted(sorted(c) for c in by.values()) == want
    tree = [(r["u"], r["v"]) for r in forest.collect()]
    assert len(tree) == sum(len(c) - 1 for c in want) and components(tree) == want
    assert all((a, b) in edges or (b, a) in edges for a, b in tree)
    none, labels = splits.spanning_forest(spark.createDataFrame([], "u string, v string"))
    assert none is None and labels.count() == 0


def test_ties_and_one_split_each(spark):
    pool = spark.createDataFrame([
        (5, "fever", " Train", "fever_0012", ("fever", "train", "12"), "x", "y"), (3, "fever", "train", "13.0", ("fever", "train", "12"), None, None), (9, "fever", "TRAIN", "13", None, None, None),
        (1, "fever", "train", "ID", ("fever", "train", " "), None, None), (2, "fever", "train", None, None, None, None), (4, None, "train", "12", None, None, None), (6, "other", "train", "12", ("other", "train", "12"), None, None), (6, "other", "train", "12", None, None, None),
    ], POOL)
    examples = spark.createDataFrame([(5, "fever", "train", "qa-13-x", "z"), (7, "fever", "train", "99", None), (8, "fever", "train", "99", None), (9, "fever", None, "13", None)], EXAMPLES)
    got = sorted(tuple(r) for r in splits.tied_members(pool, examples).collect())
    assert got == [(3, "pool_records", 5), (3, "pool_records", 9), (3, "verifier_examples", 5)]
    rows = splits.assign_splits(pool, examples).collect()
    assert len(rows) == 12
    assert len({r["split"] for r in rows if (r["member_table"], r["member_id"]) in {("pool_records", 3), ("pool_records", 5), ("pool_records", 9), ("verifier_examples", 5)}}) == 1
    empty = splits.tied_members(pool.limit(0), examples.limit(0))
    assert empty.count() == 0 and splits.assign_splits(pool.limit(0), examples.limit(0)).count() == 0


def test_shares_are_met_with_a_hot_group(spark):
    from pyspark.sql import functions as F

    ids = spark.range(3000)
    number = F.when(F.col("id") < 1000, F.lit(0)).otherwise(F.col("id"))
    pool = ids.select(F.col("id").alias("record_id"), F.lit("d").alias("source_dataset"), F.lit("s").alias("source_subset"), number.cast("string").alias("source_id"), F.struct(F.lit("d").alias("dataset"), F.lit("s").alias("subset"), number.cast("string").alias("id")).alias("group_key"))
    examples = spark.createDataFrame([], EXAMPLES)
    rows = splits.assign_splits(pool, examples, {"train": 0.7, "validation": 0.1, "test": 0.2}, per_deal=500).collect()
    per = {}
    for r in rows:
        per.setdefault(r["group_root"], set()).add(r["split"])
    assert len(per) == 2001 and all(len(v) == 1 for v in per.values())
    n = {s: sum(v == {s} for v in per.values()) / len(per) for s in ("train", "validation", "test")}
    assert abs(n["train"] - 0.7) < 0.02 and abs(n["validation"] - 0.1) < 0.02 and abs(n["test"] - 0.2) < 0.02


RECORDS = "record_id long, hypothesis string, label string, premise_text string, premise_reference string, class string, key string"
TEXTS, JSONS = ["hypothesis", "label", "premise_text"], ["premise_reference"]


def test_copies(spark):
    rows = [
        (4, "Ab, c!", "x", None, '[{"b":1,"a":"q"}]', "k", "k"), (2, "a b C", "X.", None, '[ {"a": "q", "b": 1} ]', None, None), (3, "abc", "x", "", '[{"a":"q","b":1}]', None, None), (5, "abc", "x", "!", '[{"a":"q","b":1}]', None, None),
        (6, "abd", "x", None, '[{"a":"q","b":1}]', None, None), (7, "acb", "x", None, '[{"a":"q","b":1}]', None, None), (8, None, None, None, None, None, None), (9, None, None, None, None, None, None), (10, "", None, None, None, None, None),
        (11, "abc", "x", None, "broken", None, None), (12, "Abc", "x", None, "broken", None, None), (13, "STRASSE", "x", None, None, None, None), (14, "straße", "x", None, None, None, None), (15, "y" * 300_000, "x", None, None, None, None), (16, "Y" * 300_000 + ".", "x", None, None, None, None),
    ]
    df = spark.createDataFrame(rows, RECORDS)
    assert sorted(map(tuple, duplicates.surplus(df, "record_id", TEXTS, JSONS).collect())) == [(2, 4), (3, 5), (8, 9), (11, 12), (13, 14), (15, 16)]
    assert sum(r["copies"] for r in duplicates.collapsed(df, "record_id", TEXTS, JSONS).collect()) == len(rows)
    assert duplicates.surplus(df.limit(0), "record_id", TEXTS, JSONS).count() == 0


def test_a_third_of_all_rows_alike(spark):
    from pyspark.sql import functions as F

    df = spark.range(30_000).select(F.col("id").alias("record_id"), F.when(F.col("id") % 3 == 0, "Same text.").otherwise(F.concat(F.lit("t"), F.col("id"))).alias("hypothesis"), F.lit("x").alias("label"), F.lit(None).cast("string").alias("premise_text"), F.lit("[]").alias("premise_reference"))
    got = duplicates.surplus(df, "record_id", TEXTS, JSONS)
    assert got.count() == 9_999 and got.select("kept_id").distinct().collect()[0][0] == 0


def test_a_component_that_holds_half_of_all_rows(spark):
    """A star of 24,000 leaves beside as many rows without ties: the hub and the root are hot keys."""
    from pyspark.sql import functions as F

    leaves = spark.range(24_000).select(F.concat(F.lit("leaf"), F.col("id")).alias("u"), F.lit("hub").alias("v"))
    pairs = spark.range(12_000).select(F.concat(F.lit("a"), F.col("id")).alias("u"), F.concat(F.lit("b"), F.col("id")).alias("v"))
    forest, labels = splits.spanning_forest(leaves.unionAll(pairs))
    sizes = labels.groupBy("root").count()
    assert forest.count() == 36_000
    assert sizes.filter("count = 24001").count() == 1 and sizes.filter("count = 2").count() == 12_000


def test_invariants_never_part_copies(spark):
    """What the costly key calls equal must be equal for the cheap one, special capitals included."""
    from pyspark.sql import functions as F

    rnd = random.Random(5)
    special = "ßŉǰẖẗẘẙẚﬀﬁﬂﬃﬄﬅﬆſıİK\u0345éÉœŒΣσς"
    rows = []
    for i in range(400):
        t = "".join(rnd.choice("aAeEoOcCsStTfFiIlLkK 1.-" + special) for _ in range(12))
        twin = "".join(rnd.choice((c, c.lower() if len(c.lower()) == 1 else c, c + rnd.choice((" ", ".", "")))) for c in t)
        rows += [(i, t), (i, twin), (i, t.upper())]
    df = spark.createDataFrame(rows, "i long, t string").select("i", duplicates.bare(F.col("t")).alias("bare"), duplicates.invariant([F.col("t")]).alias("cheap"))
    assert df.groupBy("bare").agg(F.count_distinct("cheap").alias("n")).filter("n > 1").count() == 0


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(keys=st.lists(st.integers(-(2**63), 2**63 - 1), min_size=1, max_size=12))
def test_the_bitmap_loses_no_shared_key(spark, keys):
    rows = spark.createDataFrame([(k, i) for i, k in enumerate([*keys, *keys[:3]])], "k long, i long")
    shared = {k for k in keys if [*keys, *keys[:3]].count(k) > 1}
    got = {r["k"] for r in duplicates.in_shared(rows, "k", duplicates.shared_bits(rows, "k")).collect()}
    assert shared <= got
