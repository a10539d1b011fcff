import pytest
from pyspark.sql import functions as F

from veriloom import config
from veriloom.operators import decide, index, leakage, scorers
from veriloom.plans import catalog, runner


def test_config(tmp_path):
    (tmp_path / "a.toml").write_text("[retrieval]\nk = 20\n")
    (tmp_path / "b.json").write_text("[1]")
    (tmp_path / "c.json").write_text("{")
    assert config.load(tmp_path / "a.toml", ("retrieval.k",)) == {"retrieval": {"k": 20}}
    for name, required in (("a.toml", ("retrieval.n",)), ("b.json", ()), ("c.json", ())):
        with pytest.raises(config.ConfigError):
            config.load(tmp_path / name, required)


def test_index_is_checked(spark, tmp_path):
    df = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(5)], "id long, vector array<float>")
    path = str(tmp_path / "ix")
    index.save(df, path, "m")
    assert index.same_rows(index.load(spark, path, "m", df), df)
    for make in (lambda: index.load(spark, path, "other"), lambda: index.load(spark, path, "m", df.limit(4)), lambda: (df.limit(4).write.mode("overwrite").parquet(f"{path}/vectors"), index.load(spark, path))):
        with pytest.raises(index.IndexMismatch):
            make()
    assert not index.same_rows(df, df.unionAll(df.limit(1)))


def test_unsafe_records_raise(spark):
    df = spark.createDataFrame([(1, None), (2, "x")], "id int, p string")
    leakage.require_safe(df, {"negative": F.col("id") < 0})
    with pytest.raises(leakage.UnsafeRecords, match="no_premise: 1"):
        leakage.require_safe(df, {"no_premise": F.col("p").isNull(), "negative": F.col("id") < 0})


def test_reasons(spark):
    p = decide.Policy(0.6, 0.6)
    df = spark.createDataFrame([("SUPPORTED", 0.9, 0.1, 2), ("CONTRADICTED", 0.2, 0.8, 1), ("ABSTAIN", 0.5, 0.5, 1), ("ABSTAIN", None, None, 0)], "d string, e double, c double, n int")
    got = [r[0] for r in df.select(decide.reason(p, F.col("d"), F.col("e"), F.col("c"), F.col("n"))).collect()]
    assert got == ["entailment 0.9000 reaches 0.6", "contradiction 0.8000 reaches 0.6", "no candidate is sure enough", "no candidates"]


def test_generation_keeps_failures(spark):
    def make():
        def model(prompt):
            if prompt == "bad":
                raise RuntimeError
            return prompt.upper()

        return model

    df = spark.createDataFrame([(1, "a b"), (2, "bad")], "id long, prompt string")
    got = {r["id"]: (r["generated_text"], r["generated_tokens"], r["error"]) for r in scorers.generate(df, "id", "prompt", make).collect()}
    assert got == {1: ("A B", 2, None), 2: (None, 0, "RuntimeError")}
    scored = df.select(scorers.choice_likelihood(F.col("prompt"), F.col("prompt"), lambda q, c: [-1.0] * len(c.split())).alias("s")).collect()
    assert [(r["s"]["total"], r["s"]["per_token"]) for r in scored] == [(-2.0, -1.0), (-1.0, -1.0)]
    assert scorers.chat_prompt("q", "i") == "system: i\nuser: q\nassistant:"


def test_stages(spark, tmp_path, data, capsys):
    known = catalog.queries()
    assert all(n in known for names in runner.STAGES.values() for n in names)
    assert runner.chosen(start="loop") == ["loop", "report"] and runner.chosen(only="pool") == ["pool"] and "loop" not in runner.chosen(fast=True)
    with pytest.raises(ValueError):
        runner.chosen(only="none")
    runner.main([data, str(tmp_path), "--only", "manifest", "--dry-run"])
    assert "dataset_manifest" in capsys.readouterr().out
    runner.run(spark, data, str(tmp_path), ["manifest"], say=lambda _: None)
    assert spark.read.parquet(str(tmp_path / "manifest" / "dataset_manifest")).count() == 5


def test_rebuilding_gives_the_same_rows(spark, data):
    q = catalog.queries()["pool_build"]
    assert index.same_rows(q(spark, data), q(spark, data))


def test_pairs_of_hot_keys_meet_once_over_a_grid(spark, monkeypatch):
    from pyspark.sql import functions as F

    from veriloom.operators import skew

    monkeypatch.setattr(skew, "PER_CELL", 40)
    rows = lambda n, name: spark.range(n).select(F.when(F.col("id") < 100, "hot").when(F.col("id") % 50 == 0, F.lit(None)).otherwise(F.concat(F.lit("k"), F.col("id"))).alias("k"), F.col("id").alias(name))
    left, right = rows(300, "a"), rows(250, "b")
    want = sorted(map(tuple, left.join(right, "k").collect()))
    assert sorted(map(tuple, skew.pair_join(left, right, "k", least=50).collect())) == want
    assert sorted(map(tuple, skew.pair_join(left, right, "k").collect())) == want


def test_a_cluster_without_a_shared_folder_is_refused():
    import pytest

    from veriloom import session

    class Context:
        master = "spark://somewhere:7077"

        def getConf(self):
            return {}

    class Session:
        conf = {}
        sparkContext = Context()

    with pytest.raises(session.NoSharedFolder):
        session.shared_dir(Session())
    Session.sparkContext.master = "local[4]"
    assert session.shared_dir(Session()).startswith("file:")
