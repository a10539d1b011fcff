import json

from pyspark.sql import types as T

from veriloom.sources import tables
from veriloom.streaming import feed

SCHEMA = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.StringType())])


def test_json_forms(spark, tmp_path):
    lines, array = tmp_path / "l.json", tmp_path / "a.json"
    lines.write_text('{"a":1,"b":"x"}\n\n{"a":2}\nbroken\n')
    array.write_text(json.dumps([{"a": 1}, {"a": 2, "b": "y"}], indent=1))
    got, bad = tables.sniff_json(spark, str(lines), SCHEMA)
    assert [r["line"] for r in bad.collect()] == ["broken"] and sorted(r["a"] for r in got.collect()) == [1, 2]
    got, bad = tables.sniff_json(spark, str(array), SCHEMA)
    assert bad.count() == 0 and sorted(r["a"] for r in got.collect()) == [1, 2]
    one, many = tmp_path / "o.json", tmp_path / "m.json"
    one.write_text('\n{\n "a": 7,\n "b": "z"\n}\n')
    many.write_text('{"a":3}\n{"a":4}\n[5]\n{"a":6}\n')
    empty = tmp_path / "e.json"
    empty.write_text("\n \n")
    got, bad = tables.sniff_json(spark, [str(p) for p in (array, one, many, empty)], SCHEMA)
    assert sorted(r["a"] for r in got.collect()) == [1, 2, 3, 4, 6, 7] and [r["line"] for r in bad.collect()] == ["[5]"]


def test_configuration(tmp_path, monkeypatch):
    import pytest

    from veriloom import config

    text = "a: 1\nb:\n  c: 'x'  \n  d: [1, two]\n  e:\n    - 1.5\n    - true\nf: null # none\n"
    (tmp_path / "c.yaml").write_text(text)
    want = {"a": 1, "b": {"c": "x", "d": [1, "two"], "e": [1.5, True]}, "f": None}
    assert config.load(tmp_path / "c.yaml", ("b.c",)) == want == config.read_plain_yaml(text)
    monkeypatch.setattr(config, "yaml", None)
    assert config.load(tmp_path / "c.yaml") == want and config.load(config.DEFAULT, ("retrieval.top_k",))["split"] == {"dev_share": 0.1}
    (tmp_path / "l.yaml").write_text("- 1\n- 2\n")
    for name, required in (("l.yaml", ()), ("c.yaml", ("b.missing",))):
        with pytest.raises(config.ConfigError):
            config.load(tmp_path / name, required)


def test_code_state():
    from pathlib import Path

    from veriloom.sources import tables

    assert set(tables.code_state(str(Path(__file__).parent))) == {"commit", "branch", "changed"}
    assert tables.code_state("/") == {"commit": None, "branch": None, "changed": None}


def test_many_files_skip_hidden_ones(spark, tmp_path):
    for name in ("one.jsonl", "._one.jsonl", "sub/two.jsonl"):
        p = tmp_path / name
        p.parent.mkdir(exist_ok=True)
        p.write_text('{"a":1}\n')
    assert tables.read_many_json_lines(spark, str(tmp_path), SCHEMA).count() == 2


def test_csv_keeps_quoted_breaks(spark, tmp_path):
    p = tmp_path / "t.csv"
    p.write_text('q,a\n"one\ntwo","say ""hi"""\n')
    assert [tuple(r) for r in tables.read_csv_header(spark, str(p)).collect()] == [("one\ntwo", 'say "hi"')]


def test_round_trips(spark, tmp_path):
    df = spark.createDataFrame([(1, "é"), (2, None)], SCHEMA)
    tables.write_json_lines(df, str(tmp_path / "j"))
    assert sorted(map(tuple, tables.read_json_lines(spark, str(tmp_path / "j"), SCHEMA).drop("_corrupt_record").collect())) == [(1, "é"), (2, None)]
    tables.write_csv_report(df, str(tmp_path / "c"))
    assert tables.read_csv_header(spark, str(tmp_path / "c")).count() == 2


def test_stream_decides_as_a_batch_does(spark, tmp_path, data):
    source = tmp_path / "in"
    attempts = spark.read.parquet(f"{data}/attempt_records.parquet").select("attempt_id", "evidence")
    attempts.repartition(3).write.parquet(str(source))
    q = feed.decide_stream(spark, str(source), attempts.schema, str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination(60)
    want = sorted(map(tuple, feed.decide_attempts(attempts).collect()))
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).select("attempt_id", "decision", "confidence").collect())) == want


def test_tables_cut_lineage(spark):
    from veriloom.session import written

    df = written(spark.range(5).toDF("x"))
    assert df.count() == 5 and "FileScan" in df._jdf.queryExecution().executedPlan().toString()


def test_first_place_that_exists(spark, tmp_path):
    import pytest

    (tmp_path / "b").mkdir()
    assert tables.first_available(spark, [str(tmp_path / "a"), str(tmp_path / "b")]).endswith("/b")
    with pytest.raises(tables.NoSource):
        tables.first_available(spark, [str(tmp_path / "a")])


def test_bar_chart():
    import xml.etree.ElementTree as E

    drawn = E.fromstring(tables.bar_chart([("a < b", 2.0), ("c", 4.0), ("d", 0.0)], "t & u"))
    bars = [float(x.get("width")) for x in drawn.iter("{http://www.w3.org/2000/svg}rect")]
    assert bars[1] == 2 * bars[0] and bars[2] == 0 and E.fromstring(tables.bar_chart([], "none")) is not None
