"""Files written and read back in every format, page scans, stored vectors, and what is written down about them.

Each query writes a table into the shared folder in one format and gives back what a reader of that format finds there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..operators import claims as C
from ..operators import index as I
from ..operators import retrieval as R
from ..session import scratch, written
from ..sources import tables as S
from .registry import query
from .retrieval_queries import CORPUS
from .shape_queries import REFS, label_sql
from .text_queries import norm_sql


def _schema(text: str) -> T.StructType:
    return T.StructType.fromDDL(text)


def folder(df: DataFrame, name: str) -> str:
    return scratch(df.sparkSession, name)


_CLAIMS = T.StructType([T.StructField("record_id", T.LongType()), T.StructField("hypothesis", T.StringType()), T.StructField("label", T.StringType())])


@query("SC1 SK1", "SELECT record_id, hypothesis, label FROM pool_records")
def json_lines_scan(t):
    df = t("pool_records").select("record_id", "hypothesis", "label")
    S.write_json_lines(df, path := folder(df, "claims"))
    return S.read_json_lines(df.sparkSession, path, _CLAIMS).filter("_corrupt_record IS NULL").select("record_id", "hypothesis", "label")


@query("SC2", "SELECT generation_id, user_input, generated_text FROM generation_results")
def json_lines_named_json(t):
    """JSON Lines in files that end on .json."""
    df = t("generation_results").select("generation_id", "user_input", "generated_text")
    S.write_json_lines(df, path := folder(df, "pairs"))
    schema = "generation_id long, user_input string, generated_text string"
    return S.read_json_lines(df.sparkSession, f"{path}/*.json", _schema(schema)).select("generation_id", "user_input", "generated_text")


@query("SC3", "SELECT a.attempt_id, a.run_id, r.n AS n_results FROM attempt_records a LEFT JOIN (SELECT run_id, attempt_number, count(*) AS n FROM pipeline_results GROUP BY ALL) r ON r.run_id = a.run_id AND r.attempt_number = a.attempt_number")
def json_lines_of_two_tables(t):
    """Responses and their sources from two JSON Lines files, joined."""
    a, r = t("attempt_records").select("attempt_id", "run_id", "attempt_number"), t("pipeline_results").select("result_id", "run_id", "attempt_number")
    found = []
    for df, name in ((a, "responses"), (r, "sources")):
        S.write_json_lines(df, path := folder(df, name))
        found.append(S.read_json_lines(df.sparkSession, path, df.schema).drop("_corrupt_record"))
    per = found[1].groupBy("run_id", "attempt_number").agg(F.count(F.lit(1)).alias("n_results"))
    return found[0].join(per, ["run_id", "attempt_number"], "left").select("attempt_id", "run_id", "n_results")


@query("SC4 SK4", "SELECT CAST(analysis_id AS VARCHAR) AS analysis_id, nullif(category, '') AS category, nullif(answer_preview, '') AS answer_preview FROM rag_error_analysis")
def csv_scan(t):
    """A table with quotes and line breaks as CSV; a CSV file knows no difference between an empty value and none."""
    df = t("rag_error_analysis").select("analysis_id", "category", "answer_preview")
    S.write_csv(df, path := folder(df, "errors"))
    return S.read_csv_header(df.sparkSession, path)


@query("SC5", "SELECT item_id, benchmark, split, text FROM eval_items")
def json_array_scan(t):
    """A bounded table, the evaluation items, as one JSON array."""
    df = t("eval_items").select("item_id", "benchmark", "split", "text")
    S.write_json_array(df, path := folder(df, "items"))
    return S.read_json_array(df.sparkSession, path, df.schema)


@query("SC6", """
SELECT 'broken' AS kind, count(*) AS n FROM pipeline_results WHERE payload IS NOT NULL AND NOT CASE WHEN json_valid(payload) THEN json_type(payload) = 'OBJECT' ELSE false END
UNION ALL SELECT 'records', count(*) FROM pipeline_results WHERE CASE WHEN json_valid(payload) THEN json_type(payload) = 'OBJECT' ELSE false END UNION ALL SELECT 'items', count(*) FROM eval_items""")
def sniffed_files(t):
    """A folder that holds payload lines, some of them broken, beside a file with one JSON array: each file is read in its own format."""
    lines, items = t("pipeline_results").filter("payload IS NOT NULL").select(F.translate("payload", "\n\r", "  ").alias("value")), t("eval_items").select("item_id")
    path = folder(lines, "mixed")
    lines.write.text(f"{path}/lines")
    S.write_json_array(items, f"{path}/array")
    records, bad = S.sniff_json(lines.sparkSession, [f"{path}/lines", f"{path}/array"], _schema("query string, item_id long"))
    per = records.groupBy(F.when(F.col("item_id").isNotNull(), "items").otherwise("records").alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    return per.unionByName(bad.agg(F.lit("broken").alias("kind"), F.count(F.lit(1)).alias("n")))


@query("SC7 FN3", """
SELECT page_id, sentence_id, text FROM sentences WHERE page_id IS NOT NULL AND sentence_id IS NOT NULL AND text IS NOT NULL AND NOT contains(text, chr(9)) AND NOT contains(text, chr(10))""")
def wiki_files_scan(t):
    """Pages as JSON Lines files below a folder, each line with its number, a tab and its text; files left by archivers are passed over."""
    s = t("sentences").filter("page_id IS NOT NULL AND sentence_id IS NOT NULL AND text IS NOT NULL").filter("NOT (contains(text, '\t') OR contains(text, '\n'))")
    spark = s.sparkSession
    path = folder(s, "wiki")
    # Lines of a page go to files in parts, as a page may hold a tenth of all rows.
    pages = s.select("page_id", F.concat(F.col("sentence_id").cast("string"), F.lit("\t"), "text").alias("line"), F.floor(F.col("row_id") / 50).alias("part"))
    S.write_json_lines(pages.groupBy("page_id", "part").agg(F.array_join(F.collect_list("line"), "\n").alias("lines")).select("page_id", "lines"), f"{path}/shards")
    S.write_json_lines(spark.createDataFrame([("hidden", "0\tnever read")], "page_id string, lines string").coalesce(1), f"{path}/._shards")
    found = S.read_many_json_lines(spark, path, _schema("page_id string, lines string"), "json")
    lines = found.select("page_id", F.explode(F.split("lines", "\n")).alias("line")).filter("line <> ''").select("page_id", X.wiki_line(F.col("line")).alias("w"))
    return lines.filter("NOT w.malformed").select("page_id", F.col("w.sentence_id").alias("sentence_id"), F.col("w.sentence").alias("text"))


_SCOPE = f"""scope AS (SELECT DISTINCT r.page_id FROM refs r JOIN pool_records p ON p.record_id = r.record_id WHERE {label_sql('p.label')} IN ('entailment', 'contradiction') AND r.page_id <> '')"""


def cited_pages(t):
    """The pages that any evidence set of a decided claim cites."""
    decided = t("pool_records").filter(X.clean_label(F.col("label")).isin("entailment", "contradiction"))
    return C.evidence_references(decided, "record_id", "premise_reference").filter(C.has_evidence(F.col("page_id"))).select("page_id").distinct()


@query("SC9 JN16 PR17", f"WITH {REFS}, {CORPUS}, {_SCOPE} SELECT corpus_id, page_id, sentence_id, text FROM corpus WHERE page_id IN (SELECT page_id FROM scope)")
def corpus_of_cited_pages(t):
    """The corpus of the cited pages only: a semi-join before texts are grouped, in page and sentence order."""
    inside = t("sentences").join(cited_pages(t), "page_id", "left_semi")
    return R.corpus(inside).select("corpus_id", "page_id", "sentence_id", "text").orderBy("page_id", "sentence_id")




@query("SC10 SC11 UD9", "SELECT vec_id AS id, round(embedding[1], 6) AS first, round(embedding[len(embedding)], 6) AS last FROM embeddings")
def stored_vectors(t):
    """Vectors saved with their manifest and loaded again; a wrong model, dimension or number of ids raises."""
    df = t("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    I.save(df, path := folder(df, "index"), "given")
    found = I.load(df.sparkSession, path, "given", df)
    return found.select("id", F.round(F.element_at("vector", 1), 6).alias("first"), F.round(F.element_at("vector", -1), 6).alias("last"))


@query("VA7", """
WITH e AS (SELECT vec_id, len(embedding) AS d FROM embeddings), r AS (SELECT doc_id, text FROM documents)
SELECT (SELECT count(*) FROM e) - (SELECT count(*) FROM r) AS count_difference, (SELECT count(*) FROM e WHERE d <> 64) AS n_other_dimension, (SELECT count(*) - count(DISTINCT vec_id) FROM e) AS n_double_ids,
(SELECT count(*) FROM r WHERE """ + norm_sql("text") + """ = '') AS n_blank, (SELECT count(*) FROM e ANTI JOIN r ON vec_id = doc_id) AS n_without_record, (SELECT count(*) FROM r ANTI JOIN e ON vec_id = doc_id) AS n_without_vector""")
def index_validate(t):
    """Vectors held against a record table, here the documents: numbers, dimension, double ids, blank texts, ids on one side only."""
    vectors = t("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return I.validate(vectors, t("documents").select(F.col("doc_id").alias("id"), "text"), 64)


@query("VA15 IT11", f"WITH {CORPUS} SELECT count(*) AS n, CAST(0 AS BIGINT) AS n_only_first, CAST(0 AS BIGINT) AS n_only_second FROM corpus")
def corpus_built_twice(t):
    """Two builds of the corpus from differently ordered input: what each has alone."""
    s = t("sentences")
    a, b = written(R.corpus(s), "first"), written(R.corpus(s.repartition(7, "text")), "second")
    return I.apart(a, b)


@query("SK2", "SELECT attempt_number AS round, attempt_id, step16_decision AS decision FROM attempt_records WHERE attempt_number IS NOT NULL")
def appended_rounds(t):
    """Rows appended round after round, each round a write of its own that replaces only itself when it is run again."""
    df = t("attempt_records").filter("attempt_number IS NOT NULL").select(F.col("attempt_number").alias("round"), "attempt_id", F.col("step16_decision").alias("decision"))
    path = folder(df, "rounds")
    for number in [r["round"] for r in df.select("round").distinct().collect()]:  # a loop has few rounds
        for _ in range(2):  # a round that is repeated leaves no row twice
            S.append_round(df.filter(F.col("round") == number).drop("round"), path, number)
    return S.read_rounds(df.sparkSession, path, "attempt_id long, decision string").select("round", "attempt_id", "decision")


@query("SK3", f"SELECT 'pool_records' AS table_name, count(*) AS n, count(DISTINCT {label_sql('label')}) AS n_labels FROM pool_records")
def json_report(t):
    """A report of one row, written as one JSON file and read again."""
    df = t("pool_records").agg(F.lit("pool_records").alias("table_name"), F.count(F.lit(1)).alias("n"), F.count_distinct(X.clean_label(F.col("label"))).alias("n_labels"))
    S.write_json_report(df, path := folder(df, "report"))
    return S.read_json_array(df.sparkSession, path, df.schema)


@query("SK7 FN15", "SELECT source, count(*) AS n_files, CAST(sum(octet_length(encode(text))) AS BIGINT) AS n_bytes, count(DISTINCT sha256(text)) AS n_contents FROM (SELECT coalesce(source, '') AS source, text FROM documents WHERE text IS NOT NULL) GROUP BY source")
def content_manifest(t):
    """Digests of contents with the state of the code that made them: rows per source; the state is given by ``tables.code_state``."""
    rows = t("documents").filter("text IS NOT NULL").select(F.coalesce("source", F.lit("")).alias("source"), F.octet_length("text").cast("long").alias("b"), F.sha2("text", 256).alias("d"))
    return rows.groupBy("source").agg(F.count(F.lit(1)).alias("n_files"), F.sum("b").alias("n_bytes"), F.count_distinct("d").alias("n_contents"))


@query("SC12 SC13", "SELECT count(*) AS n, count(CASE WHEN e.entailment_probability >= 0.6 THEN 1 END) AS n_above FROM (SELECT unnest(evidence) AS e FROM attempt_records) WHERE e IS NOT NULL")
def configured_threshold(t):
    """The threshold of the packaged YAML configuration, applied to all evidence."""
    from .. import config

    settings = config.load(config.DEFAULT, ("policy.entailment_threshold", "retrieval.top_k"))
    items = t("attempt_records").select(F.explode("evidence").alias("e")).filter("e IS NOT NULL")
    return items.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("e.entailment_probability") >= settings["policy"]["entailment_threshold"]).alias("n_above"))


@query("SC14", "SELECT record_id, hypothesis FROM pool_records WHERE split = 'test'")
def acquired_table(t):
    """A table taken from the first place that has it; a place that does not exist is passed over."""
    df = t("pool_records").filter("split = 'test'").select("record_id", "hypothesis")
    spark = df.sparkSession
    df.write.parquet(path := folder(df, "mirror"))
    return spark.read.parquet(S.first_available(spark, [f"{path}-not-there", path]))


@query("SK6", "SELECT task_type AS label, CAST(count(*) AS VARCHAR) AS value FROM rag_error_analysis WHERE task_type IS NOT NULL GROUP BY task_type")
def figure_of_tasks(t):
    """A bar chart of the analysed responses by task, written as SVG and read back: its labels and values."""
    per = t("rag_error_analysis").filter("task_type IS NOT NULL").groupBy("task_type").agg(F.count(F.lit(1)).alias("n"))
    S.write_figure(per, path := folder(per, "figure"), "task_type", "n", "Analysed responses by task")
    bars = per.sparkSession.read.text(path).filter("value LIKE '%<rect %'")
    cut = lambda n: F.regexp_extract("value", r"^<text[^>]*>([^<]*)</text><rect[^>]*/><text[^>]*>([^<]*)</text>$", n)
    return bars.select(cut(1).alias("label"), cut(2).alias("value"))
