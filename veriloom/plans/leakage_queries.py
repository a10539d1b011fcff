"""The training pool: overlaps, exclusion, splits, manifests and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import leakage as L
from ..operators import shape as S
from ..operators.skew import pair_join
from .registry import query
from .shape_queries import label_sql
from .text_queries import norm_sql

GROUP = "concat_ws('|', source_dataset, trim(lower(source_subset), ' '), coalesce(group_key.id, source_id, CAST(record_id AS VARCHAR)))"


def _group():
    return F.concat_ws("|", "source_dataset", F.trim(F.lower("source_subset")), F.coalesce("group_key.id", "source_id", F.col("record_id").cast("string")))


def _norm_set(column: str, where: str, source: str = "pool_records") -> str:
    return f"(SELECT DISTINCT norm FROM (SELECT {norm_sql(column)} AS norm FROM {source} WHERE {where}) WHERE norm <> '')"


def _overlap_sql(left: str, right: str, columns: list[str], right_source: str = "pool_records") -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS field, count(a.norm) AS n_left, count(b.norm) AS n_right, count(CASE WHEN a.norm = b.norm THEN 1 END) AS n_shared FROM {_norm_set(c, left)} a FULL JOIN {_norm_set(c, right, right_source)} b ON a.norm = b.norm" for c in columns)


@query("JN9 ST2 ST4", _overlap_sql("split = 'train'", "split = 'test'", ["hypothesis", "premise_text"]))
def overlap_counts(t):
    p = t("pool_records")
    return L.overlap_counts(p.filter("split = 'train'"), p.filter("split = 'test'"), ["hypothesis", "premise_text"])


@query("JN9", _overlap_sql("true", "true", ["hypothesis", "label"], "verifier_examples"))
def contamination_sweep(t):
    return L.overlap_counts(t("pool_records"), t("verifier_examples"), ["hypothesis", "label"])


@query("JN6 SO5", f"""
SELECT a.norm, a.record_id, b.example_id FROM (SELECT {norm_sql('hypothesis')} AS norm, record_id FROM pool_records WHERE split <> 'train') a JOIN (SELECT {norm_sql('hypothesis')} AS norm, example_id FROM verifier_examples) b ON a.norm = b.norm WHERE a.norm <> ''""")
def contamination_audit(t):
    norm = T.normalize_text(F.col("hypothesis")).alias("norm")
    a = t("pool_records").filter("split <> 'train'").select(norm, "record_id").filter("norm <> ''")
    return pair_join(a, t("verifier_examples").select(norm, "example_id").filter("norm <> ''"), "norm").select("norm", "record_id", "example_id")


@query("JN6", f"""
WITH a AS (SELECT {norm_sql('hypothesis')} AS norm, count(*) AS n_pool FROM pool_records WHERE split <> 'train' GROUP BY 1), b AS (SELECT {norm_sql('hypothesis')} AS norm, count(*) AS n_examples FROM verifier_examples GROUP BY 1)
SELECT md5(a.norm) AS class, n_pool, n_examples FROM a JOIN b ON a.norm = b.norm WHERE a.norm <> ''""")
def contamination_classes(t):
    """The shared texts by digest with their number of rows on either side: what an audit needs where a text is repeated too often to list its pairs."""
    n = lambda df, name: df.select(F.md5(T.normalize_text(F.col("hypothesis")).cast("binary")).alias("class"), T.normalize_text(F.col("hypothesis")).alias("norm")).filter("norm <> ''").groupBy("class").agg(F.count(F.lit(1)).alias(name))
    return n(t("pool_records").filter("split <> 'train'"), "n_pool").join(n(t("verifier_examples"), "n_examples"), "class")


@query("JN7 JN8 VA12", f"""
WITH p AS (SELECT record_id, split, {norm_sql('hypothesis')} AS norm FROM pool_records)
SELECT record_id, norm IN (SELECT norm FROM p WHERE split <> 'train') AS excluded FROM p WHERE split = 'train'""")
def contamination_exclude(t):
    p = t("pool_records").select("record_id", "split", T.normalize_text(F.col("hypothesis")).alias("norm"))
    kept, aside = L.exclude(p.filter("split = 'train'"), p.filter("split <> 'train'"), "norm")
    return kept.select("record_id", F.lit(False).alias("excluded")).unionAll(aside.select("record_id", F.lit(True).alias("excluded")))


@query("AG12", f"SELECT g, count(DISTINCT split) AS n_splits, count(*) AS n FROM (SELECT {GROUP} AS g, split FROM pool_records) GROUP BY g HAVING count(DISTINCT split) > 1")
def split_leakage(t):
    rows = t("pool_records").select(_group().alias("g"), "split")
    return rows.groupBy("g").agg(F.count_distinct("split").alias("n_splits"), F.count(F.lit(1)).alias("n")).filter("n_splits > 1")


@query("ST3", "SELECT 'sentences' AS only_in, page_id FROM (SELECT page_id FROM sentences WHERE page_id IS NOT NULL EXCEPT SELECT page_id FROM documents) UNION ALL SELECT 'documents', page_id FROM (SELECT page_id FROM documents WHERE page_id IS NOT NULL EXCEPT SELECT page_id FROM sentences)")
def set_difference(t):
    a, b = (t(n).filter("page_id IS NOT NULL").select("page_id").distinct() for n in ("sentences", "documents"))
    only = lambda x, y, name: x.join(y, "page_id", "left_anti").select(F.lit(name).alias("only_in"), "page_id")
    return only(a, b, "sentences").unionAll(only(b, a, "documents"))


@query("PR10 ST1", f"""
SELECT record_id, hypothesis, 'fever' AS origin, {label_sql('label')} AS clean_label FROM pool_records WHERE source_dataset = 'fever' AND premise_text IS NOT NULL AND {label_sql('label')} IN ('entailment', 'contradiction')
UNION ALL SELECT record_id, hypothesis, 'halueval', {label_sql('label')} FROM pool_records WHERE source_dataset = 'halueval' AND hypothesis IS NOT NULL""")
def pool_build(t):
    p = t("pool_records").withColumn("clean_label", T.clean_label(F.col("label")))
    cols = lambda df, origin: df.select("record_id", "hypothesis", F.lit(origin).alias("origin"), "clean_label")
    claims = p.filter((F.col("source_dataset") == "fever") & F.col("premise_text").isNotNull() & F.col("clean_label").isin("entailment", "contradiction"))
    return cols(claims, "fever").unionByName(cols(p.filter("source_dataset = 'halueval' AND hypothesis IS NOT NULL"), "halueval"))


@query("PR14", "SELECT concat_ws('.', source_dataset, trim(lower(source_subset), ' ')) AS source, count(*) AS n, count(CASE WHEN premise IS NULL OR hypothesis IS NULL THEN 1 END) AS n_excluded FROM verifier_examples GROUP BY 1")
def pool_usable_stats(t):
    source = F.concat_ws(".", "source_dataset", F.trim(F.lower("source_subset")))
    return t("verifier_examples").groupBy(source.alias("source")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("premise").isNull() | F.col("hypothesis").isNull()).alias("n_excluded"))


_CHECKS = {
    "hypothesis_present": f"{norm_sql('hypothesis')} = ''", "premise_flag_consistent": "coalesce(premise_text_available, false) <> (premise_text IS NOT NULL)",
    "label_known": f"coalesce({label_sql('label')} NOT IN ('entailment', 'contradiction', 'neutral'), true)", "group_key_present": "group_key IS NULL", "provenance_allowed": "coalesce(source_dataset NOT IN ('fever', 'halueval'), true)", "source_id_present": "source_id IS NULL",
}


@query("VA8 VA9 VA16", " UNION ALL ".join(f"SELECT '{name}' AS check_name, count(*) AS violations, CASE WHEN count(*) = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM pool_records WHERE {broken}" for name, broken in _CHECKS.items()))
def pool_validate(t):
    p, label = t("pool_records"), T.clean_label(F.col("label"))
    broken = {
        "hypothesis_present": T.normalize_text(F.col("hypothesis")) == "", "premise_flag_consistent": F.coalesce("premise_text_available", F.lit(False)) != F.col("premise_text").isNotNull(),
        "label_known": F.coalesce(~label.isin("entailment", "contradiction", "neutral"), F.lit(True)), "group_key_present": F.col("group_key").isNull(),
        "provenance_allowed": F.coalesce(~F.col("source_dataset").isin("fever", "halueval"), F.lit(True)), "source_id_present": F.col("source_id").isNull(),
    }
    one = p.agg(F.array(*[F.struct(F.lit(n).alias("check_name"), F.count_if(b).alias("violations")) for n, b in broken.items()]).alias("m"))
    return one.select(F.inline("m")).withColumn("status", F.when(F.col("violations") == 0, "PASS").otherwise("FAIL"))


@query("AG13", f"SELECT count(CASE WHEN {label_sql('label')} NOT IN ('entailment', 'contradiction') THEN 1 END) AS n_not_binary, count(CASE WHEN premise IS NULL THEN 1 END) AS n_no_premise, count(*) AS n FROM verifier_examples")
def safety_guard_violations(t):
    return t("verifier_examples").agg(F.count_if(~T.clean_label(F.col("label")).isin("entailment", "contradiction")).alias("n_not_binary"), F.count_if(F.col("premise").isNull()).alias("n_no_premise"), F.count(F.lit(1)).alias("n"))


@query("AG6", "SELECT source_dataset, split, count(*) AS n FROM pool_records GROUP BY ALL")
def role_boundary_counts(t):
    return t("pool_records").groupBy("source_dataset", "split").agg(F.count(F.lit(1)).alias("n"))


_SPLIT = f"""WITH r AS (SELECT record_id, {GROUP} AS g FROM pool_records), k AS (SELECT g, row_number() OVER (ORDER BY md5('42|' || g), g) AS i, count(*) OVER () AS n FROM (SELECT DISTINCT g FROM r)),
parts AS (SELECT record_id, g, CASE WHEN i <= greatest(1, CAST(floor(n * 0.1) AS BIGINT)) THEN 'dev' ELSE 'train' END AS part FROM r JOIN k USING (g))"""


@query("SO2 SO3", f"{_SPLIT} SELECT record_id, part FROM parts")
def group_split(t):
    return L.group_split(t("pool_records").select("record_id", "source_dataset", "source_subset", "group_key", "source_id"), _group(), 0.1).select("record_id", "part")


@query("VA10 VA11", f"{_SPLIT} SELECT count(*) AS n_groups, count(CASE WHEN n > 1 THEN 1 END) AS n_split_groups FROM (SELECT g, count(DISTINCT part) AS n FROM parts GROUP BY g)")
def split_disjointness(t):
    rows = L.group_split(t("pool_records").select("record_id", "source_dataset", "source_subset", "group_key", "source_id").withColumn("g", _group()), F.col("g"), 0.1)
    return rows.groupBy("g").agg(F.count_distinct("part").alias("n")).agg(F.count(F.lit(1)).alias("n_groups"), F.count_if(F.col("n") > 1).alias("n_split_groups"))


@query("PR8", "SELECT record_id, split FROM pool_records WHERE split IN ('dev', 'test') AND premise_text_available")
def split_filter(t):
    return t("pool_records").filter("split IN ('dev', 'test') AND premise_text_available").select("record_id", "split")


@query("AG5 VA14", f"""
SELECT n_entailment, n_contradiction, n_neutral, CASE WHEN n_entailment = 0 OR n_contradiction = 0 THEN 'invalid' WHEN n_neutral = 0 THEN 'binary' ELSE 'three_way' END AS mode FROM (SELECT {", ".join(f"count(CASE WHEN {label_sql('label')} = '{x}' THEN 1 END) AS n_{x}" for x in ("entailment", "contradiction", "neutral"))} FROM pool_records)""")
def label_space_status(t):
    label = T.clean_label(F.col("label"))
    n = t("pool_records").agg(*[F.count_if(label == x).alias(f"n_{x}") for x in ("entailment", "contradiction", "neutral")])
    return n.withColumn("mode", F.when((F.col("n_entailment") == 0) | (F.col("n_contradiction") == 0), "invalid").when(F.col("n_neutral") == 0, "binary").otherwise("three_way"))


@query("AG6", f"SELECT clean_label, count(*) AS n, round(100.0 * count(*)::DOUBLE / sum(count(*)) OVER (), 2) AS percent FROM (SELECT {label_sql('label')} AS clean_label FROM verifier_examples) GROUP BY clean_label")
def label_distribution(t):
    per = t("verifier_examples").groupBy(T.clean_label(F.col("label")).alias("clean_label")).agg(F.count(F.lit(1)).alias("n"))
    total = per.agg(F.sum("n").alias("all"))
    return per.join(F.broadcast(total)).select("clean_label", "n", F.round(F.lit(100.0) * F.col("n") / F.col("all"), 2).alias("percent"))


_TABLES = {"sentences": "row_id", "pool_records": "record_id", "verifier_examples": "example_id", "documents": "doc_id", "eval_items": "item_id"}


@query("AG49", " UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS n, count(DISTINCT {k}) AS n_keys, min({k}) AS first_key, max({k}) AS last_key FROM {n}" for n, k in _TABLES.items()))
def dataset_manifest(t):
    out = None
    for n, k in _TABLES.items():
        row = t(n).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(k).alias("n_keys"), F.min(k).alias("first_key"), F.max(k).alias("last_key")).select(F.lit(n).alias("table_name"), "n", "n_keys", "first_key", "last_key")
        out = row if out is None else out.unionAll(row)
    return out


@query("WN8 WN9", f"SELECT record_id, clean_label, r AS place FROM (SELECT record_id, {label_sql('label')} AS clean_label, CAST(row_number() OVER (PARTITION BY {label_sql('label')} ORDER BY record_id) AS INTEGER) AS r FROM pool_records WHERE hypothesis IS NOT NULL) WHERE r <= 5")
def stratified_first_n(t):
    rows = t("pool_records").filter("hypothesis IS NOT NULL").select("record_id", T.clean_label(F.col("label")).alias("clean_label"))
    return S.top_n(rows, ["clean_label"], [F.col("record_id")], 5, "place")


@query("WN11", "SELECT response_id, min(analysis_id) AS analysis_id FROM rag_error_analysis GROUP BY response_id ORDER BY response_id LIMIT 100")
def limit_by_key(t):
    return t("rag_error_analysis").groupBy("response_id").agg(F.min("analysis_id").alias("analysis_id")).orderBy("response_id").limit(100)
