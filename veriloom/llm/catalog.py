"""Registry of the queries on training data."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table
from . import confusables, duplicates, leakage, overlap, packing, pairs, residue, splits
from .oracles import ORACLES

Query = Callable[[SparkSession, str], DataFrame]

CLAIM = ["hypothesis", "label", "premise_text"]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return splits.tied_members(table(spark, d, "pool_records"), table(spark, d, "verifier_examples"))


def p1_splits(spark: SparkSession, d: str) -> DataFrame:
    return splits.assign_splits(table(spark, d, "pool_records"), table(spark, d, "verifier_examples"))


def _text_values(spark: SparkSession, d: str) -> DataFrame:
    own = confusables.values(table(spark, d, "sentences"), "sentences", "row_id", ["text"])
    return own.unionAll(confusables.values(table(spark, d, "pool_records"), "pool_records", "record_id", ["hypothesis", "premise_text"]))


def p1_forest(spark: SparkSession, d: str) -> DataFrame:
    """The spanning forest that ties the items: its edges."""
    rows = splits.members(table(spark, d, "pool_records"), table(spark, d, "verifier_examples"))
    forest, _ = splits.spanning_forest(rows.filter("b IS NOT NULL").select(F.col("a").alias("u"), F.col("b").alias("v")))
    return forest if forest is not None else spark.createDataFrame([], "u string, v string")


def p1_check(spark: SparkSession, d: str) -> DataFrame:
    """Rows, groups, groups that stand in several splits, and whether every split has its share of the groups within a hundredth."""
    rows = p1_splits(spark, d)
    groups = rows.groupBy("group_root").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("split").alias("splits"), F.min("split").alias("split"))
    share = lambda name, want: F.abs(F.count_if(F.col("split") == name) / F.count(F.lit(1)) - want) <= 0.01
    return groups.agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_groups"), F.count_if(F.col("splits") > 1).alias("n_torn"), (share("train", 0.8) & share("validation", 0.1) & share("test", 0.1)).alias("shares_met"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return confusables.deviating(_text_values(spark, d))


def p2_canonical(spark: SparkSession, d: str) -> DataFrame:
    return confusables.consistent(_text_values(spark, d))


def p2_look_alikes(spark: SparkSession, d: str) -> DataFrame:
    return confusables.look_alike_classes(_text_values(spark, d))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return duplicates.surplus(table(spark, d, "pool_records"), "record_id", CLAIM, ["premise_reference"])


def p3_collapsed(spark: SparkSession, d: str) -> DataFrame:
    return duplicates.collapsed(table(spark, d, "pool_records"), "record_id", CLAIM, ["premise_reference"])


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return pairs.defects(table(spark, d, "generation_results"), table(spark, d, "documents"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return overlap.found(table(spark, d, "pool_records"), table(spark, d, "rag_error_analysis"))


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    return overlap.report(table(spark, d, "pool_records"), table(spark, d, "rag_error_analysis"))


def p6_links(spark: SparkSession, d: str) -> DataFrame:
    return overlap.link_table(table(spark, d, "pool_records"), table(spark, d, "rag_error_analysis"))


def p6_members(spark: SparkSession, d: str) -> DataFrame:
    return overlap.membership(table(spark, d, "pool_records"), table(spark, d, "rag_error_analysis"))


def p7_packed(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(packing.token_counts(table(spark, d, "documents")))


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.containers(p7_packed(spark, d))


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    """Containers, tokens and the share of space left."""
    return packing.fill_report(p7_packed(spark, d))


def p7_check(spark: SparkSession, d: str) -> DataFrame:
    """Documents packed, those whose pieces are missing or double, and containers that hold too much."""
    packed = p7_packed(spark, d)
    pieces = packed.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("piece").alias("d"), F.max("piece").alias("last"))
    docs = pieces.agg(F.count(F.lit(1)).alias("n_documents"), F.count_if((F.col("n") != F.col("d")) | (F.col("last") + 1 != F.col("n"))).alias("n_torn"))
    return docs.join(F.broadcast(packing.containers(packed).agg(F.count_if(F.col("free") < 0).alias("n_overfull"))))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    return leakage.report(p8_found(spark, d), table(spark, d, "eval_items"))


def p8_paraphrases(spark: SparkSession, d: str) -> DataFrame:
    return leakage.paraphrased(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return residue.residue(table(spark, d, "documents")).select("doc_id").distinct()


def p9_kinds(spark: SparkSession, d: str) -> DataFrame:
    return residue.residue(table(spark, d, "documents"))


def p9_kept(spark: SparkSession, d: str) -> DataFrame:
    """The documents without residue."""
    documents = table(spark, d, "documents")
    return documents.select("doc_id").join(residue.residue(documents).select("doc_id").distinct(), "doc_id", "left_anti")


def queries() -> dict[str, Query]:
    return {name: f for name, f in globals().items() if name.startswith("p") and name[1].isdigit()}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
