"""Vectors with their ids as Parquet, a manifest beside them, and the checks before they are searched."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import is_blank


class IndexMismatch(ValueError):
    """Vectors, records and manifest do not belong together."""


def save(vectors: DataFrame, path: str, model: str) -> None:
    """Writes (id, vector) and a manifest of their number, dimension and model."""
    vectors.select("id", "vector").write.mode("overwrite").parquet(f"{path}/vectors")
    stored = vectors.sparkSession.read.parquet(f"{path}/vectors")
    manifest = stored.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vector")).alias("dimension")).withColumn("model", F.lit(model))
    manifest.coalesce(1).write.mode("overwrite").json(f"{path}/manifest")


def load(spark: SparkSession, path: str, model: str | None = None, records: DataFrame | None = None) -> DataFrame:
    """(id, vector); raises if the manifest disagrees, if another model made the vectors or if records (by id) are out of step."""
    vectors = spark.read.parquet(f"{path}/vectors")
    manifest = spark.read.schema("n long, dimension int, model string").json(f"{path}/manifest").first()
    if model is not None and manifest["model"] != model:
        raise IndexMismatch(f"vectors of {manifest['model']} searched with {model}")
    found = vectors.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("ids"), F.count_if(F.size("vector") != manifest["dimension"]).alias("odd")).first()
    if found["n"] != manifest["n"] or found["ids"] != found["n"] or found["odd"]:
        raise IndexMismatch(f"{found['n']} vectors, {found['ids']} ids, {found['odd']} of another dimension; the manifest has {manifest['n']}")
    if records is not None:
        apart = vectors.select("id").join(records.select("id"), "id", "left_anti").count() + records.select("id").join(vectors.select("id"), "id", "left_anti").count()
        if apart:
            raise IndexMismatch(f"{apart} ids stand on one side only")
    return vectors


def validate(vectors: DataFrame, records: DataFrame, dimension: int) -> DataFrame:
    """One row: how many more vectors than records, vectors of another dimension, double ids, blank texts, ids without a record or a vector."""
    own = vectors.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.size("vector") != dimension).alias("n_other_dimension"), (F.count(F.lit(1)) - F.count_distinct("id")).alias("n_double_ids"))
    other = records.agg(F.count(F.lit(1)).alias("m"), F.count_if(is_blank(F.col("text"))).alias("n_blank"))
    # Both sides once over: how often an id stands on each.
    sides = vectors.select("id", F.lit(1).alias("v"), F.lit(0).alias("r")).unionAll(records.select("id", F.lit(0), F.lit(1))).groupBy("id").agg(F.sum("v").alias("v"), F.sum("r").alias("r"))
    alone = sides.agg(F.coalesce(F.sum(F.when(F.col("r") == 0, F.col("v"))), F.lit(0)).alias("n_without_record"), F.coalesce(F.sum(F.when(F.col("v") == 0, F.col("r"))), F.lit(0)).alias("n_without_vector"))
    every = own.join(F.broadcast(other)).join(F.broadcast(alone))
    return every.select((F.col("n") - F.col("m")).alias("count_difference"), "n_other_dimension", "n_double_ids", "n_blank", "n_without_record", "n_without_vector")


def apart(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: rows of ``a``, and how many rows each table holds more often than the other (by digest, so no wide row is shuffled)."""
    digest = F.sha2(F.to_json(F.struct(*sorted(a.columns)), {"ignoreNullFields": "false"}), 256)
    side = lambda df, x, y: df.select(digest.alias("d"), F.lit(x).alias("a"), F.lit(y).alias("b"))
    per = side(a, 1, 0).unionAll(side(b, 0, 1)).groupBy("d").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    more = lambda x, y: F.coalesce(F.sum(F.greatest(F.col(x) - F.col(y), F.lit(0))), F.lit(0)).cast("long")
    return per.agg(F.coalesce(F.sum("a"), F.lit(0)).cast("long").alias("n"), more("a", "b").alias("n_only_first"), more("b", "a").alias("n_only_second"))


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Whether two tables hold the same rows equally often."""
    found = apart(a, b.select(*a.columns)).first()
    return not found["n_only_first"] and not found["n_only_second"]
