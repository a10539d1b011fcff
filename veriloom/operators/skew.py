"""Joins on keys of which a few may hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A key counts as hot from this share of all rows on; so there are at most SHARE hot keys, which bounds what is collected and broadcast.
SHARE = 1000
#: Rows of one side that one cell of a split key holds.
PER_CELL = 20_000


def hot_rows(counts: DataFrame, column: str, least: int) -> list[Row]:
    """Of keys with their number of rows in ``column`` those with at least 1/SHARE of all (and at least ``least``): never more than SHARE."""
    total = counts.agg(F.sum(column).alias("_total"))
    return counts.filter(F.col(column) >= least).join(F.broadcast(total), F.col(column) * SHARE >= F.col("_total")).drop("_total").collect()


def lookup_join(rows: DataFrame, side: DataFrame, key: str, how: str = "inner", least: int = 10_000) -> DataFrame:
    """Join ``rows`` with ``side``, which has each key once, whatever the skew of ``rows``.

    Rows of hot keys meet a broadcast of the few side rows they need; all others are
    shuffled on the key as usual. ``how`` is inner, left, left_semi or left_anti; rows
    with a null key match nothing.
    """
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    found = hot_rows(counts, "_n", least)
    if not found:
        return rows.join(side, key, how)
    if any(r[key] is None for r in found):  # many nulls: they need no join, but would all meet in one task
        out = _split(rows.filter(F.col(key).isNotNull()), side, key, how, [r for r in found if r[key] is not None])
        nulls = rows.filter(F.col(key).isNull())
        return out.unionByName(nulls, allowMissingColumns=True) if how in ("left", "left_anti") else out
    return _split(rows, side, key, how, found)


def _split(rows: DataFrame, side: DataFrame, key: str, how: str, found: list[Row]) -> DataFrame:
    if not found:
        return rows.join(side, key, how)
    hot = rows.sparkSession.createDataFrame([(r[key],) for r in found], T.StructType([T.StructField(key, rows.schema[key].dataType)]))
    few = F.broadcast(side.join(F.broadcast(hot), key, "left_semi"))
    marked = rows.join(F.broadcast(hot.withColumn("_hot", F.lit(True))), key, "left")
    warm = marked.filter(F.col("_hot").isNull()).drop("_hot")
    top = marked.filter(F.col("_hot").isNotNull()).drop("_hot")
    return warm.join(side, key, how).unionByName(top.join(few, key, how))


def pair_join(left: DataFrame, right: DataFrame, key: str, least: int = 10_000) -> DataFrame:
    """All pairs of rows with equal keys, where a hot key's pairs are spread over a grid of cells.

    A key that holds many rows of both sides is cut into parts of PER_CELL rows on
    either side; each left row is copied to the cells of its part of the grid's rows,
    each right row to those of its column. No pair is lost or made twice.
    """
    sizes = lambda df, name: df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias(name))
    one, two = sizes(left, "_l"), sizes(right, "_r")
    both = one.join(two, key).select(key, "_l", "_r", (F.col("_l") + F.col("_r")).alias("_n"))
    found = hot_rows(both, "_n", least)
    if not found:
        return left.join(right, key)
    grid = left.sparkSession.createDataFrame(
        [(r[key], -(-r["_l"] // PER_CELL), -(-r["_r"] // PER_CELL)) for r in found], T.StructType([T.StructField(key, left.schema[key].dataType), T.StructField("_rows", T.LongType()), T.StructField("_columns", T.LongType())])
    )

    def cells(df: DataFrame, own: str, across: str) -> DataFrame:
        marked = df.join(F.broadcast(grid), key, "left").withColumn("_rows", F.coalesce("_rows", F.lit(1))).withColumn("_columns", F.coalesce("_columns", F.lit(1)))
        place = F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]), F.col(own)).alias(own[:-1])
        return marked.select(*df.columns, place, F.explode(F.sequence(F.lit(0), F.col(across) - 1)).alias(across[:-1]))

    return cells(left, "_rows", "_columns").join(cells(right, "_columns", "_rows"), [key, "_row", "_column"]).drop("_row", "_column")
