"""Relational shapes that recur: which duplicate wins, ranks, percentiles by index, dense grids."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_wins(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of rows with equal keys (null equals null) the one with the smallest ``order``."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(order)).alias("_row"))
    return best.select(*keys, *[F.col("_row")[c].alias(c) for c in rest]).select(*df.columns)


def last_wins(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_row"))
    return best.select(*keys, *[F.col("_row")[c].alias(c) for c in rest]).select(*df.columns)


def one_key(*columns: str) -> Column:
    """Several columns as one text in which null equals null only."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def top_n(df: DataFrame, by: list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """The first n rows of each group; Spark limits the groups before the shuffle."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= n)


def order_statistics(df: DataFrame, keys: list[str], value: str, places: dict[str, tuple[float, Callable[[Column], Column]]], accuracy: int = 10_000) -> DataFrame:
    """For each name the exact value at a place (counted from 0) of the sorted values of a group.

    A place is given as its share of the group and as a function of the group's size. An
    approximate percentile sketch first brackets it; only the few values inside the
    bracket are then sorted, so no task sorts a whole group. Nulls are left out.
    """
    rows = df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_v"))
    margin = 2.0 / accuracy
    ends = [x for share, _ in places.values() for x in (max(0.0, share - margin), min(1.0, share + margin))]
    stats = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.percentile_approx("_v", ends, accuracy).alias("_b"))
    stats = stats.select(*[F.col(k).alias(f"_{k}") for k in keys], "_n", "_b")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    joined = rows.join(stats, same) if keys else rows.join(F.broadcast(stats))
    wanted = [F.struct(F.lit(name).alias("name"), F.col("_b")[2 * i].alias("lo"), F.col("_b")[2 * i + 1].alias("hi"), place(F.col("_n")).alias("place")) for i, (name, (_, place)) in enumerate(places.items())]
    near = joined.select(*keys, "_v", F.explode(F.array(*wanted)).alias("w")).filter("_v <= w.hi")
    # Values below the bracket only count; they share a null.
    counts = near.groupBy(*keys, F.col("w.name").alias("_name"), F.col("w.place").alias("_place"), F.when(F.col("_v") >= F.col("w.lo"), F.col("_v")).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    upto = F.sum("_c").over(Window.partitionBy(*keys, "_name").orderBy(F.asc_nulls_first("_v")))
    found = counts.withColumn("_upto", upto).filter(F.col("_upto") > F.col("_place"))
    return found.groupBy(*keys).agg(*[F.min(F.when(F.col("_name") == name, F.col("_v"))).alias(name) for name in places])


def index_percentiles(df: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """For each name in ``shares`` the value at place floor(n * share) of the sorted values, counted from 0."""
    at = lambda s: lambda n: F.least(F.floor(n * F.lit(s)), n - 1)
    return order_statistics(df, keys, value, {name: (s, at(s)) for name, s in shares.items()})


def medians(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, median): the mean of the two middle values."""
    two = order_statistics(df, keys, value, {"_low": (0.5, lambda n: F.floor((n - 1) / 2)), "_high": (0.5, lambda n: F.floor(n / 2))})
    return two.select(*keys, ((F.col("_low") + F.col("_high")) / 2).alias("median"))


def hashed_sample(df: DataFrame, key: str, n: int) -> DataFrame:
    """About ``n`` rows, never more than twice as many, chosen by a hash of ``key``; all rows if there are no more than ``n``.

    Each task passes on its share only, so what reaches the driver does not grow with the number of tasks.
    """
    total = df.select(key).count()
    if total <= n:
        return df
    parts = 1 << 40
    return df.filter(F.pmod(F.xxhash64(key), F.lit(parts)) < F.lit(int(parts * n / total))).limit(2 * n)


def dense(df: DataFrame, key: str, values: DataFrame) -> DataFrame:
    """All key values of a small grid, whether rows exist or not."""
    return F.broadcast(values).join(df, key, "left")


def md5_order(*parts: Column) -> Column:
    """A fixed pseudo-random order that any engine can reproduce."""
    return F.md5(F.concat_ws("|", *parts).cast("binary"))


def ratio(a: Column, b: Column) -> Column:
    """Null where the denominator is 0."""
    return a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0))
