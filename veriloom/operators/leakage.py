"""Overlap between sets of records, exclusion, and deterministic splits by group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize_text
from .shape import md5_order


class RoleViolation(ValueError):
    """A source is used in a role it is not allowed to have."""


def require_roles(requested: set[str], allowed: set[str]) -> None:
    wrong = sorted(requested - allowed)
    if wrong:
        raise RoleViolation(f"not allowed in training: {', '.join(wrong)}")


def texts(df: DataFrame, column: str) -> DataFrame:
    """Distinct normalised texts, without empty ones."""
    return df.select(normalize_text(F.col(column)).alias("norm")).filter("norm <> ''").distinct()


def overlap_counts(left: DataFrame, right: DataFrame, columns: list[str]) -> DataFrame:
    """(field, n_left, n_right, n_shared) of normalised texts for each column."""
    out = None
    for c in columns:
        a, b = texts(left, c).withColumn("l", F.lit(1)), texts(right, c).withColumn("r", F.lit(1))
        row = a.join(b, "norm", "full").agg(F.count("l").alias("n_left"), F.count("r").alias("n_right"), F.count_if(F.col("l").isNotNull() & F.col("r").isNotNull()).alias("n_shared"))
        row = row.select(F.lit(c).alias("field"), "n_left", "n_right", "n_shared")
        out = row if out is None else out.unionAll(row)
    return out


def exclude(df: DataFrame, blocked: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose key is not blocked, and those kept aside for the audit."""
    keys = blocked.select(key).distinct()
    return df.join(keys, key, "left_anti"), df.join(keys, key, "left_semi")


def group_split(df: DataFrame, group: Column, share: float, seed: int = 42) -> DataFrame:
    """Adds ``part`` (dev or train): whole groups, the first max(1, floor(n * share)) in a fixed pseudo-random order.

    Only the hash value at that place is searched for, by counting per leading hash
    digits first, so no task orders all groups.
    """
    rows = df.withColumn("_g", group)
    keys = rows.select("_g").distinct().withColumn("_h", md5_order(F.lit(str(seed)), F.col("_g")))
    heads = {r["p"]: r["n"] for r in keys.groupBy(F.substring("_h", 1, 3).alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}  # at most 4096 rows
    want = max(1, int(sum(heads.values()) * share))
    before, head = 0, None
    for head in sorted(heads):
        if before + heads[head] >= want:
            break
        before += heads[head]
    if head is None:
        return df.withColumn("part", F.lit("train"))
    limit = keys.filter(F.substring("_h", 1, 3) == head).select("_h").orderBy("_h").limit(want - before).agg(F.max("_h").alias("_limit"))
    picked = rows.withColumn("_h", md5_order(F.lit(str(seed)), F.col("_g"))).join(F.broadcast(limit))
    return picked.withColumn("part", F.when(F.col("_h") <= F.col("_limit"), "dev").otherwise("train")).drop("_g", "_h", "_limit")


class UnsafeRecords(ValueError):
    """Records that must not be trained on are among those chosen."""


def require_safe(df: DataFrame, rules: dict[str, Column]) -> None:
    """Raises if any row breaks a rule; all rules are counted in one pass, before the rows are used."""
    counts = df.agg(*[F.count_if(broken).alias(name) for name, broken in rules.items()]).first().asDict()
    broken = {name: n for name, n in counts.items() if n}
    if broken:
        raise UnsafeRecords(", ".join(f"{name}: {n}" for name, n in broken.items()))


def guarded(df: DataFrame, rules: dict[str, Column], key: Column) -> DataFrame:
    """The same rows; the running query fails on the first row that breaks a rule, naming the rule and the row's ``key``.

    The check is part of the plan, so it costs no pass of its own and nothing downstream sees a row that breaks it.
    """
    holds = F.lit(True)
    for name, broken in reversed(rules.items()):
        holds = F.when(F.coalesce(broken, F.lit(False)), F.raise_error(F.concat(F.lit(f"{name}: "), F.coalesce(key.cast("string"), F.lit("null")))).cast("boolean")).otherwise(holds)
    return df.filter(holds)


# Sources that may be trained on, and those that never may.
ALLOWED = (("fever", "train"), ("halueval", "qa"), ("halueval", "dialogue"), ("halueval", "summarization"))
FORBIDDEN = ("ragtruth", "truthfulqa")
TRAINED_LABELS = ("entailment", "contradiction")
# End of fixed values.


def source_group(dataset: Column, subset: Column) -> Column:
    """The group a record's measures are broken down by: halueval by subset, any other source as a whole."""
    return F.when(dataset == "halueval", F.concat_ws(".", dataset, F.lower(F.trim(subset)))).otherwise(dataset)


def allowed_source(dataset: Column, subset: Column) -> Column:
    named = F.concat_ws(".", dataset, F.lower(F.trim(subset)))
    return F.coalesce(named.isin(*[".".join(p) for p in ALLOWED]), F.lit(False))


def training_rules(dataset: Column, subset: Column, contaminated: Column) -> dict[str, Column]:
    """What no record of a training pool may be."""
    return {"forbidden source": dataset.isin(*FORBIDDEN), "unknown source": ~allowed_source(dataset, subset), "contaminated record": contaminated}


def training_pool(df: DataFrame, requested: list[tuple[str, str]], contaminated: Column, key: Column, exclude_contamination: bool = True) -> DataFrame:
    """Rows of the requested sources; raises at once if one of them may not be trained on, and in the plan on any unsafe row."""
    require_roles({".".join(r) for r in requested}, {".".join(p) for p in ALLOWED})
    named = F.concat_ws(".", "source_dataset", F.lower(F.trim("source_subset")))
    rows = df.filter(named.isin(*[".".join(r) for r in requested]))
    if exclude_contamination:
        rows = rows.filter(~contaminated)
    return guarded(rows, training_rules(F.col("source_dataset"), F.col("source_subset"), contaminated), key)


def one_split_each(df: DataFrame, group: str, split: str) -> DataFrame:
    """(group, split) with one row each; the running query fails on a group that stands in several splits."""
    per = df.groupBy(group).agg(F.count_distinct(split).alias("_splits"), F.min(split).alias(split))
    return guarded(per, {"group in several splits": F.col("_splits") > 1}, F.col(group)).select(group, split)
