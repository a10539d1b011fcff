"""Evidence selection, query aggregates and the decision policy."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shape import top_n


class NotFinite(ValueError):
    """A probability is null, NaN or infinite."""


@dataclass(frozen=True)
class Policy:
    entailment_threshold: float = 0.5
    contradiction_threshold: float = 0.5
    require_margin: float | None = None


def not_finite(p: Column) -> Column:
    return p.isNull() | F.isnan(p) | (F.abs(p) == float("inf"))


def finite(p: Column, present: Column | None = None) -> Column:
    """The probability; the running query fails on a null, NaN or infinite one before any comparison could see it.

    Spark orders NaN above all numbers, so it would pass every threshold. Where
    ``present`` is false there is no candidate and the value is null.
    """
    bad = not_finite(p) if present is None else present & not_finite(p)
    return F.when(bad, F.raise_error(F.concat(F.lit("NotFinite: "), F.coalesce(p.cast("string"), F.lit("null")))).cast("double")).otherwise(p)


def require_finite(df: DataFrame, columns: list[str]) -> None:
    """The same as a check of its own, on the driver, before anything is planned."""
    bad = df.filter(sum((not_finite(F.col(c)).cast("int") for c in columns), F.lit(0)) > 0).limit(1).count()
    if bad:
        raise NotFinite(", ".join(columns))


def select_evidence(candidates: DataFrame, keys: list[str], probability: str, rank: str, item: Column) -> DataFrame:
    """(keys, selected): the candidate with the highest probability; ties go to the better rank."""
    return candidates.groupBy(*keys).agg(F.max_by(item, F.struct(F.col(probability), -F.col(rank))).alias("selected"))


def query_aggregates(candidates: DataFrame, keys: list[str], policy: Policy = Policy(), present: Column | None = None) -> DataFrame:
    """Best and second entailment, their margin, best contradiction and counts above the thresholds.

    Of a key only the two best entailments are kept, before the shuffle as after it.
    Rows for which ``present`` is false stand for a key without candidates.
    """
    there = F.lit(True) if present is None else F.coalesce(present, F.lit(False))
    rows = candidates.select(*keys, finite(F.col("entailment_probability"), there).alias("_ent"), finite(F.col("contradiction_probability"), there).alias("_con"), there.alias("_there"))
    agg = rows.groupBy(*keys).agg(
        F.max("_con").alias("max_con"),
        F.count_if("_there").alias("num_candidates"),
        F.count_if(F.col("_ent") >= policy.entailment_threshold).alias("n_above_ent"),
        F.count_if(F.col("_con") >= policy.contradiction_threshold).alias("n_above_con"),
    )
    best = top_n(rows.select(*keys, "_ent"), keys, [F.desc("_ent")], 2, "_place")
    two = best.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.max("_ent").alias("max_ent"), F.max(F.when(F.col("_place") == 2, F.col("_ent"))).alias("second_ent"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    out = agg.join(two, same).withColumn("margin", F.col("max_ent") - F.col("second_ent"))
    return out.select(*keys, "max_con", "num_candidates", "n_above_ent", "n_above_con", "max_ent", "second_ent", "margin")


def decision(policy: Policy, ent: Column, con: Column, margin: Column) -> Column:
    """Supported, contradicted or abstain; a required margin binds the entailment branch only, and with one candidate it is missing."""
    wide = F.lit(True) if policy.require_margin is None else F.coalesce(margin >= policy.require_margin, F.lit(False))
    supported = (ent >= policy.entailment_threshold) & wide
    return F.when(F.coalesce(supported, F.lit(False)), "SUPPORTED").when(F.coalesce(con >= policy.contradiction_threshold, F.lit(False)), "CONTRADICTED").otherwise("ABSTAIN")


def decide(aggregates: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """Adds decision and confidence; without candidates the decision is to abstain with confidence 0."""
    ent, con = F.col("max_ent"), F.col("max_con")
    out = aggregates.withColumn("decision", decision(policy, ent, con, F.col("margin")))
    sure = F.when(F.col("decision") == "SUPPORTED", ent).when(F.col("decision") == "CONTRADICTED", con).otherwise(F.coalesce(F.greatest(ent, con), F.lit(0.0)))
    return out.withColumn("confidence", sure)


def correction_prompt(question: Column, answer: Column, evidence: Column) -> Column:
    """Asks for a corrected answer from the evidence alone; the evidence texts become a list."""
    listed = F.array_join(F.transform(F.filter(evidence, lambda x: x.isNotNull()), lambda x: F.concat(F.lit("* "), x)), "\n")
    return F.concat(F.lit("Question:\n"), question, F.lit("\n\nEarlier answer:\n"), answer, F.lit("\n\nPassages:\n"), F.when(listed == "", "none were found").otherwise(listed), F.lit("\n\nRewrite the answer so that the passages support all of it. Give the answer only."))


def reason(policy: Policy, decision: Column, ent: Column, con: Column, num: Column) -> Column:
    """Why the policy decided so, with the probability that cleared its threshold."""
    above = lambda what, p, t: F.concat(F.lit(f"{what} "), F.format_string("%.4f", p), F.lit(f" reaches {t}"))
    return (
        F.when(F.coalesce(num, F.lit(0)) == 0, "no candidates")
        .when(decision == "SUPPORTED", above("entailment", ent, policy.entailment_threshold))
        .when(decision == "CONTRADICTED", above("contradiction", con, policy.contradiction_threshold))
        .otherwise("no candidate is sure enough")
    )
