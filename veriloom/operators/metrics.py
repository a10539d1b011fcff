"""Confusion counts, detection and classification measures, calibration, choice scores.

Three conventions for an undefined F1 exist and are kept apart: ``binary_rates`` gives
null where precision or recall is null and 0 where both are 0; ``report`` gives 0 for
every undefined measure; averages over nothing are null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shape import dense, ratio


def confusion(truth: Column, predicted: Column) -> list[Column]:
    return [F.count_if(truth & predicted).alias("tp"), F.count_if(~truth & predicted).alias("fp"), F.count_if(truth & ~predicted).alias("fn"), F.count_if(~truth & ~predicted).alias("tn")]


def f1(p: Column, r: Column) -> Column:
    return F.when(p.isNull() | r.isNull(), F.lit(None)).when(p + r == 0, 0.0).otherwise(2 * p * r / (p + r))


def binary_rates(df: DataFrame, digits: int = 6) -> DataFrame:
    """precision, recall, f1, fpr, fnr, accuracy from tp, fp, fn, tn."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    rates = {"precision": p, "recall": r, "f1": f1(p, r), "fpr": ratio(fp, fp + tn), "fnr": ratio(fn, tp + fn), "accuracy": ratio(tp + tn, tp + fp + fn + tn)}
    return df.select("*", *[F.round(c, digits).alias(n) for n, c in rates.items()])


def detection(df: DataFrame, digits: int = 6) -> DataFrame:
    """Measures of both classes and their mean F1 from tp, fp, fn, tn."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    one = f1(ratio(tp, tp + fp), ratio(tp, tp + fn))
    other = f1(ratio(tn, tn + fn), ratio(tn, tn + fp))
    return df.select("*", F.round(ratio(tp + tn, tp + fp + fn + tn), digits).alias("accuracy"), F.round(one, digits).alias("f1"), F.round(other, digits).alias("f1_other"), F.round((one + other) / 2, digits).alias("macro_f1"))


def report(df: DataFrame, truth: str, predicted: str, by: list[str] | None = None, digits: int = 6) -> DataFrame:
    """(by, label, support, n_predicted, n_correct, precision, recall, f1): every label that occurs on either side; undefined measures are 0."""
    by = by or []
    pairs = df.groupBy(*by, truth, predicted).agg(F.count(F.lit(1)).alias("n"))
    t = pairs.select(*by, F.col(truth).alias("label"), F.col("n").alias("support"), F.lit(0).cast("long").alias("n_predicted"), F.when(F.col(truth) == F.col(predicted), F.col("n")).otherwise(0).alias("n_correct"))
    p = pairs.select(*by, F.col(predicted).alias("label"), F.lit(0).cast("long").alias("support"), F.col("n").alias("n_predicted"), F.lit(0).cast("long").alias("n_correct"))
    out = t.unionAll(p).groupBy(*by, "label").agg(F.sum("support").alias("support"), F.sum("n_predicted").alias("n_predicted"), F.sum("n_correct").alias("n_correct"))
    zero = lambda a, b: F.coalesce(ratio(a, b), F.lit(0.0))
    pr, rc = zero(F.col("n_correct"), F.col("n_predicted")), zero(F.col("n_correct"), F.col("support"))
    return out.select("*", F.round(pr, digits).alias("precision"), F.round(rc, digits).alias("recall"), F.round(zero(2 * pr * rc, pr + rc), digits).alias("f1"))


def reliability(df: DataFrame, confidence: str, correct: str, bins: int = 10, digits: int = 6) -> DataFrame:
    """(bin, n, accuracy, mean_confidence, fraction) of equal bins; empty bins stay."""
    b = F.least(F.floor(F.col(confidence) * bins), F.lit(bins - 1)).cast("long")
    per = df.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(correct).alias("accuracy"), F.avg(confidence).alias("mean_confidence"))
    total = per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("_all"))
    grid = dense(per, "bin", df.sparkSession.range(bins).select(F.col("id").alias("bin")))
    share = F.coalesce(ratio(F.coalesce("n", F.lit(0)), F.col("_all")), F.lit(0.0))
    return grid.join(F.broadcast(total)).select("bin", F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.round("accuracy", digits).alias("accuracy"), F.round("mean_confidence", digits).alias("mean_confidence"), F.round(share, digits).alias("fraction"))


def calibration(df: DataFrame, confidence: str, correct: str, bins: int = 10, digits: int = 6) -> DataFrame:
    """(n, ece, brier, verdict); null over no points."""
    b = F.least(F.floor(F.col(confidence) * bins), F.lit(bins - 1))
    per = df.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(correct).alias("acc"), F.avg(confidence).alias("c"), F.sum(F.pow(F.col(confidence) - F.col(correct), 2)).alias("sq"))
    one = per.agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.abs(F.col("acc") - F.col("c"))).alias("gap"), F.sum("sq").alias("sq"), F.sum(F.when(F.col("c") > F.col("acc"), F.col("n")).otherwise(0)).alias("over"))
    n = F.col("n")
    return one.select("n", F.round(ratio(F.col("gap"), n), digits).alias("ece"), F.round(ratio(F.col("sq"), n), digits).alias("brier"), F.when(ratio(F.col("over"), n) > 0.5, "overconfident").otherwise("not_overconfident").alias("verdict"))


def choice_scores(df: DataFrame, key: str, likelihood: str, place: str, right: str) -> DataFrame:
    """(key, best_right, mass): whether the likeliest choice (ties: the first) is right, and the softmax mass of right choices."""
    top = Window.partitionBy(key)
    e = F.exp(F.col(likelihood) - F.max(likelihood).over(top))
    rows = df.withColumn("_e", e)
    return rows.groupBy(key).agg(F.max_by(right, F.struct(F.col(likelihood), -F.col(place))).alias("best_right"), (F.sum(F.when(F.col(right), F.col("_e")).otherwise(0.0)) / F.sum("_e")).alias("mass"))


def summary(df: DataFrame, truth: str, predicted: str, by: list[str] | None = None, labels: list[str] | None = None, digits: int = 6) -> DataFrame:
    """(by, n, accuracy, macro_f1, weighted_f1): over the given labels, or all that occur on either side; undefined measures are 0, groups without rows have none."""
    by = by or []
    per = report(df, truth, predicted, by, 17)
    if labels is not None:
        per = per.filter(F.col("label").isin(*labels))
    f, n = F.col("f1"), F.col("support")
    macro = F.sum("f1") / (F.lit(float(len(labels))) if labels is not None else F.count(F.lit(1)))
    scores = per.groupBy(*[F.col(b).alias(f"_{b}") for b in by]).agg(F.coalesce(macro, F.lit(0.0)).alias("macro_f1"), F.coalesce(ratio(F.sum(f * n), F.sum(n)), F.lit(0.0)).alias("weighted_f1"))
    rows = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.avg(F.when(F.col(truth) == F.col(predicted), 1.0).otherwise(0.0)), F.lit(0.0)).alias("accuracy"))
    same = F.lit(True)
    for b in by:
        same = same & F.col(b).eqNullSafe(F.col(f"_{b}"))
    r = lambda c: F.round(c, digits).alias(c)
    return rows.join(scores, same).select(*by, "n", r("accuracy"), r("macro_f1"), r("weighted_f1"))


def confusion_matrix(df: DataFrame, truth: str, predicted: str, labels: list[str]) -> DataFrame:
    """(truth, predicted, n) of every pair of labels, none left out."""
    grid = df.sparkSession.createDataFrame([(a, b) for a in labels for b in labels], "truth string, predicted string")
    seen = df.groupBy(F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))
    return F.broadcast(grid).join(seen, ["truth", "predicted"], "left").select("truth", "predicted", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
