"""Arithmetic on scores and vectors, as expressions of the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def softmax_of_two(a: Column, b: Column) -> Column:
    """The share of ``a``; the larger is subtracted first, so neither overflows."""
    top = F.greatest(a, b)
    return F.exp(a - top) / (F.exp(a - top) + F.exp(b - top))


def log_softmax(logits: Column) -> Column:
    """The logarithm of the softmax of an array, in order."""
    top = F.array_max(logits)
    total = F.ln(F.aggregate(logits, F.lit(0.0), lambda s, x: s + F.exp(x - top)))
    return F.transform(logits, lambda x: x - top - total)


def max_abs_diff(a: Column, b: Column) -> Column:
    """The largest difference of two vectors of one length."""
    return F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))))


def allclose(a: Column, b: Column, rtol: float = 1e-5, atol: float = 1e-8) -> Column:
    """Whether all numbers agree within ``atol`` and ``rtol`` of the second; vectors of different length do not."""
    near = F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double")) <= atol + rtol * F.abs(y.cast("double")))
    return (F.size(a) == F.size(b)) & F.forall(near, lambda x: F.coalesce(x, F.lit(False)))


def training_steps(examples: Column, batch: int, accumulation: int, epochs: int, warmup: float) -> Column:
    """struct(steps_per_epoch, total_steps, warmup_steps) for a number of examples: a last batch that is not full counts as a step, there is at least one."""
    per_epoch = F.greatest(F.lit(1), F.ceil(examples / F.lit(batch * accumulation))).cast("long")
    total = per_epoch * epochs
    return F.struct(per_epoch.alias("steps_per_epoch"), total.alias("total_steps"), F.floor(total * F.lit(warmup)).cast("long").alias("warmup_steps"))
