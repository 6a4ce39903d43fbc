"""Metrics as numerator, denominator and ratio, so that they can be summed again."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(num: Column, den: Column) -> Column:
    """Rounded to six digits; null without a denominator."""
    return F.round(F.try_divide(num.cast("double"), den.cast("double")), 6)


def count_if(flag: Column) -> Column:
    return F.coalesce(F.sum(flag.cast("long")), F.lit(0)).cast("long")


def confusion(truth: Column, guess: Column) -> list[Column]:
    """tp, fp, fn and tn of two boolean columns."""
    return [count_if(truth & guess).alias("tp"), count_if(~truth & guess).alias("fp"), count_if(truth & ~guess).alias("fn"), count_if(~truth & ~guess).alias("tn")]


def precision_recall(tp: Column, fp: Column, fn: Column) -> dict[str, Column]:
    return {"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": ratio(2 * tp, 2 * tp + fp + fn)}
