"""Validators with recorded reasons, and what groups of rows decide together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_reason(checks: list[tuple[str, Column]]) -> Column:
    """The name of the first check that holds, null if none does: cheap checks go first."""
    out = F
    for name, bad in checks:
        out = out.when(bad, name)
    return out.otherwise(None)


def box_checks(x1: Column, y1: Column, x2: Column, y2: Column, width: int, height: int, large: float = 0.65, small: float = 0.005, thin: float = 0.05, wide: float = 20.0) -> list[tuple[str, Column]]:
    w, h = x2 - x1, y2 - y1
    aspect = F.try_divide(w.cast("double"), h.cast("double"))
    return [
        ("invalid_box", (x1 < 0) | (y1 < 0) | (x2 > width) | (y2 > height) | (x1 >= x2) | (y1 >= y2)),
        ("oversize", w * h >= large * width * height),
        ("too_small", (w <= small * width) | (h <= small * height)),
        ("extreme_aspect", (aspect < thin) | (aspect > wide)),
    ]


def split_rejects(df: DataFrame, reason: str = "reject_reason") -> tuple[DataFrame, DataFrame]:
    return df.where(F.col(reason).isNull()), df.where(F.col(reason).isNotNull())


def drop_groups(df: DataFrame, by: list[str], bad: Column, most_share: float | None = None, most_rows: int | None = None) -> DataFrame:
    """Drops groups with any bad row, or with more than so large a share or so many of them.

    Bad rows are counted by a partial aggregate and joined, so no group has to fit a task.
    """
    n = df.groupBy(*by).agg(F.count("*").alias("__n"), F.sum(bad.cast("int")).alias("__bad"))
    over = F.col("__bad") > 0
    if most_share is not None:
        over = F.col("__bad") > most_share * F.col("__n")
    if most_rows is not None:
        over = F.col("__bad") > most_rows
    return df.join(n.where(over).select(*by), by, "left_anti")


def unique_only(df: DataFrame, by: list[str]) -> DataFrame:
    """Rows whose key nobody else has."""
    return df.withColumn("__n", F.count("*").over(Window.partitionBy(*by))).where("__n = 1").drop("__n")
