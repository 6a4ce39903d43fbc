"""Ordered operators: histories, runs, caps and reproducible choices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def collapsed(items: Column) -> Column:
    """An array without blanks and without repeats of the item before; a blank doesn't part two repeats."""
    filled = F.filter(items, lambda x: F.coalesce(x, F.lit("")) != "")
    return F.filter(filled, lambda x, i: (i == 0) | (x != F.get(filled, i - 1)))


def history(df: DataFrame, by: list[str], order: list[str], item: str, last: int, name: str = "history") -> DataFrame:
    """The last so many distinct steps before each row, numbered from their place in the whole.

    Only rows that change the step are looked back at, through a frame of `last` rows, and
    every row takes the state of the change before it: linear in an episode's length.
    """
    before = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    step = F.when(F.coalesce(item, F.lit("")) != "", F.col(item))
    marked = df.withColumn("__prev", F.last(step, ignorenulls=True).over(before)).withColumn("__new", step.isNotNull() & ~step.eqNullSafe(F.col("__prev")))
    marked = marked.withColumn("__done", F.coalesce(F.sum(F.col("__new").cast("int")).over(before), F.lit(0))).drop("__prev")
    recent = Window.partitionBy(*by).orderBy("__at").rowsBetween(1 - last, 0)
    steps = marked.where("__new").select(*by, (F.col("__done") + 1).alias("__at"), F.col(item).alias("__step")).withColumn("__steps", F.collect_list("__step").over(recent))
    first = F.col("__done") - F.size("__steps") + 1
    numbered = F.transform("__steps", lambda x, i: F.concat(F.lit("Step "), (first + i).cast("string"), F.lit(". "), x))
    joined = marked.join(steps.select(*by, F.col("__at").alias("__done"), "__steps"), [*by, "__done"], "left")
    return joined.withColumn(name, F.coalesce(F.array_join(numbered, " "), F.lit(""))).select(*df.columns, name)


def runs(df: DataFrame, by: list[str], order: list[str], item: str) -> DataFrame:
    """by, item and length of each run of equal consecutive items."""
    all_rows, same = Window.partitionBy(*by).orderBy(*order), Window.partitionBy(*by, item).orderBy(*order)
    keyed = df.withColumn("__run", F.row_number().over(all_rows) - F.row_number().over(same))
    return keyed.groupBy(*by, item, "__run").agg(F.count("*").alias("length")).drop("__run")


def first_of(df: DataFrame, by: list[str], order: list) -> DataFrame:
    """One row of each group, the first in order."""
    return df.withColumn("__rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("__rank = 1").drop("__rank")


def capped(df: DataFrame, by: list[str], order: list, most: int) -> DataFrame:
    return df.withColumn("__rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("__rank") <= most).drop("__rank")


def hash_rank(seed: str, *keys: str) -> Column:
    """A reproducible order: MD5 of seed and keys, the same in any engine."""
    return F.md5(F.concat_ws("|", F.lit(seed), *[F.col(k).cast("string") for k in keys]))


def hash_share(seed: str, *keys: str) -> Column:
    """A reproducible number of 0 to below 1 for each key."""
    return F.conv(F.substring(hash_rank(seed, *keys), 1, 8), 16, 10).cast("double") / float(1 << 32)


def packed(lengths: Column, budget: int) -> Column:
    """For each pair of an ordered array of lengths the number of its sample.

    A sample takes pairs until the next would reach the budget; the last pair always stands
    alone unless it is the only one. One pair longer than the budget is a sample of its own.
    """
    start = F.struct(F.array().cast("array<int>").alias("out"), F.lit(0).alias("sample"), F.lit(0).cast("long").alias("used"), F.lit(0).alias("i"))
    n = F.size(lengths)

    def add(s: Column, x: Column) -> Column:
        close = (s["i"] > 0) & ((s["used"] + x >= budget) | (s["i"] == n - 1))
        sample = F.when(close, s["sample"] + 1).otherwise(s["sample"])
        used = F.when(close, x.cast("long")).otherwise(s["used"] + x)
        return F.struct(F.concat(s["out"], F.array(sample)).alias("out"), sample.alias("sample"), used.alias("used"), (s["i"] + 1).alias("i"))

    return F.aggregate(lengths, start, add, lambda s: s["out"])


def ranked(df: DataFrame, by: list[str], rank: Column, name: str = "rank") -> DataFrame:
    """The place of each row in its group by a hex hash, from 1.

    Groups are cut into 256 blocks by the hash's first two digits and block counts are
    summed, so the rows of one large group are sorted by many tasks.
    """
    keyed = df.withColumn("__hash", rank).withColumn("__block", F.substring("__hash", 1, 2))
    counts = keyed.groupBy(*by, "__block").agg(F.count("*").alias("__n"))
    earlier = Window.partitionBy(*by).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select(*by, "__block", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    inside = F.row_number().over(Window.partitionBy(*by, "__block").orderBy("__hash"))
    return keyed.withColumn("__inside", inside).join(before, [*by, "__block"]).select(*df.columns, (F.col("__before") + F.col("__inside")).alias(name))


def running(df: DataFrame, rank: Column, value: str, name: str) -> DataFrame:
    """The sum of a value over all rows before each, in the order of a hex hash; 0 for the first.

    Totals run inside 4,096 blocks by the hash's first three digits and over the blocks, so no
    task sorts all rows.
    """
    keyed = df.withColumn("__hash", rank).withColumn("__block", F.substring("__hash", 1, 3))
    blocks = keyed.groupBy("__block").agg(F.sum(value).alias("__n"))
    before = blocks.select("__block", F.coalesce(F.sum("__n").over(Window.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    inside = F.coalesce(F.sum(value).over(Window.partitionBy("__block").orderBy("__hash").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return keyed.withColumn("__inside", inside).join(F.broadcast(before), "__block").select(*df.columns, (F.col("__before") + F.col("__inside")).alias(name))


def resampled(df: DataFrame, by: str, rank: Column, target: DataFrame) -> DataFrame:
    """Each class with exactly the target's rows: whole copies, then the first rows by hash. target: by, n, target."""
    placed = ranked(df, [by], rank, "__rank").join(target, by)
    copies = F.floor(F.col("target") / F.col("n")) + (F.col("__rank") <= F.col("target") % F.col("n")).cast("long")
    return placed.withColumn("__copies", copies).where("__copies > 0").select(*df.columns, F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies"))).alias("copy"))
