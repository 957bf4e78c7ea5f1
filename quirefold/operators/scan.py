"""Running values over long ordered groups, in two levels.

A plain window sorts a whole group in one task, which a group that holds a third of all rows does
not allow. Here each group is cut into blocks by its position; a window runs within each block, and
a second one over the blocks' summaries, a few thousandth of the rows, which are joined back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 4096


def _block(at: str, size: int) -> Column:
    return F.floor(F.col(at) / F.lit(size)).cast("long")


def running_sum(df: DataFrame, group: str, at: str, value: Column, name: str, size: int = BLOCK) -> DataFrame:
    """df with the sum of value over the rows of its group up to and with its own, by at; at must be unique within the group."""
    # one exchange serves the window, the block sums and their join
    rows = df.withColumn("__v", value).withColumn("__b", _block(at, size)).repartition(group, "__b")
    inner = Window.partitionBy(group, "__b").orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    sums = rows.groupBy(group, "__b").agg(F.sum("__v").alias("__s"))
    outer = Window.partitionBy(group).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.withColumn("__before", F.coalesce(F.sum("__s").over(outer), F.lit(0))).drop("__s")
    return rows.withColumn("__r", F.sum("__v").over(inner)).join(before, [group, "__b"]).withColumn(name, F.col("__r") + F.col("__before")).drop("__v", "__b", "__r", "__before")


def carry_forward(df: DataFrame, group: str, at: str, value: Column, name: str, size: int = BLOCK) -> DataFrame:
    """df with the last value that is not null at or before each row of its group, by at; null before the first."""
    rows = df.withColumn("__v", value).withColumn("__b", _block(at, size)).repartition(group, "__b")
    inner = Window.partitionBy(group, "__b").orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    lasts = rows.where("__v is not null").groupBy(group, "__b").agg(F.max_by("__v", at).alias("__l"))
    blocks = rows.select(group, "__b").distinct().join(lasts, [group, "__b"], "left")
    outer = Window.partitionBy(group).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    before = blocks.withColumn("__before", F.last("__l", ignorenulls=True).over(outer)).drop("__l")
    return rows.withColumn("__r", F.last("__v", ignorenulls=True).over(inner)).join(before, [group, "__b"]).withColumn(name, F.coalesce("__r", "__before")).drop("__v", "__b", "__r", "__before")


def next_value(df: DataFrame, group: str, at: str, value: str, name: str, size: int = BLOCK) -> DataFrame:
    """df with the value of the following row of its group; null for the last."""
    numbered = running_sum(df, group, at, F.lit(1), "__n", size)
    following = numbered.select(group, (F.col("__n") - 1).alias("__n"), F.col(value).alias(name))
    return numbered.join(following, [group, "__n"], "left").drop("__n")
