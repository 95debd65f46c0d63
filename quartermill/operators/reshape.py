"""Pivots, top-k, stacks and set comparisons of long tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def wide(long: DataFrame, key: Sequence[str], name: str, value: str, names: Sequence[str]) -> DataFrame:
    """One column per listed name; the list is given, so no extra pass looks for it."""
    return long.groupBy(*key).agg(*[F.max(F.when(F.col(name) == n, F.col(value))).alias(n) for n in names])


def long(table: DataFrame, key: Sequence[str], columns: Sequence[str], name: str = "variable", value: str = "value") -> DataFrame:
    return table.unpivot(list(key), list(columns), name, value)


def keep_last(df: DataFrame, keys: Sequence[str], *order: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*[F.col(x).desc() for x in order])
    return df.withColumn("_nth", F.row_number().over(w)).where("_nth = 1").drop("_nth")


def first_per(df: DataFrame, keys: Sequence[str], order: str, *values: str) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.min_by(v, order).alias(v) for v in values])


def top_k(df: DataFrame, groups: Sequence[str], item: str, value: str, k: int) -> DataFrame:
    """Per group the k items with the largest sums of absolute values, ranked; ties by item."""
    score = df.groupBy(*groups, item).agg(F.sum(F.abs(value)).alias("score"))
    w = Window.partitionBy(*groups).orderBy(F.desc("score"), item)
    return score.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def top_k_and_rest(df: DataFrame, groups: Sequence[str], item: str, value: str, k: int, rest: str = "other") -> DataFrame:
    """Sums per group and item, with items beyond the top k lumped together."""
    score = df.groupBy(*groups, item).agg(F.sum(F.abs(value)).alias("score"), F.sum(value).alias("total"))
    w = Window.partitionBy(*groups).orderBy(F.desc("score"), item)
    label = F.when(F.row_number().over(w) <= k, F.col(item)).otherwise(rest)
    return score.select(*groups, label.alias(item), "total").groupBy(*groups, item).agg(F.sum("total").alias("total"))


def tail(df: DataFrame, keys: Sequence[str], order: str, n: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    return df.withColumn("_nth", F.row_number().over(w)).where(F.col("_nth") <= n).drop("_nth")


def stacked(df: DataFrame, keys: Sequence[str], order: str, value: str) -> DataFrame:
    """Where each bar of a stack begins: positive and negative parts stack apart."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    up, down = F.sum(F.greatest(F.col(value), F.lit(0.0))).over(w), F.sum(F.least(F.col(value), F.lit(0.0))).over(w)
    return df.withColumn("base", F.coalesce(F.when(F.col(value) >= 0, up).otherwise(down), F.lit(0.0)))


def set_difference(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys of one side only, and which side."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    return a.join(b, key, "left_anti").withColumn("side", F.lit("missing")).unionByName(b.join(a, key, "left_anti").withColumn("side", F.lit("extra")))
