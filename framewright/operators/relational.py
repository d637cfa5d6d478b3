"""Relational forms that Spark has no syntax for, as DataFrame operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def distinct_on(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """DISTINCT ON: the first row of each key by the order."""
    return qualify(df, "__fw_first", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)), F.col("__fw_first") == 1).drop("__fw_first")


def qualify(df: DataFrame, name: str, window: Column, condition: Column) -> DataFrame:
    """QUALIFY: a window column, then a condition on it."""
    return df.withColumn(name, window).where(condition)


def over_groups(df: DataFrame, name: str, value: Column, partition: list[str], order: str, before: int, after: int, descending: bool = False) -> DataFrame:
    """An aggregate over a GROUPS frame: so many groups of equal order values before and after.

    Rows get the rank of their order value, and a RANGE frame over ranks is a GROUPS frame over values.
    """
    key = F.col(order).desc() if descending else F.col(order).asc()
    ranked = df.withColumn("__fw_group", F.dense_rank().over(Window.partitionBy(*partition).orderBy(key)))
    return ranked.withColumn(name, value.over(Window.partitionBy(*partition).orderBy("__fw_group").rangeBetween(-before, after))).drop("__fw_group")


def union_by_name(*frames: DataFrame) -> DataFrame:
    """UNION ALL BY NAME: a column that a side lacks is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def order_by(df: DataFrame, *keys: tuple[str, bool]) -> DataFrame:
    """ORDER BY with the dialect's null order: last for ascending, first for descending keys."""
    return df.orderBy(*[F.col(c).asc_nulls_last() if ascending else F.col(c).desc_nulls_first() for c, ascending in keys])


def unnest(df: DataFrame, array: str, alias: str = "unnest") -> DataFrame:
    """One row per element; a null or empty array gives none."""
    return df.withColumn(alias, F.explode(F.expr(array)))
