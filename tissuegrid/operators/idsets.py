"""Sets of ids: slices, regions, unions and differences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def in_slices(df: DataFrame, column: str, slices: Sequence) -> DataFrame:
    """Rows of the named slices."""
    return df.where(F.col(column).isin(list(slices)))


def in_region(members: DataFrame, regions: DataFrame, names: Sequence) -> DataFrame:
    """Distinct ids of ``members(id, region)`` whose region carries one of the names in ``regions(region, name)``."""
    named = regions.where(F.col("name").isin(list(names)))
    return members.join(named, "region", "left_semi").select("id").distinct()


def common_ids(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.select("id").intersect(right.select("id"))


def missing_ids(left: DataFrame, right: DataFrame) -> DataFrame:
    """Ids of ``left`` that ``right`` lacks."""
    return left.select("id").join(right.select("id"), "id", "left_anti")


def union_ids(left: DataFrame, right: DataFrame, left_flag: str, right_flag: str) -> DataFrame:
    """Every id of either side once, with a 1 in the column of each side that has it."""
    a = left.select("id").distinct().withColumn(left_flag, F.lit(1))
    b = right.select("id").distinct().withColumn(right_flag, F.lit(1))
    return a.join(b, "id", "full_outer")
