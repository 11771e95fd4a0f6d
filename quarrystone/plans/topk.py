"""The first rows of each group without sorting a whole group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_per_group(df: DataFrame, keys: list[str], order: list[Column], quota: Column, salt_by: Column, salts: int = 32, rank: str = "rank") -> DataFrame:
    """Rows whose rank in ``order`` within their group is at most ``quota``, with that rank.

    Each group is first ranked in ``salts`` parts; only rows within the quota of their part meet
    again. ``order`` must be total. Null keys form a group of their own.
    """
    part = Window.partitionBy(*keys, "_salt").orderBy(*order)
    whole = Window.partitionBy(*keys).orderBy(*order)
    cut = df.withColumn("_quota", quota).withColumn("_salt", F.pmod(F.xxhash64(salt_by), F.lit(salts)))
    cut = cut.withColumn(rank, F.row_number().over(part)).where(F.col(rank) <= F.col("_quota"))
    out = cut.withColumn(rank, F.row_number().over(whole)).where(F.col(rank) <= F.col("_quota"))
    return out.select(*df.columns, rank)
