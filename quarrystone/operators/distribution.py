"""Value distributions of observations with statuses backed by evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEAST_COUNT, LEAST_SHARE, LEAST_COVERAGE, CONFLICT_SHARE = 3, 0.60, 0.60, 0.4


def value_distribution(observations: DataFrame, keys: list[str], values: str, observation: str, coverage: Column | float = 1.0) -> DataFrame:
    """Counts of each value per group with shares, dominance and the status of the group.

    ``observations`` has one row per completed observation with an array ``values``; null, and
    the value ``UNKNOWN``, count as observed without a value. The denominator is all
    observations. Groups without any value give one row with a null value.
    """
    eligible = observations.groupBy(*keys).agg(F.countDistinct(observation).alias("eligible"))
    one = observations.select(*keys, F.explode(values).alias("value")).where("value is not null and value <> 'UNKNOWN'")
    counts = one.groupBy(*keys, "value").agg(F.count("*").alias("n"))
    group = Window.partitionBy(*keys)
    out = eligible.join(counts, keys, "left")
    out = out.withColumn("most", F.max("n").over(group)).withColumn("leaders", F.sum(F.when(F.col("n") == F.col("most"), 1)).over(group))
    cov = coverage if isinstance(coverage, Column) else F.lit(coverage)
    share = F.col("most") / F.col("eligible")
    tie = (F.col("leaders") > 1) & (share >= CONFLICT_SHARE)
    firm = (F.col("most") >= LEAST_COUNT) & (share >= LEAST_SHARE) & (cov >= LEAST_COVERAGE)
    status = F.when(F.col("most").isNull() | tie, "UNKNOWN").when(firm, "SUPPORTED").otherwise("OBSERVED")
    reason = F.when(F.col("most").isNull(), "NO_EVIDENCE").when(tie, "CONFLICTING_EVIDENCE")
    return out.select(
        *keys, "value", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"), F.col("eligible").cast("bigint").alias("eligible"),
        F.coalesce(F.col("n") / F.col("eligible"), F.lit(0.0)).alias("share"),
        F.coalesce(F.col("n") == F.col("most"), F.lit(False)).alias("dominant"), status.alias("status"), reason.alias("reason"),
    )


def field_observations(df: DataFrame, observation: str, fields: list[str]) -> DataFrame:
    """Long form ``field, observation, values`` of several columns in one pass; arrays stay arrays."""
    kinds = dict(df.dtypes)
    as_list = lambda f: F.col(f).cast("array<string>") if kinds[f].startswith("array") else F.array(F.col(f).cast("string"))
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), as_list(f).alias("values")) for f in fields]))
    return df.select(F.col(observation).alias("observation"), pairs.alias("x")).select("x.field", "observation", "x.values")


def claims(distribution: DataFrame, keys: list[str]) -> DataFrame:
    """One claim per group: its dominant values, or ``UNKNOWN`` with the reason."""
    known = F.col("status") != "UNKNOWN"
    values = F.array_sort(F.collect_set(F.when(F.col("dominant") & known, F.col("value"))))
    return distribution.groupBy(*keys).agg(F.array_join(values, "|").alias("claim"), F.max("status").alias("status"), F.max("reason").alias("reason"))
