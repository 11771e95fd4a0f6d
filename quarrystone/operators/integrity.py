"""Checks that return violations: references, uniqueness, order, contiguity, partitions, closed keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrystone.plans.scans import running_max


def missing_references(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Child rows whose key is not null and not in the parent."""
    known = parent.select(F.col(parent_key).alias("_k")).distinct()
    return child.where(F.col(key).isNotNull()).join(known, F.col(key) == F.col("_k"), "left_anti")


def repeated(df: DataFrame, keys: list[str | Column]) -> DataFrame:
    """Keys that occur more than once, with their number of rows."""
    return df.groupBy(*keys).agg(F.count("*").alias("copies")).where("copies > 1")


def gaps(events: DataFrame, key: str, ordinal: str, block: int = 4096) -> DataFrame:
    """Where the ordinals of a key do not run 1, 2, 3...: the ordinal before (0 at the start), the next, and how many lack.

    Repeated ordinals count once. Keys may be of any size: they are scanned by blocks.
    """
    e = events.select(key, F.col(ordinal).cast("bigint").alias("o")).where(F.col(key).isNotNull() & F.col("o").isNotNull()).distinct()
    e = running_max(e, [key], ["o"], {"before": (F.col("o"), False)}, F.floor(F.col("o") / block))
    e = e.withColumn("before", F.coalesce("before", F.lit(0)))
    return e.where("o > before + 1").select(key, "before", F.col("o").alias("next"), (F.col("o") - F.col("before") - 1).alias("missing"))


def after_end(events: DataFrame, key: str, ordinal: str, kind: str, end: str) -> DataFrame:
    """Events of a key behind its first end event."""
    ends = events.where(F.col(kind) == end).groupBy(key).agg(F.min(ordinal).alias("_end"))
    return events.join(ends, key).where(F.col(ordinal) > F.col("_end")).drop("_end")


def order_breaks(df: DataFrame, keys: list[str], rank: str, score: str) -> DataFrame:
    """Rows whose score exceeds that of the rank before."""
    last = F.struct(F.col(rank), F.col(score).alias("v"))
    out = running_max(df, keys, [rank], {"_p": (last, False)}, F.floor(F.col(rank) / 4096))
    return out.where(F.col(score) > F.col("_p.v")).drop("_p")


def partition_violations(members: DataFrame, item: str, part: str, universe: DataFrame, universe_item: str) -> DataFrame:
    """Items in several parts, in none, or foreign to the universe: ``item, violation``."""
    m = members.select(F.col(item).alias("item"), F.col(part).alias("part")).where("item is not null and part is not null").distinct()
    u = universe.select(F.col(universe_item).alias("item")).where("item is not null").distinct()
    several = m.groupBy("item").agg(F.count("*").alias("n")).where("n > 1").select("item", F.lit("several").alias("violation"))
    none = u.join(m, "item", "left_anti").select("item", F.lit("none").alias("violation"))
    foreign = m.select("item").distinct().join(u, "item", "left_anti").select("item", F.lit("foreign").alias("violation"))
    return several.unionByName(none).unionByName(foreign)


def closed_keys(json: Column, expected: list[str]) -> Column:
    """Keys of a JSON object that are missing or not expected, as text; null where it is no object."""
    keys, want = F.json_object_keys(json), F.array(*map(F.lit, expected))
    odd = F.array_sort(F.concat(F.transform(F.array_except(want, keys), lambda k: F.concat(F.lit("-"), k)), F.transform(F.array_except(keys, want), lambda k: F.concat(F.lit("+"), k))))
    return F.array_join(odd, "|")
