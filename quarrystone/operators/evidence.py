"""Evidence behind values: numbered lists, sets per value, values without any, inspected paths."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrystone.plans.scans import numbered
from quarrystone.plans.topk import first_per_group

MOST_INSPECTED, MOST_DOCUMENTS = 24, 4


def in_class_order(lists: list[DataFrame], key: str, path: str) -> DataFrame:
    """Rows ``key, path, class`` of several lists of paths; one that stands in several belongs to the first.

    Null keys and paths are left out; repeated paths count once.
    """
    rows = [d.select(F.col(key).alias("key"), F.col(path).alias("path"), F.lit(i).alias("class")) for i, d in enumerate(lists)]
    return reduce(DataFrame.unionByName, rows).where("key is not null and path is not null").groupBy("key", "path").agg(F.min("class").alias("class"))


def evidence_rows(lists: list[DataFrame], key: str, path: str, prefix: str = "evidence") -> DataFrame:
    """The union of lists of evidence with ids that count per key in the order of the lists, then of paths."""
    n = numbered(in_class_order(lists, key, path), ["key"], ["class", "path"])
    return n.select("key", "class", "path", F.format_string(f"{prefix}_%03d", "n").alias("evidence_id"))


def inspection_candidates(lists: list[DataFrame], key: str, path: str, most: int | None = MOST_INSPECTED) -> DataFrame:
    """The first unique paths of each key in class order, with their rank; all of them for ``None``."""
    rows = in_class_order(lists, key, path)
    if most is None:
        return numbered(rows, ["key"], ["class", "path"], "rank")
    return first_per_group(rows, ["key"], [F.col("class"), F.col("path")], F.lit(most), F.col("path"))


def capped(df: DataFrame, keys: list[str], order: list[str], most: int | None) -> DataFrame:
    """The first rows of each group and whether more were left out (``truncated``); all rows for ``None``."""
    if most is None:
        return df.withColumn("truncated", F.lit(False))
    total = df.groupBy(*keys).agg(F.count("*").alias("_all"))
    kept = first_per_group(df, keys, [F.col(c) for c in order], F.lit(most), F.xxhash64(*order), rank="_rank")
    return kept.join(total, keys).withColumn("truncated", F.col("_all") > most).drop("_all", "_rank")


def evidence_sets(observations: DataFrame, keys: list[str], value: str, evidence: str) -> DataFrame:
    """The evidence of each value and, with a null value, of each group: distinct rows ``keys, value, evidence``.

    Sets stay rows, so that a value with most of the evidence is no single cell.
    """
    rows = observations.select(*keys, F.col(value).alias("value"), F.col(evidence).alias("evidence")).where("evidence is not null")
    return rows.where("value is not null").unionByName(rows.withColumn("value", F.lit(None).cast("string"))).distinct()


def without_evidence(values: Column, references: Column) -> Column:
    """Whether something is said without a reference: values (or a count above zero), but no references."""
    return (F.size(F.coalesce(values, F.array().cast("array<string>"))) > 0) & (F.size(F.coalesce(references, F.array().cast("array<string>"))) == 0)


def common_shape(shapes: Column) -> Column:
    """Aggregate: the shape that all members of a group have, '' if they differ; nulls are passed over."""
    return F.when(F.min(shapes) == F.max(shapes), F.min(shapes)).otherwise(F.lit(""))


def frame_count(images: Column, frames: Column) -> Column:
    """Frames of an annotated set: its image files where there are any, else what the annotations name."""
    return F.coalesce(F.nullif(images, F.lit(0)), frames, F.lit(0))


def step_label(name: Column, applies_to: Column, reason: Column) -> Column:
    """A transform step as text: its name, what it applies to in brackets, the reason behind a colon."""
    part = lambda c, before, after: F.when(F.trim(F.coalesce(c, F.lit(""))) != "", F.concat(F.lit(before), F.trim(c), F.lit(after))).otherwise(F.lit(""))
    return F.concat(F.trim(name), part(applies_to, "（", "）"), part(reason, "：", ""))


def same_steps(delivered: Column, expected: Column) -> Column:
    """Whether two lists of steps are equal as sets, without case and surrounding blanks."""
    plain = lambda c: F.array_sort(F.array_distinct(F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.lower(F.trim(x))), lambda x: x != "")))
    return plain(delivered) == plain(expected)


def merged_mappings(existing: DataFrame, suggested: DataFrame, relation: str = "relation") -> DataFrame:
    """Existing pairs ``dataset, model, name, field`` and those suggested pairs that are new and whose types can meet.

    A pair that exists already wins; suggestions for blocked types are dropped. ``origin`` tells
    them apart.
    """
    key = ["dataset", "model", "name", "field"]
    have = existing.select(*key).distinct()
    new = suggested.where((F.col(relation) != "blocked") & F.col(relation).isNotNull()).select(*key).distinct().join(have, key, "left_anti")
    return have.withColumn("origin", F.lit("existing")).unionByName(new.withColumn("origin", F.lit("suggested")))
