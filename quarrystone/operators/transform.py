"""Renaming plans: validation as violation rows, and the contract of the result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrystone.operators.integrity import missing_references

# fixed values: types that a plan may map onto each other
TEXT, IMAGE = ["string", "text", "utf8"], ["image", "pixel", "pixels"]
NUMERIC = ["int", "int8", "int16", "int32", "int64", "integer", "float", "float16", "float32", "float64", "double", "number", "classlabel", "categorical"]


def plan_types_fit(source: Column, target: Column) -> Column:
    """Symmetric within text, image and numeric types, else equal only."""
    s, t = F.lower(F.trim(source)), F.lower(F.trim(target))
    both = lambda kinds: s.isin(kinds) & t.isin(kinds)
    return (s == t) | both(TEXT) | both(IMAGE) | both(NUMERIC)


def plan_violations(plan: DataFrame, features: DataFrame, fields: DataFrame) -> DataFrame:
    """What is wrong with a plan ``source, target``: ``violation, name`` rows, none if nothing.

    Unknown sources and targets, targets written twice, types that do not fit, required fields
    that nothing serves.
    """
    say = lambda df, v, c: df.select(F.lit(v).alias("violation"), F.col(c).alias("name"))
    out = say(missing_references(plan, "source", features, "name"), "unknown_source", "source")
    out = out.unionByName(say(missing_references(plan, "target", fields, "field"), "unknown_target", "target"))
    out = out.unionByName(say(plan.groupBy("target").count().where("count > 1"), "target_twice", "target"))
    typed = plan.join(features.select(F.col("name").alias("source"), "data_type"), "source").join(fields.select(F.col("field").alias("target"), "field_type"), "target")
    out = out.unionByName(say(typed.where(~plan_types_fit(F.col("data_type"), F.col("field_type"))), "types", "target"))
    lacking = fields.where("required").join(plan.select(F.col("target").alias("field")), "field", "left_anti")
    return out.unionByName(say(lacking, "required_missing", "field"))


def contract_features(fields: DataFrame, features: DataFrame, plan: DataFrame) -> DataFrame:
    """Features of a renamed dataset: the contract's fields, then the features it neither uses nor hides."""
    rest = features.join(plan.select(F.col("source").alias("name")), "name", "left_anti").join(fields.select(F.col("field").alias("name")), "name", "left_anti")
    return fields.select(F.col("field").alias("name"), F.col("field_type").alias("data_type"), F.lit("contract").alias("origin")).unionByName(rest.select("name", "data_type", F.lit("dataset").alias("origin")))
