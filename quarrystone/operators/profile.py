"""Profiles of datasets: observed columns, merged features, splits, modalities, tasks, completeness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrystone.functions import names, types

# fixed values: name tokens and suffixes that tell a modality
MODALITY_TOKENS = {
    "image": ["image", "pixel", "photo"],
    "audio": ["audio", "speech", "waveform"],
    "video": ["video", "frame"],
    "text": ["text", "sentence", "question", "caption", "review", "document", "body", "content", "title", "prompt", "instruction"],
}
MODALITY_SUFFIXES = {"image": [".jpg", ".jpeg", ".png", ".webp"], "audio": [".wav", ".mp3", ".flac"], "video": [".mp4", ".avi", ".webm"], "text": []}
# fixed values: task tags that are taken as they are
TASK_TAGS = [
    "text-classification", "image-classification", "token-classification", "question-answering", "summarization",
    "translation", "automatic-speech-recognition", "object-detection", "image-segmentation",
]
READY = 0.5


def long_values(df: DataFrame, columns: list[str]) -> DataFrame:
    """``pos, name, value`` of every cell as text, in one pass; arrays and structs are written as JSON."""
    kinds = dict(df.dtypes)
    text = lambda c: F.to_json(c) if kinds[c].startswith(("array", "struct", "map")) else F.col(c).cast("string")
    cells = F.explode(F.array(*[F.struct(F.lit(i).alias("pos"), F.lit(c).alias("name"), text(c).alias("value")) for i, c in enumerate(columns, 1)]))
    return df.select(cells.alias("x")).select("x.pos", "x.name", "x.value")


def observed_columns(long: DataFrame, keys: list[str]) -> DataFrame:
    """Per column: one label, the set of inspected labels, nullability in both senses, rows, role.

    ``nullable`` counts null and '' as missing, ``blank`` also white space. Labels are combined
    by partial aggregation; no value leaves its task.
    """
    v = F.col("value")
    seen = F.when(v.isNotNull() & (v != ""), types.scalar_type(v))
    g = long.groupBy(*keys).agg(
        F.collect_set(seen).alias("labels"),
        F.collect_set(types.inspected_type(v)).alias("inspected"),
        F.bool_or(v.isNull() | (v == "")).alias("nullable"),
        F.bool_or(v.isNull() | (F.trim(v) == "")).alias("blank"),
        F.count("*").alias("rows"),
    )
    name = F.col(keys[-1])
    return g.select(*keys, types.combined_type(F.col("labels")).alias("data_type"), types.type_set(F.col("inspected")).alias("type_set"), "nullable", "blank", "rows", names.role(name).alias("role"))


def json_members(rows: DataFrame, json: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """``name, kind`` of every member of the JSON objects in a text column; other values are a member ``value``.

    Blank and null rows are no rows; invalid ones give a member null.
    """
    v = rows.where(F.col(json).isNotNull() & (F.trim(json) != "")).select(*keys, F.try_parse_json(json).alias("v"))
    object_ = F.try_variant_get("v", "$", "map<string,variant>")
    pairs = F.when(F.col("v").isNull(), F.array(F.struct(F.lit(None).cast("string").alias("key"), F.col("v").alias("value"))))
    pairs = pairs.when(object_.isNotNull(), F.map_entries(object_)).otherwise(F.array(F.struct(F.lit("value").alias("key"), F.col("v").alias("value"))))
    m = v.select(*keys, F.explode(pairs).alias("p")).select(*keys, F.col("p.key").alias("name"), F.col("p.value").alias("x"))
    return m.select(*keys, "name", types.variant_type(F.col("x")).alias("kind"), F.coalesce(F.is_variant_null("x"), F.lit(False)).alias("is_null"))


def merged_features(features: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """Features of several files of one dataset as one: combined label, role, nullability, first place.

    A label role anywhere wins, else the role seen first; ``order`` says what comes first.
    """
    g = features.groupBy(*keys, "name").agg(
        F.collect_set("data_type").alias("labels"),
        F.bool_or(F.col("role") == "label").alias("l"),
        F.min(F.struct(order.alias("o"), F.col("role"))).getField("role").alias("r"),
        F.bool_or(F.coalesce("nullable", F.lit(False))).alias("nullable"),
        F.min(order).alias("first"),
    )
    return g.select(*keys, "name", types.combined_type(F.col("labels")).alias("data_type"), F.when(F.col("l"), "label").otherwise(F.col("r")).alias("role"), "nullable", "first")


def array_shapes(df: DataFrame, keys: list[str], array: str) -> DataFrame:
    """The common length of an array column per group, ``variable`` for several, null without arrays."""
    n = F.size(F.col(array))
    g = df.groupBy(*keys).agg(F.min(F.when(F.col(array).isNotNull(), n)).alias("a"), F.max(F.when(F.col(array).isNotNull(), n)).alias("b"))
    return g.select(*keys, F.when(F.col("a") == F.col("b"), F.col("a").cast("string")).when(F.col("a") < F.col("b"), "variable").alias("shape"))


def modalities(texts: Column, suffixes: Column, has_features: Column) -> Column:
    """Modalities told by tokens in names and tags or by file suffixes; ``tabular`` or ``unknown`` else."""
    low = F.lower(texts)
    hit = []
    for m, tokens in MODALITY_TOKENS.items():
        found = F.arrays_overlap(suffixes, F.array(*map(F.lit, MODALITY_SUFFIXES[m]))) if MODALITY_SUFFIXES[m] else F.lit(False)
        found = F.coalesce(found, F.lit(False))
        for t in tokens:
            found = found | F.coalesce(low.contains(t), F.lit(False))
        hit.append(F.when(found, F.lit(m)))
    out = F.array_compact(F.array(*hit))
    return F.when(F.size(out) > 0, out).when(has_features, F.array(F.lit("tabular"))).otherwise(F.array(F.lit("unknown")))


def task_hints(tags: Column, has_label: Column) -> Column:
    """Known task tags in their order, else classification where there is a label."""
    known = F.array_intersect(F.transform(tags, F.lower), F.array(*map(F.lit, TASK_TAGS)))
    return F.when(F.size(F.coalesce(known, F.array().cast("array<string>"))) > 0, known).when(has_label, F.array(F.lit("classification"))).otherwise(F.array().cast("array<string>"))


def completeness(analysed: Column, has_features: Column, has_samples: Column, warnings: Column) -> Column:
    """Score of a dataset profile between 0 and 1."""
    points = F.lit(0.25) + F.when(analysed, 0.25).otherwise(0.0) + F.when(has_features, 0.3).otherwise(0.0) + F.when(has_samples, 0.15).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.round(points - F.least(F.lit(0.2), warnings * 0.03), 2)))


def model_completeness(*signals: Column) -> Column:
    """Share of the signals that hold, on two digits."""
    total = F.lit(0)
    for s in signals:
        total = total + F.coalesce(s, F.lit(False)).cast("int")
    return F.round(total / len(signals), 2)


def readiness(score: Column) -> Column:
    return F.when(score >= READY, "ready").otherwise("needs_review")


def split_counts(files: DataFrame, keys: list[str], path: str, rows: str, declared: DataFrame | None = None) -> DataFrame:
    """Rows per split named by the paths; where a dataset declares its counts these hold instead."""
    got = files.groupBy(*keys, names.path_split(F.col(path)).alias("split")).agg(F.sum(rows).cast("bigint").alias("rows"))
    if declared is None:
        return got
    return got.join(declared.select(*keys).distinct(), keys, "left_anti").unionByName(declared.select(*keys, "split", "rows"))


def schema_profile(df: DataFrame, files: int = 1) -> DataFrame:
    """Profile of a table from its schema alone: one row, nested features; no job runs."""
    feats = types.schema_features(df.schema)
    spark = df.sparkSession
    rows = spark.createDataFrame(feats, "name string, data_type string, role string, nullable boolean")
    text = " ".join(n for n, *_ in feats)
    one = rows.agg(F.sort_array(F.collect_list(F.struct("name", "data_type", "role", "nullable"))).alias("features"), F.bool_or(F.col("role") == "label").alias("has_label"))
    one = one.withColumn("modalities", modalities(F.lit(text), F.array().cast("array<string>"), F.size("features") > 0))
    tasks = types.schema_tasks(df.schema)
    hint = F.array(*map(F.lit, tasks)) if tasks else task_hints(F.array().cast("array<string>"), F.coalesce("has_label", F.lit(False)))
    return one.select("features", "modalities", hint.alias("task_hints"), completeness(F.lit(files > 0), F.size("features") > 0, F.lit(True), F.lit(0)).alias("completeness"))
