"""Whole runs: profile a folder, profile a model repository, hold datasets against models, adapt and check again."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrystone.functions import names, text, types
from quarrystone.operators import compat, profile, transform
from quarrystone.sources import files as listing
from quarrystone.sources import readers, sinks

# fixed values: what a profile looks at
SAMPLE_ROWS, MOST_TEXT_BYTES = 100, 512 << 10

_FEATURE = "path string, name string, data_type string, role string, nullable boolean, rows bigint"


def file_features(spark: SparkSession, root: str, paths: list[str], most_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Features of each file, by ``path``, from its first rows; Parquet from its footer.

    The files of one format are read together. Metadata and unknown kinds have no features.
    """
    kinds: dict[str, list[str]] = {}
    for p in paths:
        base = p.lower().rsplit("/", 1)[-1]
        if base not in names.METADATA_NAMES:
            kinds.setdefault("manifest" if base == "dataset_infos.json" else base.rsplit(".", 1)[-1], []).append(p)
    own = {k: [f"{root}/{p}" for p in v] for k, v in kinds.items()}
    out = [spark.createDataFrame([], _FEATURE)]
    key, path = ("path",), listing.source_path(spark, root).alias("path")
    columns = lambda rows: readers.json_columns(rows, "line", key).withColumn("role", names.role(F.col("name")))
    if "manifest" in own:
        f = readers.manifest_features(spark.read.text(own["manifest"], wholetext=True).select(path, "value"), keys=key)
        out.append(f.withColumns({"nullable": F.lit(True), "rows": F.lit(0)}))
    if "parquet" in own:
        f = readers.parquet_features(spark, root, kinds["parquet"])
        out.append(f.withColumn("rows", F.least("rows", F.lit(most_rows))))
    if "csv" in own:
        out.append(profile.observed_columns(readers.delimited_values(spark, root, kinds["csv"], most_rows), ["path", "name"]))
    if lines := own.get("jsonl", []) + own.get("ndjson", []):
        rows = spark.read.text(lines).select(path, F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("line"))
        rows = rows.where((F.trim("line") != "") & F.try_parse_json("line").isNotNull())
        out.append(columns(rows.withColumn("n", F.row_number().over(Window.partitionBy("path").orderBy("start", "at"))).where(F.col("n") <= most_rows)))
    if "json" in own:
        docs = spark.read.text(own["json"], wholetext=True).select(path, F.try_parse_json("value").alias("v"))
        rows = docs.select("path", F.explode(F.slice(readers.json_rows(F.col("v")), 1, most_rows)).alias("row"))
        out.append(columns(rows.select("path", F.to_json("row").alias("line"))))
    return reduce(DataFrame.unionByName, [f.select("path", "name", "data_type", "role", "nullable", F.col("rows").cast("bigint").alias("rows")) for f in out])


def profile_folder(spark: SparkSession, root: str) -> DataFrame:
    """One row that profiles the dataset in a folder: nested features, splits, modalities, tasks, score.

    All data files count, each by its first rows. A folder without data files has no features and
    is ``unknown``.
    """
    inv = listing.inventory(spark, root)
    chosen = [r.path for r in inv.where(names.data_file(F.col("path"))).orderBy("path").collect()]
    paths = spark.createDataFrame(list(enumerate(chosen)), "file int, path string")
    feats = file_features(spark, root.rstrip("/"), chosen).join(paths, "path")
    merged = profile.merged_features(feats.withColumn("k", F.lit(1)), ["k"], F.col("file"))
    rows = feats.groupBy("path").agg(F.max("rows").alias("rows"))
    splits = rows.groupBy(names.path_split(F.col("path")).alias("split")).agg(F.sum("rows").alias("rows"))
    one = merged.agg(
        F.sort_array(F.collect_list(F.struct("first", "name", "data_type", "role", "nullable"))).alias("features"),
        F.concat_ws(" ", F.collect_list("name")).alias("t"),
        F.coalesce(F.bool_or(F.col("role") == "label"), F.lit(False)).alias("has_label"),
    )
    one = one.join(F.broadcast(splits.agg(F.sort_array(F.collect_list(F.struct("split", "rows"))).alias("splits"), F.coalesce(F.sum("rows"), F.lit(0)).alias("samples"))))
    one = one.join(F.broadcast(inv.agg(F.collect_set(names.suffix(F.col("path"))).alias("suffixes"), F.count("*").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))))
    score = profile.completeness(F.lit(bool(chosen)), F.size("features") > 0, F.col("samples") > 0, F.lit(0))
    none = F.array().cast("array<string>")
    return one.select(
        "features", "splits", F.col("samples").alias("sample_count"), "files", "bytes",
        profile.modalities(F.col("t"), F.col("suffixes"), F.size("features") > 0).alias("modalities"),
        profile.task_hints(none, F.col("has_label")).alias("task_hints"),
        score.alias("completeness"), profile.readiness(score).alias("status"),
    )


def repository_texts(spark: SparkSession, root: str) -> DataFrame:
    """``path, text`` of all readable source files of a model repository; weights and large files are left out."""
    base = names.base_name(F.col("path"))
    source = names.source_file(F.col("path")) | base.startswith("readme") | base.startswith("license")
    inv = listing.inventory(spark, root).where(source & ~names.weights(F.col("path")) & (F.col("size") <= MOST_TEXT_BYTES))
    full = [f"{root.rstrip('/')}/{r.path}" for r in inv.orderBy("path").collect()]
    if not full:
        return spark.createDataFrame([], "path string, text string")
    return spark.read.text(full, wholetext=True).select(F.regexp_replace(F.input_file_name(), "^file:/+", "/").alias("path"), F.col("value").alias("text"))


def profile_models(texts: DataFrame, keys: list[str]) -> DataFrame:
    """One row per model: frameworks, architectures, tasks, modalities, steps, contract fields, licence, score.

    ``texts`` has the keys, ``path`` and ``text``. Families are sought per file and united, so
    that no repository is gathered in one place. Text generation is dropped for vision models.
    """
    t = F.col("text")
    base = names.base_name(F.col("path"))
    doc = base.rlike("^(readme|license|copying)")
    sets = {"frameworks_code": (text.FRAMEWORKS, ~doc), "frameworks_all": (text.FRAMEWORKS, F.lit(True)), "architectures": (text.ARCHITECTURES, F.lit(True)), "tasks": (text.TASKS, F.lit(True))}
    none = F.array().cast("array<string>")
    rows = texts.select(*keys, "path", "text", *[F.when(c, text.families(t, p)).otherwise(none).alias(k) for k, (p, c) in sets.items()])
    token = {m: t.rlike(p) for m, p in {"m_image": r"(?i)\b(?:pixel_values|torchvision|computer vision|vision transformer|image_size)\b", "m_text": r"(?i)\b(?:text|tokenizer|input_ids)\b", "m_audio": r"(?i)\b(?:audio|waveform|sampling_rate)\b"}.items()}
    steps = {f"s_{k}": F.lower(t).rlike(p) for k, (_, p) in text.PREPROCESSING.items()}
    low = F.min(F.when(base.rlike("^(license|copying)"), F.struct("path", text.license_of(t).alias("l")))).getField("l")
    readme = F.min(F.when(base.startswith("readme"), F.struct("path", text.readme_license(t).alias("l"), text.readme_description(t).alias("d"))))
    g = rows.groupBy(*keys).agg(
        *[F.array_sort(F.array_distinct(F.flatten(F.collect_set(k)))).alias(k) for k in sets],
        *[F.coalesce(F.bool_or(c), F.lit(False)).alias(k) for k, c in {**token, **steps}.items()],
        F.bool_or(base.startswith("readme")).alias("has_readme"), F.bool_or(base.isin(names.DEPENDENCY_NAMES)).alias("has_dependencies"),
        F.bool_or(base.isin(names.ENTRYPOINT_NAMES)).alias("has_entry"), low.alias("l"), readme.alias("r"),
    )
    vision = F.arrays_overlap("tasks", F.array(*map(F.lit, ["image-classification", "object-detection", "image-segmentation"])))
    g = g.withColumn("tasks", F.when(vision, F.array_remove("tasks", "text-generation")).otherwise(F.col("tasks")))
    g = g.withColumn("frameworks", F.when(F.size("frameworks_code") > 0, F.col("frameworks_code")).otherwise(F.col("frameworks_all")))
    hints = F.concat_ws(" ", F.when(F.col("m_image"), "pixel_values"), F.when(F.col("m_text"), "input_ids"), F.when(F.col("m_audio"), "waveform"))
    g = g.withColumn("modalities", text.model_modalities(F.col("tasks"), hints))
    found = F.array_compact(F.array(*[F.when(F.col(f"s_{k}") & F.array_contains("modalities", m), F.lit(k)) for k, (m, _) in text.PREPROCESSING.items()]))
    need = F.array_contains("modalities", "text") & ~F.array_contains(found, "tokenize")
    licence = F.coalesce(F.nullif("l", F.lit("unknown")), F.nullif("r.l", F.lit("")), F.lit("unknown"))
    score = profile.model_completeness(F.col("has_readme"), F.col("has_dependencies"), F.size("frameworks") > 0, F.size("tasks") > 0, F.col("has_entry"), licence != "unknown")
    return g.select(
        *keys, "frameworks", "architectures", "tasks", "modalities", F.when(need, F.concat(found, F.array(F.lit("tokenize")))).otherwise(found).alias("preprocessing"),
        text.model_inputs(F.col("modalities")).alias("inputs"), text.model_outputs(F.col("tasks")).alias("outputs"),
        licence.alias("license"), F.coalesce("r.d", F.lit("")).alias("description"), score.alias("completeness"),
    )


def compare(features: DataFrame, fields: DataFrame, extra: DataFrame | None = None, datasets: DataFrame | None = None, models: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Mapping, dimensions and report of every dataset against every model.

    The profiles of ``datasets`` and ``models`` add what ``compat.profile_dimensions`` compares;
    without them only fields, types and shapes are. ``extra`` adds dimension rows.
    """
    mapping = compat.field_mapping(features, fields)
    dims = compat.field_dimensions(features, fields, mapping)
    dims = dims.unionByName(compat.profile_dimensions(datasets, models)) if datasets is not None and models is not None else dims
    dims = dims.unionByName(extra, allowMissingColumns=True) if extra is not None else dims
    return mapping, dims, compat.roll_up(dims)


def adapt(data: DataFrame, dataset: str, fields: DataFrame, path: str, kind: str = "parquet") -> tuple[DataFrame, DataFrame]:
    """Rename a dataset to a model's contract, write it and hold the result against the contract again.

    Returns the violations of the derived plan (nothing is written if there are any) and the
    report of the written dataset.
    """
    spark = data.sparkSession
    pairs = spark.createDataFrame([(dataset, f.name, types.field_label(f.name, f.dataType)[0], i) for i, f in enumerate(data.schema.fields)], "dataset string, name string, data_type string, pos int")
    plan = compat.field_mapping(pairs, fields).select(F.col("name").alias("source"), F.col("field").alias("target"))
    bad = transform.plan_violations(plan, pairs.select("name", "data_type"), fields)
    if not bad.isEmpty():
        return bad, compare(pairs, fields)[2]
    steps = {r.source: r.target for r in plan.collect()}
    sinks.write_renamed(data, steps, path, kind)
    sinks.write_manifest(spark, f"{path}.manifest", {"dataset": dataset, "plan": steps})
    again = readers.parquet_facts(spark, path) if kind == "parquet" else None
    if again is None:
        new = sinks.renamed(data, steps)
        rows = [(dataset, f.name, types.field_label(f.name, f.dataType)[0], i) for i, f in enumerate(new.schema.fields)]
        feats = spark.createDataFrame(rows, "dataset string, name string, data_type string, pos int")
    else:
        feats = again.select(F.lit(dataset).alias("dataset"), "name", "data_type", F.lit(0).alias("pos"))
    return bad, compare(feats, fields)[2]
