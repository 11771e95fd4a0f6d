"""Queries for type inference, profiles, names, text and structure."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrystone.functions import names, text, types
from quarrystone.operators import profile, structure
from quarrystone.session import table
from quarrystone.sources import files as listing

Query = Callable[[SparkSession, str], DataFrame]

ORDER_COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]
REF_COLUMNS = ["sample_key", "kind", "content_hash", "split_name", "video_path", "start_ms", "frame_start"]


def infer_scalar_types(spark: SparkSession, d: str) -> DataFrame:
    long = profile.long_values(table(spark, d, "orders"), ORDER_COLUMNS)
    return long.groupBy("name", types.scalar_type(F.col("value")).alias("scalar_type")).agg(F.count("*").alias("n"))


def column_type_lattice(spark: SparkSession, d: str) -> DataFrame:
    long = profile.long_values(table(spark, d, "sample_refs"), REF_COLUMNS)
    return profile.observed_columns(long, ["name"])


def infer_scalar_types_all(spark: SparkSession, d: str) -> DataFrame:
    """``infer_scalar_types`` over every column of the table."""
    orders = table(spark, d, "orders")
    return profile.long_values(orders, orders.columns).groupBy("name", types.scalar_type(F.col("value")).alias("scalar_type")).agg(F.count("*").alias("n"))


def column_type_lattice_all(spark: SparkSession, d: str) -> DataFrame:
    """``column_type_lattice`` over every column of the table."""
    refs = table(spark, d, "sample_refs")
    return profile.observed_columns(profile.long_values(refs, refs.columns), ["name"])


def json_props_profile(spark: SparkSession, d: str) -> DataFrame:
    m = profile.json_members(table(spark, d, "events"), "props")
    return m.groupBy("name").agg(types.combined_type(F.collect_set("kind")).alias("data_type"), F.bool_or("is_null").alias("nullable"), F.count("*").alias("n"))


def delivered_json_members(spark: SparkSession, d: str) -> DataFrame:
    m = profile.json_members(table(spark, d, "job_event_deliveries"), "data_json").where("name is not null")
    return m.groupBy("name", "kind").agg(F.count("*").alias("n"))


def table_schema_features(spark: SparkSession, d: str) -> DataFrame:
    rows = [(t, *f) for t in ("image_candidates", "sample_refs", "embeddings", "documents", "lineitem") for f in types.schema_features(table(spark, d, t).schema)]
    return spark.createDataFrame([(t, n, k, r) for t, n, k, r, _ in rows], "table_name string, name string, data_type string, role string")


def table_profile(spark: SparkSession, d: str) -> DataFrame:
    p = profile.schema_profile(table(spark, d, "image_candidates"))
    return p.select(F.size("features").alias("features"), F.array_join("modalities", "|").alias("modalities"), F.array_join("task_hints", "|").alias("task_hints"), "completeness")


def semantic_roles(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "column_facts").select(names.plain_name(F.col("name")).alias("name")).where("name is not null and name <> ''").distinct()
    return n.select("name", names.role(F.col("name")).alias("role"))


def split_names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "image_candidates").groupBy(names.path_split(F.col("path")).alias("split")).agg(F.count("*").alias("n"))


def array_shapes(spark: SparkSession, d: str) -> DataFrame:
    return profile.array_shapes(table(spark, d, "image_candidates"), ["resource_id"], "embedding")


def _features(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "column_facts").select("series", "file_seq", "col_pos", names.plain_name(F.col("name")).alias("name"), "observed_types", "nullable").where("name is not null and name <> ''")
    known = F.filter("observed_types", lambda t: t.isNotNull() & (t != "unknown"))
    return f.withColumn("data_type", types.combined_type(F.coalesce(known, F.array().cast("array<string>")))).withColumn("role", names.role(F.col("name")))


def feature_merge(spark: SparkSession, d: str) -> DataFrame:
    m = profile.merged_features(_features(spark, d), ["series"], F.col("file_seq") * 1000 + F.col("col_pos"))
    return m.select("series", "name", "data_type", "role", "nullable", F.col("first").cast("bigint").alias("first_place"))


def split_row_counts(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "image_candidates").select("resource_id", "path", F.lit(1).alias("rows"))
    return profile.split_counts(f, ["resource_id"], "path", "rows")


def modality_tokens(spark: SparkSession, d: str) -> DataFrame:
    f = _features(spark, d).groupBy("series").agg(F.array_join(F.array_sort(F.collect_set("name")), " ").alias("t"))
    m = profile.modalities(F.col("t"), F.array().cast("array<string>"), F.lit(True))
    return f.select("series", F.array_join(m, "|").alias("modalities"))


def task_hint_counts(spark: SparkSession, d: str) -> DataFrame:
    f = _features(spark, d).groupBy("series").agg(F.bool_or(F.col("role") == "label").alias("has_label"))
    return f.select("series", F.array_join(profile.task_hints(F.array().cast("array<string>"), F.col("has_label")), "|").alias("task_hints"))


def profile_scores(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "column_facts").groupBy("series").agg(F.countDistinct("file_id").alias("files"), F.count_if(F.col("observed_types").isNull()).alias("warnings"))
    s = profile.completeness(F.col("files") > 0, F.lit(True), F.col("files") > 1, F.col("warnings"))
    return f.select("series", F.col("warnings").cast("bigint").alias("warnings"), s.alias("completeness"), profile.readiness(s).alias("readiness"))


def term_families(spark: SparkSession, d: str) -> DataFrame:
    patterns = {"merge": r"\bmerge\b", "helper": r"\bhelper\b", "snapshot": r"\bsnapshots?\b", **text.FRAMEWORKS, **text.ARCHITECTURES}
    low = table(spark, d, "documents").select(F.coalesce(F.lower(F.trim("source")), F.lit("")).alias("source"), F.lower("text").alias("t"))
    found = low.select("source", *[text.occurs(F.col("t"), p).alias(k) for k, p in patterns.items()])
    return found.groupBy("source").agg(*[F.coalesce(F.bool_or(k), F.lit(False)).alias(k) for k in patterns])


def license_markers(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "resources").groupBy(F.lower(text.card_license(F.col("license"))).alias("license"))
    return r.agg(F.count("*").alias("n"))


def document_licenses(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy(text.license_of(F.col("text")).alias("license")).agg(F.count("*").alias("n"))


EXTRA_SECRET = r"(?i)\b(secret|token|key|password)(\s*[=:]\s*)[\"']?[A-Za-z0-9_-]{16,}[\"']?"


def secret_redaction(spark: SparkSession, d: str) -> DataFrame:
    clean = text.redact(text.redact(F.col("text")), EXTRA_SECRET)
    return table(spark, d, "documents").select("doc_id", F.sha2(clean, 256).alias("clean_hash"), (F.col("text") != clean).alias("changed"))


def doc_excerpt(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.excerpt(F.col("text")).alias("excerpt"))


def readme_facts(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", text.readme_description(t).alias("description"), text.readme_license(t).alias("license"))


def model_contracts(spark: SparkSession, d: str) -> DataFrame:
    # step by step, so that no pattern is tried twice
    m = table(spark, d, "documents").select("text", text.families(F.col("text"), text.TASKS).alias("tasks"))
    m = m.withColumn("modalities", text.model_modalities(F.col("tasks"), F.col("text")))
    m = m.withColumn("steps", text.preprocessing(F.col("text"), F.col("modalities")))
    fields = lambda c: F.array_join(F.transform(c, lambda x: x["name"]), "|")
    g = m.select(
        F.array_join("tasks", "|").alias("tasks"), F.array_join("modalities", "|").alias("modalities"), F.array_join("steps", "|").alias("preprocessing"),
        fields(text.model_inputs(F.col("modalities"))).alias("inputs"), fields(text.model_outputs(F.col("tasks"))).alias("outputs"),
    )
    return g.groupBy(*g.columns).agg(F.count("*").alias("n"))


def inventory_histogram(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "image_candidates").select(F.replace("path", F.lit("\\"), F.lit("/")).alias("path"))
    return c.groupBy(names.suffix(F.col("path")).alias("suffix")).agg(F.count("*").alias("n"))


def survey_sketch(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "column_facts").select("resource_id", "file_id", "file_path").distinct()
    return listing.sketch(f, ["resource_id"], "file_path").drop("bytes")


def snapshot_revisions(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "image_candidates").groupBy("resource_id", "path").agg(F.max("byte_size").alias("size"), F.max("discovered_at").alias("modified"))
    return listing.revision(f, ["resource_id"])


def resource_ids(spark: SparkSession, d: str) -> DataFrame:
    made = listing.resource_id(F.lit("dataset"), F.lower("source_type"), F.col("resource_name"))
    return table(spark, d, "resources").select("resource_id", made.alias("derived_id"))


def structural_flags(spark: SparkSession, d: str) -> DataFrame:
    n = _features(spark, d).groupBy("series").agg(F.collect_set("name").alias("ns"))
    return n.select("series", F.array_join(structure.structural_tasks(F.col("ns")), "|").alias("tasks"), F.array_join(structure.structural_supervision(F.col("ns")), "|").alias("supervision"))


def structural_media(spark: SparkSession, d: str) -> DataFrame:
    n = _features(spark, d).select(F.split("series", "-")[0].alias("family"), "name").groupBy("family").agg(F.collect_set("name").alias("ns"))
    c = table(spark, d, "column_facts").select(F.split("series", "-")[0].alias("family"), "file_path").distinct().groupBy("family")
    c = c.agg(F.count_if(names.annotation(F.col("file_path"))).alias("annotations"), F.lit(1).alias("images"), F.lit(0).alias("videos"))
    j = n.join(c, "family")
    org = structure.sample_organisation(F.col("ns"), F.col("images"), F.col("videos"))
    rel = structure.structural_relations(F.col("ns"), F.col("images"), F.col("videos"), F.col("annotations"))
    return j.select("family", org.alias("organisation"), structure.temporal_structure(org).alias("temporal"), F.array_join(rel, "|").alias("relations"))


def structural_conflicts(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "image_candidates").select("resource_id", F.coalesce(F.lower(F.trim("split_name")), F.lit("UNKNOWN")).alias("told"), names.path_split(F.col("path")).alias("seen"))
    g = s.groupBy("resource_id").agg(F.collect_set("told").alias("told"), F.collect_set(F.when(F.col("seen") == "unknown", "UNKNOWN").otherwise(F.col("seen"))).alias("seen"))
    hit = structure.conflicts(F.col("seen"), F.col("told"))
    c = structure.claim(F.array_sort("seen"), hit)
    return g.select("resource_id", hit.alias("conflict"), c["status"].alias("status"), c["value"].alias("value"), c["reason"].alias("reason"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        infer_scalar_types, column_type_lattice, infer_scalar_types_all, column_type_lattice_all, json_props_profile, delivered_json_members, table_schema_features, table_profile, semantic_roles, split_names,
        array_shapes, feature_merge, split_row_counts, modality_tokens, task_hint_counts, profile_scores, term_families, license_markers, document_licenses,
        secret_redaction, doc_excerpt, readme_facts, model_contracts, inventory_histogram, survey_sketch, snapshot_revisions, resource_ids, structural_flags,
        structural_media, structural_conflicts,
    )
}

_INT = "'[+-]?[0-9]+(_[0-9]+)*'"
_NUM = "'[+-]?(([0-9]+(_[0-9]+)*)([.]([0-9]+(_[0-9]+)*)?)?|[.][0-9]+(_[0-9]+)*)([eE][+-]?[0-9]+(_[0-9]+)*)?|[+-]?(?i:inf|infinity|nan)'"


def _scalar(v: str) -> str:
    return f"CASE WHEN {v} IS NULL THEN NULL WHEN lower(trim({v})) IN ('true', 'false') THEN 'boolean' WHEN regexp_full_match(trim({v}), {_INT}) THEN 'integer' WHEN regexp_full_match(trim({v}), {_NUM}) THEN 'number' ELSE 'string' END"


def _long(table_name: str, columns: list[str]) -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS name, CAST({c} AS VARCHAR) AS value FROM {table_name}" for c in columns)


def _combine(a: str) -> str:
    return f"CASE WHEN len({a}) = 0 THEN 'unknown' WHEN len({a}) = 1 THEN {a}[1] WHEN len([x for x in {a} if x NOT IN ('integer', 'number')]) = 0 THEN 'number' ELSE 'mixed' END"


_LABELS = "'label','labels','class','class_id','target','target_id','y','category','sentiment','species','objects','annotations','bbox','bboxes','boxes','mask','masks','segmentation'"
_ROLE = f"CASE WHEN name IN ({_LABELS}) THEN 'label' WHEN name IN ('id','uuid','index','identifier') OR ends_with(name, '_id') THEN 'identifier' ELSE 'input' END"
_NAME = "lower(trim(name, ' ' || chr(9) || chr(10) || chr(13) || chr(65279)))"
_SPLIT = "CASE WHEN s IN ('valid', 'val', 'dev') THEN 'validation' WHEN s = '' THEN 'unknown' ELSE s END"
_HIT = "lower(regexp_extract(path, '(?:^|[_./-])(train|validation|valid|val|test|dev)(?:[_./-]|$)', 1, 'i'))"
_FEATURES = f"""SELECT *, {_ROLE} AS role, {_combine("known")} AS data_type FROM (
  SELECT series, file_seq, col_pos, {_NAME} AS name, nullable, list_distinct([t for t in coalesce(observed_types, []) if t IS NOT NULL AND t <> 'unknown']) AS known FROM column_facts) WHERE name <> ''"""


def _tokens(column: str, tokens: list[str]) -> str:
    return "(" + " OR ".join(f"contains({column}, '{t}')" for t in tokens) + ")"


def _family(column: str, family: str) -> str:
    return f"coalesce(bool_or(regexp_matches({column}, '{'|'.join(structure.TOKENS[family])}')), false) AS h_{family}"


_TERMS = ", ".join(
    f"coalesce(bool_or(regexp_matches(lower(text), '{p}')), false) AS {k}" for k, p in {"merge": r"\bmerge\b", "helper": r"\bhelper\b", "snapshot": r"\bsnapshots?\b", **text.FRAMEWORKS, **text.ARCHITECTURES}.items()
)
_BOX = "(h_bbox OR (h_left AND h_right AND h_top AND h_bottom) OR (h_cx AND h_cy AND h_bw AND h_bh))"


def _picked(rules: list[tuple[str, str]]) -> str:
    return "[x for x in [" + ", ".join(f"CASE WHEN {c} THEN '{v}' END" for c, v in rules) + "] if x IS NOT NULL]"


_TASK_RULES = [
    (_BOX, "object_detection"), (f"h_track AND h_frame AND {_BOX}", "multi_object_tracking"), ("h_mask AND h_instance", "instance_segmentation"),
    ("h_mask AND NOT h_instance", "semantic_segmentation"), ("h_keypoints", "pose_keypoints"), ("h_action", "action_video_understanding"),
    ("h_anomaly", "video_anomaly_detection"), ("h_identity", "reid_retrieval"),
]
_SUPERVISION_RULES = list(zip([c for c, _ in _TASK_RULES], ["bbox", "track", "instance_mask", "semantic_mask", "keypoints", "action_label", "anomaly_label", "identity"]))

SQL: dict[str, str] = {
    "infer_scalar_types": f"SELECT name, {_scalar('value')} AS scalar_type, count(*) AS n FROM ({_long('orders', ORDER_COLUMNS)}) GROUP BY ALL",
    "column_type_lattice": f"""
SELECT name, {_combine("labels")} AS data_type, CASE WHEN len(inspected) = 0 THEN 'unknown' ELSE array_to_string(inspected, '|') END AS type_set, nullable, blank, "rows", {_ROLE} AS role FROM (
  SELECT name, coalesce(list(DISTINCT l) FILTER (WHERE l IS NOT NULL), []) AS labels, coalesce(list(DISTINCT i ORDER BY i) FILTER (WHERE i IS NOT NULL), []) AS inspected,
         bool_or(value IS NULL OR value = '') AS nullable, bool_or(value IS NULL OR trim(value) = '') AS blank, count(*) AS "rows"
  FROM (SELECT *, CASE WHEN value <> '' THEN {_scalar("value")} END AS l,
               CASE WHEN trim(value) <> '' THEN replace({_scalar("value")}, 'boolean', 'string') END AS i FROM ({_long("sample_refs", REF_COLUMNS)})) GROUP BY name)""",
    "json_props_profile": "SELECT k AS name, 'integer' AS data_type, false AS nullable, count(*) AS n FROM (SELECT unnest(json_keys(props)) AS k FROM events) GROUP BY k",
    "semantic_roles": f"SELECT name, {_ROLE} AS role FROM (SELECT DISTINCT {_NAME} AS name FROM column_facts) WHERE name <> ''",
    "split_names": f"SELECT {_SPLIT} AS split, count(*) AS n FROM (SELECT {_HIT} AS s FROM image_candidates) GROUP BY ALL",
    "array_shapes": "SELECT resource_id, CASE WHEN min(len(embedding)) = max(len(embedding)) THEN CAST(min(len(embedding)) AS VARCHAR) WHEN min(len(embedding)) < max(len(embedding)) THEN 'variable' END AS shape FROM image_candidates GROUP BY resource_id",
    "feature_merge": f"""
SELECT series, name, {_combine("labels")} AS data_type, CASE WHEN l THEN 'label' ELSE r END AS role, nullable, first_place FROM (
  SELECT series, name, list(DISTINCT data_type) AS labels, bool_or(role = 'label') AS l, arg_min(role, file_seq * 1000 + col_pos) AS r,
         bool_or(coalesce(nullable, false)) AS nullable, CAST(min(file_seq * 1000 + col_pos) AS BIGINT) AS first_place FROM ({_FEATURES}) GROUP BY series, name)""",
    "split_row_counts": f"""SELECT resource_id, {_SPLIT} AS split, CAST(count(*) AS BIGINT) AS "rows" FROM (SELECT resource_id, {_HIT} AS s FROM image_candidates) GROUP BY ALL""",
    "modality_tokens": f"""
SELECT series, CASE WHEN len(m) > 0 THEN array_to_string(m, '|') ELSE 'tabular' END AS modalities FROM (
  SELECT series, {_picked([(_tokens("t", v), k) for k, v in profile.MODALITY_TOKENS.items()])} AS m FROM (SELECT series, string_agg(DISTINCT name, ' ') AS t FROM ({_FEATURES}) GROUP BY series))""",
    "task_hint_counts": f"SELECT series, CASE WHEN bool_or(role = 'label') THEN 'classification' ELSE '' END AS task_hints FROM ({_FEATURES}) GROUP BY series",
    "profile_scores": """
SELECT series, warnings, s AS completeness, CASE WHEN s >= 0.5 THEN 'ready' ELSE 'needs_review' END AS readiness FROM (
  SELECT series, w AS warnings, round(0.25 + 0.25 + 0.3 + CASE WHEN f > 1 THEN 0.15 ELSE 0 END - least(0.2, w * 0.03), 2)::DOUBLE AS s FROM (
    SELECT series, count(DISTINCT file_id) AS f, count(*) FILTER (WHERE observed_types IS NULL) AS w FROM column_facts GROUP BY series))""",
    "term_families": f"SELECT coalesce(lower(trim(source)), '') AS source, {_TERMS} FROM documents GROUP BY ALL",
    "license_markers": "SELECT lower(coalesce(nullif(trim(license), ''), 'unknown')) AS license, count(*) AS n FROM resources GROUP BY ALL",
    "document_licenses": """SELECT CASE WHEN contains(t, 'apache license') AND contains(t, 'version 2.0') THEN 'Apache-2.0' WHEN contains(t, 'mit license') THEN 'MIT'
  WHEN contains(t, 'redistribution and use in source and binary forms') THEN 'BSD-3-Clause' WHEN contains(t, 'gnu general public license') AND contains(t, 'version 3') THEN 'GPL-3.0'
  WHEN contains(t, 'creative commons attribution 4.0') THEN 'CC-BY-4.0' ELSE 'unknown' END AS license, count(*) AS n FROM (SELECT lower(text) AS t FROM documents) GROUP BY ALL""",
    "secret_redaction": r"""
SELECT doc_id, sha256(c) AS clean_hash, text <> c AS changed FROM (
  SELECT doc_id, text, regexp_replace(regexp_replace(text, '(authorization\s*:\s*bearer\s+|api[_ -]?key\s*[=:]\s*|sk-[A-Za-z0-9_-]{8,})[^\s"'']+', '[REDACTED]', 'gi'),
    '\b(secret|token|key|password)(\s*[=:]\s*)["'']?[A-Za-z0-9_-]{16,}["'']?', '[REDACTED]', 'gi') AS c FROM documents)""",
    "inventory_histogram": r"SELECT lower(regexp_extract(list_extract(string_split(replace(path, '\', '/'), '/'), -1), '[^.].*?([.][^.]+)$', 1)) AS suffix, count(*) AS n FROM image_candidates GROUP BY ALL",
    "resource_ids": "SELECT resource_id, 'dataset_' || substr(sha256('dataset' || chr(0) || lower(source_type) || chr(0) || resource_name), 1, 12) AS derived_id FROM resources",
    "structural_flags": f"""
SELECT series, CASE WHEN len(t) = 0 AND h_label THEN 'image_classification' ELSE array_to_string(t, '|') END AS tasks, CASE WHEN len(u) = 0 AND h_label THEN 'class_label' ELSE array_to_string(u, '|') END AS supervision FROM (
  SELECT *, {_picked(_TASK_RULES)} AS t, {_picked(_SUPERVISION_RULES)} AS u FROM (
    SELECT series, {", ".join(_family("name", f) for f in structure.TOKENS)} FROM ({_FEATURES}) GROUP BY series))""",
    "model_contracts": f"""
WITH t AS (SELECT lower(text) AS x FROM documents),
k AS (SELECT x, {_picked([(f"regexp_matches(x, '{p}')", n) for n, p in text.TASKS.items()])} AS t FROM t),
m AS (SELECT *, [y for y in [CASE WHEN list_has_any(t, ['image-classification', 'object-detection', 'image-segmentation', 'image-to-text']) OR (len(t) = 0 AND regexp_matches(x, '\\b(?:pixel_values|torchvision|computer vision|vision transformer|image_size)\\b')) THEN 'image' END,
  CASE WHEN list_has_any(t, ['text-generation', 'text-classification', 'token-classification', 'question-answering']) OR (len(t) = 0 AND regexp_matches(x, '\\b(?:text|tokenizer|input_ids)\\b')) THEN 'text' END,
  CASE WHEN list_contains(t, 'speech-recognition') OR (len(t) = 0 AND regexp_matches(x, '\\b(?:audio|waveform|sampling_rate)\\b')) THEN 'audio' END] if y IS NOT NULL] AS m0 FROM k),
n AS (SELECT x, t, CASE WHEN len(m0) > 0 THEN m0 ELSE ['unknown'] END AS m FROM m),
s AS (SELECT *, {_picked([(f"list_contains(m, '{k}') AND regexp_matches(x, '{p}')", n) for n, (k, p) in text.PREPROCESSING.items()])} AS s FROM n)
SELECT array_to_string(t, '|') AS tasks, array_to_string(m, '|') AS modalities, array_to_string(CASE WHEN list_contains(m, 'text') AND NOT list_contains(s, 'tokenize') THEN list_append(s, 'tokenize') ELSE s END, '|') AS preprocessing,
  coalesce(nullif(array_to_string([y for y in ['text', 'image', 'audio'] if list_contains(m, y)], '|'), ''), 'input') AS inputs,
  coalesce(nullif(concat_ws('|', CASE WHEN list_contains(t, 'text-generation') THEN 'tokens' END, CASE WHEN list_has_any(t, ['text-classification', 'image-classification']) THEN 'logits' END,
    CASE WHEN list_contains(t, 'object-detection') THEN 'detections' END, CASE WHEN list_contains(t, 'image-segmentation') THEN 'mask' END, CASE WHEN list_has_any(t, ['image-to-text', 'speech-recognition']) THEN 'text' END), ''), 'output') AS outputs, count(*) AS n
FROM s GROUP BY ALL""",
    "delivered_json_members": f"""
SELECT name, CASE t WHEN 'NULL' THEN NULL WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'BIGINT' THEN 'integer' WHEN 'UBIGINT' THEN 'integer' WHEN 'DOUBLE' THEN 'number' ELSE {_scalar("v")} END AS kind, count(*) AS n FROM (
  SELECT k AS name, json_type(j, '$."' || k || '"') AS t, j ->> ('$."' || k || '"') AS v FROM (SELECT CAST(data_json AS JSON) AS j, unnest(json_keys(data_json)) AS k FROM job_event_deliveries WHERE json_valid(data_json))) GROUP BY ALL""",
    "doc_excerpt": r"""
SELECT doc_id, left(array_to_string([y for y in [regexp_replace(x, '^\s+|\s+$', '', 'g') for x in regexp_split_to_array(
  regexp_replace(left(text, 24576), '(authorization\s*:\s*bearer\s+|api[_ -]?key\s*[=:]\s*|sk-[A-Za-z0-9_-]{8,})[^\s"'']+', '[REDACTED]', 'gi'), '\r\n|\r|\n')] if y <> ''], ' '), 800) AS excerpt FROM documents""",
    "survey_sketch": f"""
WITH f AS (SELECT resource_id, lower(list_extract(string_split(file_path, '/'), -1)) AS b, lower(regexp_extract(list_extract(string_split(file_path, '/'), -1), '[^.].*?([.][^.]+)$', 1)) AS s,
  list_has_any(string_split(replace(lower(array_to_string([regexp_replace(x, '(.)[.][^.]*$', '\\1') for x in string_split(file_path, '/')], '_')), '-', '_'), '_'), [{", ".join(repr(t) for t in names.ANNOTATION_TOKENS)}]) AS a
  FROM (SELECT DISTINCT resource_id, file_id, file_path FROM column_facts)),
k AS (SELECT resource_id, CASE WHEN b IN ('readme', 'readme.md', 'readme.txt', 'license', 'changelog') OR starts_with(b, 'readme.') THEN 'documentation' WHEN s IN ({", ".join(repr(t) for t in names.IMAGE_SUFFIXES)}) THEN 'image'
  WHEN s IN ({", ".join(repr(t) for t in names.VIDEO_SUFFIXES)}) THEN 'video' WHEN a AND s IN ({", ".join(repr(t) for t in names.ANNOTATION_SUFFIXES)}) THEN 'annotation' WHEN s IN ({", ".join(repr(t) for t in names.STRUCTURED_SUFFIXES)}) THEN 'structured' ELSE 'other' END AS k FROM f)
SELECT resource_id, count(*) AS files, {", ".join(f"count(*) FILTER (WHERE k = '{x}') AS {x}" for x in ("documentation", "image", "video", "annotation", "structured", "other"))} FROM k GROUP BY resource_id""",
    "snapshot_revisions": """
WITH f AS (SELECT resource_id, sha256(concat_ws(chr(1), path, CAST(max(byte_size) AS VARCHAR), CAST(epoch_us(max(discovered_at)) AS VARCHAR))) AS h FROM image_candidates GROUP BY resource_id, path)
SELECT resource_id, substr(sha256(concat_ws('|', count(*), sum(CAST('0x' || substr(h, 1, 15) AS UBIGINT)), sum(CAST('0x' || substr(h, 16, 15) AS UBIGINT)), sum(CAST('0x' || substr(h, 31, 15) AS UBIGINT)))), 1, 16) AS revision FROM f GROUP BY resource_id""",
    "structural_conflicts": f"""
SELECT resource_id, c AS conflict, CASE WHEN len(f) > 0 AND NOT c THEN 'VERIFIED' ELSE 'UNKNOWN' END AS status, CASE WHEN len(f) > 0 AND NOT c THEN array_to_string(f, '|') END AS value,
  CASE WHEN len(f) > 0 AND NOT c THEN NULL WHEN c THEN 'CONFLICTING_EVIDENCE' ELSE 'NO_EVIDENCE' END AS reason FROM (
  SELECT *, len(f) > 0 AND len(m) > 0 AND len([x for x in f if NOT list_contains(m, x)]) > 0 AS c FROM (
    SELECT resource_id, coalesce(list(DISTINCT seen ORDER BY seen) FILTER (WHERE seen <> 'unknown'), []) AS f, coalesce(list(DISTINCT told) FILTER (WHERE told <> 'UNKNOWN'), []) AS m FROM (
      SELECT resource_id, coalesce(lower(trim(split_name)), 'UNKNOWN') AS told, {_SPLIT} AS seen FROM (SELECT *, {_HIT} AS s FROM image_candidates)) GROUP BY 1))""",
    "readme_facts": r"""
SELECT doc_id, left(coalesce([y for y in [trim(regexp_replace(trim(x), '^#+', '')) for x in regexp_split_to_array(text, '\r\n|\r|\n')] if y <> '' AND NOT regexp_matches(y, '^[\[!<]')][1], ''), 500) AS description,
  trim(regexp_extract(text, '(?:license|licence)\s*[:#-]?\s*([A-Za-z0-9 .+-]{3,40})', 1, 'i')) AS license FROM documents""",
    "structural_media": f"""
WITH n AS (SELECT split_part(series, '-', 1) AS family, {", ".join(_family("name", f) for f in ("frame", "track", "identity", "camera"))} FROM ({_FEATURES}) GROUP BY 1),
c AS (SELECT family, count(*) FILTER (WHERE list_has_any(string_split(replace(lower(array_to_string([regexp_replace(x, '(.)[.][^.]*$', '\\1') for x in string_split(file_path, '/')], '_')), '-', '_'), '_'), [{", ".join(repr(t) for t in names.ANNOTATION_TOKENS)}])) AS a
  FROM (SELECT DISTINCT split_part(series, '-', 1) AS family, file_path FROM column_facts) GROUP BY 1)
SELECT family, CASE WHEN h_frame THEN 'image_sequence' ELSE 'independent_image' END AS organisation, CASE WHEN h_frame THEN 'sequence' ELSE 'none' END AS temporal,
  coalesce(nullif(concat_ws('|', CASE WHEN a > 0 THEN 'image_to_annotation' END, CASE WHEN h_track AND h_frame THEN 'frame_to_track' END, CASE WHEN h_identity AND h_camera THEN 'identity_to_camera' END), ''), 'UNKNOWN') AS relations
FROM n JOIN c USING (family)""",
}
