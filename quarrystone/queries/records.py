"""Queries for evidence, caps, checks and small projections of records."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrystone.functions import names, types
from quarrystone.operators import checks, compat, evidence, integrity, structure
from quarrystone.queries.analytics import _CONTRACTS, _DATASETS, _MAPPED, CONTRACTS, _contracts, _datasets, _relation
from quarrystone.queries.analytics import SQL as SQL_OF_EVENTS
from quarrystone.session import table

Query = Callable[[SparkSession, str], DataFrame]

EVENT_SCHEMA = {
    "type": "object", "required": ["stage"],
    "properties": {"stage": {"type": "string", "minLength": 1}, "completed": {"type": "integer", "minimum": 0, "maximum": 60}, "state": {"enum": ["started", "completed"]}},
    "anyOf": [{"required": ["state"]}, {"required": ["total"]}],
}
EVENT_TYPES = ["stage", "progress", "warning", "evidence", "result", "end"]
KINDS = ["image", "frame"]
LONGEST_MS = 3_600_000


def _paths(spark: SparkSession, d: str) -> list[DataFrame]:
    """Paths of images, of videos and of other files of each resource."""
    c, s, f = (table(spark, d, t) for t in ("image_candidates", "sample_refs", "column_facts"))
    return [c.select("resource_id", "path"), s.select("resource_id", F.col("video_path").alias("path")), f.select("resource_id", F.col("file_path").alias("path"))]


def evidence_rows(spark: SparkSession, d: str) -> DataFrame:
    return evidence.evidence_rows(_paths(spark, d), "resource_id", "path").select(F.col("key").alias("resource_id"), "class", "path", "evidence_id")


def allowed_paths(spark: SparkSession, d: str) -> DataFrame:
    return evidence.in_class_order(_paths(spark, d)[:2], "resource_id", "path").groupBy(F.col("key").alias("resource_id"), "class").agg(F.count("*").alias("paths"))


def inspection_candidates(spark: SparkSession, d: str) -> DataFrame:
    out = evidence.inspection_candidates(_paths(spark, d), "resource_id", "path")
    return out.select(F.col("key").alias("resource_id"), "class", "path", F.col("rank").cast("bigint").alias("rank"))


def representative_paths(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "column_facts").select("resource_id", "file_path").where("resource_id is not null and file_path is not null").distinct()
    return evidence.capped(f, ["resource_id"], ["file_path"], evidence.MOST_DOCUMENTS)


def capped_columns(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "column_facts").select("file_id", "fact_id", "col_pos")
    return evidence.capped(f, ["file_id"], ["col_pos", "fact_id"], 5)


def evidence_by_kind(spark: SparkSession, d: str) -> DataFrame:
    sets = evidence.evidence_sets(table(spark, d, "sample_refs"), ["resource_id"], "kind", "sample_key")
    return sets.groupBy("resource_id", F.coalesce("value", F.lit("*")).alias("kind")).agg(F.count("*").alias("evidence"), F.min("evidence").alias("first"), F.max("evidence").alias("last"))


def unsupported_strata(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "sampling_summaries")
    return s.where(evidence.without_evidence(F.col("strata"), F.col("coverage_losses"))).select("sampling_key", "created_at", F.size("strata").alias("strata"))


def value_violations(spark: SparkSession, d: str) -> DataFrame:
    v = checks.value_violations(table(spark, d, "sample_refs"), "sample_key", {"kind": KINDS, "split_name": ["train", "validation", "test"]})
    return v.groupBy("field", "value").agg(F.count("*").alias("rows"), F.countDistinct("row").alias("records"))


def temporal_violations(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "sample_refs").withColumn("reason", checks.temporal_reason(LONGEST_MS))
    return s.where("reason is not null and reason <> 'kind'").select("sample_key", "selected_at", "reason")


def candidate_violations(spark: SparkSession, d: str) -> DataFrame:
    out = checks.candidate_violations(table(spark, d, "image_candidates"), table(spark, d, "sample_refs"), "candidate_key")
    return out.groupBy("reason").agg(F.count("*").alias("rows"), F.countDistinct("key").alias("records"))


def schema_validation(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "job_event_deliveries").withColumn("v", F.try_parse_json("data_json"))
    return e.groupBy("event_type", checks.valid(F.col("v"), EVENT_SCHEMA).alias("valid")).agg(F.count("*").alias("n"))


def common_shapes(spark: SparkSession, d: str) -> DataFrame:
    shape = F.when(F.size("embedding") >= 0, F.size("embedding").cast("string"))
    return table(spark, d, "image_candidates").groupBy("resource_id").agg(F.coalesce(evidence.common_shape(shape), F.lit("")).alias("shape"), F.count(shape).alias("shaped"))


def frame_counts(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "resources").select("resource_id")
    i = table(spark, d, "image_candidates").groupBy("resource_id").agg(F.countDistinct("path").alias("images"))
    f = table(spark, d, "sample_refs").where("kind = 'frame'").groupBy("resource_id").agg(F.countDistinct("video_path", "frame_start").alias("frames"))
    return r.join(i, "resource_id", "left").join(f, "resource_id", "left").select("resource_id", evidence.frame_count(F.col("images"), F.col("frames")).alias("frame_count"))


def resource_means(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "sampling_summaries").groupBy("resource_id")
    mean = lambda c, ok: F.round(F.avg(F.when(ok, F.col(c))), 6)
    return s.agg(
        mean("successful_observation_count", F.col("selected_count") > 0).alias("mean_observed"), mean("failed_observation_count", F.col("failed_observation_count") > 0).alias("mean_failed"),
        mean("coverage", F.col("coverage").isNotNull()).alias("mean_coverage"), F.count_if(F.col("selected_count") > 0).alias("valid"),
    )


def license_presence(spark: SparkSession, d: str) -> DataFrame:
    known = ~F.coalesce(names.slug(F.col("license")), F.lit("")).isin("", "unknown")
    return table(spark, d, "resources").select("resource_id", F.when(known, "compatible").otherwise("unknown").alias("status"), F.when(known, 1.0).otherwise(0.5).alias("score"))


def joined_modalities(spark: SparkSession, d: str) -> DataFrame:
    none = F.array().cast("array<string>")
    union = F.array_distinct(F.concat(F.coalesce("modalities", none), F.array(F.lit("rgb"), F.lit("text"))))
    return table(spark, d, "resources").select("resource_id", F.array_join(union, "|").alias("modalities"))


def step_coverage(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "sampling_summaries")
    losses = F.array(F.lit("Budget_limited_candidate_coverage "))
    return s.select("sampling_key", "created_at", evidence.same_steps(F.col("coverage_losses"), losses).alias("same"))


def step_labels(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "sampling_summaries").select("sampling_key", "created_at", evidence.step_label(F.col("strategy"), F.col("resource_id"), F.col("fallback_reason")).alias("label"))


def flat_rows(spark: SparkSession, d: str) -> DataFrame:
    m = F.try_variant_get(F.try_parse_json("data_json"), "$", "map<string,variant>")
    scalar = lambda v: ~(F.schema_of_variant(v).startswith("OBJECT") | F.schema_of_variant(v).startswith("ARRAY"))
    return table(spark, d, "job_event_deliveries").groupBy("event_type", F.coalesce(F.exists(F.map_values(m), scalar), F.lit(False)).alias("flat")).agg(F.count("*").alias("n"))


def key_spellings(spark: SparkSession, d: str) -> DataFrame:
    v = F.try_parse_json("body")
    get = lambda name: F.try_variant_get(v, f"$.{name}", "string")
    both = F.coalesce(get("profileId"), get("profile_id"))
    return table(spark, d, "profile_bodies").select("profile_id", "received_at", both.alias("said")).where("said is not null")


def progress_gaps(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "job_event_deliveries").where("event_type <> 'progress'").withColumn("job", F.lower(F.regexp_replace("job_id", r"^\s+|\s+$", "")))
    return integrity.gaps(e, "job", "event_id")


def after_warning(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "job_event_deliveries").withColumn("job", F.lower(F.regexp_replace("job_id", r"^\s+|\s+$", "")))
    return integrity.after_end(e, "job", "event_id", "event_type", "warning").select("job", "delivery_id")


def image_flags(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "job_event_deliveries")
    said = F.lower(F.coalesce("data_json", F.lit(""))).contains("image")
    return e.groupBy(F.lower(F.trim("job_id")).alias("job")).agg(F.bool_or(said).alias("requires_image"), F.bool_or(F.col("event_type") == "error").alias("absent"))


def source_revisions(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "image_candidates").where("path is not null and content_hash is not null")
    kept = f.where(~names.weights(F.col("path")) & F.col("path").rlike("(?i)[.](jpg|jpeg)$")).select("resource_id", "path", "content_hash").distinct()
    return kept.groupBy("resource_id").agg(F.count("*").alias("files"), F.bit_xor(F.conv(F.substring(F.sha2(F.concat_ws("|", "path", "content_hash"), 256), 1, 12), 16, 10).cast("bigint")).alias("revision"))


def merged_mappings(spark: SparkSession, d: str) -> DataFrame:
    feats, fields = _datasets(spark, d), _contracts(spark)
    have = compat.field_mapping(feats, fields).select("dataset", "model", "name", "field")
    wide = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.lit(f).alias("field"), F.lit(t).alias("field_type")) for m, f, t, _ in CONTRACTS if t == "string"]))
    offered = feats.where(F.col("name").startswith("s")).select("dataset", "name", "data_type", wide.alias("x"))
    offered = offered.select("dataset", "x.model", "name", "x.field", types.type_relation(F.col("data_type"), F.col("x.field_type")).alias("relation"))
    return evidence.merged_mappings(have, offered)


def documentation_budget(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "eval_items").where("text is not null").select(F.coalesce("item_kind", F.lit("")).alias("kind"), "item_id", "text")
    out = structure.documentation_budget(docs, ["kind"], "item_id", most_chars=6000)
    return out.select("kind", "item_id", F.length("text").cast("bigint").alias("chars"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        evidence_rows, allowed_paths, inspection_candidates, representative_paths, capped_columns, evidence_by_kind, unsupported_strata, value_violations, temporal_violations,
        candidate_violations, schema_validation, common_shapes, frame_counts, resource_means, license_presence, joined_modalities, step_coverage, step_labels, flat_rows, key_spellings,
        image_flags, progress_gaps, after_warning, source_revisions, merged_mappings, documentation_budget,
    )
}

_CLASSES = """SELECT resource_id, path, min(class) AS class FROM (
  SELECT resource_id, path, 0 AS class FROM image_candidates UNION ALL SELECT resource_id, video_path, 1 FROM sample_refs UNION ALL SELECT resource_id, file_path, 2 FROM column_facts)
  WHERE resource_id IS NOT NULL AND path IS NOT NULL {where} GROUP BY 1, 2"""
_RANKED = f"SELECT resource_id, class, path, row_number() OVER (PARTITION BY resource_id ORDER BY class, path) AS rank FROM ({_CLASSES.format(where='')})"
_SLUG = "trim(regexp_replace(lower(trim(license)), '[^a-z0-9]+', '-', 'g'), '-')"
_INTEGER = "json_type(data_json, '$.completed') IN ('UBIGINT', 'BIGINT')"

SQL: dict[str, str] = {
    "evidence_rows": f"SELECT resource_id, class, path, printf('evidence_%03d', rank) AS evidence_id FROM ({_RANKED})",
    "allowed_paths": f"SELECT resource_id, class, count(*) AS paths FROM ({_CLASSES.format(where='AND class < 2')}) GROUP BY 1, 2",
    "inspection_candidates": f"SELECT * FROM ({_RANKED}) WHERE rank <= 24",
    "representative_paths": """SELECT resource_id, file_path, n > 4 AS truncated FROM (
  SELECT *, row_number() OVER (PARTITION BY resource_id ORDER BY file_path) AS r, count(*) OVER (PARTITION BY resource_id) AS n FROM (SELECT DISTINCT resource_id, file_path FROM column_facts WHERE resource_id IS NOT NULL AND file_path IS NOT NULL)) WHERE r <= 4""",
    "capped_columns": "SELECT file_id, fact_id, col_pos, n > 5 AS truncated FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY col_pos, fact_id) AS r, count(*) OVER (PARTITION BY file_id) AS n FROM column_facts) WHERE r <= 5",
    "evidence_by_kind": """SELECT resource_id, kind, count(DISTINCT sample_key) AS evidence, min(sample_key) AS first, max(sample_key) AS last FROM (
  SELECT resource_id, kind, sample_key FROM sample_refs WHERE kind IS NOT NULL UNION ALL SELECT resource_id, '*', sample_key FROM sample_refs) WHERE sample_key IS NOT NULL GROUP BY 1, 2""",
    "unsupported_strata": "SELECT sampling_key, created_at, len(strata)::INTEGER AS strata FROM sampling_summaries WHERE len(strata) > 0 AND coalesce(len(coverage_losses), 0) = 0",
    "value_violations": f"""SELECT field, value, count(*) AS rows, count(DISTINCT sample_key) AS records FROM (
  SELECT sample_key, 'kind' AS field, kind AS value FROM sample_refs WHERE kind IS NULL OR kind NOT IN {tuple(KINDS)}
  UNION ALL SELECT sample_key, 'split_name', split_name FROM sample_refs WHERE split_name IS NULL OR split_name NOT IN ('train', 'validation', 'test')) GROUP BY 1, 2""",
    "temporal_violations": f"""SELECT sample_key, selected_at, reason FROM (SELECT *, CASE WHEN coalesce(kind, '') NOT IN ('frame', 'clip') THEN 'kind'
  WHEN coalesce(video_path, '') = '' OR start_ms IS NULL OR end_ms IS NULL THEN 'video' WHEN start_ms < 0 OR end_ms <= start_ms OR end_ms > {LONGEST_MS} THEN 'time'
  WHEN frame_start IS NULL OR frame_end IS NULL OR frame_start < 0 OR frame_end < frame_start THEN 'frames' WHEN sampling_fps IS NULL OR NOT (sampling_fps > 0 AND sampling_fps <= 240) THEN 'fps' END AS reason FROM sample_refs)
  WHERE reason <> 'kind'""",
    "candidate_violations": r"""SELECT reason, count(*) AS rows, count(DISTINCT candidate_key) AS records FROM (SELECT candidate_key, CASE WHEN path IS NULL OR regexp_matches(path, '^/|(^|/)[.][.](/|$)') THEN 'path'
  WHEN NOT coalesce(regexp_full_match(content_hash, 'sha256:[0-9a-f]{64}'), false) THEN 'hash' WHEN path NOT IN (SELECT path FROM sample_refs WHERE path IS NOT NULL) THEN 'missing' END AS reason FROM image_candidates) WHERE reason IS NOT NULL GROUP BY 1""",
    "schema_validation": f"""SELECT event_type, coalesce(json_type(data_json) = 'OBJECT' AND json_type(data_json, '$.stage') = 'VARCHAR' AND length(data_json ->> '$.stage') > 0
    AND (json_type(data_json, '$.completed') IS NULL OR ({_INTEGER} AND CAST(data_json ->> '$.completed' AS BIGINT) BETWEEN 0 AND 60))
    AND (json_type(data_json, '$.state') IS NULL OR coalesce(data_json ->> '$.state', '') IN ('started', 'completed'))
    AND (json_type(data_json, '$.state') IS NOT NULL OR json_type(data_json, '$.total') IS NOT NULL), false) AS valid, count(*) AS n FROM (SELECT event_type, CASE WHEN json_valid(data_json) THEN data_json END AS data_json FROM job_event_deliveries) GROUP BY 1, 2""",
    "common_shapes": "SELECT resource_id, coalesce(CASE WHEN count(DISTINCT len(embedding)) = 1 THEN CAST(max(len(embedding)) AS VARCHAR) END, '') AS shape, count(embedding) AS shaped FROM image_candidates GROUP BY 1",
    "frame_counts": """SELECT r.resource_id, coalesce(nullif(i.n, 0), f.n, 0) AS frame_count FROM resources r
  LEFT JOIN (SELECT resource_id, count(DISTINCT path) AS n FROM image_candidates GROUP BY 1) i ON i.resource_id = r.resource_id
  LEFT JOIN (SELECT resource_id, count(DISTINCT (video_path, frame_start)) FILTER (WHERE video_path IS NOT NULL AND frame_start IS NOT NULL) AS n FROM sample_refs WHERE kind = 'frame' GROUP BY 1) f ON f.resource_id = r.resource_id""",
    "resource_means": """SELECT resource_id, round(avg(successful_observation_count) FILTER (WHERE selected_count > 0), 6) AS mean_observed, round(avg(failed_observation_count) FILTER (WHERE failed_observation_count > 0), 6) AS mean_failed,
  round(avg(coverage), 6) AS mean_coverage, count(*) FILTER (WHERE selected_count > 0) AS valid FROM sampling_summaries GROUP BY 1""",
    "license_presence": f"SELECT resource_id, CASE WHEN coalesce({_SLUG}, '') IN ('', 'unknown') THEN 'unknown' ELSE 'compatible' END AS status, CASE WHEN coalesce({_SLUG}, '') IN ('', 'unknown') THEN 0.5 ELSE 1.0 END::DOUBLE AS score FROM resources",
    "joined_modalities": "SELECT resource_id, array_to_string([x for x, i in l if list_position(l, x) = i], '|') AS modalities FROM (SELECT resource_id, list_concat(coalesce(modalities, []), ['rgb', 'text']) AS l FROM resources)",
    "step_coverage": "SELECT sampling_key, created_at, list_sort(list_distinct([lower(trim(x)) for x in coalesce(coverage_losses, []) if trim(x) <> ''])) = ['budget_limited_candidate_coverage'] AS same FROM sampling_summaries",
    "step_labels": "SELECT sampling_key, created_at, trim(strategy) || CASE WHEN trim(coalesce(resource_id, '')) <> '' THEN '（' || trim(resource_id) || '）' ELSE '' END || CASE WHEN trim(coalesce(fallback_reason, '')) <> '' THEN '：' || trim(fallback_reason) ELSE '' END AS label FROM sampling_summaries",
    "flat_rows": """SELECT event_type, coalesce(len([k for k in json_keys(data_json) if json_type(data_json, '$."' || k || '"') NOT IN ('OBJECT', 'ARRAY')]) > 0, false) AS flat, count(*) AS n
  FROM (SELECT event_type, CASE WHEN json_valid(data_json) THEN data_json END AS data_json FROM job_event_deliveries) GROUP BY 1, 2""",
    "key_spellings": "SELECT profile_id, received_at, coalesce(body ->> '$.profileId', body ->> '$.profile_id') AS said FROM (SELECT profile_id, received_at, CASE WHEN json_valid(body) THEN body END AS body FROM profile_bodies) WHERE coalesce(body ->> '$.profileId', body ->> '$.profile_id') IS NOT NULL",
    "progress_gaps": SQL_OF_EVENTS["contiguity"].replace("FROM job_event_deliveries", "FROM job_event_deliveries WHERE event_type <> 'progress'"),
    "after_warning": SQL_OF_EVENTS["after_end"].replace("event_type = 'end'", "event_type = 'warning'"),
    "image_flags": "SELECT lower(trim(job_id, ' ')) AS job, bool_or(contains(lower(coalesce(data_json, '')), 'image')) AS requires_image, bool_or(event_type = 'error') AS absent FROM job_event_deliveries GROUP BY 1",
    "source_revisions": r"""SELECT resource_id, count(*) AS files, bit_xor(CAST('0x' || substr(sha256(path || '|' || content_hash), 1, 12) AS BIGINT)) AS revision
FROM (SELECT DISTINCT resource_id, path, content_hash FROM image_candidates WHERE content_hash IS NOT NULL AND regexp_matches(lower(path), '[.](jpg|jpeg)$')) GROUP BY 1""",
    "merged_mappings": f"""WITH have AS (SELECT DISTINCT dataset, model, name, field FROM ({_MAPPED})),
offered AS (SELECT DISTINCT dataset, model, name, field FROM ({_DATASETS}) d, {_CONTRACTS} WHERE field_type = 'string' AND name LIKE 's%' AND {_relation("data_type", "field_type")} <> 'blocked')
SELECT *, 'existing' AS origin FROM have UNION ALL SELECT *, 'suggested' FROM (SELECT * FROM offered EXCEPT SELECT * FROM have)""",
}
