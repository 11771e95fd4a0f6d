"""Queries for sampling, distributions, metrics, integrity, compatibility, catalogues and events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrystone.functions import names, types
from quarrystone.operators import admission, compat, delivery, distribution, integrity, metrics, profile, retrieval, sampling, transform
from quarrystone.queries.profiling import _FEATURES, _HIT, _NAME, _SPLIT, _features
from quarrystone.session import table
from quarrystone.sources import sinks
from quarrystone.streaming import events as streams

Query = Callable[[SparkSession, str], DataFrame]

BUDGET, SEED, BYTES, K = 200, 42, 100_000, 10
# input contracts that datasets are held against: model, field, type, required
CONTRACTS = [
    ("detector", "image_id", "string", True), ("detector", "bbox_count", "integer", True), ("detector", "label", "classlabel", True),
    ("tracker", "frame_id", "integer", True), ("tracker", "track_id", "string", True), ("tracker", "speed", "number", False),
    ("captioner", "pixel_values", "image", True), ("captioner", "caption", "string", True),
]
MODEL_MODALITIES = [("detector", "rgb"), ("tracker", "rgb|event"), ("captioner", "rgb|text"), ("mapper", "depth")]


def quota_allocation(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "documents").groupBy(F.coalesce(F.lower(F.trim("source")), F.lit("")).alias("stratum")).agg(F.count("*").alias("members"))
    return sampling.quotas(s.withColumn("k", F.lit(1)), ["k"], "stratum", F.lit(BUDGET)).select("stratum", "members", "quota")


def stratified_sample(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "documents").select(F.lit(1).alias("k"), F.coalesce(F.lower(F.trim("source")), F.lit("")).alias("stratum"), F.col("doc_id").cast("string").alias("path"), F.coalesce("commit_sha", F.lit("")).alias("content_hash"))
    s = sampling.stratified_sample(c, ["k"], "stratum", "path", "content_hash", F.lit(BUDGET), SEED)
    return s.select("stratum", F.col("path").cast("bigint").alias("doc_id"), F.col("sample_rank").cast("bigint").alias("sample_rank"), "sample_id")


def image_samples(spark: SparkSession, d: str) -> DataFrame:
    c = sinks.latest(table(spark, d, "image_candidates").select("candidate_key", "resource_id", "stratum", "path", "content_hash", "discovered_at"), "candidate_key", ["discovered_at"])
    c = c.withColumn("stratum", sampling.format_stratum(F.lower(F.trim("stratum")), F.col("path")))
    s = sampling.stratified_sample(c, ["resource_id"], "stratum", "path", "content_hash", F.lit(64), SEED)
    return s.select("resource_id", "candidate_key", "stratum", "sample_id")


def sampling_coverage(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "image_candidates").withColumn("s", F.coalesce(F.lower(F.trim("stratum")), F.lit("")))
    out = sampling.sampling_summary(c, ["resource_id"], "s", F.lit(64)).drop("strata")
    return out.withColumn("coverage", F.round("coverage", 6))


def temporal_slices(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "sample_refs").where("video_path is not null").groupBy(F.col("video_path").alias("path"))
    v = v.agg(F.max("end_ms").alias("duration_ms"), (F.max("frame_end") + 1).alias("frame_count"), F.max("sampling_fps").alias("fps"))
    return sampling.temporal_slices(v, 3, 500).withColumn("slice", F.col("slice").cast("bigint"))


def _strata(spark: SparkSession, d: str) -> DataFrame:
    value = F.coalesce(F.regexp_extract(F.lower(F.trim("stratum")), "^([a-z]+):", 1), F.lit("UNKNOWN"))
    return table(spark, d, "image_candidates").select("resource_id", F.array(F.when(value == "", "UNKNOWN").otherwise(value)).alias("values"), F.concat_ws("|", "candidate_key", "discovered_at", "path").alias("obs"))


def value_distribution(spark: SparkSession, d: str) -> DataFrame:
    out = distribution.value_distribution(_strata(spark, d), ["resource_id"], "values", "obs")
    return out.withColumn("share", F.round("share", 6))


def multi_field_distribution(spark: SparkSession, d: str) -> DataFrame:
    long = distribution.field_observations(table(spark, d, "orders"), "o_orderkey", ["o_orderstatus", "o_orderpriority"])
    out = distribution.value_distribution(long, ["field"], "values", "observation")
    return out.withColumn("share", F.round("share", 6))


def claim_status(spark: SparkSession, d: str) -> DataFrame:
    return distribution.claims(distribution.value_distribution(_strata(spark, d), ["resource_id"], "values", "obs"), ["resource_id"])


def budget_admission(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.coalesce(F.lower(F.trim("source")), F.lit("")).alias("source"), "doc_id", F.char_length("text").cast("bigint").alias("size"))
    return admission.greedy_admission(docs, "source", "doc_id", "size", BYTES)


def set_prf(spark: SparkSession, d: str) -> DataFrame:
    told = table(spark, d, "sampling_summaries").select("resource_id", F.explode("strata").alias("s")).groupBy("resource_id").agg(F.collect_set(F.lower(F.trim("s"))).alias("told"))
    real = table(spark, d, "image_candidates").groupBy("resource_id").agg(F.collect_set(F.lower(F.trim("stratum"))).alias("real"))
    out = metrics.set_scores(told.join(real, "resource_id"), "real", "told")
    return out.select("tp", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


def _labels(spark: SparkSession, d: str) -> DataFrame:
    told = F.lower(F.trim("split_name"))
    said = F.when(told.isin("valid", "val", "dev"), "validation").otherwise(told)
    return table(spark, d, "image_candidates").select(said.alias("said"), F.nullif(names.path_split(F.col("path")), F.lit("unknown")).alias("seen"))


def label_f1(spark: SparkSession, d: str) -> DataFrame:
    return metrics.label_scores(_labels(spark, d), "said", "seen").withColumn("f1", F.round("f1", 6))


def macro_f1(spark: SparkSession, d: str) -> DataFrame:
    out = metrics.macro_f1(metrics.label_scores(_labels(spark, d), "said", "seen"))
    return out.select(F.round("macro_f1", 6).alias("macro_f1"), "labels")


def unknown_rate(spark: SparkSession, d: str) -> DataFrame:
    return _labels(spark, d).agg(F.round(metrics.unknown_rate(None, "seen"), 6).alias("unknown_rate"))


def profile_consistency(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "column_facts").select("series", names.plain_name(F.col("name")).alias("name"), "file_seq", types.known_types(F.col("observed_types")).alias("types"))
    f = f.where("name is not null and name <> ''").groupBy("series", "name", "file_seq").agg(F.max("types").alias("types"))
    return metrics.consistency(f, ["series", "name"], "file_seq", "types").withColumn("consistency", F.round("consistency", 6))


def hit_mrr_ndcg(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    queries = e.where("vec_id % 100 = 0")  # the stated query set, held against all rows
    ranked = retrieval.rank_by_dot(e, "vec_id", "embedding", queries, K)
    rel = ranked.join(e.select("vec_id", "label"), "vec_id").join(queries.select(F.col("vec_id").alias("query"), F.col("label").alias("ql")), "query")
    rel = rel.withColumn("rel", (F.col("label") == F.col("ql")).cast("int"))
    n = e.groupBy("label").agg(F.count("*").alias("n"))
    ideal = queries.join(n, "label").select(F.col("vec_id").alias("query"), F.array_repeat(F.lit(1), F.least(F.lit(K), F.col("n") - 1).cast("int")).alias("gains"))
    out = metrics.ranking_scores(rel, "query", "rank", "rel", ideal, K)
    return out.select("query", *[F.round(c, 6).alias(c) for c in ("hit", "rr", "ndcg")])


def nearest_rank_percentile(spark: SparkSession, d: str) -> DataFrame:
    return metrics.nearest_ranks(table(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice", {f"p{int(p * 100)}": p for p in (0.5, 0.9, 0.95)})


def fk_violations(spark: SparkSession, d: str) -> DataFrame:
    res, refs, cand = table(spark, d, "resources"), table(spark, d, "sample_refs"), table(spark, d, "image_candidates")
    checks = [
        ("candidate_resource", integrity.missing_references(cand, "resource_id", res, "resource_id")),
        ("summary_resource", integrity.missing_references(table(spark, d, "sampling_summaries"), "resource_id", cand, "resource_id")),
        ("sample_content", integrity.missing_references(refs, "content_hash", cand, "content_hash")),
        ("lineitem_order", integrity.missing_references(table(spark, d, "lineitem"), "l_orderkey", table(spark, d, "orders"), "o_orderkey")),
    ]
    out = None
    for name, bad in checks:
        one = bad.agg(F.count("*").alias("violations")).select(F.lit(name).alias("reference"), "violations")
        out = one if out is None else out.unionByName(one)
    return out


def unique_violations(spark: SparkSession, d: str) -> DataFrame:
    return integrity.repeated(table(spark, d, "documents").where("text is not null"), [F.sha2("text", 256).alias("text_hash")])


def contiguity(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "job_event_deliveries").withColumn("job", F.lower(F.regexp_replace("job_id", r"^\s+|\s+$", "")))
    return integrity.gaps(e, "job", "event_id")


def after_end(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "job_event_deliveries").withColumn("job", F.lower(F.regexp_replace("job_id", r"^\s+|\s+$", "")))
    return integrity.after_end(e, "job", "event_id", "event_type", "end").select("job", "delivery_id")


def split_partition_check(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "image_candidates").withColumn("part", F.lower(F.trim("split_name")))
    v = integrity.partition_violations(c, "candidate_key", "part", c, "candidate_key")
    return v.groupBy("violation").agg(F.count("*").alias("n"))


def closed_members(spark: SparkSession, d: str) -> DataFrame:
    odd = integrity.closed_keys(F.col("data_json"), ["stage", "state"])
    return table(spark, d, "job_event_deliveries").where("event_type = 'stage'").groupBy(odd.alias("difference")).agg(F.count("*").alias("n"))


def type_relation_matrix(spark: SparkSession, d: str) -> DataFrame:
    kinds = sorted({t for ts in types.TYPE_GROUPS.values() for t in ts} | {"array", "object", "video", "unknown"})
    left = spark.createDataFrame([(a, kinds) for a in kinds], "source_type string, targets array<string>")
    pairs = left.select("source_type", F.explode("targets").alias("target_type"))
    return pairs.withColumn("relation", types.type_relation(F.col("source_type"), F.col("target_type")))


SHAPES = [(["224", "224", "3"], ["224", "224", "3"]), (["512", "512", "3"], ["224", "224", "3"]), (["variable", "4"], ["variable", "4"]), (["16"], ["batch", "16"]), (["8", "16"], ["*", "16"]), (["x", "16"], ["8", "16"]), (None, ["1"]), (["1"], [])]


def shape_relation(spark: SparkSession, d: str) -> DataFrame:
    s = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(SHAPES)], "case_id bigint, a array<string>, b array<string>")
    return s.select("case_id", types.shape_relation(F.col("a"), F.col("b")).alias("relation"))


def modality_subset(spark: SparkSession, d: str) -> DataFrame:
    models = [F.struct(F.lit(m).alias("model"), F.array(*map(F.lit, need.split("|"))).alias("need")) for m, need in MODEL_MODALITIES]
    r = table(spark, d, "resources").select("resource_id", "modalities", F.explode(F.array(*models)).alias("m"))
    status = compat.modality_dimension(F.col("modalities"), F.col("m.need"))
    lack = F.when(status == "blocked", compat.missing_modalities(F.col("modalities"), F.col("m.need")))
    return r.select("resource_id", F.col("m.model").alias("model"), status.alias("status"), lack.alias("missing"))


TASK_CASES = [("text-classification", "classification"), ("classification", "image-classification"), ("semantic-segmentation", "image-segmentation"), ("language-modeling", "text-generation"), ("object-detection", "regression"), ("", "regression"), ("Image Classification", "image-classification")]


def task_overlap(spark: SparkSession, d: str) -> DataFrame:
    t = spark.createDataFrame([(i, [a] if a else [], [b]) for i, (a, b) in enumerate(TASK_CASES)], "case_id bigint, hints array<string>, tasks array<string>")
    return t.select("case_id", compat.task_dimension(F.col("hints"), F.col("tasks")).alias("status"))


def _contracts(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CONTRACTS, "model string, field string, field_type string, required boolean")


def _datasets(spark: SparkSession, d: str) -> DataFrame:
    f = _features(spark, d).groupBy(F.col("series").alias("dataset"), "name")
    g = f.agg(F.collect_set("data_type").alias("labels"), F.min(F.col("file_seq") * 1000 + F.col("col_pos")).alias("pos"))
    return g.select("dataset", "name", types.combined_type(F.col("labels")).alias("data_type"), "pos")


def field_mapping(spark: SparkSession, d: str) -> DataFrame:
    m = compat.field_mapping(_datasets(spark, d), _contracts(spark))
    return m.select("dataset", "model", "field", "name", "data_type", "relation", "kind", "confidence")


def compat_dimensions(spark: SparkSession, d: str) -> DataFrame:
    dims = compat.mapping_dimensions(compat.field_mapping(_datasets(spark, d), _contracts(spark)))
    return dims.withColumn("score", F.round("score", 6))


def compat_report(spark: SparkSession, d: str) -> DataFrame:
    dims = compat.mapping_dimensions(compat.field_mapping(_datasets(spark, d), _contracts(spark)))
    return compat.roll_up(dims).withColumn("score", F.round("score", 6))


def compat_analysis(spark: SparkSession, d: str) -> DataFrame:
    """Report of every series with every contract over all nine dimensions.

    Modalities and licence of a series are those of its resource, as delivered. The contracts state no tasks, steps, licences or frameworks, so those count as not given.
    """
    none, f = F.array().cast("array<string>"), _features(spark, d)
    label = (F.col("role") == "label") | names.field_key(F.col("name")).isin("label", "labels", "target", "class")
    g = f.groupBy(F.col("series").alias("dataset")).agg(F.bool_or(label).alias("has_label"))
    own = table(spark, d, "column_facts").where("series is not null").groupBy(F.col("series").alias("dataset")).agg(F.min("resource_id").alias("resource_id"))
    known = own.join(table(spark, d, "resources").select("resource_id", "license", "modalities"), "resource_id").select("dataset", "license", "modalities")
    data = g.join(known, "dataset", "left").select("dataset", profile.task_hints(none, F.col("has_label")).alias("task_hints"), "modalities", "license", "has_label", none.alias("satisfied"))
    need = F.create_map(*[x for m, v in MODEL_MODALITIES for x in (F.lit(m), F.array(*map(F.lit, v.split("|"))))])
    models = _contracts(spark).select("model").distinct().select("model", none.alias("tasks"), F.element_at(need, F.col("model")).alias("modalities"), none.alias("preprocessing"), F.lit("unknown").alias("license"), none.alias("frameworks"))
    features, fields = _datasets(spark, d), _contracts(spark)
    dims = compat.field_dimensions(features, fields, compat.field_mapping(features, fields)).unionByName(compat.profile_dimensions(data, models))
    return compat.roll_up(dims).withColumn("score", F.round("score", 6))


def unmatched_fields(spark: SparkSession, d: str) -> DataFrame:
    data, contracts = _datasets(spark, d), _contracts(spark)
    return compat.unmatched(data, contracts, compat.field_mapping(data, contracts))


PLAN = [("caption", "caption"), ("img", "pixel_values"), ("label", "caption"), ("nothing", "caption"), ("speed", "missing_field")]


def plan_violations(spark: SparkSession, d: str) -> DataFrame:
    feats = _datasets(spark, d).groupBy("name").agg(F.min("data_type").alias("data_type"))
    plan = spark.createDataFrame(PLAN, "source string, target string")
    return transform.plan_violations(plan, feats, _contracts(spark).where("model = 'captioner'"))


def contract_union(spark: SparkSession, d: str) -> DataFrame:
    feats = _datasets(spark, d).groupBy("name").agg(F.min("data_type").alias("data_type"))
    plan = spark.createDataFrame([("caption", "caption"), ("mask_path", "pixel_values")], "source string, target string")
    return transform.contract_features(_contracts(spark).where("model = 'captioner'"), feats, plan)


def rename_transform(spark: SparkSession, d: str) -> DataFrame:
    return sinks.renamed(table(spark, d, "customer"), {"c_custkey": "id", "c_name": "text", "c_mktsegment": "label"})


def catalog_latest(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "image_candidates").select("candidate_key", "discovered_at", "path", "byte_size")
    return sinks.latest(c, "candidate_key", ["discovered_at", "path", "byte_size"])


def catalog_listing(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "resources").withColumn("kind", F.lit("dataset"))
    return sinks.newest_first(r, "dataset").select("resource_id", "updated_at")


def catalog_counts(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "sampling_summaries")
    warned = F.size(F.array_distinct(F.coalesce("coverage_losses", F.array().cast("array<string>"))))
    return c.agg(F.count_if(F.col("coverage") >= 0.5).alias("ready"), F.count_if(F.coalesce(F.col("coverage") < 0.5, F.lit(True))).alias("reviewing"), F.sum(warned).cast("bigint").alias("warnings"))


def topk_files(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_partkey", "p_size", names.file_priority(F.lower("p_name")).alias("priority"))
    return p.orderBy("priority", "p_size", "p_partkey").limit(12)


def dedupe_first(spark: SparkSession, d: str) -> DataFrame:
    first = F.min(F.struct("ts", "event_id")).alias("f")
    return table(spark, d, "events").groupBy("user_id", "event_type").agg(first).select("user_id", "event_type", F.col("f.event_id").alias("event_id"))


def idempotent_requests(spark: SparkSession, d: str) -> DataFrame:
    key = F.sha2(F.concat_ws("|", F.col("user_id").cast("string"), "event_type"), 256)
    g = table(spark, d, "events").groupBy(key.alias("canonical_key")).agg(F.min("event_id").alias("kept_event"), F.count("*").alias("requests"))
    return g


def event_replay(spark: SparkSession, d: str) -> DataFrame:
    e = delivery.exactly_once(table(spark, d, "job_event_deliveries"))
    return streams.replay(e, 10).select("delivery_id", "event_id")


def plain_events(spark: SparkSession, d: str) -> DataFrame:
    return streams.plain_events(table(spark, d, "job_event_deliveries")).groupBy("event_type", "stage").agg(F.count("*").alias("n"))


def event_windows(spark: SparkSession, d: str) -> DataFrame:
    return streams.windowed_counts(table(spark, d, "events"), "ts", "event_type", "1 day")


def event_sessions(spark: SparkSession, d: str) -> DataFrame:
    return streams.sessions(table(spark, d, "events"), "ts", "user_id", "30 minutes")


def profile_documents(spark: SparkSession, d: str) -> DataFrame:
    """The slice from table to report: profile a table and hold it against the contracts."""
    feats = types.schema_features(table(spark, d, "documents").schema)
    data = spark.createDataFrame([("documents", n, k, i) for i, (n, k, _, _) in enumerate(feats)], "dataset string, name string, data_type string, pos int")
    fields = spark.createDataFrame([("classifier", "text", "string", True), ("classifier", "label", "classlabel", True), ("counter", "n_chars", "number", True)], "model string, field string, field_type string, required boolean")
    return compat.roll_up(compat.field_dimensions(data, fields, compat.field_mapping(data, fields)))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        quota_allocation, stratified_sample, image_samples, sampling_coverage, temporal_slices, value_distribution, multi_field_distribution, claim_status,
        budget_admission, set_prf, label_f1, macro_f1, unknown_rate, profile_consistency, hit_mrr_ndcg, nearest_rank_percentile, fk_violations, unique_violations,
        contiguity, after_end, split_partition_check, closed_members, type_relation_matrix, shape_relation, modality_subset, task_overlap, field_mapping,
        compat_dimensions, compat_report, compat_analysis, unmatched_fields, plan_violations, contract_union, rename_transform, catalog_latest, catalog_listing, catalog_counts,
        topk_files, dedupe_first, idempotent_requests, event_replay, plain_events, event_windows, event_sessions, profile_documents,
    )
}
del Window

_JOB = r"lower(regexp_replace(job_id, '^\s+|\s+$', '', 'g'))"
_SOURCE = "coalesce(lower(trim(source)), '')"
_QUOTAS = f"""
  SELECT stratum, members, base + CASE WHEN row_number() OVER (ORDER BY base < members DESC, raw - floor(raw) DESC, stratum) <= b - sum(base) OVER () AND base < members THEN 1 ELSE 0 END AS quota FROM (
    SELECT *, least(members, CAST(floor(raw) AS BIGINT)) AS base FROM (
      SELECT *, b::DOUBLE * members / total AS raw FROM (
        SELECT {_SOURCE} AS stratum, count(*) AS members, least({BUDGET}, sum(count(*)) OVER ()) AS b, sum(count(*)) OVER () AS total FROM documents GROUP BY 1)))"""
_STRATA = "SELECT resource_id, coalesce(nullif(regexp_extract(lower(trim(stratum)), '^([a-z]+):', 1), ''), 'UNKNOWN') AS value, concat_ws('|', candidate_key, discovered_at, path) AS obs FROM image_candidates"


def _distribution(source: str, key: str, obs: str) -> str:
    return f"""
SELECT {key}, value, coalesce(n, 0) AS n, eligible, round(coalesce(n / eligible::DOUBLE, 0), 6) AS share, coalesce(n = most, false) AS dominant, {{status}} AS status, {{reason}} AS reason FROM (
  SELECT *, count(*) FILTER (WHERE n = most) OVER (PARTITION BY {key}) AS leaders FROM (
    SELECT e.{key}, value, n, eligible, max(n) OVER (PARTITION BY e.{key}) AS most
    FROM (SELECT {key}, count(DISTINCT {obs}) AS eligible FROM ({source}) GROUP BY 1) e
    LEFT JOIN (SELECT {key}, value, count(*) AS n FROM ({source}) WHERE value IS NOT NULL AND value <> 'UNKNOWN' GROUP BY 1, 2) c ON e.{key} = c.{key}))""".format(
        status="CASE WHEN most IS NULL OR (leaders > 1 AND most / eligible::DOUBLE >= 0.4) THEN 'UNKNOWN' WHEN most >= 3 AND most / eligible::DOUBLE >= 0.6 THEN 'SUPPORTED' ELSE 'OBSERVED' END",
        reason="CASE WHEN most IS NULL THEN 'NO_EVIDENCE' WHEN leaders > 1 AND most / eligible::DOUBLE >= 0.4 THEN 'CONFLICTING_EVIDENCE' END",
    )


_LABELS = f"""SELECT CASE WHEN t IN ('valid', 'val', 'dev') THEN 'validation' ELSE t END AS said, nullif({_SPLIT}, 'unknown') AS seen
  FROM (SELECT lower(trim(split_name)) AS t, {_HIT} AS s FROM image_candidates)"""
_F1 = f"""SELECT label, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn, CASE WHEN 2 * sum(tp) + sum(fp) + sum(fn) = 0 THEN 0 ELSE 2.0 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)) END::DOUBLE AS f1 FROM (
  SELECT e AS label, CASE WHEN e = p THEN 1 ELSE 0 END AS tp, 0 AS fp, CASE WHEN e = p THEN 0 ELSE 1 END AS fn FROM (SELECT coalesce(said, 'UNKNOWN') AS e, coalesce(seen, 'UNKNOWN') AS p FROM ({_LABELS}))
  UNION ALL SELECT p, 0, CASE WHEN e = p THEN 0 ELSE 1 END, 0 FROM (SELECT coalesce(said, 'UNKNOWN') AS e, coalesce(seen, 'UNKNOWN') AS p FROM ({_LABELS}))) GROUP BY label"""
_GROUPS = " ".join(f"WHEN {{c}} IN ({', '.join(repr(t) for t in ts)}) THEN '{g}'" for g, ts in types.TYPE_GROUPS.items())


def _relation(a: str, b: str) -> str:
    ga, gb = (f"(CASE {_GROUPS.format(c=c)} END)" for c in (a, b))
    return f"CASE WHEN {a} = {b} THEN 'compatible' WHEN coalesce({ga} = {gb} OR ({ga} = 'integer' AND {gb} = 'float') OR ({ga} = 'text' AND {gb} = 'integer'), false) THEN 'adaptable' ELSE 'blocked' END"


_CONTRACTS = "(VALUES " + ", ".join(f"('{m}', '{f}', '{t}', {str(r).lower()})" for m, f, t, r in CONTRACTS) + ") c(model, field, field_type, required)"
_COMBINE = "CASE WHEN len(labels) = 0 THEN 'unknown' WHEN len(labels) = 1 THEN labels[1] WHEN len([x for x in labels if x NOT IN ('integer', 'number')]) = 0 THEN 'number' ELSE 'mixed' END"
_DATASETS = f"SELECT series AS dataset, name, {_COMBINE} AS data_type, pos FROM (SELECT series, name, list(DISTINCT data_type) AS labels, min(file_seq * 1000 + col_pos) AS pos FROM ({_FEATURES}) GROUP BY 1, 2)"
_KEY = "regexp_replace(lower(trim({c})), '[^a-z0-9]+', '', 'g')"
_MAPPED = f"""SELECT dataset, model, field, name, data_type, field_type, relation, CASE WHEN relation = 'compatible' AND same THEN 'exact' ELSE 'transform' END AS kind FROM (
  SELECT *, {_relation("data_type", "field_type")} AS relation FROM (
    SELECT dataset, model, field, field_type, name, data_type, true AS same FROM (
      SELECT d.*, c.*, row_number() OVER (PARTITION BY dataset, model, field ORDER BY pos DESC, name DESC) AS n FROM ({_DATASETS}) d JOIN {_CONTRACTS} ON {_KEY.format(c="d.name")} = {_KEY.format(c="c.field")}) WHERE n = 1
    UNION ALL
    SELECT dataset, model, field, field_type, max(name), max(data_type), false FROM ({_DATASETS}) d
      JOIN {_CONTRACTS} ON {_KEY.format(c="c.field")} = 'pixelvalues' AND {_KEY.format(c="d.name")} IN ('image', 'images', 'pixelvalues')
      WHERE {_KEY.format(c="d.name")} <> {_KEY.format(c="c.field")} GROUP BY ALL HAVING count(*) = 1))"""
_DIMENSIONS = f"""SELECT dataset, model, dimension, avg(s) AS score, CASE WHEN min(s) = 0 THEN 'blocked' WHEN min(s) < 1 THEN 'adaptable' ELSE 'compatible' END AS status FROM (
  SELECT dataset, model, 'input_fields' AS dimension, CASE WHEN kind = 'exact' THEN 1.0 ELSE 0.75 END::DOUBLE AS s FROM ({_MAPPED})
  UNION ALL SELECT dataset, model, 'data_types', CASE relation WHEN 'compatible' THEN 1.0 WHEN 'adaptable' THEN 0.65 ELSE 0.0 END::DOUBLE FROM ({_MAPPED})) GROUP BY 1, 2, 3"""
_MODELS = "(VALUES " + ", ".join(f"('{m}', string_split('{n}', '|'))" for m, n in MODEL_MODALITIES) + ") m(model, need)"

SQL: dict[str, str] = {
    "quota_allocation": f"SELECT stratum, members, CAST(quota AS BIGINT) AS quota FROM ({_QUOTAS})",
    "stratified_sample": f"""
SELECT stratum, doc_id, sample_rank, sample_id FROM (
  SELECT d.stratum, doc_id, quota, row_number() OVER (PARTITION BY d.stratum ORDER BY sha256('{SEED}|' || d.stratum || '|' || doc_id || '|' || coalesce(commit_sha, '')), CAST(doc_id AS VARCHAR)) AS sample_rank,
         'sample_' || substr(sha256('{SEED}|image|' || doc_id), 1, 16) AS sample_id
  FROM (SELECT *, {_SOURCE} AS stratum FROM documents) d JOIN ({_QUOTAS}) q ON d.stratum = q.stratum) WHERE sample_rank <= quota""",
    "sampling_coverage": """
SELECT resource_id, candidate_count, least(64, candidate_count) AS selected_count, CASE WHEN f THEN 'stratified' ELSE 'deterministic_fallback' END AS strategy,
  round(least(64, candidate_count) / candidate_count::DOUBLE, 6) AS coverage, CASE WHEN NOT f THEN 'clustering_metadata_or_embedding_unavailable' END AS fallback_reason,
  concat_ws('|', CASE WHEN candidate_count > 64 THEN 'budget_limited_candidate_coverage' END, CASE WHEN NOT f THEN 'no_metadata_or_embedding_centers' END) AS coverage_losses
FROM (SELECT resource_id, count(*) AS candidate_count, bool_and(coalesce(metadata_available, false)) AND bool_and(coalesce(embedding_available, false)) AS f FROM image_candidates GROUP BY 1)""",
    "value_distribution": _distribution(_STRATA, "resource_id", "obs"),
    "multi_field_distribution": _distribution("SELECT 'o_orderstatus' AS field, o_orderkey AS obs, o_orderstatus AS value FROM orders UNION ALL SELECT 'o_orderpriority', o_orderkey, o_orderpriority FROM orders", "field", "obs"),
    "claim_status": f"""SELECT resource_id, coalesce(string_agg(value, '|' ORDER BY value) FILTER (WHERE dominant AND status <> 'UNKNOWN'), '') AS claim, max(status) AS status, max(reason) AS reason
FROM ({_distribution(_STRATA, "resource_id", "obs")}) GROUP BY 1""",
    "budget_admission": f"""
WITH RECURSIVE items AS (SELECT {_SOURCE} AS source, doc_id, length(text) AS size, row_number() OVER (PARTITION BY {_SOURCE} ORDER BY doc_id) AS n FROM documents WHERE text IS NOT NULL),
walk AS (
  SELECT source, doc_id, size, n, CASE WHEN size <= {BYTES} THEN size ELSE 0 END AS used, size <= {BYTES} AS taken FROM items WHERE n = 1
  UNION ALL SELECT i.source, i.doc_id, i.size, i.n, w.used + CASE WHEN w.used + i.size <= {BYTES} THEN i.size ELSE 0 END, w.used + i.size <= {BYTES} FROM walk w JOIN items i ON i.source = w.source AND i.n = w.n + 1)
SELECT source, doc_id, CAST(size AS BIGINT) AS size, CAST(used AS BIGINT) AS used FROM walk WHERE taken""",
    "set_prf": """
WITH told AS (SELECT resource_id, list(DISTINCT lower(trim(s))) FILTER (WHERE s IS NOT NULL) AS t FROM (SELECT resource_id, unnest(strata) AS s FROM sampling_summaries) GROUP BY 1),
     seen AS (SELECT resource_id, list(DISTINCT lower(trim(stratum))) FILTER (WHERE stratum IS NOT NULL) AS r FROM image_candidates GROUP BY 1),
     c AS (SELECT sum(len(list_intersect(t, r)))::BIGINT AS tp, sum(len(t) - len(list_intersect(t, r)))::BIGINT AS fp, sum(len(r) - len(list_intersect(t, r)))::BIGINT AS fn
           FROM (SELECT coalesce(t, []) AS t, coalesce(r, []) AS r FROM told JOIN seen USING (resource_id)))
SELECT tp, fp, fn, round(tp / (tp + fp)::DOUBLE, 6) AS precision, round(tp / (tp + fn)::DOUBLE, 6) AS recall, round(2.0 * tp / (2 * tp + fp + fn), 6)::DOUBLE AS f1 FROM c""",
    "label_f1": f"SELECT label, tp, fp, fn, round(f1, 6) AS f1 FROM ({_F1})",
    "macro_f1": f"SELECT round(avg(f1), 6) AS macro_f1, count(*) AS labels FROM ({_F1})",
    "unknown_rate": f"SELECT round(avg(CASE WHEN seen IS NULL THEN 1.0 ELSE 0.0 END)::DOUBLE, 6) AS unknown_rate FROM ({_LABELS})",
    "profile_consistency": f"""
SELECT count(*) AS comparisons, CAST(sum(CASE WHEN p IS NOT DISTINCT FROM t THEN 1 ELSE 0 END) AS BIGINT) AS matches, round(avg(CASE WHEN p IS NOT DISTINCT FROM t THEN 1.0 ELSE 0.0 END)::DOUBLE, 6) AS consistency FROM (
  SELECT t, lag(t) OVER w AS p, row_number() OVER w AS n FROM (
    SELECT series, name, file_seq, max(t) AS t FROM (
      SELECT series, {_NAME} AS name, file_seq, nullif(array_to_string(list_sort(list_distinct([x for x in coalesce(observed_types, []) if x IS NOT NULL AND x NOT IN ('', 'unknown')])), '|'), '') AS t FROM column_facts) WHERE name <> '' GROUP BY 1, 2, 3)
  WINDOW w AS (PARTITION BY series, name ORDER BY file_seq)) WHERE n > 1""",
    "hit_mrr_ndcg": f"""
WITH q AS (SELECT vec_id AS query, embedding AS qe, label AS ql FROM embeddings WHERE vec_id % 100 = 0),
     r AS (SELECT query, ql, label, row_number() OVER (PARTITION BY query ORDER BY list_dot_product(qe::DOUBLE[], embedding::DOUBLE[]) DESC, vec_id) AS rank FROM q, embeddings WHERE vec_id <> query),
     m AS (SELECT query, max(CASE WHEN label = ql THEN 1.0 ELSE 0.0 END)::DOUBLE AS hit, coalesce(1.0 / min(CASE WHEN label = ql THEN rank END), 0.0)::DOUBLE AS rr,
                  sum(CASE WHEN label = ql THEN 1 / log2(rank + 1) ELSE 0 END) AS dcg FROM r WHERE rank <= {K} GROUP BY query),
     i AS (SELECT query, (SELECT coalesce(sum(1 / log2(g + 1)), 0) FROM range(1, {K + 1}) t(g) WHERE g <= n) AS idcg FROM (SELECT query, (SELECT count(*) - 1 FROM embeddings e WHERE e.label = ql) AS n FROM q))
SELECT query, round(hit, 6) AS hit, round(rr, 6) AS rr, round(CASE WHEN idcg = 0 THEN 0 ELSE dcg / idcg END, 6) AS ndcg FROM m JOIN i USING (query)""",
    "nearest_rank_percentile": "SELECT l_returnflag, quantile_disc(l_extendedprice, 0.5) AS p50, quantile_disc(l_extendedprice, 0.9) AS p90, quantile_disc(l_extendedprice, 0.95) AS p95 FROM lineitem GROUP BY 1",
    "fk_violations": """
SELECT 'candidate_resource' AS reference, count(*) AS violations FROM image_candidates c WHERE resource_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM resources r WHERE r.resource_id = c.resource_id)
UNION ALL SELECT 'summary_resource', count(*) FROM sampling_summaries s WHERE resource_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM image_candidates c WHERE c.resource_id = s.resource_id)
UNION ALL SELECT 'sample_content', count(*) FROM sample_refs s WHERE content_hash IS NOT NULL AND NOT EXISTS (SELECT 1 FROM image_candidates c WHERE c.content_hash = s.content_hash)
UNION ALL SELECT 'lineitem_order', count(*) FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = l.l_orderkey)""",
    "unique_violations": "SELECT sha256(text) AS text_hash, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1",
    "contiguity": f"""
SELECT job, before, next, next - before - 1 AS missing FROM (
  SELECT job, coalesce(lag(event_id) OVER (PARTITION BY job ORDER BY event_id), 0) AS before, event_id AS next FROM (SELECT DISTINCT {_JOB} AS job, event_id FROM job_event_deliveries)) WHERE next > before + 1""",
    "after_end": f"""
WITH e AS (SELECT {_JOB} AS job, * FROM job_event_deliveries)
SELECT e.job, delivery_id FROM e JOIN (SELECT job, min(event_id) AS last FROM e WHERE event_type = 'end' GROUP BY 1) x ON e.job = x.job WHERE event_id > last""",
    "split_partition_check": """
WITH m AS (SELECT DISTINCT candidate_key, lower(trim(split_name)) AS part FROM image_candidates)
SELECT violation, count(*) AS n FROM (
  SELECT candidate_key, 'several' AS violation FROM m WHERE part IS NOT NULL GROUP BY 1 HAVING count(*) > 1
  UNION ALL SELECT candidate_key, 'none' FROM m GROUP BY 1 HAVING count(part) = 0) GROUP BY 1""",
    "type_relation_matrix": "WITH t AS (SELECT unnest([" + ", ".join(repr(t) for t in sorted({t for ts in types.TYPE_GROUPS.values() for t in ts} | {"array", "object", "video", "unknown"})) + f"]) AS k) SELECT a.k AS source_type, b.k AS target_type, {_relation('a.k', 'b.k')} AS relation FROM t a, t b",
    "modality_subset": """
SELECT resource_id, model, CASE WHEN h IS NULL OR len(h) = 0 THEN 'unknown' WHEN len(lack) = 0 THEN 'compatible' ELSE 'blocked' END AS status,
  CASE WHEN h IS NOT NULL AND len(h) > 0 AND len(lack) > 0 THEN array_to_string(lack, '|') END AS missing FROM (
  SELECT *, list_sort([x for x in need if NOT list_contains(h, x)]) AS lack FROM (
    SELECT resource_id, model, need, list_distinct([regexp_replace(regexp_replace(lower(trim(x)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') for x in modalities if x IS NOT NULL AND regexp_matches(lower(x), '[a-z0-9]')]) AS h
    FROM resources, """ + _MODELS + "))",
    "field_mapping": f"SELECT dataset, model, field, name, data_type, relation, kind, CASE WHEN kind = 'exact' THEN 1.0 ELSE 0.8 END::DOUBLE AS confidence FROM ({_MAPPED})",
    "compat_dimensions": f"SELECT dataset, model, dimension, round(score, 6) AS score, status FROM ({_DIMENSIONS})",
    "compat_report": f"""SELECT dataset, model, CASE WHEN bool_or(status = 'blocked') THEN 'blocked' WHEN bool_or(status = 'adaptable') THEN 'adaptable' ELSE 'compatible' END AS status,
  round(CASE WHEN bool_or(status = 'blocked') THEN least(avg(score), 0.49) ELSE avg(score) END::DOUBLE, 6) AS score, count(*) AS dimensions FROM ({_DIMENSIONS}) GROUP BY 1, 2""",
    "unmatched_fields": f"""
WITH m AS ({_MAPPED}), p AS (SELECT DISTINCT dataset, model FROM m)
SELECT p.dataset, p.model, 'dataset' AS side, d.name FROM p JOIN ({_DATASETS}) d ON p.dataset = d.dataset WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.dataset = p.dataset AND m.model = p.model AND m.name = d.name)
UNION ALL SELECT p.dataset, p.model, 'model', c.field FROM p JOIN {_CONTRACTS} ON p.model = c.model WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.dataset = p.dataset AND m.model = p.model AND m.field = c.field)""",
    "rename_transform": "SELECT c_custkey AS id, c_name AS text, c_nationkey, c_acctbal, c_mktsegment AS label FROM customer",
    "catalog_latest": "SELECT candidate_key, discovered_at, path, byte_size FROM (SELECT *, row_number() OVER (PARTITION BY candidate_key ORDER BY discovered_at DESC NULLS LAST, path DESC NULLS LAST, byte_size DESC NULLS LAST) AS n FROM image_candidates) WHERE n = 1",
    "catalog_listing": "SELECT resource_id, updated_at FROM resources",
    "catalog_counts": "SELECT count(*) FILTER (WHERE coverage >= 0.5) AS ready, count(*) FILTER (WHERE coalesce(coverage < 0.5, true)) AS reviewing, CAST(sum(len(list_distinct(coalesce(coverage_losses, [])))) AS BIGINT) AS warnings FROM sampling_summaries",
    "topk_files": "SELECT p_partkey, p_size, 3 AS priority FROM part ORDER BY p_size, p_partkey LIMIT 12",
    "dedupe_first": "SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events) WHERE n = 1",
    "idempotent_requests": "SELECT sha256(user_id || '|' || event_type) AS canonical_key, min(event_id) AS kept_event, count(*) AS requests FROM events GROUP BY 1",
    "event_replay": f"SELECT delivery_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY {_JOB}, event_id ORDER BY received_at, delivery_id) AS n FROM job_event_deliveries) WHERE n = 1 AND event_id > 10",
    "event_windows": "SELECT date_trunc('day', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL",
    "event_sessions": """
SELECT user_id, min(ts) AS session_start, count(*) AS n FROM (
  SELECT user_id, ts, sum(CASE WHEN p IS NULL OR ts >= p + INTERVAL 30 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s
  FROM (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events)) GROUP BY user_id, s""",
    "image_samples": f"""
WITH c AS (SELECT resource_id, candidate_key, path, content_hash, coalesce(nullif(lower(trim(stratum)), ''), 'format:' || coalesce(nullif(lower(regexp_extract(replace(path, chr(92), '/'), '[.]([^./]+)$', 1)), ''), 'unknown')) AS stratum
  FROM (SELECT *, row_number() OVER (PARTITION BY candidate_key ORDER BY discovered_at DESC NULLS LAST, resource_id DESC NULLS LAST, stratum DESC NULLS LAST, path DESC NULLS LAST, content_hash DESC NULLS LAST) AS n FROM image_candidates) WHERE n = 1),
q AS (SELECT *, b::DOUBLE * members / total AS raw FROM (SELECT resource_id, stratum, count(*) AS members, sum(count(*)) OVER (PARTITION BY resource_id) AS total, least(64, sum(count(*)) OVER (PARTITION BY resource_id)) AS b FROM c GROUP BY 1, 2)),
q2 AS (SELECT *, least(members, CAST(floor(raw) AS BIGINT)) AS base FROM q),
q3 AS (SELECT resource_id, stratum, base + CASE WHEN base < members AND row_number() OVER (PARTITION BY resource_id ORDER BY base < members DESC, raw - floor(raw) DESC, stratum) <= b - sum(base) OVER (PARTITION BY resource_id) THEN 1 ELSE 0 END AS quota FROM q2)
SELECT resource_id, candidate_key, stratum, 'sample_' || substr(sha256('{SEED}|image|' || coalesce(path, '')), 1, 16) AS sample_id FROM (
  SELECT c.*, quota, row_number() OVER (PARTITION BY c.resource_id, c.stratum ORDER BY sha256('{SEED}|' || c.stratum || '|' || coalesce(path, '') || '|' || coalesce(content_hash, '')), coalesce(path, '')) AS n
  FROM c JOIN q3 ON c.resource_id = q3.resource_id AND c.stratum = q3.stratum) WHERE n <= quota""",
    "temporal_slices": """
WITH v AS (SELECT video_path AS path, greatest(1, max(end_ms)) AS d, max(frame_end) + 1 AS f, max(sampling_fps) AS fps FROM sample_refs WHERE video_path IS NOT NULL GROUP BY 1 HAVING max(end_ms) IS NOT NULL AND max(frame_end) + 1 > 0 AND max(sampling_fps) > 0),
s AS (SELECT path, slice, d, f, fps, CAST(least(floor((slice + 0.5::DOUBLE) * d / 3), greatest(0, d - 1)) AS BIGINT) AS a FROM v, range(3) t(slice)),
e AS (SELECT *, least(d, a + 500) AS z FROM s),
g AS (SELECT *, least(f - 1, greatest(0, CAST(round_even(a * fps / 1000, 0) AS BIGINT))) AS fs FROM e)
SELECT path, slice, a AS start_ms, greatest(a + 1, z) AS end_ms, fs AS frame_start, least(f - 1, greatest(fs, CAST(round_even((z - 1) * fps / 1000, 0) AS BIGINT))) AS frame_end FROM g""",
    "closed_members": """
SELECT CASE WHEN k IS NOT NULL THEN array_to_string(list_sort(list_concat(['-' || x for x in ['stage', 'state'] if NOT list_contains(k, x)], ['+' || x for x in k if x NOT IN ('stage', 'state')])), '|') END AS difference, count(*) AS n
FROM (SELECT CASE WHEN json_valid(data_json) THEN json_keys(data_json) END AS k FROM job_event_deliveries WHERE event_type = 'stage') GROUP BY 1""",
    "plain_events": """
SELECT event_type, coalesce(CASE WHEN json_valid(data_json) THEN json_extract_string(data_json, '$.stage') END, 'unknown') AS stage, count(*) AS n FROM job_event_deliveries WHERE event_type NOT IN ('result', 'end') GROUP BY 1, 2""",
    "plan_violations": f"""
WITH p(source, target) AS (VALUES {", ".join(f"('{a}', '{b}')" for a, b in PLAN)}), d AS (SELECT name, min(data_type) AS data_type FROM ({_DATASETS}) GROUP BY 1),
c AS (SELECT field, field_type, required FROM {_CONTRACTS} WHERE model = 'captioner')
SELECT 'unknown_source' AS violation, source AS name FROM p WHERE source NOT IN (SELECT name FROM d)
UNION ALL SELECT 'unknown_target', target FROM p WHERE target NOT IN (SELECT field FROM c)
UNION ALL SELECT 'target_twice', target FROM p GROUP BY target HAVING count(*) > 1
UNION ALL SELECT 'types', target FROM p JOIN d ON d.name = source JOIN c ON c.field = target WHERE NOT (data_type = field_type OR (data_type IN ('string', 'text', 'utf8') AND field_type IN ('string', 'text', 'utf8')))
UNION ALL SELECT 'required_missing', field FROM c WHERE required AND field NOT IN (SELECT target FROM p)""",
    "contract_union": f"""
WITH d AS (SELECT name, min(data_type) AS data_type FROM ({_DATASETS}) GROUP BY 1), c AS (SELECT field, field_type FROM {_CONTRACTS} WHERE model = 'captioner')
SELECT field AS name, field_type AS data_type, 'contract' AS origin FROM c
UNION ALL SELECT name, data_type, 'dataset' FROM d WHERE name NOT IN ('caption', 'mask_path') AND name NOT IN (SELECT field FROM c)""",
}
