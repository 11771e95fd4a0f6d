"""Deterministic stratified sampling, quotas and temporal slices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrystone.plans.topk import first_per_group


def quotas(sizes: DataFrame, keys: list[str], stratum: str, budget: Column) -> DataFrame:
    """Largest-remainder quota of each stratum: ``sizes`` has the keys, the stratum and ``members``.

    The budget is clipped to the members there are; remainders are given in the order of their
    size, then of the stratum's name, and never beyond a stratum's members.
    """
    group = Window.partitionBy(*keys)
    s = sizes.withColumn("_total", F.sum("members").over(group))
    s = s.withColumn("_budget", F.greatest(F.lit(0), F.least(budget, F.col("_total"))).cast("bigint"))
    s = s.withColumn("_raw", F.col("_budget").cast("double") * F.col("members") / F.col("_total"))
    s = s.withColumn("_base", F.least(F.col("members"), F.floor("_raw")))
    s = s.withColumn("_left", F.col("_budget") - F.sum("_base").over(group))
    open_ = F.col("_base") < F.col("members")
    order = Window.partitionBy(*keys).orderBy(open_.desc(), (F.col("_raw") - F.floor("_raw")).desc(), F.col(stratum))
    extra = F.when(open_ & (F.row_number().over(order) <= F.col("_left")), 1).otherwise(0)
    return s.withColumn("quota", (F.col("_base") + extra).cast("bigint")).select(*sizes.columns, "quota")


def sample_rank(seed: int, stratum: Column, path: Column, content_hash: Column) -> Column:
    """Hash by which the members of a stratum are ranked."""
    return F.sha2(F.concat(F.lit(f"{seed}|"), stratum, F.lit("|"), path, F.lit("|"), content_hash), 256)


def sample_id(seed: int, prefix: str, path: Column) -> Column:
    return F.concat(F.lit("sample_"), F.substring(F.sha2(F.concat(F.lit(f"{seed}|{prefix}|"), path), 256), 1, 16))


def format_stratum(stratum: Column, path: Column) -> Column:
    """The stratum, or the file format where there is none."""
    suffix = F.lower(F.regexp_extract(path, r"[.]([^./\\]+)$", 1))
    return F.coalesce(F.nullif(stratum, F.lit("")), F.concat(F.lit("format:"), F.when(suffix == "", "unknown").otherwise(suffix)))


def stratified_sample(df: DataFrame, keys: list[str], stratum: str, path: str, content_hash: str, budget: Column, seed: int = 42) -> DataFrame:
    """A sample of at most ``budget`` rows per key, spread over strata by quota, ranked by hash.

    The result does not depend on the order of the rows. Null paths and hashes rank as ''.
    Repeated rows are separate members; equal ranks are broken by the path.
    """
    sizes = df.groupBy(*keys, stratum).agg(F.count("*").alias("members"))
    q = quotas(sizes, keys, stratum, budget).select(*keys, stratum, "quota")
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    ranked = df.join(q, [*keys, stratum]).withColumn("_r", sample_rank(seed, F.col(stratum), text(path), text(content_hash)))
    out = first_per_group(ranked, [*keys, stratum], [F.col("_r"), text(path)], F.col("quota"), F.col("_r"), rank="sample_rank")
    return out.withColumn("sample_id", sample_id(seed, "image", text(path))).drop("_r", "quota")


def sampling_summary(df: DataFrame, keys: list[str], stratum: str, budget: Column) -> DataFrame:
    """Per key: strategy, strata, candidates, selected, coverage, fallback reason and losses."""
    all_true = lambda c: F.bool_and(F.coalesce(F.col(c), F.lit(False)))
    g = df.groupBy(*keys).agg(
        F.array_join(F.array_sort(F.collect_set(stratum)), "|").alias("strata"),
        F.count("*").alias("candidate_count"),
        all_true("metadata_available").alias("m"),
        all_true("embedding_available").alias("e"),
    )
    g = g.withColumn("selected_count", F.least(budget, F.col("candidate_count")).cast("bigint"))
    full = F.col("m") & F.col("e")
    loss = F.array_compact(F.array(F.when(F.col("selected_count") < F.col("candidate_count"), F.lit("budget_limited_candidate_coverage")), F.when(~full, F.lit("no_metadata_or_embedding_centers"))))
    return g.select(
        *keys, "strata", "candidate_count", "selected_count",
        F.when(full, "stratified").otherwise("deterministic_fallback").alias("strategy"),
        (F.col("selected_count") / F.col("candidate_count")).alias("coverage"),
        F.when(~full, F.lit("clustering_metadata_or_embedding_unavailable")).alias("fallback_reason"),
        F.array_join(loss, "|").alias("coverage_losses"),
    )


def temporal_slices(videos: DataFrame, frames: int, clip_ms: int | None = None) -> DataFrame:
    """Slices around the midpoints of ``frames`` equal parts of each video, half-open in milliseconds.

    ``videos`` has ``path, duration_ms, frame_count, fps``. Videos without usable numbers give
    no slices. Frame numbers are rounded half to even and kept inside the video.
    """
    v = videos.where("duration_ms is not null and frame_count > 0 and fps > 0")
    v = v.withColumn("duration", F.greatest(F.lit(1), F.col("duration_ms"))).withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(frames - 1))))
    start = F.floor((F.col("slice") + 0.5) * F.col("duration") / frames)
    v = v.withColumn("start_ms", F.least(start, F.greatest(F.lit(0), F.col("duration") - 1)).cast("bigint"))
    length = F.lit(clip_ms) if clip_ms else F.greatest(F.lit(1), F.ceil(F.lit(1000) / F.col("fps")))
    v = v.withColumn("end_ms", F.least(F.col("duration"), F.col("start_ms") + length).cast("bigint"))
    last = F.col("frame_count") - 1
    at = lambda ms: F.bround(ms * F.col("fps") / 1000, 0).cast("bigint")
    v = v.withColumn("frame_start", F.least(last, F.greatest(F.lit(0), at(F.col("start_ms")))))
    v = v.withColumn("frame_end", F.least(last, F.greatest(F.col("frame_start"), at(F.col("end_ms") - 1))))
    return v.select("path", "slice", "start_ms", F.greatest(F.col("start_ms") + 1, F.col("end_ms")).alias("end_ms"), "frame_start", "frame_end")
