"""Inventories of files: listing without reading, kinds, limits, revisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrystone.functions import names
from quarrystone.operators.admission import greedy_admission
from quarrystone.plans.topk import first_per_group

# fixed values: limits of a survey
MOST_FILES, MOST_DEPTH, MOST_FILE_BYTES, MOST_TOTAL_BYTES = 10_000, 32, 256 << 20, 2 << 30


def inventory(spark: SparkSession, root: str, glob: str | None = None) -> DataFrame:
    """``path`` relative to the root, ``size``, ``modified`` of every file below it; contents are not read.

    Ignored folders, sensitive files and unsafe paths are left out.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    files = (reader.option("pathGlobFilter", glob) if glob else reader).load(root).drop("content")
    out = files.select(F.expr("1").alias("one"), relative(spark, root, F.col("path")).alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    out = out.select("path", "size", "modified")
    return out.where(~names.ignored(F.col("path")) & ~names.sensitive(F.col("path")) & ~names.unsafe(F.col("path")))


def relative(spark: SparkSession, root: str, path: Column) -> Column:
    """A full path as Spark gives it, relative to the root."""
    base = spark._jvm.org.apache.hadoop.fs.Path(root)
    full = base.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(base).toString().rstrip("/")
    cut = len(full.replace("file:", "").replace("//", "/").rstrip("/")) + 2
    return F.substr(F.regexp_replace(path, "^file:/+", "/"), F.lit(cut))


def source_path(spark: SparkSession, root: str) -> Column:
    """Path below the root of the file that a row was read from, which Spark gives with escapes."""
    return relative(spark, root, F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))))


def skip_code(path: Column, size: Column) -> Column:
    """Why a listed file is left out of a survey; null where it is not."""
    depth = F.size(F.split(path, "/")) - 1
    return F.when(names.sensitive(path), "SENSITIVE_FILE_SKIPPED").when(depth > MOST_DEPTH, "DEPTH_LIMIT").when(size > MOST_FILE_BYTES, "FILE_SIZE_LIMIT")


def survey(files: DataFrame, key: str, order: str, path: str = "path", size: str = "size", most_bytes: int = MOST_TOTAL_BYTES, most_files: int = MOST_FILES) -> tuple[DataFrame, DataFrame]:
    """Admitted and skipped files of each key, greedily in order under the limits.

    ``order`` is a number, unique within its key. The byte limit is greedy: a file that does not
    fit is skipped and smaller ones may follow; then the first ``most_files`` are kept.
    """
    f = files.withColumn("code", skip_code(F.col(path), F.col(size)))
    fit = greedy_admission(f.where("code is null"), key, order, size, most_bytes).select(key, order)
    kept = first_per_group(fit, [key], [F.col(order)], F.lit(most_files), F.col(order)).drop("rank")
    admitted = f.join(kept, [key, order]).drop("code")
    skipped = f.join(admitted.select(key, order), [key, order], "left_anti")
    return admitted, skipped.withColumn("code", F.coalesce("code", F.lit("TOTAL_SIZE_LIMIT")))


def sketch(files: DataFrame, keys: list[str], path: str = "path", size: str | None = None) -> DataFrame:
    """Files, bytes and counts by kind of each key."""
    kind = names.kind_of_file(F.col(path))
    counts = [F.count_if(kind == k).alias(k) for k in ("documentation", "image", "video", "annotation", "structured", "other")]
    total = F.sum(size) if size else F.lit(None).cast("bigint")
    return files.groupBy(*keys).agg(F.count("*").alias("files"), total.alias("bytes"), *counts)


def revision(files: DataFrame, keys: list[str], path: str = "path", size: str = "size", modified: str = "modified") -> DataFrame:
    """A hash of each key's listing that changes with any path, size or time.

    Each file is hashed by itself and the hashes are added up, so that a listing of any length
    is combined on the map side and the order of rows does not matter.
    """
    one = F.sha2(F.concat_ws("\u0001", path, F.col(size).cast("string"), F.unix_micros(modified).cast("string")), 256)
    part = lambda at: F.sum(F.conv(F.substring(one, at, 15), 16, 10).cast("decimal(38,0)"))
    g = files.groupBy(*keys).agg(F.count("*").alias("n"), part(1).alias("a"), part(16).alias("b"), part(31).alias("c"))
    return g.select(*keys, F.substring(F.sha2(F.concat_ws("|", "n", "a", "b", "c"), 256), 1, 16).alias("revision"))


def resource_id(kind: Column, source_type: Column, source: Column) -> Column:
    nul = F.lit("\u0000")
    return F.concat(kind, F.lit("_"), F.substring(F.sha2(F.concat(kind, nul, source_type, nul, source), 256), 1, 12))
