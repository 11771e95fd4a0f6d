"""Writers: catalogue, renamed datasets, manifests, event logs, cached profiles."""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):  # noqa: ANN202
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def replace_table(df: DataFrame, path: str) -> None:
    """Write a table beside its old version and swap the folders; the old one returns if the swap fails."""
    spark = df.sparkSession
    new, old = f"{path}.new-{uuid.uuid4().hex[:8]}", f"{path}.old-{uuid.uuid4().hex[:8]}"
    df.write.parquet(new)
    fs, p = _fs(spark, path)
    path_of = spark._jvm.org.apache.hadoop.fs.Path
    had = fs.exists(p)
    if had and not fs.rename(p, path_of(old)):
        raise OSError(f"{path} cannot be moved")
    if not fs.rename(path_of(new), p):
        if had:
            fs.rename(path_of(old), p)
        raise OSError(f"{path} cannot be replaced")
    if had:
        fs.delete(path_of(old), True)


def latest(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The row of each key that is last in ``order``, nulls first; combined on the map side. Null keys are one key."""
    rest = [c for c in df.columns if c not in (key, *order)]
    best = F.max(F.struct(*order, F.struct(*rest).alias("_row"))).alias("b") if rest else F.max(F.struct(*order)).alias("b")
    return df.groupBy(key).agg(best).select(*[F.col(key) if c == key else F.col(f"b.{c}") if c in order else F.col(f"b._row.{c}") for c in df.columns])


def upsert(spark: SparkSession, path: str, rows: DataFrame, key: str) -> None:
    """Rows of a catalogue by key: new ones replace old ones.

    Of several new rows of one key the one that is last in its other columns counts.
    """
    order = [f.name for f in rows.schema.fields if f.name != key and "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    rows = latest(rows, key, order) if order else rows.dropDuplicates([key])
    if exists(spark, path):
        kept = spark.read.parquet(path).join(rows.select(key), key, "left_anti")
        rows = kept.unionByName(rows, allowMissingColumns=True)
    replace_table(rows, path)


def delete(spark: SparkSession, path: str, keys: DataFrame, key: str) -> None:
    """Take keys out of a catalogue; unknown ones do no harm."""
    replace_table(spark.read.parquet(path).join(keys.select(key).distinct(), key, "left_anti"), path)


def newest_first(catalogue: DataFrame, kind: str | None = None) -> DataFrame:
    """A catalogue, newest first, ties by id, of one kind if given."""
    rows = catalogue.where(F.col("kind") == kind) if kind else catalogue
    return rows.orderBy(F.col("updated_at").desc_nulls_last(), F.col("resource_id"))


def renamed(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Columns renamed at once; a name that would occur twice is an error, unknown names are ignored."""
    new = [mapping.get(c, c) for c in df.columns]
    if len({c.lower() for c in new}) != len(new):
        raise ValueError(f"the renaming gives a column twice: {sorted(new)}")
    return df.toDF(*new)


def write_renamed(df: DataFrame, mapping: dict[str, str], path: str, kind: str) -> DataFrame:
    """A renamed dataset as csv, json or parquet."""
    out = renamed(df, mapping)
    writer = out.write.mode("errorifexists")
    {"csv": lambda: writer.option("header", True).csv(path), "json": lambda: writer.json(path), "parquet": lambda: writer.parquet(path)}[kind]()
    return out


def digest(value: object) -> str:
    """SHA-256 of canonical JSON."""
    return hashlib.sha256(json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def write_manifest(spark: SparkSession, path: str, manifest: dict) -> None:
    """A manifest as one JSON line with its digest."""
    spark.createDataFrame([(digest(manifest), json.dumps(manifest, ensure_ascii=False, sort_keys=True))], "digest string, manifest string").coalesce(1).write.mode("overwrite").json(path)


def append_events(spark: SparkSession, path: str, events: DataFrame, key: str, order: list[str]) -> None:
    """Append events to a log by key; numbers go on from the last one of each key, by one."""
    w = Window.partitionBy(key).orderBy(*order)
    new = events.withColumn("event_id", F.row_number().over(w).cast("bigint"))
    if exists(spark, path):
        last = spark.read.json(path).groupBy(key).agg(F.max("event_id").alias("_last"))
        new = new.join(last, key, "left").withColumn("event_id", F.col("event_id") + F.coalesce("_last", F.lit(0))).drop("_last")
    new.write.mode("append").json(path)


def cached(spark: SparkSession, path: str, wanted: DataFrame, keys: list[str]) -> tuple[DataFrame | None, DataFrame]:
    """Profiles already in a cache, and the keys that are not; the keys include revision and version."""
    if not exists(spark, path):
        return None, wanted
    held = spark.read.parquet(path)
    return held.join(wanted.select(*keys).distinct(), keys, "left_semi"), wanted.join(held.select(*keys).distinct(), keys, "left_anti")
