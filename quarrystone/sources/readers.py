"""Rows of CSV, JSON, JSON lines, Parquet and XML files, without trusting their types."""

from __future__ import annotations

import csv
import re
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrystone.functions import types
from quarrystone.operators.profile import json_members
from quarrystone.operators.tree_edit import compile_projection, edit_script, schema_tree
from quarrystone.sources.files import source_path

# fixed values: members that hold the rows of a JSON document, first list wins
PROFILE_ROWS = ["data", "records", "items", "examples"]
INSPECTION_ROWS = ["records", "data", "items", "rows"]


def detect_delimiter(head: str) -> str:
    """Tab if the first line has more tabs than commas, else comma."""
    line = re.split(r"\r\n|\r|\n", head.lstrip("﻿"), maxsplit=1)[0]
    return "\t" if line.count("\t") > line.count(",") else ","


def unique_headers(values: list[str]) -> list[str]:
    """Blank names become ``column_N``; a repeated name gets a number."""
    used: dict[str, int] = {}
    out = []
    for i, v in enumerate(values, 1):
        base = v.strip() or f"column_{i}"
        used[base] = used.get(base, 0) + 1
        out.append(base if used[base] == 1 else f"{base}_{used[base]}")
    return out


def _shape_of(spark: SparkSession, path: str, sep: str) -> tuple[int, bool]:
    """The most separators in a line, and whether a quoted value goes over lines."""
    line = F.col("value")
    found = lambda c: F.length(line) - F.length(F.replace(line, F.lit(c)))
    r = spark.read.text(path).agg(F.max(found(sep)).alias("most"), F.bool_or(found('"') % 2 == 1).alias("long")).first()
    return r.most or 0, bool(r.long)


def _surplus(width: int, sep: str):  # noqa: ANN202
    """What a record has beyond its columns, from its text."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def cells(records: pd.Series) -> pd.Series:
        return records.map(lambda r: next(csv.reader([r], delimiter=sep), [])[width:] or None if isinstance(r, str) else None)

    return cells


def read_delimited(spark: SparkSession, path: str, delimiter: str | None = None) -> DataFrame:
    """A delimited file as text columns: no inference, header required, short rows end in nulls.

    The delimiter is a tab for .tsv, else detected from the first line unless given. Where rows
    have more cells than the header these stand in a further column ``unnamed`` (an array). A file
    in which no quoted value goes over lines is read by many tasks.
    """
    first = spark.read.text(path).limit(1).collect()
    if not first:
        return spark.createDataFrame([], "value string")
    sep = delimiter or ("\t" if path.lower().endswith(".tsv") else detect_delimiter(first[0].value))
    most, long_ = _shape_of(spark, path, sep)
    how = {"sep": sep, "inferSchema": False, "mode": "PERMISSIVE", "multiLine": long_, "escape": '"', "nullValue": "\u0000", "emptyValue": ""}
    head = [x or "" for x in spark.read.csv(path, header=False, **how).first()]
    head[0] = head[0].lstrip("\ufeff")
    names = unique_headers(head)
    if most < len(head):
        return spark.read.csv(path, header=True, **how).toDF(*names)
    cells = [f"c{i}" for i in range(len(head))]
    df = spark.read.schema(", ".join(f"{c} string" for c in [*cells, "_record"])).option("columnPruning", "false").csv(path, header=True, columnNameOfCorruptRecord="_record", **how)
    df = df.withColumn("_more", _surplus(len(head), sep)("_record"))
    kept = df.select(*[F.col(c).alias(n) for c, n in zip(cells, names)], F.col("_more").alias(unique_headers([*names, "unnamed"])[-1]))
    return kept.select(*[F.col(f"`{n}`") for n in names]) if not df.agg(F.count("_more"), F.max(F.length("c0"))).first()[0] else kept


def limited(df: DataFrame, most: int | None) -> tuple[DataFrame, bool]:
    """The first rows and whether there are more; all rows for ``None``."""
    return (df, False) if most is None else (df.limit(most), df.limit(most + 1).count() > most)


def read_json_lines(spark: SparkSession, path: str) -> DataFrame:
    """``line, row, valid`` of a JSON lines file; blank lines are no rows; an invalid row is null."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.select(F.col("value").alias("line"), F.try_parse_json("value").alias("row")).withColumn("valid", F.col("row").isNotNull())


def json_rows(v: Column, members: list[str] = PROFILE_ROWS) -> Column:
    """Rows of a JSON document: itself if a list, else the first list among its members, else itself alone."""
    lists = [F.try_variant_get(v, "$", "array<variant>")] + [F.try_variant_get(v, f"$.{m}", "array<variant>") for m in members]
    return F.coalesce(*lists, F.when(v.isNotNull(), F.array(v)))


def read_json_document(spark: SparkSession, path: str, members: list[str] = PROFILE_ROWS) -> DataFrame:
    """``row`` of each row of whole JSON documents."""
    docs = spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("v"))
    return docs.select(F.explode(json_rows(F.col("v"), members)).alias("row"))


def json_columns(rows: DataFrame, text: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Observed columns of JSON rows held as text, of each key: name, label, nullability."""
    m = json_members(rows, text, keys).where("name is not null")
    return m.groupBy(*keys, "name").agg(types.combined_type(F.collect_set("kind")).alias("data_type"), F.bool_or("is_null").alias("nullable"), F.count("*").alias("rows"))


def parquet_facts(spark: SparkSession, path: str) -> DataFrame:
    """One row per column from the footers alone: ``name, physical, data_type, role, nullable, rows``."""
    df = spark.read.parquet(path)
    n = df.count()
    rows = [(f.name, f.dataType.simpleString(), *types.field_label(f.name, f.dataType), f.nullable, n) for f in df.schema.fields]
    return spark.createDataFrame(rows, "name string, physical string, data_type string, role string, nullable boolean, rows bigint")


def parquet_features(spark: SparkSession, root: str, paths: list[str]) -> DataFrame:
    """``parquet_facts`` of each of many files: schemas from the footers, all rows counted in one scan.

    A file that is no Parquet file has no features.
    """
    found = []
    for p in paths:
        try:
            found.append((p, spark.read.parquet(f"{root}/{p}").schema))
        except (PySparkException, Py4JJavaError):
            continue
    rows = [(p, f.name, *types.field_label(f.name, f.dataType), f.nullable) for p, s in found for f in s.fields]
    feats = spark.createDataFrame(rows, "path string, name string, data_type string, role string, nullable boolean")
    if not found:
        return feats.withColumn("rows", F.lit(0).cast("bigint"))
    n = spark.read.schema("_none int").parquet(*[f"{root}/{p}" for p, _ in found]).groupBy(source_path(spark, root).alias("path")).agg(F.count("*").alias("rows"))
    return feats.join(n, "path", "left").withColumn("rows", F.coalesce("rows", F.lit(0)))


def delimited_values(spark: SparkSession, root: str, paths: list[str], most_rows: int) -> DataFrame:
    """``path, name, value`` of the first rows of many CSV files, read in one scan for each delimiter.

    Headers, delimiters and short rows are taken as by ``read_delimited``.
    """
    full = [f"{root}/{p}" for p in paths]
    path, place = source_path(spark, root).alias("path"), F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("place")
    heads = spark.read.text(full).select(path, place, "value").where("trim(value) <> ''").groupBy("path").agg(F.min_by("value", "place").alias("value")).collect()
    width: dict[str, int] = {}
    files: dict[str, list[str]] = {}
    for h in heads:
        sep = detect_delimiter(h.value)
        n = h.value.count(sep) + 1
        if h.value.count('"') % 2:  # the header goes on in the next line
            n = max(n, len(spark.read.csv(f"{root}/{h.path}", sep=sep, multiLine=True, escape='"').columns))
        width[sep] = max(width.get(sep, 0), n)
        files.setdefault(sep, []).append(h.path)
    out = spark.createDataFrame([], "path string, name string, value string")
    for sep, own in files.items():
        cells = [f"c{i}" for i in range(width[sep])]
        df = spark.read.schema(", ".join(f"{c} string" for c in cells)).csv([f"{root}/{p}" for p in own], sep=sep, header=False, mode="PERMISSIVE", multiLine=True, escape='"', nullValue="\u0000", emptyValue="")
        df = df.select(path, place, F.array(*cells).alias("cells")).withColumn("n", F.row_number().over(Window.partitionBy("path").orderBy("place"))).where(F.col("n") <= most_rows + 1)
        names = []
        for h in df.where("n = 1").collect():
            last = max((i for i, c in enumerate(h.cells) if c is not None), default=-1)
            head = [c or "" for c in h.cells[: last + 1]]
            names += [(h.path, i, c) for i, c in enumerate(unique_headers([head[0].lstrip("﻿"), *head[1:]] if head else []))]
        known = spark.createDataFrame(names, "path string, pos int, name string")
        out = out.unionByName(df.where("n > 1").select("path", F.posexplode("cells").alias("pos", "value")).join(known, ["path", "pos"]).select("path", "name", "value"))
    return out


def read_drifting(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Parquet files whose schemas differ as one table of the last file's schema and the columns gone before it.

    A minimum-cost edit script leads from each distinct schema to the last one and is compiled
    into a projection; files of one schema are read together.
    """
    schemas: dict[str, tuple] = {}
    for p in paths:
        s = spark.read.parquet(p).schema
        schemas.setdefault(s.json(), (s, []))[1].append(p)
    last = spark.read.parquet(paths[-1]).schema
    out = None
    for schema, group in schemas.values():
        script = edit_script(schema_tree(schema), schema_tree(last))
        lost = [s.old.name for s in script if s.op == "delete" and len(s.old_parts) == 1]
        part = spark.read.schema(schema).parquet(*group).selectExpr(*compile_projection(script, schema, last), *[_quoted(c) for c in lost])
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def manifest_features(docs: DataFrame, text: str = "value", keys: tuple[str, ...] = ()) -> DataFrame:
    """Declared features of dataset manifests held as text: the first configuration that has any.

    ``name, data_type, role, names`` of each feature; other documents give nothing.
    """
    v = docs.select(*keys, F.try_parse_json(text).alias("v"))
    configs = v.select(*keys, F.try_variant_get("v", "$", "map<string,variant>").alias("m")).where("m is not null")
    first = configs.select(*keys, F.expr("filter(map_entries(m), e -> try_variant_get(e.value, '$.features', 'map<string,variant>') is not null)[0].value").alias("c")).where("c is not null")
    f = first.select(*keys, F.explode(F.try_variant_get("c", "$.features", "map<string,variant>")).alias("name", "d"))
    kind, dtype = F.try_variant_get("d", "$._type", "string"), F.try_variant_get("d", "$.dtype", "string")
    label = F.when(kind.isin("Image", "Audio", "Video", "ClassLabel"), F.lower(kind)).when((kind == "Value") & (F.trim(dtype) != ""), types.declared_type(dtype)).otherwise("object")
    from quarrystone.functions.names import role

    roles = F.when(kind == "ClassLabel", "label").when(kind == "Image", role(F.col("name"))).otherwise("input")
    return f.select(*keys, "name", label.alias("data_type"), roles.alias("role"), F.size(F.try_variant_get("d", "$.names", "array<string>")).alias("names"))


def tracking_statistics(spark: SparkSession, path: str) -> DataFrame:
    """Tracks, labels, visible and invalid boxes and annotated frames of a tracking XML export.

    Boxes outside the frame are left out; boxes without a frame number or with impossible
    coordinates are counted as invalid.
    """
    num = "double"
    schema = f"_id string, _label string, box array<struct<_frame:string,_outside:string,_xtl:{num},_ytl:{num},_xbr:{num},_ybr:{num}>>"
    t = spark.read.format("xml").option("rowTag", "track").schema(schema).load(path)
    b = t.select("_id", "_label", F.explode_outer("box").alias("b")).where("b is null or b._outside is null or b._outside <> '1'")
    ok = F.col("b._frame").rlike("^[0-9]+$") & (F.col("b._xbr") > F.col("b._xtl")) & (F.col("b._ybr") > F.col("b._ytl"))
    ok = F.coalesce(ok, F.lit(False))
    return b.agg(
        F.countDistinct("_id").alias("tracks"), F.array_join(F.array_sort(F.collect_set("_label")), "|").alias("labels"),
        F.count_if(ok).alias("visible_boxes"), F.count_if(F.col("b").isNotNull() & ~ok).alias("invalid_boxes"), F.countDistinct(F.when(ok, F.col("b._frame"))).alias("frames"),
    )


def _elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        paths, tags, attrs, counts = [], [], [], []
        for path, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            head = raw[:65536].upper()
            if b"<!DOCTYPE" in head or b"<!ENTITY" in raw.upper():
                found = {("!rejected", ""): 1}
            else:
                found = {}
                try:
                    for e in ElementTree.fromstring(raw).iter():
                        key = (e.tag, "|".join(sorted(e.attrib)))
                        found[key] = found.get(key, 0) + 1
                except ElementTree.ParseError:
                    found = {("!invalid", ""): 1}
            for (tag, a), n in found.items():
                paths.append(path), tags.append(tag), attrs.append(a), counts.append(n)
        yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(tags, pa.string()), pa.array(attrs, pa.string()), pa.array(counts, pa.int64())], names=["path", "tag", "attributes", "n"])


def xml_elements(spark: SparkSession, path: str) -> DataFrame:
    """Elements of XML files by tag and set of attributes; documents with a DOCTYPE or entities are rejected."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(_elements, "path string, tag string, attributes string, n bigint").groupBy("path", "tag", "attributes").agg(F.sum("n").alias("n"))


def document_fields(docs: DataFrame, text: str = "value") -> DataFrame:
    """Fields of data-model documents held as text: ``document, entity, field, name, data_type, nullable``.

    Versioned documents list entities with fields; others are a JSON schema with ``properties``
    or a sample object, which becomes one entity.
    """
    v = docs.select(F.try_parse_json(text).alias("v")).where("v is not null")
    field = "array<struct<id:string,name:string,dataType:string,nullable:boolean>>"
    entities = F.try_variant_get("v", "$.entities", "array<variant>")
    e = v.where(entities.isNotNull()).select(F.try_variant_get("v", "$.id", "string").alias("document"), F.explode(entities).alias("e"))
    e = e.select("document", F.try_variant_get("e", "$.id", "string").alias("entity"), F.explode(F.try_variant_get("e", "$.fields", field)).alias("f"))
    versioned = e.select("document", "entity", F.col("f.id").alias("field"), F.col("f.name").alias("name"), F.col("f.dataType").alias("data_type"), F.col("f.nullable").alias("nullable"))
    plain = v.where(entities.isNull())
    props = F.try_variant_get("v", "$.properties", "map<string,variant>")
    need = F.coalesce(F.try_variant_get("v", "$.required", "array<string>"), F.array().cast("array<string>"))
    title = F.coalesce(F.try_variant_get("v", "$.title", "string"), F.lit("document")).alias("document")
    s = plain.where(props.isNotNull()).select(title, need.alias("need"), F.explode(props).alias("name", "d"))
    schema = s.select("document", F.lit("default").alias("entity"), F.col("name").alias("field"), "name", F.coalesce(F.try_variant_get("d", "$.type", "string"), F.lit("unknown")).alias("data_type"), (~F.array_contains("need", F.col("name"))).alias("nullable"))
    o = plain.where(props.isNull()).select(title, F.explode(F.try_variant_get("v", "$", "map<string,variant>")).alias("name", "d"))
    kind = F.when(F.schema_of_variant("d") == "STRING", "string").otherwise(F.coalesce(types.variant_type(F.col("d")), F.lit("null")))
    sample = o.select("document", F.lit("default").alias("entity"), F.col("name").alias("field"), "name", kind.alias("data_type"), (F.is_variant_null("d")).alias("nullable"))
    return versioned.unionByName(schema).unionByName(sample)
