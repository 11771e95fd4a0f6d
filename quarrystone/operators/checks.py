"""Checks of records: closed value sets, bounds of temporal samples, sampling candidates, JSON schemas."""

from __future__ import annotations

import json
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_FPS = 240


def value_violations(df: DataFrame, row: str, allowed: dict[str, list[str]]) -> DataFrame:
    """``row, field, value`` of every value outside its closed set; null is outside too."""
    pairs = [F.when(~F.coalesce(F.col(c).isin(v), F.lit(False)), F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value"))) for c, v in allowed.items()]
    return df.select(F.col(row).alias("row"), F.explode(F.array_compact(F.array(*pairs))).alias("x")).select("row", "x.field", "x.value")


def first_reason(rules: list[tuple[str, Column]]) -> Column:
    """The first rule that holds; null where none does."""
    out = F.lit(None).cast("string")
    for reason, broken in reversed(rules):
        out = F.when(F.coalesce(broken, F.lit(False)), reason).otherwise(out)
    return out


def temporal_reason(most_ms: Column | int) -> Column:
    """Why a frame or clip has no usable bounds (``kind, video_path, start_ms, end_ms, frame_start, frame_end, sampling_fps``), or null."""
    c = F.col
    missing = lambda *columns: reduce(lambda a, b: a | b, [c(x).isNull() for x in columns])
    return first_reason([
        ("kind", ~F.coalesce(c("kind").isin("frame", "clip"), F.lit(False))),
        ("video", missing("video_path", "start_ms", "end_ms") | (c("video_path") == "")),
        ("time", (c("start_ms") < 0) | (c("end_ms") <= c("start_ms")) | (c("end_ms") > most_ms)),
        ("frames", missing("frame_start", "frame_end") | (c("frame_start") < 0) | (c("frame_end") < c("frame_start"))),
        ("fps", c("sampling_fps").isNull() | ~((c("sampling_fps") > 0) & (c("sampling_fps") <= MOST_FPS))),
    ])


def candidate_violations(candidates: DataFrame, inventory: DataFrame, key: str, path: str = "path", content_hash: str = "content_hash") -> DataFrame:
    """``key, reason`` of candidates with an unsafe path, a hash of another form, or no file in the inventory."""
    known = inventory.select(F.col(path).alias("_file")).where("_file is not null").distinct().withColumn("_there", F.lit(True))
    rows = candidates.select(F.col(key).alias("key"), F.col(path).alias("p"), F.col(content_hash).alias("h")).join(known, F.col("p") == F.col("_file"), "left")
    reason = first_reason([("path", F.col("p").isNull() | F.col("p").rlike("^/|(^|/)[.][.](/|$)")), ("hash", ~F.coalesce(F.col("h").rlike("^sha256:[0-9a-f]{64}$"), F.lit(False))), ("missing", F.col("_there").isNull())])
    return rows.select("key", reason.alias("reason")).where("reason is not null")


_KINDS = {
    "string": lambda k, v: k == "STRING",
    "boolean": lambda k, v: k == "BOOLEAN",
    "null": lambda k, v: k == "VOID",
    "object": lambda k, v: k.startswith("OBJECT"),
    "array": lambda k, v: k.startswith("ARRAY"),
    "number": lambda k, v: _numeric(k),
    "integer": lambda k, v: F.when(_numeric(k), F.try_variant_get(v, "$", "double") == F.floor(F.try_variant_get(v, "$", "double"))).otherwise(F.lit(False)),
}


def _numeric(kind: Column) -> Column:
    return (kind == "BIGINT") | kind.startswith("DECIMAL") | kind.isin("DOUBLE", "FLOAT")


def valid(v: Column, schema: dict[str, Any] | bool, root: dict[str, Any] | None = None) -> Column:
    """Whether a variant is valid by a JSON schema (a subset of draft 2020-12), as one column expression.

    Known are ``$ref`` into the same document, ``type``, ``const``, ``enum``, ``allOf``, ``anyOf``,
    ``oneOf``, ``not``, ``if``/``then``/``else``, and the bounds of objects, arrays, texts and numbers.
    Schemas that refer to themselves are refused. A null column (no JSON) is not valid.
    """
    return F.coalesce(_valid(v, schema, schema if root is None else root, 0), F.lit(False))


def _valid(v: Column, schema: Any, root: Any, depth: int) -> Column:
    if isinstance(schema, bool):
        return F.lit(schema)
    if depth > 32:
        raise ValueError("a schema that refers to itself")
    sub = lambda s, x=v: _valid(x, s, root, depth + 1)
    each = lambda s: lambda y: F.coalesce(sub(s, y), F.lit(False))
    kind = F.schema_of_variant(v)
    both, either = (lambda cs: reduce(lambda a, b: a & b, cs, F.lit(True))), (lambda cs: reduce(lambda a, b: a | b, cs, F.lit(False)))
    rules = [v.isNotNull()]
    only = lambda label, rule: rules.append(F.when(_KINDS[label](kind, v), rule).otherwise(F.lit(True)))
    text, number = F.try_variant_get(v, "$", "string"), F.try_variant_get(v, "$", "double")
    items, members = F.try_variant_get(v, "$", "array<variant>"), F.try_variant_get(v, "$", "map<string,variant>")
    same = lambda value: F.to_json(v) == F.to_json(F.parse_json(F.lit(json.dumps(value))))
    for word, x in schema.items():
        if word == "$ref":
            at = root
            for part in x.removeprefix("#").split("/")[1:]:
                at = at[part.replace("~1", "/").replace("~0", "~")]
            rules.append(sub(at))
        elif word == "type":
            rules.append(either([_KINDS[k](kind, v) for k in ([x] if isinstance(x, str) else x)]))
        elif word in ("const", "enum"):
            rules.append(either([same(y) for y in ([x] if word == "const" else x)]))
        elif word == "allOf":
            rules.append(both([sub(s) for s in x]))
        elif word == "anyOf":
            rules.append(either([sub(s) for s in x]))
        elif word == "oneOf":
            rules.append(reduce(lambda a, b: a + b, [F.coalesce(sub(s), F.lit(False)).cast("int") for s in x]) == 1)
        elif word == "not":
            rules.append(~F.coalesce(sub(x), F.lit(False)))
        elif word == "if":
            holds = F.coalesce(sub(x), F.lit(False))
            rules.append(F.when(holds, sub(schema.get("then", True))).otherwise(sub(schema.get("else", True))))
        elif word == "properties":
            for name, s in x.items():
                y = F.try_variant_get(v, f"$['{name}']", "variant")
                only("object", F.when(y.isNull(), F.lit(True)).otherwise(sub(s, y)))
        elif word == "required":
            only("object", both([F.map_contains_key(members, F.lit(name)) for name in x]))
        elif word == "additionalProperties":
            extra = F.map_filter(members, lambda k, _: ~k.isin(list(schema.get("properties", {})) or [""]))
            only("object", F.size(extra) == 0 if x is False else F.forall(F.map_values(extra), each(x)))
        elif word == "items":
            only("array", F.forall(items, each(x)))
        elif word in ("minItems", "maxItems", "uniqueItems"):
            plain = F.transform(items, lambda y: F.to_json(y))
            only("array", {"minItems": F.size(items) >= x, "maxItems": F.size(items) <= x, "uniqueItems": (F.size(F.array_distinct(plain)) == F.size(plain)) | F.lit(not x)}[word])
        elif word in ("minLength", "maxLength", "pattern"):
            only("string", {"minLength": lambda: F.char_length(text) >= x, "maxLength": lambda: F.char_length(text) <= x, "pattern": lambda: text.rlike(x)}[word]())
        elif word in ("minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum"):
            only("number", {"minimum": number >= x, "maximum": number <= x, "exclusiveMinimum": number > x, "exclusiveMaximum": number < x}[word])
    return both(rules)
