"""Type labels: what a text value looks like, what a set of labels combines to, what a Spark type is called."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values: what counts as an integer and as a number in text; ASCII digits, single underscores between digits
INTEGER = r"^[+-]?[0-9]+(_[0-9]+)*$"
NUMBER = r"^[+-]?(([0-9]+(_[0-9]+)*)([.]([0-9]+(_[0-9]+)*)?)?|[.][0-9]+(_[0-9]+)*)([eE][+-]?[0-9]+(_[0-9]+)*)?$|^[+-]?([iI][nN][fF]([iI][nN][iI][tT][yY])?|[nN][aA][nN])$"


def _stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def scalar_type(text: Column) -> Column:
    """``string``, ``boolean``, ``integer`` or ``number`` for one text value; null for null; blank is a string."""
    t = _stripped(text)
    return F.when(text.isNull(), None).when(F.lower(t).isin("true", "false"), "boolean").when(t.rlike(INTEGER), "integer").when(t.rlike(NUMBER), "number").otherwise("string")


def inspected_type(text: Column) -> Column:
    """``integer``, ``number`` or ``string``; null for null and blank. Booleans and containers are strings."""
    t = _stripped(text)
    return F.when(text.isNull() | (t == ""), None).when(t.rlike(INTEGER), "integer").when(t.rlike(NUMBER), "number").otherwise("string")


def variant_type(v: Column) -> Column:
    """Label of a JSON value; text inside it is looked at like any other text; JSON null gives null."""
    s = F.schema_of_variant(v)
    return (
        F.when(v.isNull() | F.is_variant_null(v), None)
        .when(s == "BOOLEAN", "boolean")
        .when(s == "BIGINT", "integer")
        .when(s.startswith("DECIMAL") | s.isin("DOUBLE", "FLOAT"), "number")
        .when(s.startswith("OBJECT"), "object")
        .when(s.startswith("ARRAY"), "array")
        .when(s == "STRING", scalar_type(F.try_variant_get(v, "$", "string")))
        .otherwise("unknown")
    )


def combined_type(labels: Column) -> Column:
    """One label for an array of observed labels: integers and numbers are numbers, other mixtures ``mixed``."""
    u = F.array_distinct(F.filter(labels, lambda x: x.isNotNull()))
    numeric = F.size(F.array_except(u, F.array(F.lit("integer"), F.lit("number")))) == 0
    return F.when(labels.isNull() | (F.size(u) == 0), "unknown").when(F.size(u) == 1, F.element_at(u, 1)).when(numeric, "number").otherwise("mixed")


def type_set(labels: Column) -> Column:
    """Sorted set of observed labels as text, ``unknown`` if there is none."""
    u = F.array_sort(F.array_distinct(F.filter(labels, lambda x: x.isNotNull())))
    return F.when(labels.isNull() | (F.size(u) == 0), "unknown").otherwise(F.array_join(u, "|"))


def type_label(kind: T.DataType) -> str:
    """Label of a Spark type. Decimals are numbers, maps objects; dates, times and intervals are unknown."""
    for label, kinds in (
        ("boolean", T.BooleanType),
        ("integer", (T.ByteType, T.ShortType, T.IntegerType, T.LongType)),
        ("number", (T.FloatType, T.DoubleType, T.DecimalType)),
        ("string", T.StringType),
        ("array", T.ArrayType),
        ("binary", T.BinaryType),
        ("object", (T.StructType, T.MapType)),
    ):
        if isinstance(kind, kinds):
            return label
    return "unknown"


def declared_type(dtype: Column) -> Column:
    """Label of a type name declared in a dataset manifest; unknown names stay, in lower case."""
    d = F.lower(F.trim(dtype))
    return (
        F.when(d.isin("bool", "boolean"), "boolean")
        .when(d.startswith("int") | d.startswith("uint"), "integer")
        .when(d.startswith("float") | d.startswith("double"), "number")
        .when(d.isin("string", "str"), "string")
        .otherwise(d)
    )


# fixed values: groups of type names that can be adapted to each other
TYPE_GROUPS = {
    "text": ["string", "text", "utf8"],
    "integer": ["int", "int8", "int16", "int32", "int64", "integer", "uint8", "uint16", "uint32", "uint64", "classlabel", "categorical"],
    "float": ["float", "float16", "float32", "float64", "double", "number"],
    "image": ["image", "pixel", "pixels"],
    "audio": ["audio", "waveform"],
    "boolean": ["boolean", "bool"],
}


def type_group(name: Column) -> Column:
    """Group of a type name, null for types that match only themselves."""
    out = F.lit(None).cast("string")
    for group, names in TYPE_GROUPS.items():
        out = F.when(name.isin(names), group).otherwise(out)
    return out


def type_relation(source: Column, target: Column) -> Column:
    """``compatible``, ``adaptable`` or ``blocked``; integers may become floats and text integers, not the reverse."""
    from quarrystone.functions.names import slug

    s, t = slug(source), slug(target)
    gs, gt = type_group(s), type_group(t)
    widen = ((gs == "integer") & (gt == "float")) | ((gs == "text") & (gt == "integer"))
    return F.when(s == t, "compatible").when(F.coalesce((gs == gt) | widen, F.lit(False)), "adaptable").otherwise("blocked")


def shape_relation(source: Column, target: Column) -> Column:
    """How a shape fits an expected one; shapes are arrays of texts, ``*``, ``dynamic``, ``-1`` and null are open."""
    wild = lambda e: e.isNull() | e.isin("*", "dynamic", "-1")
    number = lambda x: F.coalesce(x.rlike("^[1-9][0-9]*$"), F.lit(False))
    step = F.zip_with(source, target, lambda a, e: F.when(wild(e) | F.coalesce(a == e, F.lit(False)), None).when(number(a) & number(e), "adaptable").otherwise("blocked"))
    hit = F.filter(step, lambda x: x.isNotNull())
    by_part = F.when(F.size(hit) > 0, F.element_at(hit, 1)).otherwise("compatible")
    open_ = source.isNull() | target.isNull() | (F.size(target) == 0)
    return F.when(open_ | F.coalesce(source == target, F.lit(False)), "compatible").when(F.size(source) != F.size(target), "adaptable").otherwise(by_part)


def _names(kind: T.DataType) -> set[str]:
    return {n.lower() for n in kind.names} if isinstance(kind, T.StructType) else set()


def field_label(name: str, kind: T.DataType) -> tuple[str, str]:
    """Label and role of a Spark field: media by name and physical type, class labels, else the type's label."""
    from quarrystone.functions.names import role_of

    low, role = name.lower(), role_of(name)
    media = {"bytes", "path"} <= _names(kind)
    raw = isinstance(kind, (T.BinaryType, T.StringType))
    masks = low in {"label", "labels", "mask", "masks", "segmentation", "segmentation_map"} and media
    has = lambda *tokens: any(t in low for t in tokens)
    if (has("image", "img", "pixel", "photo") and (raw or media)) or masks:
        return "image", role
    if has("audio", "waveform", "speech") and isinstance(kind, (T.BinaryType, T.StructType, T.ArrayType)):
        return "audio", role
    if has("video", "frame") and (raw or isinstance(kind, (T.StructType, T.ArrayType))):
        return "video", role
    if role == "label" and type_label(kind) in ("integer", "string"):
        return "classlabel", "label"
    return type_label(kind), role


def detection_field(name: str, kind: T.DataType) -> bool:
    """Whether a field holds detections: by its name, or a struct of boxes with categories."""
    boxes, classes = {"bbox", "bboxes", "box", "boxes"}, {"category", "categories", "class", "classes", "label", "labels"}
    own = _names(kind.elementType if isinstance(kind, T.ArrayType) else kind) if isinstance(kind, T.StructType) else _names(kind)
    return name.lower() in boxes | {"objects", "annotations", "detections"} or bool(own & boxes and own & classes)


def schema_features(schema: T.StructType) -> list[tuple[str, str, str, bool]]:
    """``(name, label, role, nullable)`` of each field, from the schema alone; no job runs."""
    return [(f.name, *field_label(f.name, f.dataType), f.nullable) for f in schema.fields]


def schema_tasks(schema: T.StructType) -> list[str]:
    """Task hints of a schema with an image field."""
    feats = schema_features(schema)
    if not any(label == "image" for _, label, _, _ in feats):
        return []
    labels = [label for _, label, role, _ in feats if role == "label"]
    out = ["image-segmentation"] * ("image" in labels) + ["object-detection"] * any(detection_field(f.name, f.dataType) for f in schema.fields)
    return out or (["image-classification"] if labels else [])


def known_types(types: Column) -> Column:
    """The known set of types as sorted text; null when it says nothing."""
    clean = F.transform(F.filter(types, lambda t: t.isNotNull()), lambda t: F.lower(F.trim(t)))
    kept = F.array_sort(F.array_distinct(F.filter(clean, lambda t: (t != "") & (t != "unknown"))))
    return F.when(F.size(kept) > 0, F.array_join(kept, "|"))
