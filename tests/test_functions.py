import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrystone.functions import names, text, types
from quarrystone.operators import structure


def one(spark, value, fn, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(fn(F.col("v")).alias("r")).first().r


@pytest.mark.parametrize(
    ("value", "label"),
    [("1", "integer"), (" -1_000 ", "integer"), ("1__0", "string"), ("_1", "string"), ("1.", "number"), (".5e-3", "number"), ("1e5", "number"), ("NaN", "number"), ("-Infinity", "number"), ("12d", "string"), ("True", "boolean"), ("", "string"), ("  ", "string"), ("9" * 40, "integer"), (None, None)],
)
def test_scalar_types(spark, value, label):
    assert one(spark, value, types.scalar_type) == label


def test_inspected_types_have_no_booleans(spark):
    assert [one(spark, v, types.inspected_type) for v in ("true", " ", None, "1", "1.5")] == ["string", None, None, "integer", "number"]


def test_lattices(spark):
    f = lambda v: one(spark, v, types.combined_type, "array<string>")
    assert [f(v) for v in ([], None, ["integer"], ["integer", "number", None], ["integer", "string"], ["number"], [None])] == ["unknown", "unknown", "integer", "number", "mixed", "number", "unknown"]
    assert one(spark, ["string", "integer", "string"], types.type_set, "array<string>") == "integer|string"


def test_json_types(spark):
    f = lambda v: one(spark, v, lambda c: types.variant_type(F.parse_json(c)))
    assert [f(v) for v in ("1", "1.5", "1e3", "true", '"7"', '"x"', "[1]", '{"a":1}', "null")] == ["integer", "number", "number", "boolean", "integer", "string", "array", "object", None]


def test_type_and_shape_relations(spark):
    rel = lambda a, b: spark.createDataFrame([(a, b)], "a string, b string").select(types.type_relation(F.col("a"), F.col("b"))).first()[0]
    assert [rel(*p) for p in (("Int32", "int32"), ("int", "float"), ("float", "int"), ("text", "int"), ("text", "float"), ("array", "array"), ("array", "object"), ("string", "utf8"))] == [
        "compatible", "adaptable", "blocked", "adaptable", "blocked", "compatible", "blocked", "adaptable",
    ]
    shp = lambda a, b: spark.createDataFrame([(a, b)], "a array<string>, b array<string>").select(types.shape_relation(F.col("a"), F.col("b"))).first()[0]
    assert [shp(*p) for p in ((["1"], []), (None, ["1"]), (["8", "x"], ["*", "4"]), (["8", "4"], ["dynamic", "4"]), (["8"], ["4"]), (["8"], ["4", "4"]), (["x"], ["4"]))] == [
        "compatible", "compatible", "blocked", "compatible", "adaptable", "adaptable", "blocked",
    ]


def test_names(spark):
    assert [one(spark, v, names.role) for v in ("Class_ID", "target_id", "user_id", "uuid", "text")] == ["label", "label", "identifier", "identifier", "input"]
    assert [one(spark, v, names.path_split) for v in ("dev/x", "trainset.csv", "a/b-VAL.csv", "x.test.json", "data/valid/train.csv", "")] == ["validation", "unknown", "validation", "test", "validation", "unknown"]
    assert [one(spark, v, names.slug) for v in (" Text Generation! ", "--", "A_b")] == ["text-generation", "", "a-b"]
    assert one(spark, " In-Put IDs", names.field_key) == "inputids"
    assert [one(spark, v, names.suffix) for v in ("a/b.TAR.gz", ".env", "x", "a.b/c", "a/.hidden.json")] == [".gz", "", "", "", ".json"]
    assert [one(spark, v, names.unsafe) for v in ("", "/a", "a/../b", "a\\b", "a..b/c", None)] == [True, True, True, True, False, True]
    assert [one(spark, v, names.sensitive) for v in ("x/.ENV", ".env.dev", "config.llm.json", "env")] == [True, True, True, False]
    assert [one(spark, v, names.annotation) for v in ("labels/a.txt", "a/my-boxes_1.json", "labelled/a.txt")] == [True, True, False]
    assert [one(spark, v, names.kind_of_file) for v in ("README.md", "a.JPG", "b.mp4", "masks/c.json", "c.json", "d.bin")] == ["documentation", "image", "video", "annotation", "structured", "other"]
    assert [one(spark, v, names.frame_image) for v in ("images/a.png", "a.png", "overlays/images/a.png", "other/a.png")] == [True, True, False, False]
    assert [one(spark, v, names.canonical_task) for v in ("Language Modeling", "semantic_segmentation", "regression")] == ["text-generation", "image-segmentation", "regression"]
    assert [one(spark, v, names.file_priority) for v in ("LICENSE", "a/setup.py", "train.py", "x.py")] == [0, 1, 2, 3]


def test_text(spark):
    assert one(spark, "x api_key = abc123 y Authorization: Bearer q.w", text.redact) == "x [REDACTED] y [REDACTED]"
    assert one(spark, "\n a \r\n\r\n b sk-12345678zz9\n", text.excerpt) == "a b [REDACTED]"
    assert [one(spark, v, text.license_of) for v in ("Apache License\nVersion 2.0", "apache license", "The MIT License", None)] == ["Apache-2.0", "unknown", "MIT", "unknown"]
    assert one(spark, "# \n[badge]\n## The Title\nmore", text.readme_description) == "The Title"
    assert one(spark, "Uses PyTorch and a Transformer", lambda c: F.array_join(text.families(c, text.FRAMEWORKS), "|")) == "pytorch"
    mods = lambda t: one(spark, t, lambda c: F.array_join(text.model_modalities(text.families(c, text.TASKS), c), "|"))
    assert [mods(t) for t in ("image classification", "pixel_values and tokenizer", "asr", "nothing")] == ["image", "image|text", "audio", "unknown"]
    assert one(spark, "resize it, std = 1", lambda c: F.array_join(text.preprocessing(c, F.array(F.lit("image"), F.lit("text"))), "|")) == "resize|tokenize"
    assert one(spark, 'so ```json\n{"a": 1}\n``` ok', lambda c: F.to_json(text.json_in_text(c))) == '{"a":1}'
    assert one(spark, 'so {"a": {"b": 2}} ok', lambda c: F.to_json(text.json_in_text(c))) == '{"a":{"b":2}}'
    assert one(spark, "no", text.json_in_text) is None
    assert one(spark, bytearray(b"ab"), lambda c: text.data_url(c, F.lit("png")), "binary") == "data:image/png;base64,YWI="


def test_schema_features():
    media = T.StructType().add("bytes", "binary").add("path", "string")
    box = T.StructType().add("bbox", T.ArrayType(T.FloatType())).add("category", "long")
    s = T.StructType().add("img", "binary").add("label", "long").add("pixel_values", media).add("mask", media).add("when", "timestamp").add("m", T.MapType(T.StringType(), T.LongType())).add("d", "decimal(9,2)").add("objects", T.ArrayType(box)).add("frame_no", "long")
    got = {n: (k, r) for n, k, r, _ in types.schema_features(s)}
    assert got == {"img": ("image", "input"), "label": ("classlabel", "label"), "pixel_values": ("image", "input"), "mask": ("image", "label"), "when": ("unknown", "input"), "m": ("object", "input"), "d": ("number", "input"), "objects": ("array", "label"), "frame_no": ("integer", "input")}
    assert types.schema_tasks(s) == ["image-segmentation", "object-detection"]
    assert types.schema_tasks(T.StructType().add("img", "binary").add("label", "long")) == ["image-classification"]


@pytest.mark.parametrize(
    ("fields", "tasks"),
    [("frame_id track_id xmin ymin xmax ymax", "object_detection|multi_object_tracking"), ("image_id segmentation category_id", "semantic_segmentation"), ("image_id xmin ymin xmax ymax", "object_detection"), ("inbox", "object_detection"), ("category", "image_classification"), ("x", "")],
)
def test_structural_tasks(spark, fields, tasks):
    assert one(spark, fields.split(), lambda c: F.array_join(structure.structural_tasks(c), "|"), "array<string>") == tasks


def test_conflicts_and_claims(spark):
    df = spark.createDataFrame([(["a"], ["b"]), (["a"], ["a", "b"]), (["UNKNOWN"], ["b"]), (["a", "b"], ["b"])], "f array<string>, m array<string>")
    assert [r[0] for r in df.select(structure.conflicts(F.col("f"), F.col("m"))).collect()] == [True, False, False, True]
    c = df.select(structure.claim(F.col("f"), structure.conflicts(F.col("f"), F.col("m"))).alias("c")).collect()
    assert [(r.c.status, r.c.reason) for r in c] == [("UNKNOWN", "CONFLICTING_EVIDENCE"), ("VERIFIED", None), ("UNKNOWN", "NO_EVIDENCE"), ("UNKNOWN", "CONFLICTING_EVIDENCE")]


def test_languages_task_names_and_documentation_budget(spark):
    docs = {'{"language":"en","cardData":{"language":["de","en",3,""]}}': ["en", "de"], '{"language":5}': [], "no": [], '{"cardData":{"language":"fr"}}': ["fr"]}
    assert {d: one(spark, d, text.languages) for d in docs} == docs
    assert one(spark, ["regression", "other", "classification"], text.task_names, "array<string>") == "分类、other、回归"
    df = spark.createDataFrame([("a", 1, "xxxx"), ("a", 2, "yyyy"), ("a", 3, "z"), ("b", 1, None), ("b", 2, "w")], "k string, o int, text string")
    got = structure.documentation_budget(df, ["k"], "o", most_chars=6).collect()
    assert sorted((r.k, r.o, r.text) for r in got) == [("a", 1, "xxxx"), ("a", 2, "yy"), ("b", 1, ""), ("b", 2, "w")]


def test_types_of_every_column(spark):
    from quarrystone.queries import all_queries

    d, q = "/root/testdata/sf0.001", all_queries()
    for name, part, of in (("infer_scalar_types_all", "infer_scalar_types", "orders"), ("column_type_lattice_all", "column_type_lattice", "sample_refs")):
        full = q[name](spark, d)
        assert {r.name for r in full.collect()} == set(spark.read.parquet(f"{d}/{of}.parquet").columns)
        assert q[part](spark, d).exceptAll(full).isEmpty()
