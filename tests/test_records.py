import json

import pytest
from pyspark.sql import functions as F

from quarrystone.operators import checks, evidence
from quarrystone.plans.scans import numbered

CASES = [
    ({"type": "object", "required": ["a"], "additionalProperties": False, "properties": {"a": {"type": "integer", "minimum": 1}, "b": {"type": ["string", "null"]}}}, [
        ('{"a": 1}', True), ('{"a": 1.0, "b": null}', True), ('{"a": 0}', False), ('{"b": "x"}', False), ('{"a": 2, "c": 1}', False), ('{"a": "1"}', False), ("[]", False), ("{", False), (None, False)]),
    ({"type": "array", "items": {"$ref": "#/$defs/name"}, "minItems": 1, "maxItems": 3, "uniqueItems": True, "$defs": {"name": {"type": "string", "pattern": "^[a-z]+$", "maxLength": 3}}}, [
        ('["a", "bc"]', True), ("[]", False), ('["a", "a"]', False), ('["abcd"]', False), ('["A"]', False), ('[1]', False), ('["a","b","c","d"]', False), ("[null]", False)]),
    ({"oneOf": [{"const": "x"}, {"enum": ["x", 2]}, {"type": "boolean"}]}, [('"x"', False), ("2", True), ("true", True), ('"y"', False)]),
    ({"if": {"required": ["k"]}, "then": {"properties": {"k": {"const": 1}}}, "else": {"not": {"required": ["z"]}}}, [('{"k": 1}', True), ('{"k": 2}', False), ('{"z": 0}', False), ("{}", True)]),
    ({"allOf": [{"exclusiveMinimum": 0}, {"exclusiveMaximum": 5}], "anyOf": [{"maximum": 1}, {"minimum": 4}]}, [("1", True), ("2", False), ("5", False), ("4.5", True), ('"text"', True)]),
]


@pytest.mark.parametrize(("schema", "cases"), CASES)
def test_schemas(spark, schema, cases):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, t string").withColumn("v", F.try_parse_json("t"))
    got = [r.ok for r in df.select("i", checks.valid(F.col("v"), schema).alias("ok")).orderBy("i").collect()]
    assert got == [ok for _, ok in cases], json.dumps(schema)


def test_a_schema_of_itself_is_refused():
    with pytest.raises(ValueError):
        checks.valid(F.col("v"), {"items": {"$ref": "#"}})


def test_numbers_of_a_hot_key(spark):
    rows = [("hot" if i % 3 else f"k{i % 5}" if i % 2 else None, i // 2, i) for i in range(300)]
    got = numbered(spark.createDataFrame(rows, "k string, o int, n2 int"), ["k"], ["o", "n2"]).collect()
    by = {}
    for r in got:
        by.setdefault(r.k, []).append((r.o, r.n2, r.n))
    assert len(got) == 300 and all([x[2] for x in sorted(v)] == list(range(1, len(v) + 1)) for v in by.values())


def test_evidence_edges(spark):
    a = spark.createDataFrame([("r", "b"), ("r", "b"), ("r", None), (None, "x")], "k string, p string")
    b = spark.createDataFrame([("r", "b"), ("r", "a"), ("s", "z")], "k string, p string")
    got = sorted((r.key, r.path, r.evidence_id) for r in evidence.evidence_rows([a, b], "k", "p").collect())
    assert got == [("r", "a", "evidence_002"), ("r", "b", "evidence_001"), ("s", "z", "evidence_001")]
    assert {(r.key, r.path) for r in evidence.inspection_candidates([a, b], "k", "p", 1).collect()} == {("r", "b"), ("s", "z")}
    assert evidence.inspection_candidates([a, b], "k", "p", None).count() == 3
    c = evidence.capped(spark.createDataFrame([("x", i) for i in range(4)] + [("y", 1)], "k string, i int"), ["k"], ["i"], 3).collect()
    assert {(r.k, r.truncated) for r in c} == {("x", True), ("y", False)} and len(c) == 4
    empty = spark.createDataFrame([], "k string, p string")
    assert evidence.evidence_rows([empty], "k", "p").count() == 0


def test_temporal_reasons(spark):
    rows = [("frame", "v", 0, 5, 0, 0, 30.0), ("clip", "v", 5, 5, 0, 1, 30.0), ("clip", None, 0, 5, 0, 1, 30.0), ("clip", "v", 0, 5, 2, 1, 30.0), ("clip", "v", 0, 5, 0, 1, 0.0), ("image", None, None, None, None, None, None), ("clip", "v", 0, 11, 0, 1, 1.0)]
    df = spark.createDataFrame(rows, "kind string, video_path string, start_ms bigint, end_ms bigint, frame_start bigint, frame_end bigint, sampling_fps double")
    assert [r[0] for r in df.select(checks.temporal_reason(10)).collect()] == [None, "time", "video", "frames", "fps", "kind", "time"]


def test_labels_of_steps_and_merged_pairs(spark):
    df = spark.createDataFrame([(" resize ", "image", " to 224 "), ("crop", None, " "), ("x", " ", "why")], "n string, a string, r string")
    assert [r[0] for r in df.select(evidence.step_label(F.col("n"), F.col("a"), F.col("r"))).collect()] == ["resize（image）：to 224", "crop", "x：why"]
    have = spark.createDataFrame([("d", "m", "a", "f")], "dataset string, model string, name string, field string")
    new = spark.createDataFrame([("d", "m", "a", "f", "compatible"), ("d", "m", "b", "f", "adaptable"), ("d", "m", "c", "f", "blocked"), ("d", "m", "e", "f", None)], "dataset string, model string, name string, field string, relation string")
    assert {(r.name, r.origin) for r in evidence.merged_mappings(have, new).collect()} == {("a", "existing"), ("b", "suggested")}
