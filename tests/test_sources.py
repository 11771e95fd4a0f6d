import json
import struct

import pytest
from pyspark.sql import functions as F

from quarrystone.sources import files, media, readers, sinks
from quarrystone.streaming import events


def test_delimited(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text('﻿id,text,,text\n1,"a\nb",x\n2,c,y,z\n')
    df = readers.read_delimited(spark, str(p))
    assert df.columns == ["id", "text", "column_3", "text_2"]
    assert [tuple(r) for r in df.collect()] == [("1", "a\nb", "x", None), ("2", "c", "y", "z")]
    t = tmp_path / "a.tsv"
    t.write_text("a\tb,c\n1\t2\n")
    assert readers.read_delimited(spark, str(t)).first()["b,c"] == "2"
    e = tmp_path / "e.csv"
    e.write_text("")
    assert readers.read_delimited(spark, str(e)).count() == 0
    assert readers.unique_headers(["a", " ", "a", "a"]) == ["a", "column_2", "a_2", "a_3"]


def test_json(spark, tmp_path):
    p = tmp_path / "a.jsonl"
    p.write_text('{"a":1}\n\nbad\n{"a":2}\n')
    rows = readers.read_json_lines(spark, str(p))
    assert (rows.count(), rows.where("not valid").count()) == (3, 1)
    d = tmp_path / "d.json"
    d.write_text(json.dumps({"records": [{"answer": "x", "scores": [1, 2]}], "rows": [1, 2]}))
    assert readers.read_json_document(spark, str(d)).count() == 1
    assert readers.read_json_document(spark, str(d), ["rows"]).count() == 2
    cols = {r.name: (r.data_type, r.nullable) for r in readers.json_columns(spark.createDataFrame([('{"a":1,"b":null}',), ('{"a":"x"}',)], "j string"), "j").collect()}
    assert cols == {"a": ("mixed", False), "b": ("unknown", True)}


def test_manifest_and_documents(spark):
    doc = {"empty": {}, "default": {"features": {"img": {"_type": "Image"}, "label": {"_type": "ClassLabel", "names": ["a", "b"]}, "n": {"_type": "Value", "dtype": "uint8"}, "s": {"feature": {}}}}}
    got = {r.name: (r.data_type, r.role) for r in readers.manifest_features(spark.createDataFrame([(json.dumps(doc),), ("x",)], "value string")).collect()}
    assert got == {"img": ("image", "input"), "label": ("classlabel", "label"), "n": ("integer", "input"), "s": ("object", "input")}
    v = {"version": 1, "id": "d", "entities": [{"id": "e", "fields": [{"id": "f", "name": "F", "dataType": "datetime", "nullable": True}]}]}
    s = {"title": "t", "properties": {"a": {"type": "string"}, "b": {}}, "required": ["a"]}
    o = {"x": 1, "y": "7", "z": None}
    rows = {(r.document, r.field, r.data_type, r.nullable) for r in readers.document_fields(spark.createDataFrame([(json.dumps(x),) for x in (v, s, o)], "value string")).collect()}
    assert rows == {("d", "f", "datetime", True), ("t", "a", "string", False), ("t", "b", "unknown", True), ("document", "x", "integer", False), ("document", "y", "string", False), ("document", "z", "null", True)}


def test_xml(spark, tmp_path):
    box = '<box frame="0" outside="0" xtl="1" ytl="1" xbr="5" ybr="5"/><box frame="1" outside="1" xtl="1" ytl="1" xbr="5" ybr="5"/><box frame="2" outside="0" xtl="9" ytl="1" xbr="5" ybr="5"/>'
    (tmp_path / "annotations.xml").write_text(f'<annotations><track id="0" label="car">{box}</track><track id="1" label="bus"></track></annotations>')
    s = readers.tracking_statistics(spark, str(tmp_path / "annotations.xml")).first()
    assert (s.tracks, s.labels, s.visible_boxes, s.invalid_boxes, s.frames) == (2, "bus|car", 1, 1, 1)
    (tmp_path / "evil.xml").write_text('<!DOCTYPE x [<!ENTITY a "b">]><x>&a;</x>')
    e = {(r.tag, r.n) for r in readers.xml_elements(spark, str(tmp_path / "*.xml")).groupBy("tag").agg(F.sum("n").alias("n")).collect()}
    assert e == {("annotations", 1), ("track", 2), ("box", 3), ("!rejected", 1)}


def test_image_headers(spark):
    png = b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR" + struct.pack(">IIBB", 7, 5, 8, 6) + b"\0" * 8
    gif = b"GIF89a" + struct.pack("<HH", 3, 4)
    bmp = b"BM" + b"\0" * 16 + struct.pack("<ii", 9, -2) + struct.pack("<HH", 1, 24)
    jpg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x11\x08" + struct.pack(">HHB", 11, 12, 3) + b"\0" * 12
    webp = b"RIFF\0\0\0\0WEBPVP8X" + b"\0" * 8 + (99).to_bytes(3, "little") + (49).to_bytes(3, "little")
    assert [media.image_header(x) for x in (png, gif, bmp, jpg, webp, b"", None, b"xx")] == [(7, 5, 4, 8), (3, 4, 3, 8), (9, 2, 3, 24), (12, 11, 3, 8), (100, 50, 4, 8), None, None, None]
    df = spark.createDataFrame([("a", bytearray(png)), ("b", None), ("c", bytearray(b"?"))], "path string, content binary")
    assert {(r.path, r.kind, r.width) for r in media.image_facts(df).collect()} == {("a", "png", 7), ("b", None, None), ("c", None, None)}
    heads = spark.createDataFrame([(bytearray(b"RIFF1234AVI xx"),), (bytearray(b"....ftypmp42"),), (bytearray(b"\x1a\x45\xdf\xa3"),), (bytearray(b"no"),)], "h binary")
    assert [r[0] for r in heads.select(media.container(F.col("h"))).collect()] == ["avi", "mp4", "webm_or_mkv", None]


def test_inventory_and_survey(spark, tmp_path):
    for name, n in (("a/train.csv", 5), ("b.png", 9), (".git/x.csv", 1), ("a/.env", 1)):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"x" * n)
    inv = files.inventory(spark, str(tmp_path))
    assert {(r.path, r.size) for r in inv.collect()} == {("a/train.csv", 5), ("b.png", 9)}
    f = spark.createDataFrame([("r", 1, "a.png", 60), ("r", 2, "b.png", 60), ("r", 3, "c.json", 40), ("r", 4, "x/.env", 1)], "k string, o int, path string, size bigint")
    ok, skipped = files.survey(f, "k", "o", most_bytes=100)
    assert {r.path for r in ok.collect()} == {"a.png", "c.json"} and {(r.path, r.code) for r in skipped.collect()} == {("b.png", "TOTAL_SIZE_LIMIT"), ("x/.env", "SENSITIVE_FILE_SKIPPED")}
    one = files.revision(f.withColumn("modified", F.lit("2020-01-01").cast("timestamp")), ["k"]).first().revision
    two = files.revision(f.orderBy(F.desc("o")).withColumn("modified", F.lit("2020-01-01").cast("timestamp")), ["k"]).first().revision
    assert one == two and len(one) == 16


def test_catalogue(spark, tmp_path):
    p = str(tmp_path / "cat")
    row = "id string, v int"
    sinks.upsert(spark, p, spark.createDataFrame([("a", 1), ("b", 1)], row), "id")
    sinks.upsert(spark, p, spark.createDataFrame([("b", 2), ("c", 2)], row), "id")
    sinks.delete(spark, p, spark.createDataFrame([("a", 0), ("zz", 0)], row), "id")
    assert sorted(tuple(r) for r in spark.read.parquet(p).collect()) == [("b", 2), ("c", 2)]
    held, missing = sinks.cached(spark, p, spark.createDataFrame([("b", 0), ("q", 0)], row), ["id"])
    assert held.count() == 1 and missing.first().id == "q"
    got = sinks.latest(spark.createDataFrame([("a", None, 1), ("a", 2, 2), ("b", None, 3)], "id string, at int, x int"), "id", ["at"]).collect()
    assert sorted(tuple(r) for r in got) == [("a", 2, 2), ("b", None, 3)]


def test_renamed_datasets(spark, tmp_path):
    df = spark.createDataFrame([("i", 1)], "image_path string, label int")
    for kind in ("csv", "json", "parquet"):
        sinks.write_renamed(df, {"image_path": "image", "label": "target"}, str(tmp_path / kind), kind)
    assert spark.read.parquet(str(tmp_path / "parquet")).columns == ["image", "target"]
    assert spark.read.csv(str(tmp_path / "csv"), header=True).columns == ["image", "target"]
    with pytest.raises(ValueError):
        sinks.renamed(df, {"image_path": "Label"})
    sinks.write_manifest(spark, str(tmp_path / "m"), {"b": 1, "a": 2})
    assert spark.read.json(str(tmp_path / "m")).first().digest == sinks.digest({"a": 2, "b": 1})


def test_event_log(spark, tmp_path):
    p = str(tmp_path / "log")
    new = lambda rows: spark.createDataFrame(rows, "job string, at int, kind string")
    sinks.append_events(spark, p, new([("a", 2, "y"), ("a", 1, "x"), ("b", 1, "x")]), "job", ["at"])
    sinks.append_events(spark, p, new([("a", 3, "z")]), "job", ["at"])
    log = spark.read.json(p)
    assert sorted((r.job, r.event_id, r.kind) for r in log.collect()) == [("a", 1, "x"), ("a", 2, "y"), ("a", 3, "z"), ("b", 1, "x")]
    assert events.replay(log, 2).count() == 1


def test_windows(spark):
    rows = [("2020-01-01 00:00:00", "u"), ("2020-01-01 00:10:00", "u"), ("2020-01-01 01:00:00", "u"), ("2020-01-02 00:00:00", "v")]
    df = spark.createDataFrame(rows, "t string, u string").withColumn("t", F.to_timestamp("t"))
    assert sorted(r.n for r in events.windowed_counts(df, "t", "u", "1 day").collect()) == [1, 3]
    assert sorted((r.u, r.n) for r in events.sessions(df, "t", "u", "30 minutes").collect()) == [("u", 1), ("u", 2), ("v", 1)]


def test_a_stream_kept_as_a_table(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("b", 1)], "id string, v int")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = events.into_table(stream, str(tmp_path / "out"), str(tmp_path / "c"), "id")
    q.processAllAvailable()
    spark.createDataFrame([("b", 2)], rows.schema).write.mode("append").parquet(str(tmp_path / "in"))
    q.processAllAvailable()
    q.stop()
    assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [("a", 1), ("b", 2)]


def test_surplus_cells_and_values_over_lines(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text('a,b\n1,2,3\n4\n"x,y",5,"6, 7",8\n')
    rows = readers.read_delimited(spark, str(p)).collect()
    assert [tuple(r) for r in rows] == [("1", "2", ["3"]), ("4", None, None), ("x,y", "5", ["6, 7", "8"])]
    p.write_text('a,b\n"1\n2",3\n')
    assert [tuple(r) for r in readers.read_delimited(spark, str(p)).collect()] == [("1\n2", "3")]
    df, more = readers.limited(spark.range(5), 3)
    assert (df.count(), more) == (3, True) and readers.limited(spark.range(3), 3)[1] is False and readers.limited(spark.range(3), None)[1] is False


def test_blanks_around_numbers(spark):
    from quarrystone.functions import types

    df = spark.createDataFrame([("\t12\n",), ("\u00a01.5 ",), ("\n",), (" TRUE\r",)], "t string")
    assert [r[0] for r in df.select(types.scalar_type(F.col("t"))).collect()] == ["integer", "number", "string", "boolean"]


def test_jpeg_segments_are_walked():
    seg = lambda m, body: bytes([0xFF, m]) + (len(body) + 2).to_bytes(2, "big") + body
    sof = seg(0xC2, bytes([8, 0, 20, 0, 30, 1]))
    start = b"\xff\xd8"
    cases = [start + seg(0xE0, b"\xff" * 9) + b"\xff\xff" + sof + b"x" * 9, start + b"\xff\x01" + b"junk" + seg(0xC4, b"t" * 30) + sof + b"x" * 9, start + seg(0xE1, b"z" * 40), start + b"\xff\xe0\x00\x01" + sof + b"x" * 9]
    assert [media.image_header(b) for b in cases] == [(30, 20, 1, 8), (30, 20, 1, 8), None, None]
