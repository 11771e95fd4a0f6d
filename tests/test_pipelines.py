import json

from pyspark.sql import functions as F

from quarrystone.plans import pipelines


def test_folder_profile(spark, tmp_path):
    (tmp_path / "train.csv").write_text("id,text,label\n1,a,0\n2,,1\n")
    (tmp_path / "validation.jsonl").write_text('{"id":3,"text":"c","label":1}\n\n')
    (tmp_path / "id2label.json").write_text('{"0":"no"}')
    (tmp_path / ".env").write_text("SECRET=1")
    p = pipelines.profile_folder(spark, str(tmp_path)).first()
    assert {f.name: (f.data_type, f.role, f.nullable) for f in p.features} == {"id": ("integer", "identifier", False), "text": ("string", "input", True), "label": ("integer", "label", False)}
    assert {(s.split, s.rows) for s in p.splits} == {("train", 2), ("validation", 1)}
    assert (p.modalities, p.task_hints, p.sample_count, p.completeness, p.status) == (["text"], ["classification"], 3, 0.95, "ready")


def test_json_and_parquet_files(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"records": [{"answer": "x", "scores": [1, 2]}]}))
    spark.createDataFrame([(bytearray(b"x"), 1)], "img binary, label bigint").coalesce(1).write.parquet(str(tmp_path / "p"))
    p = pipelines.profile_folder(spark, str(tmp_path)).first()
    assert {f.name: f.data_type for f in p.features} == {"answer": "string", "scores": "array", "img": "image", "label": "classlabel"}
    assert p.task_hints == ["classification"]


def test_every_data_file_of_a_folder_counts(spark, tmp_path):
    (tmp_path / "test").mkdir()
    for i in range(9):
        spark.createDataFrame([(i,)], "id bigint").toPandas().to_parquet(tmp_path / "test" / f"part-{i}.parquet")
    (tmp_path / "train-a b+c%20.csv").write_text("k.x,label\n" + "".join(f"{i},1\n" for i in range(150)))
    (tmp_path / "train-2.csv").write_text('\ufeff"label"\tn\tn\nu\t2\n\t\n')
    (tmp_path / "train-3.csv").write_text("label,one\n1,2\n3\n")
    (tmp_path / "train-4.jsonl").write_text('{"only":true}\n\nbad\n{"only":null}\n')
    (tmp_path / "train-5.json").write_text('[{"last":1.5},{"last":2}]')
    (tmp_path / "train-6.csv").write_text("")
    (tmp_path / "train-7.parquet").write_text("no such thing")
    p = pipelines.profile_folder(spark, str(tmp_path)).first()
    got = {f.name: (f.data_type, f.nullable) for f in p.features}
    assert got == {"id": ("integer", True), "k.x": ("integer", False), "label": ("mixed", True), "n": ("integer", True), "n_2": ("unknown", True), "one": ("integer", True), "only": ("boolean", True), "last": ("number", False)}
    assert {(s.split, s.rows) for s in p.splits} == {("test", 9), ("train", 100 + 2 + 2 + 2 + 2)} and p.sample_count == 117


def test_empty_folder(spark, tmp_path):
    (tmp_path / "notes.xyz").write_text("x")
    p = pipelines.profile_folder(spark, str(tmp_path)).first()
    assert (p.features, p.modalities, p.status) == ([], ["unknown"], "needs_review")


def test_model_profile(spark, tmp_path):
    (tmp_path / "README.md").write_text("# Net\n\nImage classification, no text generation here. License: MIT\n")
    (tmp_path / "train.py").write_text("import torch\nresize(image)\n")
    (tmp_path / "requirements.txt").write_text("torch\n")
    (tmp_path / "model.safetensors").write_bytes(b"\0" * 10)
    texts = pipelines.repository_texts(spark, str(tmp_path)).withColumn("model", F.lit("m"))
    m = pipelines.profile_models(texts, ["model"]).first()
    assert (m.frameworks, m.tasks, m.modalities, m.preprocessing, m.license, m.description) == (["pytorch"], ["image-classification"], ["image"], ["resize"], "MIT", "Net")
    assert [(f.name, f.data_type) for f in m.inputs] == [("image", "image")] and [f.name for f in m.outputs] == ["logits"] and m.completeness == 1.0


def test_every_text_of_a_repository_counts(spark, tmp_path):
    for i in range(13):
        (tmp_path / f"n{i:02}.txt").write_text("-")
    (tmp_path / "zz.py").write_text("import torch\n# image classification\n" + "#" * 200)
    (tmp_path / "LICENSE-MIT").write_text("MIT License")
    texts = pipelines.repository_texts(spark, str(tmp_path)).withColumn("model", F.lit("m"))
    m = pipelines.profile_models(texts, ["model"]).first()
    assert (texts.count(), m.frameworks, m.tasks, m.license) == (15, ["pytorch"], ["image-classification"], "MIT")


def test_adaptation(spark, tmp_path):
    data = spark.createDataFrame([("i", 1)], "images string, target int")
    fields = spark.createDataFrame([("m", "pixel_values", "image", True), ("m", "target", "classlabel", True)], "model string, field string, field_type string, required boolean")
    bad, report = pipelines.adapt(data, "d", fields, str(tmp_path / "out"))
    assert bad.count() == 0 and spark.read.parquet(str(tmp_path / "out")).columns == ["pixel_values", "target"]
    assert report.first().status == "compatible"
    bad, _ = pipelines.adapt(data.drop("target"), "d", fields, str(tmp_path / "no"))
    assert [tuple(r) for r in bad.collect()] == [("required_missing", "target")] and not (tmp_path / "no").exists()
