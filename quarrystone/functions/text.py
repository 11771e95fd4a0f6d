"""Text scalars: redaction, excerpts, licences, term families, JSON out of prose."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: what counts as a secret
SECRET = r"(?i)(authorization\s*:\s*bearer\s+|api[_ -]?key\s*[=:]\s*|sk-[A-Za-z0-9_-]{8,})[^\s\"']+"
# fixed values: how tasks are named in messages
TASK_NAMES = {
    "classification": "分类", "text-classification": "文本分类", "image-classification": "图像分类", "audio-classification": "音频分类", "token-classification": "序列标注",
    "text-generation": "文本生成", "image-segmentation": "图像分割", "object-detection": "目标检测", "regression": "回归",
}
# fixed values: phrases that together name a licence, first match wins
LICENSE_MARKERS = [
    ("Apache-2.0", ["apache license", "version 2.0"]),
    ("MIT", ["mit license"]),
    ("BSD-3-Clause", ["redistribution and use in source and binary forms"]),
    ("GPL-3.0", ["gnu general public license", "version 3"]),
    ("CC-BY-4.0", ["creative commons attribution 4.0"]),
]
# fixed values: patterns of term families in lower-case text
FRAMEWORKS = {
    "pytorch": r"\btorch\b|\bpytorch\b",
    "tensorflow": r"\btensorflow\b|\btf\.keras\b",
    "keras": r"\bkeras\b",
    "transformers": r"\btransformers\b|\bautotokenizer\b|\bautomodel\b",
    "onnx": r"\bonnx\b",
    "jax": r"\bjax\b",
    "flax": r"\bflax\b",
}
ARCHITECTURES = {
    "transformer": r"\btransformer\b|\bbert\b|\bgpt\b|\bllama\b",
    "cnn": r"\bcnn\b|\bconvolutional\b|\bconv2d\b",
    "resnet": r"\bresnet\b",
    "unet": r"\bu-?net\b",
    "rnn": r"\b(?:lstm|gru|rnn)\b",
    "diffusion": r"\bdiffusion\b",
}
TASKS = {
    "text-generation": r"\btext generation\b|\bcausal language model|\blanguage modeling\b",
    "text-classification": r"\btext classification\b|\bsequence classification\b|\bautomodelforsequenceclassification\b|文本分类|分类模型",
    "token-classification": r"\btoken classification\b|\bner\b",
    "question-answering": r"\bquestion answering\b|\bqa\b",
    "image-classification": r"\bimage classification\b",
    "object-detection": r"\bobject detection\b",
    "image-segmentation": r"\b(?:image|semantic) segmentation\b",
    "speech-recognition": r"\b(?:speech recognition|automatic speech recognition|asr)\b",
    "image-to-text": r"\b(?:image captioning|visual question answering|image-to-text)\b",
}
PREPROCESSING = {
    "tokenize": ("text", r"\b(?:tokenize|tokenizer|input_ids)\b"),
    "normalize": ("image", r"\b(?:normaliz[ez]|mean\s*=|std\s*=)\b"),
    "resize": ("image", r"\b(?:resize|image_size|resolution)\b"),
    "padding": ("image", r"\b(?:padding|pad_to)\b"),
    "resample": ("audio", r"\b(?:resample|sampling_rate)\b"),
}


def redact(text: Column, pattern: str = SECRET) -> Column:
    """Text with secrets replaced; null stays null."""
    return F.regexp_replace(text, pattern, "[REDACTED]")


def excerpt(text: Column, most_bytes: int = 24 * 1024, most_chars: int = 800) -> Column:
    """The non-blank lines of the head of a document, redacted, joined by blanks, cut to a length."""
    lines = F.split(redact(F.left(text, F.lit(most_bytes))), r"\r\n|\r|\n")
    trimmed = F.filter(F.transform(lines, lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")
    return F.left(F.array_join(trimmed, " "), F.lit(most_chars))


def license_of(text: Column) -> Column:
    """Licence named by its phrases, ``unknown`` without; null is unknown."""
    low, out = F.lower(text), F.lit("unknown")
    for name, marks in reversed(LICENSE_MARKERS):
        hit = F.lit(True)
        for m in marks:
            hit = hit & low.contains(m)
        out = F.when(hit, name).otherwise(out)
    return out


def readme_license(text: Column) -> Column:
    """Licence named in running text after the word license, '' without one."""
    return F.trim(F.regexp_extract(text, r"(?i)(?:license|licence)\s*[:#-]?\s*([A-Za-z0-9 .+-]{3,40})", 1))


def card_license(value: Column) -> Column:
    """A declared licence, ``unknown`` where it is null or blank."""
    return F.coalesce(F.nullif(F.trim(value), F.lit("")), F.lit("unknown"))


def readme_description(text: Column) -> Column:
    """First usable line of a readme: no badge, image or tag; heading signs removed; '' without one."""
    lines = F.transform(F.split(text, r"\r\n|\r|\n"), lambda x: F.trim(F.regexp_replace(F.trim(x), "^#+", "")))
    good = F.filter(lines, lambda x: (x != "") & ~x.rlike(r"^[\[!<]"))
    return F.left(F.coalesce(F.try_element_at(good, F.lit(1)), F.lit("")), F.lit(500))


def occurs(low: Column, pattern: str) -> Column:
    """Whether a pattern occurs in lower-case text.

    Each alternative's longest run of plain letters is looked for first, which is much cheaper.
    """
    runs = [max(re.findall(r"[a-z0-9 _\u4e00-\u9fff]+", re.sub(r"\\[a-zA-Z]|\[[^\]]*\]|.[?*]", "#", p)), key=len, default="") for p in pattern.split("|")]
    if "(" in pattern or min(map(len, runs)) < 2:
        return low.rlike(pattern)
    return reduce(lambda a, b: a | b, [low.contains(r) for r in runs]) & low.rlike(pattern)


def families(text: Column, patterns: dict[str, str]) -> Column:
    """Array of the families whose pattern occurs in the lower-case text, in the order given."""
    low = F.lower(text)
    return F.array_compact(F.array(*[F.when(occurs(low, p), F.lit(name)) for name, p in patterns.items()]))


def model_modalities(tasks: Column, text: Column) -> Column:
    """Input modalities that tasks imply, or that the text implies where no task is known."""
    low = F.lower(text)
    none = F.size(tasks) == 0
    any_of = lambda *names: F.arrays_overlap(tasks, F.array(*map(F.lit, names)))
    image = any_of("image-classification", "object-detection", "image-segmentation", "image-to-text") | (none & low.rlike(r"\b(?:pixel_values|torchvision|computer vision|vision transformer|image_size)\b"))
    words = any_of("text-generation", "text-classification", "token-classification", "question-answering") | (none & low.rlike(r"\b(?:text|tokenizer|input_ids)\b"))
    audio = any_of("speech-recognition") | (none & low.rlike(r"\b(?:audio|waveform|sampling_rate)\b"))
    out = F.array_compact(F.array(F.when(image, F.lit("image")), F.when(words, F.lit("text")), F.when(audio, F.lit("audio"))))
    return F.when(F.size(out) > 0, out).otherwise(F.array(F.lit("unknown")))


def preprocessing(text: Column, modalities: Column) -> Column:
    """Preprocessing steps named in the text for the given modalities; text is always tokenized."""
    low = F.lower(text)
    steps = [F.when(F.array_contains(modalities, kind) & low.rlike(p), F.lit(name)) for name, (kind, p) in PREPROCESSING.items()]
    found = F.array_compact(F.array(*steps))
    need = F.array_contains(modalities, "text") & ~F.array_contains(found, "tokenize")
    return F.when(need, F.concat(found, F.array(F.lit("tokenize")))).otherwise(found)


def model_inputs(modalities: Column) -> Column:
    """Input fields of a model from its modalities."""
    field = lambda name, kind: F.struct(F.lit(name).alias("name"), F.lit(kind).alias("data_type"), F.lit(True).alias("required"))
    known = [F.when(F.array_contains(modalities, m), field(m, k)) for m, k in (("text", "string"), ("image", "image"), ("audio", "audio"))]
    out = F.array_compact(F.array(*known))
    return F.when(F.size(out) > 0, out).otherwise(F.array(field("input", "unknown")))


def model_outputs(tasks: Column) -> Column:
    """Output fields of a model from its tasks, one per name; required only where it is the single one."""
    rules = (
        ("tokens", "integer", ["text-generation"]),
        ("logits", "number", ["text-classification", "image-classification"]),
        ("detections", "object", ["object-detection"]),
        ("mask", "image", ["image-segmentation"]),
        ("text", "string", ["image-to-text", "speech-recognition"]),
    )
    pick = lambda n, k: F.struct(F.lit(n).alias("name"), F.lit(k).alias("data_type"))
    out = F.array_compact(F.array(*[F.when(F.arrays_overlap(tasks, F.array(*map(F.lit, ts))), pick(n, k)) for n, k, ts in rules]))
    return F.when(F.size(out) > 0, out).otherwise(F.array(pick("output", "unknown")))


def languages(metadata: Column) -> Column:
    """Languages that dataset metadata, a JSON text, names itself and then in its card, each once."""
    v, none = F.try_parse_json(metadata), F.array().cast("array<string>")
    out = []
    for path in ("$.language", "$.cardData.language"):
        x = F.try_variant_get(v, path, "variant")
        items = F.filter(F.try_variant_get(x, "$", "array<variant>"), lambda i: F.schema_of_variant(i) == "STRING")
        many = F.transform(items, lambda i: F.try_variant_get(i, "$", "string"))
        out.append(F.coalesce(F.when(F.schema_of_variant(x) == "STRING", F.array(F.try_variant_get(x, "$", "string"))).otherwise(many), none))
    return F.array_distinct(F.filter(F.concat(*out), lambda t: t != ""))


def task_names(tasks: Column) -> Column:
    """Tasks as messages name them, sorted by the task itself."""
    known = F.create_map(*[F.lit(x) for kv in TASK_NAMES.items() for x in kv])
    return F.array_join(F.transform(F.array_sort(F.array_distinct(tasks)), lambda t: F.coalesce(F.element_at(known, t), t)), "、")


def json_in_text(text: Column) -> Column:
    """The JSON object in a model's answer: a fenced block, else from the first to the last brace; null if it does not parse."""
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    braces = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    return F.try_parse_json(F.when(fenced != "", fenced).otherwise(F.nullif(braces, F.lit(""))))


def data_url(content: Column, kind: Column) -> Column:
    """Bytes as a data URL of an image kind."""
    return F.concat(F.lit("data:image/"), kind, F.lit(";base64,"), F.base64(content))
