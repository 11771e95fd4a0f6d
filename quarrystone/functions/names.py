"""What names and paths tell: roles, splits, keys, kinds of files."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: column names that name labels and identifiers
LABEL_NAMES = [
    "label", "labels", "class", "class_id", "target", "target_id", "y", "category", "sentiment", "species",
    "objects", "annotations", "bbox", "bboxes", "boxes", "mask", "masks", "segmentation",
]
IDENTIFIER_NAMES = ["id", "uuid", "index", "identifier"]
# fixed values: path tokens that name a split
SPLIT = r"(?i)(?:^|[_./-])(train|validation|valid|val|test|dev)(?:[_./-]|$)"
# fixed values: file kinds
DATA_SUFFIXES = [".csv", ".json", ".jsonl", ".ndjson", ".parquet"]
IMAGE_SUFFIXES = [".jpg", ".jpeg", ".png", ".gif", ".bmp", ".webp", ".tif", ".tiff"]
VIDEO_SUFFIXES = [".mp4", ".avi", ".mov", ".mkv", ".webm", ".mpeg", ".mpg"]
STRUCTURED_SUFFIXES = [".csv", ".tsv", ".json", ".jsonl", ".ndjson", ".parquet"]
ANNOTATION_SUFFIXES = [".xml", ".json", ".jsonl", ".ndjson", ".csv", ".tsv", ".txt"]
DOC_NAMES = ["readme", "readme.md", "readme.txt", "license", "changelog"]
SENSITIVE_NAMES = [".env", ".env.local", ".env.production", "config.llm.json", "credentials.json", "secrets.json", "id_rsa"]
IGNORED_FOLDERS = [".git", ".ssh", ".aws", ".gnupg", ".kube", "__pycache__", ".venv", "venv", "node_modules"]
WEIGHT_SUFFIXES = [".bin", ".ckpt", ".h5", ".keras", ".onnx", ".pb", ".pt", ".pth", ".safetensors", ".tflite", ".weights", ".msgpack"]
DEPENDENCY_NAMES = ["requirements.txt", "requirements-dev.txt", "pyproject.toml", "setup.py", "setup.cfg", "environment.yml", "environment.yaml", "pipfile"]
ENTRYPOINT_NAMES = ["app.py", "main.py", "serve.py", "inference.py", "predict.py", "train.py", "run.py", "cli.py"]
SOURCE_SUFFIXES = [".md", ".rst", ".txt", ".json", ".yaml", ".yml", ".toml", ".py"]
METADATA_NAMES = ["dataset_dict.json", "id2label.json", "label2id.json", "state.json"]
ANNOTATION_TOKENS = ["annotation", "annotations", "label", "labels", "mask", "masks", "bbox", "boxes", "track", "tracks", "keypoint", "keypoints"]
# fixed values: task names that mean another
TASK_ALIASES = {
    "language-modeling": "text-generation",
    "causal-language-modeling": "text-generation",
    "sequence-to-sequence": "text-generation",
    "semantic-segmentation": "image-segmentation",
}


def slug(text: Column) -> Column:
    """Lower case, runs of other signs as one hyphen, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def field_key(text: Column) -> Column:
    """Lower-case letters and digits only."""
    return F.regexp_replace(F.lower(F.trim(text)), "[^a-z0-9]+", "")


def role(name: Column) -> Column:
    """``label``, ``identifier`` or ``input``; label names win over the ``_id`` ending."""
    n = F.lower(name)
    return F.when(n.isin(LABEL_NAMES), "label").when(n.isin(IDENTIFIER_NAMES) | n.endswith("_id"), "identifier").otherwise("input")


def role_of(name: str) -> str:
    """``role`` for one name on the driver."""
    n = name.lower()
    return "label" if n in LABEL_NAMES else "identifier" if n in IDENTIFIER_NAMES or n.endswith("_id") else "input"


def path_split(path: Column) -> Column:
    """Split named by the leftmost delimited token of a path, ``unknown`` without one."""
    hit = F.lower(F.regexp_extract(path, SPLIT, 1))
    return F.when(hit.isin("valid", "val", "dev"), "validation").when(hit == "", "unknown").otherwise(hit)


def canonical_task(text: Column) -> Column:
    """Task name with aliases resolved."""
    s = slug(text)
    out = s
    for alias, name in TASK_ALIASES.items():
        out = F.when(s == alias, name).otherwise(out)
    return out


def base_name(path: Column) -> Column:
    return F.lower(F.element_at(F.split(path, "/"), -1))


def suffix(path: Column) -> Column:
    """Suffix with its dot in lower case; '' for none and for names that only begin with a dot."""
    return F.lower(F.regexp_extract(F.element_at(F.split(path, "/"), -1), r"[^.].*?([.][^.]+)$", 1))


def sensitive(path: Column) -> Column:
    n = base_name(path)
    return n.isin(SENSITIVE_NAMES) | n.startswith(".env.")


def unsafe(path: Column) -> Column:
    """Empty, absolute, climbing or backslashed paths."""
    return path.isNull() | (path == "") | path.startswith("/") | path.contains("\\") | F.array_contains(F.split(path, "/"), "..")


def ignored(path: Column) -> Column:
    return F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, IGNORED_FOLDERS)))


def data_file(path: Column) -> Column:
    return suffix(path).isin(DATA_SUFFIXES) & ~unsafe(path)


def documentation(path: Column) -> Column:
    n = base_name(path)
    return n.isin(DOC_NAMES) | n.startswith("readme.")


def annotation(path: Column) -> Column:
    """Whether any part of a path holds an annotation token."""
    stems = F.transform(F.split(path, "/"), lambda p: F.regexp_replace(p, r"(?<=.)[.][^.]*$", ""))
    tokens = F.split(F.lower(F.replace(F.array_join(stems, "_"), F.lit("-"), F.lit("_"))), "_")
    return F.arrays_overlap(tokens, F.array(*map(F.lit, ANNOTATION_TOKENS)))


def frame_image(path: Column) -> Column:
    """Whether a path may hold an original frame of a tracking export."""
    parts = F.split(F.lower(path), "/")
    overlay = F.arrays_overlap(parts, F.array(*map(F.lit, ["boxes", "overlays", "visualizations"])))
    return ~overlay & (F.array_contains(parts, "images") | (F.size(parts) == 1))


def kind_of_file(path: Column) -> Column:
    """``documentation``, ``image``, ``video``, ``annotation``, ``structured`` or ``other``; the first that holds."""
    s = suffix(path)
    return (
        F.when(documentation(path), "documentation")
        .when(s.isin(IMAGE_SUFFIXES), "image")
        .when(s.isin(VIDEO_SUFFIXES), "video")
        .when(s.isin(ANNOTATION_SUFFIXES) & annotation(path), "annotation")
        .when(s.isin(STRUCTURED_SUFFIXES), "structured")
        .otherwise("other")
    )


def file_priority(path: Column) -> Column:
    """Order in which source files are sampled: documents, dependencies, entry points, others."""
    n = base_name(path)
    return (
        F.when(n.startswith("readme") | n.startswith("license") | (n == "copying"), 0)
        .when(n.isin(DEPENDENCY_NAMES), 1)
        .when(n.isin(ENTRYPOINT_NAMES), 2)
        .otherwise(3)
    )


def weights(path: Column) -> Column:
    return suffix(path).isin(WEIGHT_SUFFIXES)


def source_file(path: Column) -> Column:
    """Files worth sampling from a model repository."""
    n = base_name(path)
    return n.isin("license", "copying", *DEPENDENCY_NAMES, *ENTRYPOINT_NAMES) | suffix(path).isin(SOURCE_SUFFIXES)


def plain_name(name: Column) -> Column:
    """Lower case without surrounding white space and byte-order marks."""
    return F.lower(F.regexp_replace(name, r"^[\s\p{Z}\x{FEFF}]+|[\s\p{Z}\x{FEFF}]+$", ""))
