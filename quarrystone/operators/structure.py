"""What a dataset holds, told by the names of its fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrystone.functions import text
from quarrystone.plans.scans import running_sum

# fixed value: characters of documentation that a dataset may show
MOST_DOCUMENTATION = 8_000
# fixed values: tokens sought anywhere in a field name
TOKENS = {
    "bbox": ["bbox", "bounding_box", "boundingbox", "box"],
    "left": ["xmin", "left", "x_min"], "right": ["xmax", "right", "x_max"], "top": ["ymin", "top", "y_min"], "bottom": ["ymax", "bottom", "y_max"],
    "cx": ["x_center", "center_x", "cx"], "cy": ["y_center", "center_y", "cy"], "bw": ["box_width", "bbox_width"], "bh": ["box_height", "bbox_height"],
    "track": ["track_id", "trackid", "track"], "frame": ["frame_id", "frameid", "frame"], "mask": ["mask", "segmentation", "polygon"],
    "instance": ["instance", "instance_id"], "keypoints": ["keypoints", "keypoint", "skeleton"], "action": ["action", "activity", "clip_label"],
    "anomaly": ["anomaly", "abnormal"], "identity": ["identity", "person_id", "camera_id", "query_id", "gallery_id"], "label": ["label", "class", "category"],
    "camera": ["camera_id", "camera"], "split": ["split", "fold"],
}


def holds(names: Column, family: str) -> Column:
    """Whether any of an array of lower-case names contains a token of the family."""
    return F.coalesce(F.exists(names, lambda n: n.rlike("|".join(TOKENS[family]))), F.lit(False))


def structural_tasks(names: Column) -> Column:
    """Task families an array of lower-case field names gives evidence for, in fixed order."""
    h = lambda f: holds(names, f)
    box = h("bbox") | (h("left") & h("right") & h("top") & h("bottom")) | (h("cx") & h("cy") & h("bw") & h("bh"))
    rules = [
        (box, "object_detection"),
        (h("track") & h("frame") & box, "multi_object_tracking"),
        (h("mask") & h("instance"), "instance_segmentation"),
        (h("mask") & ~h("instance"), "semantic_segmentation"),
        (h("keypoints"), "pose_keypoints"),
        (h("action"), "action_video_understanding"),
        (h("anomaly"), "video_anomaly_detection"),
        (h("identity"), "reid_retrieval"),
    ]
    found = F.array_compact(F.array(*[F.when(c, F.lit(t)) for c, t in rules]))
    return F.when((F.size(found) == 0) & h("label"), F.array(F.lit("image_classification"))).otherwise(found)


def structural_supervision(names: Column) -> Column:
    """Kinds of annotation the names give evidence for."""
    h = lambda f: holds(names, f)
    box = h("bbox") | (h("left") & h("right") & h("top") & h("bottom")) | (h("cx") & h("cy") & h("bw") & h("bh"))
    rules = [
        (box, "bbox"), (h("track") & h("frame") & box, "track"), (h("mask") & h("instance"), "instance_mask"), (h("mask") & ~h("instance"), "semantic_mask"),
        (h("keypoints"), "keypoints"), (h("action"), "action_label"), (h("anomaly"), "anomaly_label"), (h("identity"), "identity"),
    ]
    found = F.array_compact(F.array(*[F.when(c, F.lit(t)) for c, t in rules]))
    return F.when((F.size(found) == 0) & h("label"), F.array(F.lit("class_label"))).otherwise(found)


def sample_organisation(names: Column, images: Column, videos: Column) -> Column:
    """``video``, ``image_sequence``, ``independent_image`` or ``UNKNOWN``."""
    return F.when(videos > 0, "video").when(holds(names, "frame") & (images > 0), "image_sequence").when(images > 0, "independent_image").otherwise("UNKNOWN")


def temporal_structure(organisation: Column) -> Column:
    return F.when(organisation == "video", "video").when(organisation == "image_sequence", "sequence").when(organisation == "independent_image", "none").otherwise("UNKNOWN")


def structural_relations(names: Column, images: Column, videos: Column, annotations: Column) -> Column:
    """How the resources of a dataset relate; ``UNKNOWN`` where nothing tells."""
    h = lambda f: holds(names, f)
    rules = [
        ((images > 0) & (annotations > 0), "image_to_annotation"),
        (h("track") & h("frame"), "frame_to_track"),
        ((videos > 0) & (h("action") | h("anomaly")), "video_to_clip_label"),
        (h("identity") & h("camera"), "identity_to_camera"),
    ]
    found = F.array_compact(F.array(*[F.when(c, F.lit(t)) for c, t in rules]))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("UNKNOWN")))


def conflicts(fact: Column, model: Column) -> Column:
    """Whether a model's values leave out a known fact; unknown values on either side are no conflict."""
    known = lambda a: F.filter(a, lambda x: x != "UNKNOWN")
    return (F.size(known(fact)) > 0) & (F.size(known(model)) > 0) & (F.size(F.array_except(known(fact), known(model))) > 0)


def claim(values: Column, conflicted: Column) -> Column:
    """A claim of a field: ``VERIFIED`` with its values, or ``UNKNOWN`` with a reason."""
    known = F.filter(values, lambda x: x != "UNKNOWN")
    ok = (F.size(known) > 0) & ~conflicted
    return F.struct(
        F.when(ok, "VERIFIED").otherwise("UNKNOWN").alias("status"),
        F.when(ok, F.array_join(known, "|")).alias("value"),
        F.when(~ok, F.when(conflicted, "CONFLICTING_EVIDENCE").otherwise("NO_EVIDENCE")).alias("reason"),
    )


def documentation_budget(docs: DataFrame, keys: list[str], order: str, text_column: str = "text", most_chars: int = MOST_DOCUMENTATION) -> DataFrame:
    """The redacted excerpts of each key, in order, as far as they fit into a budget of characters.

    The excerpt at the limit is cut there and later ones are left out. ``order`` is a number,
    unique within its key.
    """
    d = docs.withColumn(text_column, text.redact(F.coalesce(text_column, F.lit(""))))
    d = running_sum(d, keys, [order], F.length(text_column), "_sum", F.floor(F.col(order) / 512))
    left = F.lit(most_chars) - (F.col("_sum") - F.length(text_column))
    return d.withColumn("_left", left).where("_left > 0").withColumn(text_column, F.substr(text_column, F.lit(1), F.col("_left").cast("int"))).drop("_sum", "_left")
