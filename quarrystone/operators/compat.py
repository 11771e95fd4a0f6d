"""How the fields of datasets fit the input fields of models.

Pairs are built from fields that share a key, or from the small table of contracts; the contracts
are a stated rule table and are checked to be small before they are broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrystone.functions import names, types

MOST_CONTRACT_FIELDS = 10_000
SCORES = {"compatible": 1.0, "adaptable": 0.65, "blocked": 0.0}
# fixed values: dataset field keys that stand in for a model's field
ALIASES = {
    "inputids": ["text", "input", "tokens", "inputids"],
    "attentionmask": ["attentionmask", "mask"],
    "pixelvalues": ["image", "images", "pixelvalues"],
    "inputvalues": ["audio", "waveform", "inputvalues"],
}


def bounded(rules: DataFrame, most: int = MOST_CONTRACT_FIELDS) -> DataFrame:
    """A rule table for broadcasting; raises where it is larger than allowed."""
    if rules.limit(most + 1).count() > most:
        raise ValueError(f"a rule table has more than {most} rows")
    return F.broadcast(rules)


def field_mapping(features: DataFrame, fields: DataFrame) -> DataFrame:
    """For each dataset and model field the feature that serves it, how, and with what confidence.

    ``features``: ``dataset, name, data_type, pos``; ``fields``: ``model, field, field_type, required``.
    Equal keys match, the last of several wins; else an alias, if exactly one feature has one.
    Model fields without a feature are absent here.
    """
    f = features.withColumn("key", names.field_key(F.col("name")))
    last = Window.partitionBy("dataset", "key").orderBy(F.col("pos").desc(), F.col("name").desc())
    one = f.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")
    want = bounded(fields.withColumn("key", names.field_key(F.col("field"))))
    exact = one.join(want, "key").select("dataset", "model", "field", "field_type", "name", "data_type", F.lit(True).alias("same"))
    alias_rows = [(k, a) for k, vs in ALIASES.items() for a in vs]
    aliases = features.sparkSession.createDataFrame(alias_rows, "key string, alias_key string")
    via = want.join(aliases, "key").select("model", "field", "field_type", F.col("alias_key").alias("_via"))
    byalias = f.join(bounded(via), F.col("key") == F.col("_via")).groupBy("dataset", "model", "field", "field_type").agg(F.count("*").alias("n"), F.max("name").alias("name"), F.max("data_type").alias("data_type"))
    byalias = byalias.where("n = 1").drop("n").join(exact.select("dataset", "model", "field"), ["dataset", "model", "field"], "left_anti").withColumn("same", F.lit(False))
    m = exact.unionByName(byalias)
    m = m.withColumn("relation", types.type_relation(F.col("data_type"), F.col("field_type")))
    kind = F.when(F.col("same") & (F.col("relation") == "compatible"), "exact").otherwise("transform")
    return m.select("dataset", "model", "field", "name", "data_type", "field_type", "relation", kind.alias("kind"), F.when(kind == "exact", 1.0).otherwise(0.8).alias("confidence"))


def unmatched(features: DataFrame, fields: DataFrame, mapping: DataFrame) -> DataFrame:
    """Features of a dataset that no model field uses, and model fields no feature serves."""
    pairs = mapping.select("dataset", "model").distinct()
    left = pairs.join(features.select("dataset", "name"), "dataset").join(mapping.select("dataset", "model", "name"), ["dataset", "model", "name"], "left_anti")
    right = pairs.join(bounded(fields.select("model", "field")), "model").join(mapping.select("dataset", "model", "field"), ["dataset", "model", "field"], "left_anti")
    cols = lambda d, c, side: d.select("dataset", "model", F.lit(side).alias("side"), F.col(c).alias("name"))
    return cols(left, "name", "dataset").unionByName(cols(right, "field", "model"))


def status_of(least: Column) -> Column:
    """Status of a dimension from its least score; null means nothing was compared."""
    return F.when(least.isNull(), "unknown").when(least == 0.0, "blocked").when(least < 1.0, "adaptable").otherwise("compatible")


def mapping_dimensions(mapping: DataFrame) -> DataFrame:
    """Scores of fields and types per dataset and model, in long form."""
    score = F.element_at(F.create_map(*[x for k, v in SCORES.items() for x in (F.lit(k), F.lit(v))]), F.col("relation"))
    field = F.when(F.col("kind") == "exact", 1.0).otherwise(0.75)
    long = mapping.select("dataset", "model", F.explode(F.array(F.struct(F.lit("input_fields").alias("dimension"), field.alias("s")), F.struct(F.lit("data_types").alias("dimension"), score.alias("s")))).alias("x"))
    g = long.groupBy("dataset", "model", "x.dimension").agg(F.avg("x.s").alias("score"), F.min("x.s").alias("least"))
    return g.select("dataset", "model", "dimension", "score", status_of(F.col("least")).alias("status"))


def field_dimensions(features: DataFrame, fields: DataFrame, mapping: DataFrame) -> DataFrame:
    """Scores of fields, types and shapes of every dataset with every model, in long form.

    A required field that no feature serves scores 0 where no feature's type would do, else 0.5,
    and leaves the pair ``unresolved``; an optional one does not count. ``shape`` of features and
    fields is an array of texts and may be absent. Nothing to compare is unknown, with score 0.5.
    """
    none = F.array().cast("array<string>")
    shape = lambda d: F.coalesce("shape", none) if "shape" in d.columns else none
    wanted = bounded(fields.select("model", "field", "field_type", F.coalesce("required", F.lit(True)).alias("required"), shape(fields).alias("want")))
    kinds = bounded(fields.select("field_type").distinct())
    usable = features.select("dataset", "data_type").distinct().join(kinds, types.type_relation(F.col("data_type"), F.col("field_type")) != "blocked").select("dataset", "field_type").distinct().withColumn("usable", F.lit(True))
    served = mapping.select("dataset", "model", "field", "name", "relation", "kind")
    if "shape" in features.columns:
        served = served.join(features.groupBy("dataset", "name").agg(F.max_by("shape", "pos").alias("have")), ["dataset", "name"], "left")
    else:
        served = served.withColumn("have", none)
    m = features.select("dataset").distinct().join(wanted).join(served, ["dataset", "model", "field"], "left").join(usable, ["dataset", "field_type"], "left")
    open_ = F.col("name").isNull() & F.col("required")
    rate = lambda c: F.element_at(F.create_map(*[x for k, v in SCORES.items() for x in (F.lit(k), F.lit(v))]), c)
    own = F.when(F.col("kind") == "exact", 1.0).when(F.col("name").isNotNull(), 0.75).when(open_ & F.col("usable"), 0.5).when(open_, 0.0)
    scores = {"input_fields": own, "data_types": rate(F.col("relation")), "shape": F.when(F.col("name").isNotNull(), rate(types.shape_relation(F.coalesce("have", none), F.col("want"))))}
    parts = F.array(*[F.struct(F.lit(k).alias("dimension"), v.alias("s"), (F.lit(k == "input_fields") & open_ & F.col("usable").isNotNull()).alias("u")) for k, v in scores.items()])
    g = m.select("dataset", "model", F.explode(parts).alias("x")).groupBy("dataset", "model", "x.dimension")
    g = g.agg(F.coalesce(F.avg("x.s"), F.lit(0.5)).alias("score"), F.min("x.s").alias("least"), F.bool_or("x.u").alias("unresolved"))
    return g.select("dataset", "model", "dimension", "score", status_of(F.col("least")).alias("status"), "unresolved")


def profile_dimensions(datasets: DataFrame, models: DataFrame) -> DataFrame:
    """Task, modality, preprocessing, labels, licence and runtime of every dataset with every model.

    ``datasets``: ``dataset, task_hints, modalities, license, has_label, satisfied`` (steps that an
    adapter vouches for); ``models``: ``model, tasks, modalities, preprocessing, license, frameworks``.
    """
    want = bounded(models.select("model", "tasks", F.col("modalities").alias("need"), "preprocessing", F.col("license").alias("model_license"), "frameworks"))
    none = F.array().cast("array<string>")
    clean = lambda c: F.array_distinct(F.filter(F.transform(F.coalesce(c, none), names.slug), lambda x: x.isNotNull() & (x != "")))
    lists = lambda c: F.size(F.coalesce(c, none)) > 0
    steps = clean(F.col("preprocessing"))
    covered = (F.size(steps) > 0) & (F.size(F.array_except(steps, clean(F.col("satisfied")))) == 0)
    classifies = F.exists(F.coalesce("tasks", none), lambda t: F.coalesce(names.canonical_task(t).contains("classification"), F.lit(False)))
    unknown = F.lit(False)
    for c in ("license", "model_license"):
        unknown = unknown | F.coalesce(names.slug(F.col(c)), F.lit("")).isin("unknown", "")
    by_status = lambda s: F.when(s == "compatible", 1.0).when(s == "blocked", 0.0).otherwise(0.5)
    task, modality = task_dimension(F.col("task_hints"), F.col("tasks")), modality_dimension(F.col("modalities"), F.col("need"))
    dims = {
        "task": (task, by_status(task)),
        "modality": (modality, by_status(modality)),
        "preprocessing": (F.when(~lists(F.col("preprocessing")) | covered, "compatible").otherwise("adaptable"), F.when(~lists(F.col("preprocessing")) | covered, 1.0).otherwise(0.75)),
        "labels": (F.when(classifies & ~F.coalesce("has_label", F.lit(False)), "adaptable").otherwise("compatible"), F.when(classifies & ~F.coalesce("has_label", F.lit(False)), 0.5).otherwise(1.0)),
        "license": (F.when(unknown, "unknown").otherwise("compatible"), F.when(unknown, 0.5).otherwise(1.0)),
        "runtime": (F.lit("unknown"), F.when(lists(F.col("frameworks")), 0.6).otherwise(0.5)),
    }
    rows = F.array(*[F.struct(F.lit(k).alias("dimension"), score.alias("score"), status.alias("status")) for k, (status, score) in dims.items()])
    return datasets.join(want).select("dataset", "model", F.explode(rows).alias("x")).select("dataset", "model", "x.dimension", "x.score", "x.status", F.lit(False).alias("unresolved"))


def task_dimension(hints: Column, tasks: Column) -> Column:
    """Status of the task dimension from two arrays of task names."""
    a, b = (F.array_distinct(F.filter(F.transform(x, names.canonical_task), lambda t: t != "")) for x in (hints, tasks))
    generic = lambda x, y: F.array_contains(x, "classification") & F.exists(y, lambda t: t.contains("classification"))
    missing = hints.isNull() | tasks.isNull() | (F.size(a) == 0) | (F.size(b) == 0)
    return F.when(missing, "unknown").when(F.arrays_overlap(a, b) | generic(a, b) | generic(b, a), "compatible").otherwise("blocked")


def modality_dimension(have: Column, need: Column) -> Column:
    """Status of the modality dimension: everything needed must be there."""
    a, b = (F.array_distinct(F.filter(F.transform(x, names.slug), lambda t: t.isNotNull() & (t != ""))) for x in (have, need))
    missing = have.isNull() | need.isNull() | (F.size(a) == 0) | (F.size(b) == 0)
    return F.when(missing, "unknown").when(F.size(F.array_except(b, a)) == 0, "compatible").otherwise("blocked")


def missing_modalities(have: Column, need: Column) -> Column:
    a, b = (F.filter(F.transform(x, names.slug), lambda t: t.isNotNull() & (t != "")) for x in (have, need))
    return F.array_join(F.array_sort(F.array_except(b, a)), "|")


def roll_up(dimensions: DataFrame) -> DataFrame:
    """Status and capped mean score of each dataset and model from its dimensions.

    A blocked dimension caps the score at 0.49; an unknown task or modality, or a required field
    left ``unresolved``, makes the whole unknown.
    """
    left = F.coalesce("unresolved", F.lit(False)) if "unresolved" in dimensions.columns else F.lit(False)
    g = dimensions.groupBy("dataset", "model").agg(
        F.bool_or(F.col("status") == "blocked").alias("b"),
        F.bool_or((F.col("status") == "unknown") & F.col("dimension").isin("task", "modality") | left).alias("u"),
        F.bool_or(F.col("status") == "adaptable").alias("a"),
        F.avg("score").alias("mean"),
        F.count("*").alias("dimensions"),
    )
    status = F.when(F.col("b"), "blocked").when(F.col("u"), "unknown").when(F.col("a"), "adaptable").otherwise("compatible")
    return g.select("dataset", "model", status.alias("status"), F.when(F.col("b"), F.least(F.col("mean"), F.lit(0.49))).otherwise(F.col("mean")).alias("score"), "dimensions")
