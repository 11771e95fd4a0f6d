"""Nested JSON records into related flat tables (Arrow-buffer flattening).

The JVM decodes each body once and brings the spellings of its members to one nested Arrow type,
in which lists keep their null entries so that positions stay as stored. The nested column then
goes to Python as Arrow buffers: child rows are made from list offsets and parent indices and the
keys of the parents follow by a vectorised take. No row is parsed or walked in Python.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Step = Callable[[Column], Column]


def _let(value: Column, body: Step) -> Column:
    """``body`` with ``value`` evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _member(value: Column, *names: str, kind: str = "variant") -> Column:
    return F.coalesce(*[F.try_variant_get(value, f"$.{n}", kind) for n in names])


def _parsed(v: Column) -> Column:
    """A value that was stored as JSON text inside a string, decoded; null for others."""
    return F.when(F.schema_of_variant(v) == "STRING", F.try_parse_json(F.try_variant_get(v, "$", "string")))


def _get(value: Column, *names: str) -> Column:
    """A member of an object, also of one stored as text. The type is looked at only where there is no such member."""
    return _let(value, lambda v: F.coalesce(_member(v, *names), _member(_parsed(v), *names)))


def _listed(value: Column) -> Column:
    """A stored list, also as text; a single object stands for a list of one; null or absent is an empty list."""
    empty = F.array().cast("array<variant>")
    single = lambda v: F.when(v.isNull() | F.is_variant_null(v), empty).otherwise(F.array(v))
    inner = lambda v: _let(F.coalesce(_parsed(v), v), lambda w: F.coalesce(F.try_variant_get(w, "$", "array<variant>"), single(w)))
    return _let(value, lambda v: F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.when(v.isNull(), empty), inner(v)))


def _text(value: Column) -> Column:
    return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string"))


def _path(value: Column) -> Column:
    return F.coalesce(_member(value, "path", kind="string"), _text(value))


def _loss(value: Column) -> Column:
    code, path = _member(value, "code", kind="string"), F.nullif(_member(value, "path", kind="string"), F.lit(""))
    pieces = F.when(code.isNotNull() | path.isNotNull(), F.concat_ws(":", path, code))
    return F.coalesce(_text(value), pieces)


def profile_tree(body: Column) -> Column:
    """A profile body as ``array<struct<revision, skipped, sampling array<struct<run, losses, videos>>>>``.

    Null for a body that is null or not valid JSON. A profile may stand inside an envelope
    (member ``payload``); members are spelled in camel or snake case.
    """

    def run(g: Column) -> Column:
        summary = _get(g, "samplingSummary", "sampling_summary")
        refs = _listed(_get(g, "sampleRefs", "sample_refs"))
        parts = lambda m: F.struct(
            F.try_variant_get(_get(m, "id"), "$", "string").alias("run"), F.transform(_listed(_get(m, "coverageLosses", "coverage_losses")), _loss).alias("losses")
        )
        videos = F.transform(refs, lambda r: F.nullif(_member(r, "videoPath", "video_path", kind="string"), F.lit("")))
        return _let(_let(summary, parts), lambda p: F.struct(p["run"].alias("run"), p["losses"].alias("losses"), videos.alias("videos")))

    def snapshot(s: Column) -> Column:
        return F.struct(
            _member(s, "revision", "snapshotRevision", "snapshot_revision", kind="string").alias("revision"),
            F.transform(_listed(_get(_get(s, "sketch"), "skippedPaths", "skipped_paths")), _path).alias("skipped"),
            F.transform(_listed(_get(s, "sampling")), run).alias("sampling"),
        )

    def root(v: Column) -> Column:
        return F.transform(_listed(_get(F.coalesce(_member(v, "payload"), v), "snapshots")), snapshot)

    # the parser ignores what follows a first value: a sentinel behind the body shows it
    guarded = F.try_parse_json(F.concat(F.lit("["), body, F.lit(",7]")))
    whole = lambda p: (F.size(F.try_variant_get(p, "$", "array<variant>")) == 2) & (F.try_variant_get(p, "$[1]", "int") == 7)
    return _let(guarded, lambda p: F.when(whole(p), root(F.try_variant_get(p, "$[0]", "variant"))))


def children(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Of a list array: each child's parent row, its position in the stored list, and the children.

    Null lists have no children. Works on offsets; slices of larger arrays are allowed.
    """
    if pa.types.is_large_list(lists.type):
        lists = lists.cast(pa.list_(lists.type.value_type))
    parent = np.asarray(pc.list_parent_indices(lists), dtype=np.int64)
    values = lists.flatten()  # leaves out what stands behind null lists
    starts = np.flatnonzero(np.r_[True, parent[1:] != parent[:-1]]) if len(parent) else np.zeros(0, np.int64)
    position = np.arange(len(parent)) - np.repeat(starts, np.diff(np.r_[starts, len(parent)])) if len(parent) else parent
    return parent, position, values


def _field(structs: pa.Array, name: str) -> pa.Array:
    """A member of a struct array, null where the struct is null."""
    return pc.struct_field(structs, name)


OUT = "profile_id bigint, child_kind string, snapshot_pos bigint, sampling_pos bigint, child_pos bigint, child_value string"
_SCHEMA = pa.schema(
    [("profile_id", pa.int64()), ("child_kind", pa.string()), ("snapshot_pos", pa.int64()), ("sampling_pos", pa.int64()), ("child_pos", pa.int64()), ("child_value", pa.string())]
)


def _emit(kind: str, pid: pa.Array, snap: np.ndarray, samp: np.ndarray, pos: np.ndarray, value: pa.Array) -> pa.RecordBatch:
    n = len(pos)
    return pa.RecordBatch.from_arrays(
        [pid.cast(pa.int64()), pa.array([kind]).take(pa.array(np.zeros(n, np.int32))), pa.array(snap), pa.array(samp), pa.array(pos), value.cast(pa.string())], schema=_SCHEMA
    )


def _flatten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pid, tree = batch.column(0), batch.column(1)
        s_parent, s_pos, snaps = children(tree)
        s_pid = pid.take(pa.array(s_parent))
        none = lambda n: np.full(n, -1, np.int64)
        yield _emit("snapshot", s_pid, s_pos, none(len(s_pos)), s_pos, _field(snaps, "revision"))
        k_parent, k_pos, paths = children(_field(snaps, "skipped"))
        yield _emit("skipped_path", s_pid.take(pa.array(k_parent)), s_pos[k_parent], none(len(k_pos)), k_pos, paths)
        r_parent, r_pos, runs = children(_field(snaps, "sampling"))
        r_pid, r_snap = s_pid.take(pa.array(r_parent)), s_pos[r_parent]
        yield _emit("sampling_run", r_pid, r_snap, r_pos, r_pos, _field(runs, "run"))
        for kind, member in (("coverage_loss", "losses"), ("video_path", "videos")):
            c_parent, c_pos, values = children(_field(runs, member))
            yield _emit(kind, r_pid.take(pa.array(c_parent)), r_snap[c_parent], r_pos[c_parent], c_pos, values)


def flat_profiles(bodies: DataFrame, key: str = "profile_id", body: str = "body") -> DataFrame:
    """Every node of every profile as one row linked to its parent by positions.

    ``child_kind`` is ``snapshot``, ``sampling_run``, ``skipped_path``, ``coverage_loss`` or
    ``video_path``; ``sampling_pos`` is -1 above the sampling level. The value of a snapshot is
    its revision and of a run its id; both may be null. Leaves without a value are left out, but
    count as positions. Bodies that are null or not JSON give nothing; a profile that arrived
    again gives its rows once; a null key is kept as null.
    """
    source = bodies.select(F.col(key).cast("bigint").alias("profile_id"), profile_tree(F.col(body)).alias("tree"))
    flat = source.where(F.col("tree").isNotNull()).mapInArrow(_flatten, OUT)
    node = F.col("child_kind").isin("snapshot", "sampling_run")
    return flat.where(node | F.col("child_value").isNotNull()).distinct()


def leaves(bodies: DataFrame) -> DataFrame:
    """Skipped paths, coverage losses and video paths only."""
    return flat_profiles(bodies).where(F.col("child_kind").isin("skipped_path", "coverage_loss", "video_path"))


def _levels(kind: T.DataType, path: tuple[str, ...] = ()) -> list[tuple[str, ...]]:
    """Paths of all arrays below a type; the element of an array of arrays is called ``element``."""
    if isinstance(kind, T.StructType):
        return [p for f in kind.fields for p in _levels(f.dataType, (*path, f.name))]
    if isinstance(kind, T.ArrayType):
        return [path, *_levels(kind.elementType, (*path, "element"))]
    return []


def _values(kind: T.DataType, path: tuple[str, ...] = ()) -> list[tuple[tuple[str, ...], T.DataType]]:
    """Members that are no arrays, those of inner structs by their path; a plain value has the empty path."""
    if isinstance(kind, T.StructType):
        return [v for f in kind.fields for v in _values(f.dataType, (*path, f.name))]
    return [] if isinstance(kind, T.ArrayType) else [(path, kind)]


def _member_of(array: pa.Array, path: tuple[str, ...]) -> pa.Array:
    for name in path:
        array = pc.struct_field(array, name)
    return array


def _level_rows(batches: Iterator[pa.RecordBatch], steps: list[tuple[str, ...]], members: list[tuple[str, ...]], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows of one level: the key, the positions in the lists above, the position, the members."""
    for batch in batches:
        keys, current = batch.column(0), batch.column(1)
        above: list[np.ndarray] = []
        for step in steps:
            parent, pos, current = children(_member_of(current, step))
            keys = keys.take(pa.array(parent))
            above = [a[parent] for a in above] + [pos]
        n, width = len(keys), max(len(steps) - 1, 0)
        flat = np.stack(above[:-1], 1).ravel() if width and n else np.zeros(0, np.int64)
        link = [pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * width, pa.int32()), pa.array(flat, pa.int64())), pa.array(above[-1], pa.int64())] if steps else []
        yield pa.RecordBatch.from_arrays([keys, *link, *[_member_of(current, m) for m in members]], names=names)


def child_tables(df: DataFrame, key: str, column: str) -> dict[str, DataFrame]:
    """A nested column of any type as flat tables, one for the records themselves (``""``) and one for each array below.

    A table of an array, named by its path, has the key, ``_parent`` (the positions of the list
    elements that enclose the row, outermost first), ``_pos`` (its own position from 0) and the
    members of its elements, inner structs by dotted names; a plain element is ``value``. The parent of a row is the row
    with the same key whose ``_parent`` and ``_pos`` are this ``_parent``. Null lists have no rows,
    null elements have rows of nulls; maps stay values. Names that would clash get underscores.
    Every table reads only the members it needs.
    """
    kind = df.schema[column].dataType
    out = {}
    for path in [None, *_levels(kind)]:
        steps: list[tuple[str, ...]] = []
        at, here = kind, ()
        for name in path or ():
            here, at = (*here, name), at[name].dataType if isinstance(at, T.StructType) else at.elementType
            if isinstance(at, T.ArrayType):
                steps.append(here if not steps or here[0] != "element" else here[1:])
                here = ()
        if path == ():
            steps = [()]
        element = kind if path is None else at.elementType
        if path is None and isinstance(kind, T.ArrayType):
            continue
        members = _values(element)
        names = [key] + (["_parent", "_pos"] if path is not None else [])
        fields = [T.StructField(key, df.schema[key].dataType)] + ([T.StructField("_parent", T.ArrayType(T.LongType())), T.StructField("_pos", T.LongType())] if path is not None else [])
        for m, k in members:
            name = ".".join(m) or "value"
            while name in names:
                name += "_"
            names.append(name)
            fields.append(T.StructField(name, k))
        rows = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{column}`").alias("value"))
        if path is None:
            rows = rows.where("value is not null")
        out["" if path is None else ".".join(path) or "value"] = rows.mapInArrow(lambda b, s=steps, m=[p for p, _ in members], n=names: _level_rows(b, s, m, n), T.StructType(fields))
    return out
