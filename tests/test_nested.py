import json

import pyarrow as pa

from quarrystone.operators import nested


def rows(spark, bodies):
    df = spark.createDataFrame([(i, b, "t", 0) for i, b in enumerate(bodies)], "profile_id bigint, body string, tree string, child_pos int")
    return sorted((r.profile_id, r.child_kind, r.snapshot_pos, r.sampling_pos, r.child_pos, r.child_value) for r in nested.leaves(df).collect())


def test_shapes_spellings_and_positions(spark):
    run = {"samplingSummary": {"coverageLosses": [None, "x", {"path": "p", "code": "c"}, {"code": "d"}, {}]}, "sampleRefs": [{"videoPath": None}, None, {"video_path": "v"}, {"videoPath": ""}]}
    body = {"envelope": 2, "payload": {"snapshots": [None, {"sketch": {"skippedPaths": ["a", None, {"path": "b"}, {"reason": "r"}]}, "sampling": [None, run]}]}}
    assert rows(spark, [json.dumps(body)]) == [
        (0, "coverage_loss", 1, 1, 1, "x"), (0, "coverage_loss", 1, 1, 2, "p:c"), (0, "coverage_loss", 1, 1, 3, "d"),
        (0, "skipped_path", 1, -1, 0, "a"), (0, "skipped_path", 1, -1, 2, "b"), (0, "video_path", 1, 1, 2, "v"),
    ]


def test_single_objects_and_text_inside_text(spark):
    one = {"snapshots": {"sketch": json.dumps({"skipped_paths": {"path": "é/1"}}), "sampling": json.dumps([{"sampling_summary": {"coverage_losses": {"code": "z"}}}])}}
    assert rows(spark, [json.dumps(one)]) == [(0, "coverage_loss", 0, 0, 0, "z"), (0, "skipped_path", 0, -1, 0, "é/1")]


def test_what_is_no_json_yields_nothing(spark):
    good = '{"snapshots":[{"sketch":{"skippedPaths":["a"]}}]}'
    assert rows(spark, [None, "", " ", "nope", good + "x", good + "," + good, good + "],[" + good, good[:-1], "7", "null", "[]"]) == []
    assert rows(spark, []) == []
    assert rows(spark, [f" \n{good} "]) == [(0, "skipped_path", 0, -1, 0, "a")]


def test_repeats_give_one_row_and_long_lists_hold(spark):
    many = json.dumps({"snapshots": [{"sketch": {"skippedPaths": [f"p{i}" for i in range(30000)]}}]})
    df = spark.createDataFrame([(1, many), (1, many)], "profile_id bigint, body string")
    assert nested.leaves(df).count() == 30000


def test_child_kernel_on_slices_and_nulls():
    a = pa.array([[1], None, [2, None, 3], [], [4]], pa.list_(pa.int64())).slice(1)
    parent, position, values = nested.children(a)
    assert (parent.tolist(), position.tolist(), values.to_pylist()) == ([1, 1, 1, 3], [0, 1, 2, 0], [2, None, 3, 4])
    parent, position, values = nested.children(pa.array([], pa.list_(pa.string())))
    assert len(parent) == len(position) == len(values) == 0


def test_parents_are_linked(spark):
    body = json.dumps({"snapshots": [{"revision": "r1", "sampling": [{"samplingSummary": {"id": "s1"}}, {"samplingSummary": {}}]}]})
    got = {(r.child_kind, r.snapshot_pos, r.sampling_pos, r.child_value) for r in nested.flat_profiles(spark.createDataFrame([(1, body)], "profile_id bigint, body string")).collect()}
    assert got == {("snapshot", 0, -1, "r1"), ("sampling_run", 0, 0, "s1"), ("sampling_run", 0, 1, None)}


def test_any_nested_column_becomes_linked_tables(spark):
    kind = "struct<id:int,who:struct<name:string>,xs:array<struct<a:int,_pos:string,ys:array<int>,deep:struct<zs:array<struct<z:string>>>>>,grid:array<array<int>>>"
    rows = [
        (1, (7, ("n",), [(1, "p", [5, None], ([("u",), None],)), None, (3, None, None, None)], [[1], None, [2, 3]])),
        (2, None), (3, (8, None, [], None)),
    ]
    tables = nested.child_tables(spark.createDataFrame(rows, f"k bigint, v {kind}"), "k", "v")
    got = {name: sorted(map(tuple, t.collect()), key=repr) for name, t in tables.items()}
    assert set(got) == {"", "xs", "xs.element.ys", "xs.element.deep.zs", "grid", "grid.element"}
    assert got[""] == [(1, 7, "n"), (3, 8, None)]
    assert got["xs"] == [(1, [], 0, 1, "p"), (1, [], 1, None, None), (1, [], 2, 3, None)] and tables["xs"].columns == ["k", "_parent", "_pos", "a", "_pos_"]
    assert got["xs.element.ys"] == [(1, [0], 0, 5), (1, [0], 1, None)]
    assert got["xs.element.deep.zs"] == [(1, [0], 0, "u"), (1, [0], 1, None)]
    assert got["grid.element"] == [(1, [0], 0, 1), (1, [2], 0, 2), (1, [2], 1, 3)] and len(got["grid"]) == 3


def test_plain_arrays_and_empty_tables(spark):
    t = nested.child_tables(spark.createDataFrame([(1, [4, 5]), (2, None)], "k int, v array<int>"), "k", "v")
    assert {n: sorted(map(tuple, d.collect())) for n, d in t.items()} == {"value": [(1, [], 0, 4), (1, [], 1, 5)]}
    t = nested.child_tables(spark.createDataFrame([], "k int, v struct<a:array<struct<b:int>>>"), "k", "v")
    assert {n: d.count() for n, d in t.items()} == {"": 0, "a": 0}
