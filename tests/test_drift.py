import random
from datetime import datetime

import pytest
from pyspark.sql import types as T

from quarrystone.operators import drift
from quarrystone.operators.tree_edit import Node, edit_script, schema_tree
from quarrystone.sources.readers import read_drifting

SCHEMA = "fact_id bigint, file_id bigint, resource_id string, series string, file_seq int, col_pos int, name string, observed_types array<string>, nullable boolean, inspected_at timestamp, prev int, types string, file string"
T0 = datetime(2020, 1, 1)


def changes(spark, rows):
    df = spark.createDataFrame([(i, f, "r", s, q, p, n, t, u, T0, 1, "x", "y") for i, (f, s, q, p, n, t, u) in enumerate(rows)], SCHEMA)
    return sorted((r.file_id, r.change_kind, r.old_name, r.new_name) for r in drift.schema_changes(df).collect())


def plain(rows):
    """Sequential fold of the definition."""
    files = {}
    for f, s, q, p, n, t, u in rows:
        if n is None or not n.strip(" ﻿\t\n"):
            continue
        known = frozenset(x for x in t or [] if x and x != "unknown") or None
        files.setdefault((s, q, f), {})[n.strip(" ﻿\t\n").lower()] = (p, known, u if known else None)
    out, state, before = [], {}, None
    for s, q, f in sorted(files):
        cur = files[s, q, f]
        first = s != before
        state, before = ({} if first else state), s
        gone, came, was = [n for n in state if n not in cur], [n for n in cur if n not in state], {n: n for n in cur if n in state}
        if not first:
            for a in list(gone):
                for b in list(came):
                    if state[a][0] == cur[b][0] and state[a][1] and state[a][1] == cur[b][1]:
                        gone.remove(a), came.remove(b)
                        was[b] = a
                        out.append((f, "renamed", a, b))
                        break
            out += [(f, "removed", a, "") for a in gone] + [(f, "added", "", b) for b in came]
        new = {}
        for n, (p, t, u) in cur.items():
            o = state.get(was.get(n))
            if o and t and o[1] and t != o[1]:
                out.append((f, "type_changed", was[n], n))
            if o and u is not None and o[2] is not None and u != o[2]:
                out.append((f, "nullable_changed", was[n], n))
            new[n] = (p, t or (o and o[1]), u if u is not None else o and o[2])
        state = new
    return sorted(out)


def test_against_the_sequential_fold(spark, monkeypatch):
    monkeypatch.setattr(drift, "BLOCK", 3)  # many blocks
    rng, rows, f = random.Random(4), [], 0
    for s in ("big", "a", "b"):
        for q in range(40 if s == "big" else 8):
            f += 1
            names = rng.sample(["a", "b", "c", "d", "e", "x y"], rng.randrange(2, 5))
            for p, n in enumerate(names, 1):
                t = rng.choice([["integer"], ["number", "integer"], ["integer", "number"], None, [], ["unknown"]])
                rows.append((f, s, q * 2, p, rng.choice([n, n.upper(), f"﻿ {n}"]), t, rng.choice([True, False, None, None])))
    rng.shuffle(rows)
    assert changes(spark, rows) == plain(rows)


@pytest.mark.parametrize("seed", range(4))
def test_seams_between_ranges(spark, seed):
    """Series over many ranges, with renames of columns whose types or nullability were told long before."""
    rng, rows, f = random.Random(seed), [], 0
    for s in ("big", "a", "b"):
        cur = {p: rng.choice("abcdef") + str(p) for p in range(1, 5)}
        for q in range(60 if s == "big" else 7):
            f += 1
            for p in list(cur):
                if rng.random() < 0.15:
                    cur[p] = rng.choice("abcdef") + str(p)
            for p, n in cur.items():
                t = rng.choice([["integer"], ["integer"], ["string"], None, None, None, ["unknown"]])
                if rng.random() < 0.9:
                    rows.append((f, s, q, p, n, t, rng.choice([True, False, None, None, None])))
    rng.shuffle(rows)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    want = plain(rows)
    try:
        results = []
        for ranges in (1, 24):
            spark.conf.set("spark.sql.shuffle.partitions", ranges)
            assert changes(spark, rows) == want
            df = spark.createDataFrame([(n, f, "r", s, q, p, c, t, u, T0, 1, "x", "y") for n, (f, s, q, p, c, t, u) in enumerate(sorted(rows, key=repr))], SCHEMA)
            results.append((sorted(map(tuple, drift.consistent_columns(df).collect())), sorted(map(tuple, drift.file_projections(df).collect()))))
        assert results[0] == results[1]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_nullability_follows_a_chain_of_renames(spark):
    i = ["integer"]
    rows = [(1, "s", 1, 1, "a", i, True), (2, "s", 2, 1, "b", i, None), (3, "s", 3, 1, "c", i, None), (4, "s", 4, 1, "d", i, None), (5, "s", 5, 1, "d", i, False)]
    got = changes(spark, rows)
    assert (5, "nullable_changed", "d", "d") in got and sum(k == "renamed" for _, k, _, _ in got) == 3


def test_nulls_repeats_and_empty(spark):
    assert changes(spark, []) == []
    rows = [(1, "s", 1, 1, "a", ["integer"], True), (1, "s", 1, 1, "a", ["integer"], True), (2, None, 2, 1, "a", None, None), (2, "s", 2, None, "a", None, None), (2, "s", 2, 2, None, None, None), (None, "s", 3, 1, "q", ["string"], True)]
    assert changes(spark, rows) == []


def test_consistent_table_and_projection(spark):
    i = ["integer"]
    rows = [(1, "s", 1, 1, " A", i, True), (1, "s", 1, 2, "k", ["string"], False), (2, "s", 2, 1, "b", i, True), (2, "s", 2, 2, "k", ["string"], False), (3, "s", 3, 1, "b", ["number"], True)]
    df = spark.createDataFrame([(n, f, "r", s, q, p, c, t, u, T0, 1, "x", "y") for n, (f, s, q, p, c, t, u) in enumerate(rows)], SCHEMA)
    cols = {r.column_name: r for r in drift.consistent_columns(df).collect()}
    assert set(cols) == {"b", "k"} and cols["b"].unified_type == "number" and cols["b"].names == "a|b" and cols["k"].last_file == 2
    got = {r.file_id: r.projection for r in drift.file_projections(df).collect()}
    assert got[1] == "try_cast(` A` as double) as `b`, try_cast(`k` as string) as `k`"


def test_tree_edit_scripts():
    old = Node("", None, None, [Node("a", "int", 1), Node("s", "struct", 2, [Node("x", "int", 1), Node("y", "int", 2)])])
    new = Node("", None, None, [Node("b", "int", 1), Node("s", "struct", 2, [Node("x", "int", 1)]), Node("y", "int", 3)])
    ops = {(e.op, e.old_path, e.new_path) for e in edit_script(old, new)}
    assert ops == {("rename", "a", "b"), ("keep", "s", "s"), ("keep", "s.x", "s.x"), ("move", "s.y", "y")}
    assert edit_script(Node(""), Node("")) == []


def test_edit_cost_is_least_among_all_matchings():
    from itertools import permutations

    rng = random.Random(2)
    for _ in range(60):
        make = lambda pool: Node("", None, None, [Node(n, rng.choice("ij"), p) for p, n in enumerate(rng.sample(pool, rng.randrange(0, 5)), 1)])  # noqa: B023,E731
        a, b = make("abcde"), make("cdefg")
        cost = sum({"keep": 0, "retype": 0, "rename": 1, "delete": 1, "add": 1, "move": 2}[e.op] for e in edit_script(a, b))
        best = 99
        small, large, flip = (a.children, b.children, False) if len(a.children) <= len(b.children) else (b.children, a.children, True)
        for perm in permutations(list(large) + [None] * len(small), len(small)):
            c = len(large) - sum(x is not None for x in perm)
            for x, y in zip(small, perm):
                o, n = (y, x) if flip else (x, y)
                c += 1 if y is None else 0 if o.name == n.name else 1 if o.position == n.position and o.kind == n.kind else 99
            best = min(best, c)
        assert cost == best


def test_read_drifting_files(spark, tmp_path):
    a = spark.createDataFrame([(1, ("u", 5))], "id int, s struct<n:string,k:int>")
    b = spark.createDataFrame([(2, ("v", 6, True), "z")], T.StructType.fromDDL("ident int, s struct<n:string,k:bigint,t:boolean>, extra string"))
    a.write.parquet(str(tmp_path / "a"))
    b.write.parquet(str(tmp_path / "b"))
    rows = read_drifting(spark, [str(tmp_path / "a"), str(tmp_path / "b")]).orderBy("ident").collect()
    assert [(r.ident, r.s.n, r.s.k, r.s.t, r.extra) for r in rows] == [(1, "u", 5, None, None), (2, "v", 6, True, "z")]
    assert schema_tree(a.schema).size() == 5


def table_of(spark, rows):
    df = spark.createDataFrame([(n, f, "r", s, q, p, c, t, u, T0, 1, "x", "y") for n, (f, s, q, p, c, t, u) in enumerate(rows)], SCHEMA)
    cols = {r.column_name: (r.unified_type, r.n_files, r.names) for r in drift.consistent_columns(df).collect()}
    return cols, {r.file_id: r.projection for r in drift.file_projections(df).collect()}


def test_a_name_that_returns_beside_its_successor(spark):
    i, t = ["integer"], ["string"]
    rows = [(1, "s", 1, 1, "a", i, True), (2, "s", 2, 1, "b", i, True), (3, "s", 3, 1, "b", i, True), (3, "s", 3, 2, "a", t, True)]
    cols, got = table_of(spark, rows)
    assert cols == {"b": ("integer", 3, "a|b"), "a": ("string", 1, "a")}
    assert got[1] == "try_cast(`a` as bigint) as `b`" and got[3] == "try_cast(`a` as string) as `a`, try_cast(`b` as bigint) as `b`"


def test_stretches_of_one_last_name(spark):
    i, t = ["integer"], ["string"]
    # away for a file: one column; renamed to a name that another column bore at the same time: two
    rows = [(1, "s", 1, 1, "n", i, True), (3, "s", 3, 1, "n", i, True), (2, "s", 2, 5, "k", t, True)]
    assert table_of(spark, rows)[0] == {"n": ("integer", 2, "n"), "k": ("string", 1, "k")}
    rows = [(1, "s", 1, 1, "n", i, True), (1, "s", 1, 2, "b", t, True), (2, "s", 2, 2, "b", t, True), (3, "s", 3, 2, "n", t, True)]
    cols, got = table_of(spark, rows)
    assert cols == {"n": ("string", 3, "b|n"), "n#1": ("integer", 1, "n")}
    assert got[1] == "try_cast(`b` as string) as `n`, try_cast(`n` as bigint) as `n#1`"


def test_members_of_arrays_maps_and_null_structs_by_name(spark, tmp_path):
    a = spark.createDataFrame(
        [([(1, 2)], {"k": (3, 4)}, None, (5, "u"), 7), (None, None, None, None, 8)],
        "xs array<struct<x:int,y:int>>, m map<string,struct<p:int,q:int>>, gone struct<z:int>, `s.t` struct<`a.b`:int,`o'c`:string>, a int",
    )
    b = spark.createDataFrame(
        [([(9, 8, 7)], {"k": (6, 5)}, (4, "w"), 3, 2)], "xs array<struct<y:bigint,x:bigint,z:int>>, m map<string,struct<q:int,p:int>>, `s.t` struct<`a.b`:bigint,`o'c`:string>, b int, a int"
    )
    a.write.parquet(str(tmp_path / "a"))
    b.write.parquet(str(tmp_path / "b"))
    rows = read_drifting(spark, [str(tmp_path / "a"), str(tmp_path / "b")]).orderBy("a").collect()
    assert rows[0].xs is not None and [r.a for r in rows] == [2, 7, 8]
    seven, eight = rows[1], rows[2]
    assert (seven.xs[0].x, seven.xs[0].y, seven.xs[0].z) == (1, 2, None)
    assert (seven.m["k"].p, seven.m["k"].q) == (3, 4) and seven["s.t"]["a.b"] == 5 and seven["s.t"]["o'c"] == "u"
    assert eight.xs is None and eight.m is None and eight["s.t"] is None and eight.gone is None


def test_swapped_names_are_no_rename():
    old = Node("", None, None, [Node("a", "int", 1), Node("b", "int", 2)])
    new = Node("", None, None, [Node("b", "int", 1), Node("a", "int", 2)])
    assert {(e.op, e.old_path, e.new_path) for e in edit_script(old, new)} == {("keep", "a", "a"), ("keep", "b", "b")}


def test_a_moved_subtree_is_one_move():
    part = lambda at: Node("s", "struct", at, [Node("x", "int", 1), Node("y", "int", 2)])
    old = Node("", None, None, [Node("o", "struct", 1, [part(1)])])
    new = Node("", None, None, [Node("o", "struct", 1, []), part(2)])
    assert [(e.op, e.old_path, e.new_path) for e in edit_script(old, new)] == [("keep", "o", "o"), ("move", "o.s", "s")]


def test_four_thousand_renames_are_fast():
    import time

    make = lambda prefix: Node("", None, None, [Node(f"{prefix}{i}", "int", i) for i in range(4000)])
    began = time.time()
    steps = edit_script(make("a"), make("b"))
    assert {e.op for e in steps} == {"rename"} and len(steps) == 4000 and time.time() - began < 1


def test_level_scripts_equal_edit_scripts():
    import numpy as np

    from quarrystone.operators.tree_edit import Level, level_scripts

    rng = random.Random(9)
    sides, want = ([], []), []
    for pair in range(80):
        trees = []
        for side, pool in enumerate(("abcde", "cdefg")):
            nodes = [Node(n, rng.choice(["0", "1", None]), p) for p, n in enumerate(rng.sample(pool, rng.randrange(0, 6)))]
            sides[side].extend((pair, ord(x.name), x.position, -1 if x.kind is None else int(x.kind)) for x in nodes)
            trees.append(Node("", children=nodes))
        want += [(pair, e.op, e.old_path, e.new_path) for e in edit_script(*trees) if e.op != "move"]
        want += [(pair, op, *x) for e in edit_script(*trees) if e.op == "move" for op, x in (("delete", (e.old_path, "")), ("add", ("", e.new_path)))]
    old, new = (Level(*[np.array(c) for c in zip(*s)]) for s in sides)
    got = []
    for op, (a, b) in level_scripts(old, new).items():
        for k in range(max(len(a), len(b))):
            got.append((int(old.pair[a[k]] if len(a) else new.pair[b[k]]), op, chr(old.name[a[k]]) if len(a) else "", chr(new.name[b[k]]) if len(b) else ""))
    assert sorted(got) == sorted(want)
