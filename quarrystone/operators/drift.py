"""Schemas that drift between the files of a series: changes, one table, projections.

The facts are sorted once, by a range shuffle on (series, file): a range holds whole files in
order, and a series with most of the rows spreads over many ranges. Within a range everything is
worked out on Arrow columns: what is last known of each column (``known`` in its unbroken stretch
of files), the tree edit script between each file and the one before it (``level_scripts``), and
what renames carry on. What hangs on the range before - the first file's neighbour, and facts
not said again since - is put down as a *piece*: the columns of the range's first and last file and
the comparisons left open. The pieces of one series, as many as it has ranges, are put together
at the end.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrystone.operators.tree_edit import Level, level_scripts
from quarrystone.plans.scans import running_max
from quarrystone.session import cut

BLOCK = 512
COMBINED = 1 << 18  # rows that a map task holds to drop repeated inspections before they are shuffled
# fixed values: white space, all space separators and the byte-order mark
BLANKS = " \t\n\x0b\f\r\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"

_FACTS = pa.schema([("series", pa.string()), ("seq", pa.int64()), ("file", pa.int64()), ("name", pa.string()), ("raw", pa.string()), ("pos", pa.int64()), ("types", pa.string()), ("nullable", pa.bool_()), ("seen", pa.int64()), ("fact", pa.int64())])
_FACTS_SQL = "series string, seq bigint, file bigint, name string, raw string, pos bigint, types string, nullable boolean, seen bigint, fact bigint"


def plain_name(name: str) -> str:
    """Lower case without surrounding white space and byte-order marks."""
    return name.strip(BLANKS).lower()


def _mapped(values: pa.Array, of) -> pa.Array:  # noqa: ANN001
    """``of`` applied to every distinct value; nulls stay."""
    values = values.combine_chunks() if isinstance(values, pa.ChunkedArray) else values
    d = values.dictionary_encode()
    return pa.array([of(v) for v in d.dictionary.to_pylist()], pa.string()).take(d.indices)


def known_types(lists: pa.Array) -> pa.Array:
    """The known set of types of each list as sorted text; null when it says nothing."""
    n = len(lists)
    parent = np.asarray(pc.list_parent_indices(lists), np.int64)
    value = _mapped(lists.flatten().cast(pa.string()), lambda v: v.strip(" ").lower())
    keep = np.asarray(pc.fill_null(pc.and_(pc.not_equal(value, ""), pc.not_equal(value, "unknown")), False))
    code, labels = _codes(value.filter(pa.array(keep)))
    pairs = np.unique(np.c_[parent[keep], code], axis=0) if keep.any() else np.zeros((0, 2), np.int64)
    out = np.full(n, None, object)
    starts = np.flatnonzero(np.r_[True, pairs[1:, 0] != pairs[:-1, 0]]) if len(pairs) else np.zeros(0, np.int64)
    made: dict[bytes, str] = {}
    if len(labels) < 63 and len(pairs):  # sets as bits
        sets, back = np.unique(np.bitwise_or.reduceat(np.int64(1) << pairs[:, 1], starts), return_inverse=True)
        text = np.array(["|".join(x for k, x in enumerate(labels) if m >> k & 1) for m in sets.tolist()], object)
        out[pairs[starts, 0]] = text[back]
        return pa.array(out, pa.string())
    for a, b in zip(starts, np.r_[starts[1:], len(pairs)]):
        key = pairs[a:b, 1].tobytes()
        if key not in made:
            made[key] = "|".join(labels[c] for c in pairs[a:b, 1])
        out[pairs[a, 0]] = made[key]
    return pa.array(out, pa.string())


def _codes(values: pa.Array) -> tuple[np.ndarray, list[str]]:
    """Numbers of texts in their order, -1 for null, and the texts by number."""
    values = values.combine_chunks() if isinstance(values, pa.ChunkedArray) else values
    d = values.dictionary_encode()
    labels = d.dictionary.to_pylist()
    order = sorted(range(len(labels)), key=labels.__getitem__)
    rank = np.empty(len(labels) + 1, np.int64)
    rank[order], rank[-1] = np.arange(len(labels)), -1
    return rank[np.asarray(d.indices.fill_null(len(labels)), np.int64)], [labels[i] for i in order]


def _ints(column: pa.Array, none: int = np.iinfo(np.int64).min) -> np.ndarray:
    """Whole numbers with ``none`` for null."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.cast(pa.int64()).fill_null(none), np.int64)


def _latest(t: pa.Table) -> tuple[pa.Table, dict[str, np.ndarray], dict[str, list[str]]]:
    """One row per file and column name, the latest inspection, sorted by series, file and name; with codes of the texts."""
    texts = {c: _codes(t.column(c)) for c in ("series", "name", "types", "raw")}
    num = {c: _ints(t.column(c)) for c in ("seq", "file", "pos", "nullable", "seen", "fact")}
    num |= {c: x[0] for c, x in texts.items()}
    key = ("series", "seq", "file", "name")
    by = np.lexsort([num[c] for c in ("raw", "pos", "nullable", "types", "fact", "seen", *key[::-1])])
    last = np.ones(len(by), bool)
    if len(by):
        last[:-1] = np.any([num[c][by][1:] != num[c][by][:-1] for c in key], axis=0)
    by = by[last]
    return t.take(pa.array(by)), {c: x[by] for c, x in num.items()}, {c: x[1] for c, x in texts.items()}


def _prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Plain names and known types; repeated inspections are dropped within what a task holds."""

    def sent(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if held:
            yield from _latest(pa.Table.from_batches(held, _FACTS))[0].to_batches()

    held, rows = [], 0
    for b in batches:
        types = known_types(b.column(5))
        cols = [b.column(0), b.column(1), b.column(2), _mapped(b.column(3), plain_name), b.column(3), b.column(4), types, pc.if_else(types.is_valid(), b.column(6), pa.scalar(None, pa.bool_())), b.column(7), b.column(8)]
        batch = pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cols, _FACTS)], schema=_FACTS)
        held.append(batch.filter(pc.fill_null(pc.not_equal(batch.column(3), ""), False)))
        rows += len(b)
        if rows >= COMBINED:
            yield from sent(held)
            held, rows = [], 0
    yield from sent(held)


def sorted_facts(facts: DataFrame) -> DataFrame:
    """Facts in ranges of whole files by (series, file_seq, file_id).

    Rows without a series, file or usable name say nothing and are left out.
    """
    f = facts.where("series is not null and file_seq is not null and file_id is not null and name is not null")
    f = f.select("series", "file_seq", "file_id", "name", "col_pos", "observed_types", "nullable", F.unix_micros(F.col("inspected_at").cast("timestamp")), "fact_id")
    ranges = int(facts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return f.mapInArrow(_prepare, _FACTS_SQL).repartitionByRange(ranges, "series", "seq", "file")


_OUT = "kind string, series string, part int, file_id bigint, op string, old_name string, new_name string, chain bigint, first_at bigint, last_at bigint, first_file bigint, last_file bigint, n bigint, types array<string>, nullable boolean, names array<string>, payload string"
_OUT_SCHEMA = pa.schema(
    [("kind", pa.string()), ("series", pa.string()), ("part", pa.int32()), ("file_id", pa.int64()), ("op", pa.string()), ("old_name", pa.string()), ("new_name", pa.string())]
    + [(c, pa.int64()) for c in ("chain", "first_at", "last_at", "first_file", "last_file", "n")]
    + [("types", pa.list_(pa.string())), ("nullable", pa.bool_()), ("names", pa.list_(pa.string())), ("payload", pa.string())]
)
_KINDS = {"keep": "", "delete": "removed", "add": "added", "rename": "renamed", "retype": "type_changed"}


def _rows(rows: int, /, **columns: Any) -> pa.RecordBatch:
    """A batch of the output with the given columns, all others null."""
    cols = []
    for f in _OUT_SCHEMA:
        v = columns.get(f.name)
        cols.append(pa.nulls(rows, f.type) if v is None else pa.array([v] * rows, f.type) if isinstance(v, (str, int)) else pa.array(v, f.type, from_pandas=False))
    return pa.RecordBatch.from_arrays(cols, schema=_OUT_SCHEMA)


@dataclass
class _Range:
    """The columns of a range of files, by column and file; all arrays are indexed by row unless named otherwise.

    Known values are codes, -1 for unknown. A *stretch* is an unbroken run of files with one name.
    """

    series: np.ndarray
    seq: np.ndarray
    name: np.ndarray
    at: np.ndarray  # number of the file in the range
    pos: np.ndarray
    types: np.ndarray
    nullable: np.ndarray
    stretch: np.ndarray
    begins: np.ndarray  # first row of each stretch
    ends: np.ndarray  # last row of each stretch
    last_types: np.ndarray  # last known, this file included
    last_nullable: np.ndarray
    file_series: np.ndarray  # by file
    file_id: np.ndarray  # by file


def _ranged(num: dict[str, np.ndarray]) -> _Range:
    s, q, f, n = (num[c] for c in ("series", "seq", "file", "name"))
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (q[1:] != q[:-1]) | (f[1:] != f[:-1])
    at = np.cumsum(new) - 1
    by = np.lexsort((at, n, s))
    x = {c: v[by] for c, v in num.items()} | {"at": at[by]}
    first = np.ones(len(by), bool)
    first[1:] = (x["series"][1:] != x["series"][:-1]) | (x["name"][1:] != x["name"][:-1]) | (x["at"][1:] != x["at"][:-1] + 1)
    stretch = np.cumsum(first) - 1
    begins = np.flatnonzero(first)
    ends = np.r_[begins[1:], len(by)] - 1
    i = np.arange(len(by))

    def last(v: np.ndarray) -> np.ndarray:
        k = np.maximum.accumulate(np.where(v >= 0, i, -1))
        return np.where(k >= begins[stretch], v[k], -1)

    types, nullable = x["types"], np.where(x["nullable"] < 0, -1, x["nullable"])
    return _Range(x["series"], x["seq"], x["name"], x["at"], x["pos"], types, nullable, stretch, begins, ends, last(types), last(nullable), s[new], f[new])


def _part() -> int:
    from pyspark import TaskContext

    return TaskContext.get().partitionId()


def _drift(batches: Iterator[pa.RecordBatch], lines: bool, members: bool) -> Iterator[pa.RecordBatch]:
    """Changes within a range, or its lines of columns, and the pieces of its first and last series."""
    held = [b for b in batches if len(b)]
    if not held:
        return
    t, num, label = _latest(pa.Table.from_batches(held, _FACTS))
    r, part = _ranged(num), _part()
    names, series, types = label["name"], label["series"], label["types"]
    last_file = len(r.file_id) - 1
    open_ = r.at[r.begins] == 0  # stretches that may have begun in the range before
    opens = open_[r.stretch]

    follows = np.r_[False, r.file_series[1:] == r.file_series[:-1]]  # by file: another of its series stands before it
    more = np.r_[follows[1:], False]
    old, new = np.flatnonzero(more[r.at]), np.flatnonzero(follows[r.at])
    left = Level(r.at[old] + 1, r.name[old], r.pos[old], r.last_types[old])
    right = Level(r.at[new], r.name[new], r.pos[new], r.types[new])
    # a name that is gone, of which the range before may know the types: its place is left open
    unsure = _unsure(r, left, right, old, new, opens)
    script = level_scripts(left, right, unsure)
    script = {op: (old[a], new[b]) for op, (a, b) in script.items()}
    groups, in_group = _groups(r, script, unsure, old)

    before = np.full(len(r.begins), -1)  # stretch that a stretch goes on with by a rename
    a, b = script["rename"]
    before[r.stretch[b]] = r.stretch[a]
    chain = _roots(before)
    start, compare = _inherited(r, before, open_, in_group, names)

    # types that the range before may know better: the first that are said in an open stretch
    said = np.flatnonzero(opens & (r.types >= 0) & (r.at > 0))
    prior = np.where(r.at[said] > 0, r.last_types[said - 1], -1)
    for i in said[prior < 0]:
        compare.append(["t", names[r.name[i]], int(r.file_id[r.at[i]]), names[r.name[i]], names[r.name[i]], types[r.types[i]]])

    if not lines:
        for op, (a, b) in script.items():
            if op == "keep":
                continue
            grouped = np.isin(a, in_group["gone"]) if op == "delete" else np.isin(b, in_group["came"]) if op == "add" else np.zeros(len(a), bool)
            yield _edits(series, r, names, part, _KINDS[op], a[~grouped] if len(a) else None, b[~grouped] if len(b) else None)
        yield from _nullable_changes(series, r, names, part, script, start)
    else:
        yield _chains(r, chain, series, names, types, part)
        if members:
            pick = np.lexsort((r.name, r.at))  # the order of the table
            yield _rows(len(pick), kind="row", part=part, series=t.column("series").to_pylist(), file_id=r.file_id[r.at[pick]], chain=chain[r.stretch[pick]], first_at=r.seq[pick], old_name=t.column("raw").to_pylist())
    yield from _pieces(r, part, series, names, types, groups, compare, start, open_, chain, last_file)


def _unsure(r: _Range, left: Level, right: Level, old: np.ndarray, new: np.ndarray, opens: np.ndarray) -> np.ndarray:
    """Old rows whose rename is decided later: at a place where an open stretch of unknown types ends and a name comes."""
    ending = np.zeros(len(r.at), bool)
    ending[r.ends] = True
    coming = np.zeros(len(r.at), bool)
    coming[r.begins] = True
    gone = ending[old]
    cause = gone & opens[old] & (r.last_types[old] < 0) & (left.place >= 0)
    if not cause.any():
        return cause
    came = {(int(p), int(x)) for p, x in zip(right.pair[coming[new]], right.place[coming[new]])}
    places = {k for k in zip(left.pair[cause].tolist(), left.place[cause].tolist()) if k in came}
    return gone & np.array([k in places for k in zip(left.pair.tolist(), left.place.tolist())], bool)


def _groups(r: _Range, script: dict, unsure: np.ndarray, old: np.ndarray) -> tuple[list[tuple[np.ndarray, np.ndarray]], dict]:
    """The places left open, in file order, as rows that are gone and rows that came."""
    rows = old[unsure]
    places: dict[tuple[int, int], tuple[list[int], list[int]]] = {}
    for i in rows:
        places.setdefault((int(r.at[i]) + 1, int(r.pos[i])), ([], []))[0].append(int(i))
    for i in script["add"][1]:
        if (key := (int(r.at[i]), int(r.pos[i]))) in places:
            places[key][1].append(int(i))
    groups = [places[k] for k in sorted(places)]
    number = {i: g for g, (_, came) in enumerate(groups) for i in came}
    return groups, {"gone": np.array([i for g in groups for i in g[0]], np.int64), "came": np.array([i for g in groups for i in g[1]], np.int64), "number": number}


def _roots(before: np.ndarray) -> np.ndarray:
    """First stretch of the chain of renames of each stretch, by pointer doubling."""
    up = np.where(before >= 0, before, np.arange(len(before)))
    while (up[up] != up).any():
        up = up[up]
    return up


def _inherited(r: _Range, before: np.ndarray, open_: np.ndarray, in_group: dict, names: list[str]) -> tuple[dict[int, Any], list[list]]:
    """What is known of nullability where a stretch begins, and the comparisons that hang on the range before.

    A value is 0 or 1, ``["h", name]`` for what holds behind the range's first file, or
    ``["d", group, name]`` for what the name takes over if its group is decided for a rename.
    """
    start: dict[int, Any] = {int(s): ["h", names[r.name[r.begins[s]]]] for s in np.flatnonzero(open_)}
    start |= {int(r.stretch[i]): ["d", g, names[r.name[i]]] for i, g in in_group["number"].items()}
    for s in sorted(np.flatnonzero(before >= 0), key=lambda s: r.at[r.begins[s]]):
        end = r.last_nullable[r.ends[before[s]]]
        value = int(end) if end >= 0 else start.get(int(before[s]))
        if value is not None:
            start[int(s)] = value
    compare = []
    for s, value in start.items():
        if isinstance(value, list):
            told = np.flatnonzero(r.nullable[r.begins[s] : r.ends[s] + 1] >= 0)
            if len(told):
                i = r.begins[s] + told[0]
                if told[0] == 0 and before[s] < 0:  # told by the first file, or where a group is decided
                    continue
                was = names[r.name[r.ends[before[s]]]] if told[0] == 0 else names[r.name[i]]
                compare.append(["u", value, int(r.file_id[r.at[i]]), was, names[r.name[i]], int(r.nullable[i])])
    return start, compare


def _edits(series: list[str], r: _Range, names: list[str], part: int, kind: str, old: np.ndarray | None, new: np.ndarray | None) -> pa.RecordBatch:
    side = new if new is not None else old
    if side is None:
        return _rows(0)
    at = r.at[side] + (new is None)
    text = lambda rows: [names[c] for c in r.name[rows]] if rows is not None else [""] * len(side)
    return _rows(len(side), kind="change", part=part, series=[series[c] for c in r.file_series[at]], file_id=r.file_id[at], op=kind, old_name=text(old), new_name=text(new))


def _nullable_changes(series: list[str], r: _Range, names: list[str], part: int, script: dict, start: dict[int, Any]) -> Iterator[pa.RecordBatch]:
    """Kept and renamed columns whose nullability is known and differs from what was last known."""
    a, b = (np.r_[script["keep"][k], script["rename"][k]] for k in (0, 1))
    first = np.full(len(r.begins), -1)
    for s, v in start.items():
        first[s] = v if isinstance(v, int) else -1
    known = np.where(r.last_nullable[a] >= 0, r.last_nullable[a], first[r.stretch[a]])
    differs = (known >= 0) & (r.nullable[b] >= 0) & (known != r.nullable[b])
    yield _edits(series, r, names, part, "nullable_changed", a[differs], b[differs])


def _chains(r: _Range, chain: np.ndarray, series: list[str], names: list[str], types: list[str], part: int) -> pa.RecordBatch:
    """Each chain of stretches: its last name, its files, all types and names. Files are numbered from the series' first one in the range."""
    of = chain[r.stretch]
    by = np.lexsort((r.at, of))
    cuts = np.flatnonzero(np.r_[True, of[by][1:] != of[by][:-1]])
    offset = np.zeros(len(r.file_series), np.int64)
    starts = np.flatnonzero(np.r_[True, r.file_series[1:] != r.file_series[:-1]])
    offset = np.repeat(starts, np.diff(np.r_[starts, len(r.file_series)]))
    cols: dict[str, list] = {c: [] for c in ("series", "chain", "new_name", "first_at", "last_at", "first_file", "last_file", "n", "types", "nullable", "names")}
    for a, b in zip(cuts, np.r_[cuts[1:], len(by)]):
        rows = by[a:b]
        i, j = rows[0], rows[-1]
        seen = r.nullable[rows]
        values = (
            series[r.series[i]], int(of[i]), names[r.name[j]], int(r.at[i] - offset[r.at[i]]), int(r.at[j] - offset[r.at[j]]), int(r.file_id[r.at[i]]), int(r.file_id[r.at[j]]), len(rows),
            sorted({x for c in np.unique(r.types[rows]) if c >= 0 for x in types[c].split("|")}), None if (seen < 0).all() else bool((seen == 1).any()), [names[c] for c in np.unique(r.name[rows])],
        )
        for c, v in zip(cols, values):
            cols[c].append(v)
    return _rows(len(cuts), kind="chain", part=part, **cols)


def _pieces(r: _Range, part: int, series: list[str], names: list[str], types: list[str], groups: list, compare: list, start: dict, open_: np.ndarray, chain: np.ndarray, last_file: int) -> Iterator[pa.RecordBatch]:
    """The first and the last series of a range as JSON: columns of the first and the last file, and what was left open."""
    text = lambda c: types[c] if c >= 0 else None

    def end(i: int) -> list:
        """Name, place, types, nullability and chain of a column behind its row; ``"?"`` for types that the first file has or takes over."""
        s = int(r.stretch[i])
        kind = text(r.last_types[i]) or ("?" if open_[s] else None)
        told = int(r.last_nullable[i])
        return [names[r.name[i]], int(r.pos[i]), kind, told if told >= 0 else start.get(s), int(chain[s])]

    def begin(i: int) -> list:
        u = int(r.nullable[i])
        return [names[r.name[i]], int(r.pos[i]), text(r.types[i]), u if u >= 0 else None, int(chain[r.stretch[i]])]

    for own in {int(r.file_series[0]), int(r.file_series[-1])}:
        files = np.flatnonzero(r.file_series == own)
        piece: dict[str, Any] = {"files": len(files)}
        if own == r.file_series[0]:
            piece["head"] = [begin(i) for i in np.flatnonzero(r.at == 0)]
            piece["head_file"] = int(r.file_id[0])
            piece["groups"] = [[int(r.file_id[r.at[came[0]]]) if came else int(r.file_id[r.at[gone[0]] + 1]), [end(i) for i in gone], [begin(i) for i in came]] for gone, came in groups]
            piece["compare"] = compare
        if own == r.file_series[-1]:
            piece["tail"] = [end(i) for i in np.flatnonzero(r.at == last_file)]
        yield _rows(1, kind="piece", series=series[own], part=part, payload=json.dumps(piece))


def _join_pieces(key: tuple, table: pa.Table) -> pa.Table:
    """The pieces of one series in order: changes at and across the seams, and which chains go on."""
    t = table.sort_by("part")
    out: list[dict] = []
    state: dict[str, list] | None = None
    canon: dict[tuple[int, int], tuple[int, int]] = {}
    files = 0
    change = lambda file, kind, old, new: out.append({"kind": "change", "file_id": file, "op": kind, "old_name": old, "new_name": new})

    def compared(file: int, old: str, new: str, was: list, now: list) -> None:
        """Type and nullability of a kept or renamed column."""
        if was[0] is not None and now[0] is not None and was[0] != now[0]:
            change(file, "type_changed", old, new)
        if was[1] is not None and now[1] is not None and was[1] != now[1]:
            change(file, "nullable_changed", old, new)

    def taken_over(file: int, gone: list[list], came: list[list]) -> dict[str, list | None]:
        """Renames among columns ``[name, pos, types, nullable, chain]``: the old column of each new name, or None."""
        code = {x: i for i, x in enumerate(sorted({c[k] for c in gone + came for k in (0, 2) if c[k]}))}
        level = lambda side: Level(*[np.array(c, np.int64) for c in zip(*[(0, code[x[0]], x[1], code.get(x[2], -1)) for x in side])]) if side else Level(*[np.zeros(0, np.int64)] * 4)
        script = level_scripts(level(gone), level(came))
        pairs: dict[str, list | None] = {came[j][0]: gone[i] for op in ("keep", "rename") for i, j in zip(*script[op])}
        for i in script["delete"][0]:
            change(file, "removed", gone[i][0], "")
        for j in script["add"][1]:
            change(file, "added", "", came[j][0])
            pairs[came[j][0]] = None
        return pairs

    for part, payload in zip(t.column("part").to_pylist(), t.column("payload").to_pylist()):
        p = json.loads(payload)
        links = {}
        if "head" not in p:  # the series begins here
            p |= {"head": [], "groups": [], "compare": []}
            head = {}
        elif state is None:
            head = {c[0]: list(c[2:4]) for c in p["head"]}
        else:
            head = {}
            pairs = taken_over(p["head_file"], list(state.values()), p["head"])
            for c in p["head"]:
                was = pairs[c[0]]
                if was is not None:
                    if was[0] != c[0]:
                        change(p["head_file"], "renamed", was[0], c[0])
                    compared(p["head_file"], was[0], c[0], was[2:4], c[2:4])
                    links[c[4]] = was[4]
                head[c[0]] = [c[2] if c[2] is not None or was is None else was[2], c[3] if c[3] is not None or was is None else was[3]]
        decided: list[dict[str, Any]] = []

        def value(x: Any, head: dict = head, decided: list = decided) -> int | None:
            return head[x[1]][1] if isinstance(x, list) and x[0] == "h" else decided[x[1]].get(x[2]) if isinstance(x, list) else x

        where = lambda chain, part=part, links=links: links.get(chain) or canon.get((part, chain)) or (part, chain)
        for file, gone, came in p["groups"]:
            sides = [[n, pos, head[n][0] if kind == "?" else kind, value(u), c] for n, pos, kind, u, c in gone]
            pairs = taken_over(file, sides, came)
            decided.append({})
            for c in came:
                was = pairs[c[0]]
                if was is not None:
                    change(file, "renamed", was[0], c[0])
                    compared(file, was[0], c[0], [None, was[3]], [None, c[3]])
                    decided[-1][c[0]] = was[3]
                    links[c[4]] = where(was[4])
        for kind, x, file, old, new, now in p["compare"]:
            compared(file, old, new, *([[head[x][0], None], [now, None]] if kind == "t" else [[None, value(x)], [None, now]]))
        canon |= {(part, c): to for c, to in links.items()}
        out += [{"kind": "link", "part": part, "chain": c, "first_at": to[0], "last_at": to[1]} for c, to in links.items()]
        out.append({"kind": "offset", "part": part, "first_at": files})
        files += p["files"]
        if "tail" in p:
            state = {n: [n, pos, head[n][0] if kind == "?" else kind, value(u), where(c)] for n, pos, kind, u, c in p["tail"]}
    n = len(out)
    cols = {f.name: [x.get(f.name) for x in out] for f in _OUT_SCHEMA}
    cols["series"] = [key[0].as_py()] * n
    return pa.table([pa.array(cols[f.name], f.type) for f in _OUT_SCHEMA], schema=_OUT_SCHEMA)


def _worked(facts: DataFrame, lines: bool = False, members: bool = False) -> tuple[DataFrame, DataFrame]:
    """What the ranges give, and what comes of putting their pieces together."""
    worked = cut(sorted_facts(facts).mapInArrow(lambda b: _drift(b, lines, members), _OUT))
    return worked, worked.where("kind = 'piece'").groupBy("series").applyInArrow(_join_pieces, _OUT)


def schema_changes(facts: DataFrame) -> DataFrame:
    """Every change between neighbouring files of a series.

    Columns ``series, file_id, change_kind, old_name, new_name``: ``added``, ``removed``,
    ``renamed``, ``type_changed``, ``nullable_changed``. Order alone is no change; a first file
    has no changes; an empty table gives none. Of several inspections of a file the latest counts;
    columns without a position are not renamed.
    """
    ranges, seams = _worked(facts)
    return ranges.unionByName(seams).where("kind = 'change'").select("series", "file_id", F.col("op").alias("change_kind"), "old_name", "new_name")


_WIDEN = "CASE WHEN types IS NULL THEN 'unknown' WHEN types RLIKE 'string|[|]' AND NOT types RLIKE '^integer[|]number$' THEN 'string' WHEN types RLIKE 'number' THEN 'number' ELSE types END"


def _lineage(facts: DataFrame, members: bool = False) -> tuple[DataFrame, DataFrame]:
    """The columns of files with the line they belong to (if wanted), and the lines.

    Stretches of files that a rename joins form a chain, which bears its last name. Chains of one
    last name are one line, as a column that was away for a while is. Only where such a chain
    still runs when a later one has begun (under another name) it is a line of its own, told
    apart by the number of its last file, since both stand in the same files.
    """
    ranges, seams = _worked(facts, True, members)
    seams = cut(seams)
    links = seams.where("kind = 'link'").select("series", "part", "chain", F.col("first_at").alias("to_part"), F.col("last_at").alias("to_chain"))
    offsets = seams.where("kind = 'offset'").select("series", "part", F.col("first_at").alias("before"))
    here = ranges.where("kind = 'chain'").join(links, ["series", "part", "chain"], "left").join(offsets, ["series", "part"], "left")
    here = here.withColumn("whole", F.struct(F.coalesce("to_part", "part").cast("bigint").alias("p"), F.coalesce("to_chain", "chain").alias("c")))
    at = lambda c: F.col(c) + F.coalesce("before", F.lit(0)) + 1
    end = F.max(F.struct(at("last_at").alias("at"), F.col("last_file").alias("file"), F.col("new_name").alias("name")))
    chains = here.groupBy("series", "whole").agg(
        end.alias("e"), F.min(F.struct(at("first_at").alias("at"), F.col("first_file").alias("file"))).alias("b"), F.sum("n").alias("n"),
        F.flatten(F.collect_list("types")).alias("types"), F.bool_or("nullable").alias("nullable"), F.flatten(F.collect_list("names")).alias("names"),
    )
    chains = cut(chains.select("series", "whole", F.col("e.name").alias("last"), F.col("b.at").alias("begin"), F.col("e.at").alias("end"), F.col("b.file").alias("first_file"), F.col("e.file").alias("last_file"), "n", "types", "nullable", "names"))
    chains = running_max(chains, ["series", "last"], ["end"], {"later": (F.col("begin"), False)}, F.floor(F.col("end") / BLOCK), descending=True)
    sharp = F.aggregate("names", F.lit(0), lambda a, x: F.greatest(a, F.length(x) - F.length(F.replace(x, F.lit("#")))))
    marks = chains.groupBy("series").agg(F.max(sharp).alias("marks"))  # more of them than any name has
    apart = F.concat("last", F.repeat(F.lit("#"), F.col("marks") + 1), F.col("end").cast("string"))
    lines = cut(chains.join(marks, "series").withColumn("line", F.when(F.col("later") <= F.col("end"), apart).otherwise(F.col("last"))))
    per = lines.groupBy("series", F.col("line").alias("column_name")).agg(
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("types")))), "|").alias("types"),
        F.coalesce(F.bool_or("nullable"), F.lit(True)).alias("nullable"),
        F.min(F.struct("begin", "first_file")).getField("first_file").alias("first_file"),
        F.max(F.struct("end", "last_file")).getField("last_file").alias("last_file"),
        F.sum("n").alias("n_files"),
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("names")))), "|").alias("names"),
    )
    per = per.withColumn("types", F.nullif("types", F.lit(""))).withColumn("unified_type", F.expr(_WIDEN))
    rows = ranges.where("kind = 'row'").join(links, ["series", "part", "chain"], "left")
    rows = rows.select("series", F.struct(F.coalesce("to_part", "part").cast("bigint").alias("p"), F.coalesce("to_chain", "chain").alias("c")).alias("whole"), F.col("first_at").alias("file_seq"), "file_id", F.col("old_name").alias("raw"))
    return rows.join(lines.select("series", "whole", "line"), ["series", "whole"]), per


def consistent_columns(facts: DataFrame) -> DataFrame:
    """The one column table of each series: last name, widened type, nullability, files, all names.

    A name that comes back after it was renamed is a column of its own beside its successor.
    ``integer`` widens to ``number``, any other mixture to ``string``.
    """
    return _lineage(facts)[1].select("series", "column_name", "unified_type", "nullable", "first_file", "last_file", "n_files", "names")


def file_projections(facts: DataFrame) -> DataFrame:
    """For each file the projection that reads it as the consistent table of its series.

    A list of SQL expressions, over the names as stored in the file, in the order of the target
    names, each of which stands once. Columns that a file lacks are left to
    ``unionByName(allowMissingColumns=True)``.
    """
    lined, per = _lineage(facts, True)
    sql = F.element_at(F.create_map(*[F.lit(x) for x in ("integer", "bigint", "number", "double", "boolean", "boolean")]), F.col("unified_type"))
    expr = F.concat(F.lit("try_cast(`"), F.replace("raw", F.lit("`"), F.lit("``")), F.lit("` as "), F.coalesce(sql, F.lit("string")), F.lit(") as `"), F.replace("column_name", F.lit("`"), F.lit("``")), F.lit("`"))
    rows = lined.withColumnRenamed("line", "column_name").join(per.select("series", "column_name", "unified_type"), ["series", "column_name"]).select("series", "file_seq", "file_id", "column_name", expr.alias("e"))
    out = rows.groupBy("series", "file_seq", "file_id").agg(F.array_sort(F.collect_set(F.struct("column_name", "e"))).alias("es"))
    return out.select("series", "file_id", F.array_join(F.transform("es", lambda x: x["e"]), ", ").alias("projection"))
