"""Minimum-cost edit scripts between nested schemas.

The distance is the constrained edit distance between unordered labelled trees (Zhang 1996):
the children of two matched nodes are matched at minimum cost, everything else is deleted or
added with its subtree. Equal labels cost nothing to match, a rename costs one where it is allowed
(same place, same known kind), adding or deleting a node costs one. Where places are told apart a
rename has at most one partner and costs less than a deletion and an addition, so it is found by
lookup; only siblings that share place and kind and have members of their own are assigned to each
other by cost. A node that is deleted in one place and added with the same members in another is a
move, which takes the place of both steps; moves are looked for after the matching.

``level_scripts`` does the same for the flat trees of many pairs of schemas at once.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

import numpy as np
from pyspark.sql import types as T

Path = tuple[str, ...]


@dataclass
class Node:
    """A schema node: its name, what is known of its kind, where it stands, its members."""

    name: str
    kind: str | None = None
    position: int | None = None
    children: list[Node] = field(default_factory=list)
    extra: Any = None

    def size(self) -> int:
        return 1 + sum(c.size() for c in self.children)

    def shape(self) -> tuple:
        """Name, kind and members, in any order: equal for subtrees that a move may exchange."""
        return self.name, self.kind, tuple(sorted((c.shape() for c in self.children), key=repr))


def schema_tree(schema: T.StructType, name: str = "") -> Node:
    """A Spark schema as a tree; arrays and maps have their element types as members."""

    def of(label: str, kind: T.DataType, at: int) -> Node:
        if isinstance(kind, T.StructType):
            return Node(label, "struct", at, [of(f.name, f.dataType, i) for i, f in enumerate(kind.fields, 1)])
        if isinstance(kind, T.ArrayType):
            return Node(label, "array", at, [of("element", kind.elementType, 1)])
        if isinstance(kind, T.MapType):
            return Node(label, "map", at, [of("key", kind.keyType, 1), of("value", kind.valueType, 2)])
        return Node(label, kind.simpleString(), at)

    return of(name, schema, 1)


def _rank(keys: tuple[np.ndarray, ...], order: np.ndarray) -> np.ndarray:
    """Number of each row among the rows of equal keys, in the given order (for ties)."""
    by = np.lexsort((order, *keys[::-1]))
    new = np.ones(len(by), bool)
    new[1:] = np.any([k[by][1:] != k[by][:-1] for k in keys], axis=0)
    at = np.arange(len(by))
    out = np.empty(len(by), np.int64)
    out[by] = at - np.maximum.accumulate(np.where(new, at, 0))
    return out


def _meet(old: tuple[np.ndarray, ...], new: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the rows of two sides that have equal, on each side unique, integer keys."""
    n = len(old[0])
    both = [np.r_[a, b] for a, b in zip(old, new)]
    by = np.lexsort(both[::-1])
    same = np.all([k[by][1:] == k[by][:-1] for k in both], axis=0) if len(by) > 1 else np.zeros(0, bool)
    at = np.flatnonzero(same)
    a, b = by[at], by[at + 1]
    return np.minimum(a, b), np.maximum(a, b) - n


@dataclass
class Level:
    """Siblings of one level of many schema pairs: pair number, name, place (-1 unknown), kind (-1 unknown), all as numbers."""

    pair: np.ndarray
    name: np.ndarray
    place: np.ndarray
    kind: np.ndarray

    def take(self, rows: np.ndarray) -> Level:
        return Level(self.pair[rows], self.name[rows], self.place[rows], self.kind[rows])


def level_scripts(old: Level, new: Level, barred: np.ndarray | None = None) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Minimum-cost scripts between leaves: ``keep``, ``retype``, ``rename``, ``delete``, ``add`` with rows of both sides.

    A name stands once on each side of a pair. ``barred`` marks old rows that no new name may take
    over, since what is known of them is not settled here.
    """
    keep_o, keep_n = _meet((old.pair, old.name), (new.pair, new.name))
    gone, came = np.ones(len(old.pair), bool), np.ones(len(new.pair), bool)
    gone[keep_o], came[keep_n] = False, False
    a, b = np.flatnonzero(gone), np.flatnonzero(came)
    fit_a, fit_b = (old.place[a] >= 0) & (old.kind[a] >= 0), (new.place[b] >= 0) & (new.kind[b] >= 0)
    a, b = a[fit_a if barred is None else fit_a & ~barred[a]], b[fit_b]
    key = lambda x: (x.pair, x.place, x.kind)
    x, y = old.take(a), new.take(b)
    i, j = _meet((*key(x), _rank(key(x), x.name)), (*key(y), _rank(key(y), y.name)))
    ren_o, ren_n = a[i], b[j]
    gone[ren_o], came[ren_n] = False, False
    none = np.zeros(0, np.int64)
    k, m = old.kind[keep_o], new.kind[keep_n]
    retyped = (k >= 0) & (m >= 0) & (k != m)
    return {"keep": (keep_o, keep_n), "retype": (keep_o[retyped], keep_n[retyped]), "rename": (ren_o, ren_n), "delete": (np.flatnonzero(gone), none), "add": (none, np.flatnonzero(came))}


def same_place_and_kind(a: Node, b: Node) -> bool:
    """A rename keeps the position and the known kind."""
    return a.position == b.position and a.kind is not None and a.kind == b.kind


def _assign(cost: np.ndarray) -> list[int]:
    """Column of each row in a minimum-cost assignment of a square matrix (Hungarian method, vectorised by rows)."""
    n = len(cost)
    u, v, match = np.zeros(n + 1), np.zeros(n + 1), np.zeros(n + 1, np.int64)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        least, way, used = np.full(n + 1, np.inf), np.zeros(n + 1, np.int64), np.zeros(n + 1, bool)
        while match[j0]:
            used[j0] = True
            i0 = match[j0]
            c = cost[i0 - 1] - u[i0] - v[1:]
            better = ~used[1:] & (c < least[1:])
            least[1:][better], way[1:][better] = c[better], j0
            j1 = int(np.argmin(np.where(used, np.inf, least)))
            delta = least[j1]
            u[match[used]] += delta
            v[used] -= delta
            least[~used] -= delta
            j0 = j1
        while j0:
            match[j0], j0 = match[way[j0]], int(way[j0])
    out = [0] * n
    for j in range(1, n + 1):
        out[match[j] - 1] = j - 1
    return out


def _costs(old: list[Node], new: list[Node], may_rename: Callable[[Node, Node], bool]) -> tuple[float, list[tuple[Node | None, Node | None]]]:
    """Cost and pairs of a best matching of two lists of siblings."""
    byname: dict[str, list[Node]] = {}
    for b in new:
        byname.setdefault(b.name, []).append(b)
    pairs: list[tuple[Node | None, Node | None]] = []
    cost, rest_old, taken = 0.0, [], set()
    for a in old:  # equal names match at no cost of their own, which nothing undercuts
        if same := byname.get(a.name):
            b = same.pop(0)
            taken.add(id(b))
            pairs.append((a, b))
            cost += _costs(a.children, b.children, may_rename)[0]
        else:
            rest_old.append(a)
    rest_new = [b for b in new if id(b) not in taken]
    more, found = _renames(rest_old, rest_new, may_rename)
    cost, pairs = cost + more, pairs + found
    taken = {id(x) for pair in found for x in pair}
    alone = [(a, None) for a in rest_old if id(a) not in taken] + [(None, b) for b in rest_new if id(b) not in taken]
    return cost + sum((a or b).size() for a, b in alone), pairs + alone


def _renames(old: list[Node], new: list[Node], may_rename: Callable[[Node, Node], bool]) -> tuple[float, list[tuple[Node, Node]]]:
    """Cost and pairs of the renames among siblings of different names.

    By place and kind each group is on its own; with another rule for renames all are one group.
    """
    groups: dict[Any, tuple[list[Node], list[Node]]] = {}
    key = (lambda x: (x.position, x.kind)) if may_rename is same_place_and_kind else (lambda _: None)
    for side, nodes in enumerate((old, new)):
        for x in nodes:
            groups.setdefault(key(x), ([], []))[side].append(x)
    cost, out = 0.0, []
    for xs, ys in groups.values():
        n, m = len(xs), len(ys)
        if may_rename is same_place_and_kind and (n == 1 or m == 1 or not any(x.children for x in xs + ys)):
            if n and m and may_rename(xs[0], ys[0]):  # leaves all cost the same, one partner leaves no choice of number
                best = min(((x, y) for x in xs for y in ys), key=lambda p: _costs(p[0].children, p[1].children, may_rename)[0] - p[0].size() - p[1].size()) if min(n, m) == 1 else None
                chosen = [best] if best else list(zip(xs, ys))
                out += chosen
                cost += sum(1 + _costs(x.children, y.children, may_rename)[0] for x, y in chosen)
        elif n and m:
            grid = np.full((n + m, n + m), 0.0)
            grid[:n, m:], grid[n:, :m] = BARRED, BARRED
            for i, x in enumerate(xs):
                grid[i, m + i] = x.size()
                for j, y in enumerate(ys):
                    grid[i, j] = 1 + _costs(x.children, y.children, may_rename)[0] if may_rename(x, y) else BARRED
            for j, y in enumerate(ys):
                grid[n + j, j] = y.size()
            to = _assign(grid)
            chosen = [(i, to[i]) for i in range(n) if to[i] < m]
            out += [(xs[i], ys[j]) for i, j in chosen]
            cost += sum(grid[i, j] for i, j in chosen)
    return cost, out


BARRED = 1e9


@dataclass(frozen=True)
class Edit:
    """One step of a script: ``keep``, ``rename``, ``delete``, ``add``, ``move`` or ``retype``; paths of the old and the new place."""

    op: str
    old_parts: Path
    new_parts: Path
    old: Node | None = field(default=None, compare=False)
    new: Node | None = field(default=None, compare=False)

    @property
    def old_path(self) -> str:
        return ".".join(self.old_parts)

    @property
    def new_path(self) -> str:
        return ".".join(self.new_parts)


def edit_script(old: Node, new: Node, may_rename: Callable[[Node, Node], bool] = same_place_and_kind) -> list[Edit]:
    """A minimum-cost script from ``old`` to ``new``; the roots are matched. Empty trees are fine."""
    steps: list[Edit] = []

    def whole(op: str, node: Node, path: Path) -> None:
        here = (*path, node.name)
        steps.append(Edit(op, here if op == "delete" else (), here if op == "add" else (), node if op == "delete" else None, node if op == "add" else None))
        for c in node.children:
            whole(op, c, here)

    def walk(a: Node, b: Node, pa: Path, pb: Path) -> None:
        for x, y in _costs(a.children, b.children, may_rename)[1]:
            if y is None:
                whole("delete", x, pa)
            elif x is None:
                whole("add", y, pb)
            else:
                here = ((*pa, x.name), (*pb, y.name))
                steps.append(Edit("keep" if x.name == y.name else "rename", *here, x, y))
                if x.kind is not None and y.kind is not None and x.kind != y.kind:
                    steps.append(Edit("retype", *here, x, y))
                walk(x, y, *here)

    walk(old, new, (), ())
    return _with_moves(steps)


def _with_moves(steps: list[Edit]) -> list[Edit]:
    """Deletions and additions of equal subtrees as moves, the largest subtrees first."""
    gone: dict[tuple, list[Edit]] = {}
    for s in sorted((s for s in steps if s.op == "delete"), key=lambda s: len(s.old_parts)):
        gone.setdefault(s.old.shape(), []).append(s)
    dropped: set[int] = set()
    moved: dict[int, Edit] = {}
    paths = {s.old_parts: s for s in steps if s.op == "delete"}, {s.new_parts: s for s in steps if s.op == "add"}

    def drop(node: Node, path: Path, side: int) -> None:
        dropped.add(id(paths[side][path]))
        for c in node.children:
            drop(c, (*path, c.name), side)

    for s in sorted((s for s in steps if s.op == "add"), key=lambda s: -s.new.size()):
        if id(s) in dropped:
            continue
        same = [d for d in gone.get(s.new.shape(), []) if id(d) not in dropped]
        if same:
            d = same[0]
            drop(d.old, d.old_parts, 0)
            drop(s.new, s.new_parts, 1)
            moved[id(s)] = Edit("move", d.old_parts, s.new_parts, d.old, s.new)
    return [moved.get(id(s), s) for s in steps if id(s) in moved or id(s) not in dropped]


def _name(part: str) -> str:
    return "`" + part.replace("`", "``") + "`"


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def compile_projection(script: list[Edit], old: T.StructType, new: T.StructType) -> list[str]:
    """SQL expressions that read a file of schema ``old`` as the top-level columns of ``new``.

    Kept, renamed and moved members are cast to the new type, added ones are null, deleted ones
    are left out. Members of structs are found by name at every depth, also inside arrays and maps;
    a struct, array or map that is null stays null.
    """
    source = {s.new_parts: s.old_parts for s in script if s.op in ("keep", "rename", "move")}
    places: dict[Path, T.DataType] = {}

    def note(kind: T.DataType, path: Path) -> None:
        places[path] = kind
        for name, k in _members(kind):
            note(k, (*path, name))

    note(old, ())
    counter = iter(range(1 << 30))

    def from_root(path: Path) -> str | None:
        """A member of the row, if no array or map stands above it."""
        if any(not isinstance(places[path[:i]], T.StructType) for i in range(len(path))):
            return None
        return ".".join(map(_name, path))

    def build(kind: T.DataType, path: Path, held: tuple[Path, str] | None) -> str:
        """The value at ``path`` of the new schema; ``held`` is the old place, and its expression, of the value it is read from."""
        was = source.get(path)
        expr = None
        if was is not None:
            if held is not None and was[: len(held[0])] == held[0] and not any(not isinstance(places[was[:i]], T.StructType) for i in range(len(held[0]), len(was))):
                expr = ".".join([held[1], *map(_name, was[len(held[0]) :])])  # null where the struct is
            else:
                expr = from_root(was)
        if expr is None:
            return f"cast(null as {_ddl(kind)})"
        have = places[was]
        inner = (was, expr)
        if isinstance(kind, T.StructType) and isinstance(have, T.StructType):
            fields = ", ".join(f"{_text(f.name)}, {build(f.dataType, (*path, f.name), inner)}" for f in kind.fields)
            return f"if(isnull({expr}), cast(null as {_ddl(kind)}), named_struct({fields}))"
        def part(label: str) -> tuple[str, str]:
            """A lambda over what stands at ``label`` below: its variable and its body."""
            var, there = f"_v{next(counter)}_", (*path, label)
            below = dict(_members(kind))[label]
            own = source.get(there) == (*was, label)
            return var, build(below, there, ((*was, label), var)) if own else f"cast(null as {_ddl(below)})"

        if isinstance(kind, T.ArrayType) and isinstance(have, T.ArrayType):
            return "transform({0}, {1} -> {2})".format(expr, *part("element"))
        if isinstance(kind, T.MapType) and isinstance(have, T.MapType) and source.get((*path, "key")) == (*was, "key"):
            (k, key), (v, value) = part("key"), part("value")
            return f"map_from_arrays(transform(map_keys({expr}), {k} -> {key}), transform(map_values({expr}), {v} -> {value}))"
        if _members(kind) or _members(have):  # a struct cannot be read as a number, nor the other way
            return f"cast(null as {_ddl(kind)})"
        return f"try_cast({expr} as {_ddl(kind)})"

    return [f"{build(f.dataType, (f.name,), None)} as {_name(f.name)}" for f in new.fields]


def _members(kind: T.DataType) -> list[tuple[str, T.DataType]]:
    if isinstance(kind, T.StructType):
        return [(f.name, f.dataType) for f in kind.fields]
    if isinstance(kind, T.ArrayType):
        return [("element", kind.elementType)]
    return [("key", kind.keyType), ("value", kind.valueType)] if isinstance(kind, T.MapType) else []


def _ddl(kind: T.DataType) -> str:
    """A type as SQL, with every member name quoted."""
    if isinstance(kind, T.StructType):
        return "struct<" + ", ".join(f"{_name(f.name)}: {_ddl(f.dataType)}" for f in kind.fields) + ">"
    if isinstance(kind, T.ArrayType):
        return f"array<{_ddl(kind.elementType)}>"
    return f"map<{_ddl(kind.keyType)}, {_ddl(kind.valueType)}>" if isinstance(kind, T.MapType) else kind.simpleString()
