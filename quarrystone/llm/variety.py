"""A varied subset of given size per resource (concave feature coverage).

The value of a subset is the sum over features of the square root of the selected mass, so a
further record of a well-covered kind adds little. Features are the stratum, cells of random
projections of the embedding, and the signed squares of its parts.

Records are added in rounds with one descending threshold per resource. The state of a resource,
its feature masses, goes to all of its shards; a shard proposes the records whose marginal gains
still reach the threshold after its own earlier proposals; the proposals of all shards are added one
by one as far as they reach it in the state they meet. Then the threshold falls. A shard holds
``SHARD`` rows, and a round takes at most ``PROPOSALS`` proposals, in turns where there are more
shards. A resource that asks for more than ``CELL`` records is spread evenly over cells that choose
their parts on their own; the value being homogeneous, such a random part stands for the whole.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrystone.session import cut

SHARD, CELL, PROPOSALS = 4096, 4096, 8192
TABLES, BITS = 6, 6
STRATUM_WEIGHT, CELL_WEIGHT = 1.0, 0.5
DESCENT = 0.9
MOST_STATE_BYTES = 64 << 20  # of all open states together, to be broadcast


def plain_stratum(stratum: Column) -> Column:
    """Strata that differ in case, blanks or the sign behind their kind are one; '' where unknown."""
    s = F.regexp_replace(F.lower(F.trim(stratum)), r"\s+", " ")
    return F.coalesce(F.regexp_replace(s, r"^([a-z]+)[ :_/-]+", "$1:"), F.lit(""))


def listed_candidates(candidates: DataFrame) -> DataFrame:
    """One row per candidate, its latest listing: ``resource_id, candidate_key, stratum, embedding``.

    The embedding is null where it is unavailable, by its flag or in fact.
    """
    emb = F.when(F.coalesce("embedding_available", F.lit(True)), F.col("embedding"))
    item = F.struct(F.col("discovered_at"), F.col("stratum").isNotNull().alias("s"), plain_stratum(F.col("stratum")).alias("stratum"), emb.alias("embedding"))
    rows = candidates.where("resource_id is not null and candidate_key is not null")
    return rows.groupBy("resource_id", "candidate_key").agg(F.max(item).alias("x")).select("resource_id", "candidate_key", "x.stratum", "x.embedding")


def requested_budgets(summaries: DataFrame) -> DataFrame:
    """The budget each resource asks for: that of its latest summary with a budget above zero."""
    rows = summaries.where("resource_id is not null and budget > 0")
    return rows.groupBy("resource_id").agg(F.max(F.struct("created_at", "sampling_key", "budget")).getField("budget").alias("budget"))


def _features(emb: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Cell number per table (-1 without an embedding) and masses of the signed squares."""
    emb = emb.combine_chunks() if isinstance(emb, pa.ChunkedArray) else emb
    n = len(emb)
    size = np.asarray(pc.list_value_length(emb).fill_null(0), np.int64)
    cells, mass = np.full((n, TABLES), -1, np.int64), np.zeros((n, 2 * width))
    if width:
        x = np.zeros((n, width))
        rows = np.repeat(np.arange(n), size)
        at = np.arange(len(rows)) - np.repeat(np.cumsum(size) - size, size)
        x[rows, at] = np.nan_to_num(np.asarray(emb.flatten().cast(pa.float64()).fill_null(0.0)))
        norm = np.linalg.norm(x, axis=1)
        has = norm > 0
        x[has] /= norm[has, None]
        planes = np.random.default_rng(width).standard_normal((width, TABLES * BITS))
        sign = (x @ planes > 0).reshape(n, TABLES, BITS)
        cells[has] = (sign * (1 << np.arange(BITS))).sum(2)[has]
        mass = np.concatenate([np.where(x > 0, x, 0) ** 2, np.where(x < 0, x, 0) ** 2], axis=1)
    return cells, mass


_TABLES = np.arange(TABLES)


def _step(count: np.ndarray) -> np.ndarray:
    return np.sqrt(count + 1) - np.sqrt(count)


class Cover:
    """The masses that the chosen records of a resource have put on the features."""

    def __init__(self, width: int) -> None:
        self.strata: dict[str, int] = {}
        self.cells = np.zeros((TABLES, (1 << BITS) + 1))  # the last cell stands for no embedding and gains nothing
        self.mass = np.zeros(2 * width)

    def counts(self, names: np.ndarray) -> np.ndarray:
        return np.array([self.strata.get(x, 0) for x in names], float)

    def gains(self, in_stratum: np.ndarray, cells: np.ndarray, mass: np.ndarray) -> np.ndarray:
        """Marginal gains of records, given what is chosen of their strata."""
        g = STRATUM_WEIGHT * _step(in_stratum)
        g = g + CELL_WEIGHT * (_step(self.cells[_TABLES, cells]) * (cells >= 0)).mean(1)
        return g + (np.sqrt(self.mass + mass) - np.sqrt(self.mass)).sum(1) if mass.shape[1] else g

    def add(self, stratum: str, cells: np.ndarray, mass: np.ndarray) -> None:
        self.strata[stratum] = self.strata.get(stratum, 0) + 1
        self.cells[_TABLES, cells] += 1
        self.mass += mass

    def value(self) -> float:
        """The value of what is chosen."""
        return STRATUM_WEIGHT * np.sqrt(list(self.strata.values())).sum() + CELL_WEIGHT * np.sqrt(self.cells[:, :-1]).sum() / TABLES + np.sqrt(self.mass).sum()


class Shard:
    """Records with their features, those with equal strata under one code."""

    def __init__(self, strata: np.ndarray, cells: np.ndarray, mass: np.ndarray, tie: np.ndarray) -> None:
        self.names, self.code = np.unique(strata.astype(str), return_inverse=True)
        self.cells, self.mass, self.tie = cells, mass, tie

    def round(self, cover: Cover, rows: np.ndarray, bar: float, most: int) -> tuple[list[int], float, bool]:
        """Rows added to ``cover`` one by one whose gain reaches the bar, the best gain left, and whether ``most`` cut it short."""
        counts = cover.counts(self.names)
        gains = lambda r: cover.gains(counts[self.code[r]], self.cells[r], self.mass[r])
        g = gains(rows)
        over = np.flatnonzero(g >= bar)
        over = over[np.lexsort((self.tie[rows[over]], -g[over]))]
        taken: list[int] = []
        left = np.ones(len(rows), bool)
        for k in over:
            if len(taken) == most:
                return taken, float(g.max()), True
            r = rows[k : k + 1]
            if gains(r)[0] >= bar:
                cover.add(self.names[self.code[r[0]]], self.cells[r[0]], self.mass[r[0]])
                counts[self.code[r[0]]] += 1
                taken.append(int(r[0]))
                left[k] = False
        return taken, float(gains(rows[left]).max()) if left.any() else 0.0, False


def threshold_rounds(strata: np.ndarray, cells: np.ndarray, mass: np.ndarray, order: np.ndarray, budget: int) -> list[int]:
    """Rows chosen by descending thresholds from one shard; ``order`` breaks ties. Exactly min(budget, rows)."""
    n = len(strata)
    if n <= budget:
        return list(range(n))
    tie = np.empty(n, np.int64)
    tie[order] = np.arange(n)
    shard, cover = Shard(strata, cells, mass, tie), Cover(mass.shape[1] // 2)
    rows, chosen = np.arange(n), []
    bar = cover.gains(np.zeros(n), cells, mass).max()
    while len(chosen) < budget:
        taken, best, _ = shard.round(cover, rows, bar, budget - len(chosen))
        chosen += taken
        rows = np.setdiff1d(rows, taken, assume_unique=True)
        bar = min(bar * DESCENT, best)
    return chosen


_BLOB = "resource_id string, cell int, shard int, shards int, quota int, width int, done boolean, keys array<string>, strata array<string>, cells binary, mass binary, tie binary, top double"
_STATE = "resource_id string, cell int, left int, state binary"


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _pack(table: pa.Table) -> pa.Table:
    """One row per shard with its records and their features; a cell of one shard chooses here."""
    first = {c: table.column(c)[0].as_py() for c in ("resource_id", "cell", "shard", "shards", "quota", "width")}
    keys, strata = table.column("candidate_key"), np.asarray(table.column("stratum").to_pylist(), object).astype(str)
    cells, mass = _features(table.column("embedding"), first["width"])
    tie = np.asarray(table.column("tie"))
    done = first["shards"] == 1
    rows = np.array(threshold_rounds(strata, cells, mass, np.argsort(tie, kind="stable"), first["quota"]) if done else range(len(tie)), np.int64)
    top = float(Cover(first["width"]).gains(np.zeros(len(tie)), cells, mass).max())
    raw = [None] * 3 if done else [cells.astype(np.int8).tobytes(), mass.astype(np.float32).tobytes(), tie.tobytes()]
    one = [*first.values(), done, keys.take(pa.array(rows)).to_pylist(), strata[rows].tolist(), *raw, top]
    kinds = [pa.string(), *[pa.int32()] * 5, pa.bool_(), pa.list_(pa.string()), pa.list_(pa.string()), *[pa.binary()] * 3, pa.float64()]
    return pa.table([pa.array([v], k) for v, k in zip(one, kinds)], names=_names(_BLOB))


def _shard(row: dict) -> Shard:
    n, width = len(row["keys"]), row["width"]
    cells = np.frombuffer(row["cells"], np.int8).reshape(n, TABLES).astype(np.int64)
    mass = np.frombuffer(row["mass"], np.float32).reshape(n, 2 * width).astype(float)
    return Shard(np.array(row["strata"], object), cells, mass, np.frombuffer(row["tie"], np.int64))


_PROPOSED = "resource_id string, cell int, shard int, state binary, proposed binary"


def _propose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What each shard proposes in this round, given the state of its resource."""
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            state = pickle.loads(row["state"])
            turns = -(-row["shards"] // PROPOSALS)
            if row["shard"] % turns == state["turn"]:
                s = _shard(row)
                free = np.setdiff1d(np.arange(len(s.tie)), [i for k, i in state["chosen"] if k == row["shard"]])
                most = min(state["left"], max(1, PROPOSALS * turns // row["shards"]))
                rows, best, more = s.round(state["cover"], free, state["bar"], most)
                proposed = pickle.dumps({"rows": rows, "strata": s.names[s.code[rows]].tolist(), "cells": s.cells[rows].astype(np.int8), "mass": s.mass[rows].astype(np.float32), "tie": s.tie[rows], "best": best, "more": more, "turns": turns})
                out.append((row["resource_id"], row["cell"], row["shard"], row["state"] if row["shard"] == state["turn"] else None, proposed))
        kinds = (pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=_names(_PROPOSED))


def _decide(table: pa.Table) -> pa.Table:
    """Adds the proposals of a resource's shards that reach the threshold in the state they meet, and lowers it."""
    table = table.sort_by("shard")  # the first one brings the state
    state = pickle.loads(table.column("state")[0].as_py())
    cover, bar = state["cover"], state["bar"]
    said = [(s, pickle.loads(p)) for s, p in zip(table.column("shard").to_pylist(), table.column("proposed").to_pylist())]
    rows = [(s, r) for s, p in said for r in p["rows"]]
    best = max([state["best"], *[p["best"] for _, p in said]])
    if rows:
        all_ = Shard(np.array([x for _, p in said for x in p["strata"]], object), *[np.concatenate([p[c] for _, p in said if p["rows"]]).astype(k) for c, k in (("cells", np.int64), ("mass", float), ("tie", np.int64))])
        added, missed, _ = all_.round(cover, np.arange(len(rows)), bar, state["left"])
        state["chosen"] += [rows[i] for i in added]
        state["left"] -= len(added)
        best = max(best, missed)
    turns = said[0][1]["turns"]
    state["best"], state["more"] = best, state["more"] or any(p["more"] for _, p in said)
    state["turn"] = (state["turn"] + 1) % turns
    if state["turn"] == 0:  # every shard has been asked
        if not state["more"]:
            state["bar"] = min(bar * DESCENT, best)
        state["best"], state["more"] = 0.0, False
    first = [table.column(c)[0].as_py() for c in ("resource_id", "cell")]
    return pa.table([pa.array([v], k) for v, k in zip([*first, state["left"], pickle.dumps(state)], (pa.string(), pa.int32(), pa.int32(), pa.binary()))], names=_names(_STATE))


def _begin(table: pa.Table) -> pa.Table:
    first = {c: table.column(c)[0].as_py() for c in ("resource_id", "cell", "quota", "width")}
    state = {"cover": Cover(first["width"]), "bar": pc.max(table.column("top")).as_py(), "left": first["quota"], "chosen": [], "turn": 0, "best": 0.0, "more": False}
    return pa.table([pa.array([v], k) for v, k in zip([first["resource_id"], first["cell"], first["quota"], pickle.dumps(state)], (pa.string(), pa.int32(), pa.int32(), pa.binary()))], names=_names(_STATE))


def _chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            rows = range(len(row["keys"])) if row["done"] else [i for k, i in pickle.loads(row["state"])["chosen"] if k == row["shard"]]
            out += [(row["resource_id"], row["keys"][i], row["strata"][i]) for i in rows]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.string()) for i in range(3)], names=["resource_id", "candidate_key", "stratum"])


def _spread(candidates: DataFrame, summaries: DataFrame, shard: int, cell: int) -> DataFrame:
    """Candidates with the cell and shard they belong to and the quota of the cell, in proportion to its rows."""
    pool = cut(listed_candidates(candidates).join(requested_budgets(summaries), "resource_id").withColumn("tie", F.xxhash64("candidate_key")))
    sizes = pool.groupBy("resource_id").agg(F.count("*").alias("rows"), F.max("budget").alias("b"), F.max(F.greatest(F.size("embedding"), F.lit(0))).alias("width"))
    sizes = sizes.select("resource_id", "rows", "width", F.least("b", "rows").alias("b"), F.greatest(F.ceil(F.col("b") / cell), F.lit(1)).cast("int").alias("n"))
    placed = pool.drop("budget").join(sizes, "resource_id").withColumn("cell", F.pmod("tie", F.col("n")).cast("int"))
    cells = placed.groupBy("resource_id", "cell", "rows", "b").agg(F.count("*").alias("own"))
    exact = F.col("b") * F.col("own") / F.col("rows")
    whole = F.floor(exact)
    left = F.col("b") - F.sum(whole).over(Window.partitionBy("resource_id"))
    order = F.row_number().over(Window.partitionBy("resource_id").orderBy((whole - exact).asc(), "cell"))
    cells = cells.select("resource_id", "cell", (whole + F.when(order <= left, 1).otherwise(0)).cast("int").alias("quota"), F.ceil(F.col("own") / shard).cast("int").alias("shards"))
    return placed.join(cells, ["resource_id", "cell"]).withColumn("shard", F.pmod(F.xxhash64("tie"), F.col("shards")).cast("int"))


def varied_subset(candidates: DataFrame, summaries: DataFrame, shard: int | None = None, cell: int | None = None) -> DataFrame:
    """``resource_id, candidate_key, stratum`` of exactly the budget of each resource, or of all if fewer.

    Resources without a request are left out, and requests without candidates give nothing.
    Candidates without stratum or embedding count with what they have. Ties are broken by a hash
    of the key, so the result does not depend on the order of rows. ``shard`` and ``cell`` bound
    the rows that one task works on and the records chosen together.
    """
    shard, cell = shard or SHARD, cell or CELL
    kept = ["resource_id", "cell", "shard", "shards", "quota", "width", "candidate_key", "stratum", F.col("embedding").cast("array<float>").alias("embedding"), "tie"]
    spread = _spread(candidates, summaries, shard, cell).where("quota > 0").select(*kept)
    packed = cut(spread.groupBy("resource_id", "cell", "shard").applyInArrow(_pack, _BLOB))
    open_ = packed.where("not done")
    states = cut(open_.groupBy("resource_id", "cell").applyInArrow(_begin, _STATE))
    key = ["resource_id", "cell"]
    while True:
        asking = states.where("left > 0").select(*key, "state")
        size = asking.agg(F.sum(F.octet_length("state"))).first()[0]
        if size is None:
            break
        asked = open_.join(F.broadcast(asking) if size <= MOST_STATE_BYTES else asking, key)  # else the shards are moved to their states
        decided = asked.select(*key, "shard", "shards", "width", "keys", "strata", "cells", "mass", "tie", "state").mapInArrow(_propose, _PROPOSED)
        states = cut(decided.groupBy(*key).applyInArrow(_decide, _STATE).unionByName(states.where("left = 0")))
    columns = [*key, "shard", "done", "keys", "strata"]
    chosen = packed.where("done").select(*columns, F.lit(None).cast("binary").alias("state")).unionByName(open_.select(*columns).join(states.select(*key, "state"), key))
    return chosen.mapInArrow(_chosen, "resource_id string, candidate_key string, stratum string")


def coverage_report(candidates: DataFrame, summaries: DataFrame) -> DataFrame:
    """Per resource: budget, candidates, chosen, strata present and strata covered."""
    listed = listed_candidates(candidates).groupBy("resource_id").agg(F.count("*").alias("candidates"), F.countDistinct("stratum").alias("strata"))
    chosen = varied_subset(candidates, summaries).groupBy("resource_id").agg(F.count("*").alias("chosen"), F.countDistinct("stratum").alias("strata_covered"))
    return requested_budgets(summaries).join(listed, "resource_id").join(chosen, "resource_id")
