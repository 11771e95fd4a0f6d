import math
import random
from datetime import datetime

import numpy as np

from quarrystone.llm import variety

CAND = "candidate_key string, resource_id string, stratum string, embedding_available boolean, discovered_at timestamp, embedding array<float>, shard int, budget int, rows int"
SUM = "sampling_key string, resource_id string, budget int, created_at timestamp, strata array<string>"
T0, T1 = datetime(2020, 1, 1), datetime(2021, 1, 1)


def chosen(spark, cand, summ, **kw):
    c = spark.createDataFrame([(*r, 1, 2, 3) for r in cand], CAND)
    s = spark.createDataFrame([(*r, None) for r in summ], SUM)
    return sorted((r.resource_id, r.candidate_key, r.stratum) for r in variety.varied_subset(c, s, **kw).collect())


def unit(rng):
    v = rng.normal(size=16)
    return [float(x) for x in v / np.linalg.norm(v)]


def test_exact_sizes_distinct_and_independent_of_order(spark):
    rng = np.random.default_rng(1)
    cand = []
    for i in range(700):
        r = "big" if i % 3 else f"r{i % 7}"
        cand.append((f"k{i % 600}", r, random.Random(i).choice(["a:x", "A:X ", "a_x", "b:y", None]), i % 5 > 0, T0, unit(rng) if i % 4 else None))
    summ = [("s1", "big", 9, T0), ("s2", "big", 20, T1), ("s3", "r0", 5, T0), ("s4", "r1", 10**6, T0), ("s5", "r2", None, T0), ("s6", "gone", 5, T0), ("s7", None, 5, T0)]
    got = chosen(spark, cand, summ, shard=50)
    n = lambda r: sum(x[0] == r for x in got)
    assert (n("big"), n("r0"), n("r1")) == (20, 5, len({k for k, r, *_ in cand if r == "r1"})) and len(got) == len(set(got)) and n("r2") == 0
    random.Random(3).shuffle(cand)
    again = chosen(spark, cand, summ, shard=50)
    assert [x[:2] for x in again] == [x[:2] for x in got]


def test_small_groups_are_covered_before_look_alikes(spark):
    rng = np.random.default_rng(2)
    twin = unit(rng)
    cand = [(f"t{i}", "r", "a:big", True, T0, twin) for i in range(400)] + [(f"s{i}", "r", f"b:{i}", True, T0, unit(rng)) for i in range(9)]
    got = chosen(spark, cand, [("s", "r", 12, T0)])
    assert len(got) == 12 and sum(k.startswith("s") for _, k, _ in got) == 9


def test_nulls_and_empty(spark):
    assert chosen(spark, [], [("s", "r", 3, T0)]) == [] and chosen(spark, [("a", "r", None, None, None, None)], []) == []
    cand = [("a", "r", None, None, None, None), ("b", "r", None, True, T0, []), ("c", "r", "", True, T0, [float("nan")] * 16), (None, "r", "x", True, T0, None), ("d", None, "x", True, T0, None)]
    assert [k for _, k, _ in chosen(spark, cand, [("s", "r", 2, T0)])] != [] and len(chosen(spark, cand, [("s", "r", 2, T0)])) == 2


def test_latest_listing_counts(spark):
    cand = [("a", "r", "old:x", True, T0, None), ("a", "r", "new:x", True, T1, None)]
    assert chosen(spark, cand, [("s", "r", 5, T0)]) == [("r", "a", "new:x")]


def test_rounds_reach_the_greedy_value():
    rng = np.random.default_rng(4)
    n, budget = 400, 20
    strata = rng.integers(0, 6, n)
    cells = rng.integers(0, 64, (n, variety.TABLES))
    x = rng.normal(size=(n, 4))
    x /= np.linalg.norm(x, axis=1)[:, None]
    mass = np.concatenate([np.where(x > 0, x, 0) ** 2, np.where(x < 0, x, 0) ** 2], 1)

    def value(rows):
        v = variety.STRATUM_WEIGHT * sum(math.sqrt(c) for c in np.bincount(strata[rows]))
        v += variety.CELL_WEIGHT * np.mean([sum(math.sqrt(c) for c in np.bincount(cells[rows, t])) for t in range(variety.TABLES)])
        return v + np.sqrt(mass[rows].sum(0)).sum()

    got = variety.threshold_rounds(strata, cells, mass, np.arange(n), budget)
    greedy = []
    for _ in range(budget):
        greedy.append(max((i for i in range(n) if i not in greedy), key=lambda i: value(greedy + [i])))
    assert len(set(got)) == budget and value(got) > 0.97 * value(greedy) > value(list(range(budget)))


def greedy(cand, budget):
    """Plain greedy choice of one resource from rows (stratum, embedding), and the value of any choice."""
    import pyarrow as pa

    width = max((len(e) for _, e in cand if e is not None), default=0)
    cells, mass = variety._features(pa.array([e for _, e in cand], pa.list_(pa.float32())), width)
    names, code = np.unique(np.array([s for s, _ in cand], object).astype(str), return_inverse=True)

    def value(rows):
        cover = variety.Cover(width)
        for r in rows:
            cover.add(names[code[r]], cells[r], mass[r])
        return cover.value()

    cover, left, out = variety.Cover(width), np.arange(len(cand)), []
    while len(out) < min(budget, len(cand)):
        k = int(np.argmax(cover.gains(cover.counts(names)[code[left]], cells[left], mass[left])))
        r = left[k]
        cover.add(names[code[r]], cells[r], mass[r])
        out.append(r)
        left = np.delete(left, k)
    return value(out), value


def test_shards_reach_the_greedy_value_for_every_resource(spark):
    import os

    import pytest

    d = "/root/testdata/sf0.01"
    if not os.path.isdir(d):
        pytest.skip("no test tables")
    c, s = spark.read.parquet(f"{d}/image_candidates.parquet"), spark.read.parquet(f"{d}/sampling_summaries.parquet")
    pool = {}
    for r in variety.listed_candidates(c).collect():
        pool.setdefault(r.resource_id, {})[r.candidate_key] = (r.stratum, r.embedding)
    budgets = {r.resource_id: r.budget for r in variety.requested_budgets(s).collect()}
    got = {}
    for r in variety.varied_subset(c, s, shard=24).collect():
        got.setdefault(r.resource_id, []).append(r.candidate_key)
    sharded = 0
    for resource, budget in budgets.items():
        own = pool.get(resource, {})
        assert len(got.get(resource, [])) == min(budget, len(own)) == len(set(got.get(resource, [])))
        if own:
            sharded += len(own) > 24
            keys = list(own)
            best, value = greedy([own[k] for k in keys], budget)
            assert value([keys.index(k) for k in got[resource]]) >= 0.95 * best, resource
    assert sharded > 20


def test_large_budgets_are_chosen_in_cells_and_many_shards_take_turns(spark, monkeypatch):
    monkeypatch.setattr(variety, "PROPOSALS", 3)
    rng = np.random.default_rng(5)
    cand = [(f"k{i}", "r", f"s:{i % 11}" if i % 2 else "s:big", True, T0, unit(rng)) for i in range(600)]
    got = chosen(spark, cand, [("s", "r", 90, T0)], shard=40, cell=50)
    assert len({k for _, k, _ in got}) == 90
    rows = {k: (s, e) for k, _, s, _, _, e in cand}
    keys = list(rows)
    best, value = greedy([rows[k] for k in keys], 90)
    assert value([keys.index(k) for _, k, _ in got]) > 0.95 * best
