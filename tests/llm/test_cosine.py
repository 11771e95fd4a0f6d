import random

import numpy as np

from quarrystone.llm import cosine

VECTORS = "id bigint, vector array<struct<term:bigint,weight:double>>"


def plain(left, right, t):
    unit = lambda v: {k: w / sum(x * x for _, x in v) ** 0.5 for k, w in v}
    out = {}
    for i, v in left:
        for j, u in right:
            if v and u:
                a, b = unit(v), unit(u)
                dot = sum(w * b.get(k, 0) for k, w in a.items())
                if dot >= t:
                    out[i, j] = dot
    return out


def joined(spark, left, right, t):
    got = cosine.cosine_join(spark.createDataFrame(left, VECTORS), spark.createDataFrame(right, VECTORS), t).collect()
    return {(r.left_id, r.right_id): r.dot for r in got}


def test_against_brute_force_with_a_cluster(spark, monkeypatch):
    monkeypatch.setattr(cosine, "LIST", 8)
    rng = random.Random(1)
    centre = [(k, rng.random() + 0.1) for k in range(6)]

    def vector(i):
        if i % 3 == 0:  # a third of all vectors look alike
            return [(k, w * rng.uniform(0.8, 1.2)) for k, w in centre] + [(100 + i, 0.1)]
        return [(k, rng.random() ** 3 + 0.01) for k in rng.sample(range(40), rng.randrange(1, 9))]

    left, right = [(i, vector(i)) for i in range(90)], [(i, vector(i)) for i in range(70)]
    for t in (0.3, 0.8, 0.99):
        want, got = plain(left, right, t), joined(spark, left, right, t)
        assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in want) and want


def test_nulls_empty_and_single(spark):
    left = [(1, None), (2, []), (3, [(5, 2.0)]), (None, [(5, 1.0)])]
    assert joined(spark, left, [(9, [(5, 0.1)]), (8, [(6, 1.0)])], 0.5) == {(3, 9): 1.0}
    assert joined(spark, [], [(9, [(5, 0.1)])], 0.5) == {}


def test_lists_are_pruned_at_run_time():
    terms = np.array([[1, 2, 3, 4]])
    weights = np.full((1, 4), 0.5)
    kept = lambda most, t: cosine.prefixes(terms, weights, most, np.array([[9, 1, 1, 1]]), t)
    order, rest, keep = kept(weights, 0.5)
    assert order[0].tolist() == [2, 3, 4, 1] and keep[0].tolist() == [True, True, True, False]  # the longest list last, and not entered
    assert np.allclose(rest[0] ** 2, [1, 0.75, 0.5, 0.25])
    assert kept(np.array([[0.5, 0.5, 0.0, 0.0]]), 0.5)[2].sum() == 1  # terms that the other side lacks
    assert kept(np.array([[0.5, 0.5, 0.0, 0.0]]), 0.6)[2].sum() == 0


def test_a_map_never_loses_a_term():
    rng = np.random.default_rng(2)
    terms = rng.integers(-(1 << 63), (1 << 63) - 1, 5000)
    batch = cosine.TermMap.words(terms)
    met = cosine.TermMap(np.asarray(batch.column(0), np.int64), np.asarray(batch.column(1)).copy())
    assert met.holds(terms).all() and met.holds(rng.integers(-(1 << 63), (1 << 63) - 1, 5000)).mean() < 0.01
