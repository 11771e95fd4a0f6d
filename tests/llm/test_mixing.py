import random

import pytest

from quarrystone.llm import mixing

DOCS = "doc_id bigint, text string, source string, tokens string, key string, bucket int"
TARGETS = "source string, target_share double, max_repeats int"


def mix(spark, docs, targets, **kw):
    d = spark.createDataFrame([(*r, "x", "y", 1) for r in docs], DOCS)
    chosen, shares = mixing.mixture(d, spark.createDataFrame(targets, TARGETS), **kw)
    return {r.doc_id: r for r in chosen.collect()}, {r.source: r for r in shares.collect()}


def corpus(n, seed=1):
    rng = random.Random(seed)
    return [(i, "word " * rng.randrange(1, 60) + "x", rng.choice(["A", " a\n", "b", "B ", "c"] + ["a"] * 4)) for i in range(n)]


def test_shares_budgets_and_repeats(spark):
    chosen, shares = mix(spark, corpus(900), [("a", 0.5, 1), ("b", 0.3, 4), ("C ", 0.15, 9), ("none", 0.05, 3)])
    longest = 62
    for s, r in shares.items():
        assert r.budget_tokens - longest < r.mixed_tokens <= r.budget_tokens and r.repeats <= r.max_repeats
    total = sum(r.mixed_tokens for r in shares.values())
    assert abs(shares["a"].actual_share - 0.5 / 0.95) < 0.01 and abs(shares["c"].actual_share - shares["c"].mixed_tokens / total) < 1e-9
    assert shares["none"].mixed_tokens == 0 and shares["none"].target_share == 0.05
    for s in ("a", "b", "c"):  # whole epochs first: repeats differ by one at most
        reps = {r.repeats for r in chosen.values() if r.source == s} | ({0} if sum(r.source == s for r in chosen.values()) < shares[s].documents else set())
        assert max(reps) - min(reps) <= 1


def test_a_given_total_and_the_same_result_again(spark):
    docs = corpus(300)
    one = mix(spark, docs, [("a", 0.6, 1), ("b", 0.4, 1)], total=1000)
    assert sum(r.mixed_tokens for r in one[1].values()) <= 1000
    two = mix(spark, docs[::-1], [("a", 0.6, 1), ("b", 0.4, 1)], total=1000)
    assert {k: v.repeats for k, v in one[0].items()} == {k: v.repeats for k, v in two[0].items()}


def test_better_documents_are_taken_more_often(spark):
    docs = [(i, ("plain words in a sentence " * 8) if i % 2 else ("x9$Qz#7!kT&" * 12), "a") for i in range(600)]
    chosen, _ = mix(spark, docs, [("a", 1.0, 1)], total=9000)
    good = sum(k % 2 for k in chosen)
    assert good > 0.6 * len(chosen)


def test_nulls_empty_and_long(spark):
    docs = [(1, None, "a"), (2, "", "a"), (3, "hello", None), (None, "hello", "a"), (4, "y" * 300000, "a"), (5, "hello there", "zz")]
    chosen, shares = mix(spark, docs, [("a", 1.0, 2), (None, 0.5, 1), ("b", None, None)])
    assert set(chosen) == {4} and chosen[4].repeats == 2
    chosen, shares = mix(spark, [], [("a", 1.0, 2)])
    assert chosen == {} and shares["a"].actual_share == 0
    assert mix(spark, docs, []) == ({}, {})


def test_plan_and_bounds(spark):
    total, budget = mixing.plan_budgets([("a", 0.5, 1), ("b", 0.5, 2)], {"a": 100, "b": 30})
    assert (total, budget) == (120, {"a": 60, "b": 60})
    assert mixing.plan_budgets([("a", 0.5, 1)], {}) == (0, {})
    with pytest.raises(ValueError):
        mixing.MOST_TARGETS, old = 1, mixing.MOST_TARGETS
        try:
            mix(spark, [(1, "t", "a")], [("a", 0.5, 1), ("b", 0.5, 1)])
        finally:
            mixing.MOST_TARGETS = old


def test_long_texts_are_counted_piece_by_piece(monkeypatch):
    rng = random.Random(5)
    encode = mixing._encoding(mixing.TOKENIZER).encode_ordinary
    for _ in range(40):
        text = "".join(rng.choice(["word", " two", "\n", "\n\n", "\r\n", " ", "\t", "it's", "+", "12", "é", "'", "\n+", " \n"]) for _ in range(300))
        monkeypatch.setattr(mixing, "PIECE", rng.choice([1, 7, 50]))
        pieces = list(mixing._pieces(text))
        assert "".join(pieces) == text and len(pieces) > 1
        assert [t for x in pieces for t in encode(x)] == encode(text)


def test_budgets_are_filled_with_documents_that_still_fit(spark):
    rng = random.Random(6)
    docs = [(i, "word " * (800 if rng.random() < 0.2 else rng.randrange(1, 12)) + "x", "abc"[i % 3]) for i in range(900)]
    _, shares = mix(spark, docs, [("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.2, 1)], total=40_000)
    for r in shares.values():
        assert 0 <= r.budget_tokens - r.mixed_tokens <= 0.01 * r.budget_tokens
