"""Greedy admission of items in order under a budget: what does not fit is skipped, later smaller items may still fit."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrystone.plans.topk import first_per_group
from quarrystone.session import cut

AT_ONCE = 4096  # items of a key that one task walks through in a round


def _walk(table: pa.Table) -> pa.Table:
    """Admits the items of one key in order; the last row tells where it stopped and what is spent."""
    t = table.sort_by("o")
    order, size = (np.asarray(t.column(c), np.int64) for c in ("o", "s"))
    spent, budget = t.column("spent")[0].as_py(), t.column("budget")[0].as_py()
    taken, used, at = [], [], 0
    while at < len(size):  # runs of items that fit, found by prefix sums
        run = spent + np.cumsum(size[at:])
        fits = int(np.searchsorted(run, budget, "right"))
        taken += range(at, at + fits)
        used += run[:fits].tolist()
        spent = used[-1] if fits else spent
        later = np.flatnonzero(size[at + fits + 1 :] <= budget - spent)
        if not len(later):
            break
        at += fits + 1 + int(later[0])
    rows = np.array(taken, np.int64)
    n = len(rows) + 1
    cols = [np.r_[order[rows], order[-1]], np.r_[size[rows], 0], np.r_[used, spent].astype(np.int64), np.r_[np.ones(n - 1, bool), False]]
    key = t.column("k").combine_chunks().take(pa.array(np.zeros(n, np.int64)))
    return pa.table([key, *map(pa.array, cols)], names=["k", "o", "s", "used", "admitted"])


def greedy_admission(items: DataFrame, key: str, order: str, size: str, budget: int, rounds: int = 10_000) -> DataFrame:
    """``key, order, size, used`` of the admitted items; ``used`` is the budget spent with them.

    ``order`` is a number, unique within its key; null and negative sizes are never admitted, null keys are a
    key of their own. In each round the next items of every key that could still fit are walked
    through, a bounded number at once; keys are worked on together.
    """
    base = items.select(F.coalesce(key, F.lit("")).alias("k"), F.col(order).cast("bigint").alias("o"), F.col(size).cast("bigint").alias("s")).where(f"s is not null and o is not null and s between 0 and {budget}")
    base = cut(base)
    state = base.groupBy("k").agg(F.min(F.col("o") - 1).alias("stop"), F.lit(0).cast("bigint").alias("spent"))
    out = [items.sparkSession.createDataFrame([], "k string, o bigint, s bigint, used bigint")]
    for _ in range(rounds):
        left = base.join(state, "k").where(F.col("o") > F.col("stop")).where(F.col("spent") + F.col("s") <= budget)
        left = first_per_group(left, ["k"], [F.col("o")], F.lit(AT_ONCE), F.col("o")).withColumn("budget", F.lit(budget).cast("bigint"))
        walked = cut(left.select("k", "o", "s", "spent", "budget").groupBy("k").applyInArrow(_walk, "k string, o bigint, s bigint, used bigint, admitted boolean"))
        out.append(walked.where("admitted").drop("admitted"))
        state = walked.where("not admitted").select("k", F.col("o").alias("stop"), F.col("used").alias("spent"))
        if state.isEmpty():
            return reduce(DataFrame.unionByName, out).select(F.col("k").alias(key), F.col("o").alias(order), F.col("s").alias(size), "used")
    raise RuntimeError(f"admission did not end in {rounds} rounds")
