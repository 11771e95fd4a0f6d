import random
from datetime import datetime, timedelta

from quarrystone.operators import delivery
from quarrystone.streaming import events

SCHEMA = "delivery_id bigint, job_id string, event_id bigint, received_at timestamp, quotient string, first int"
T0 = datetime(2020, 1, 1)


def surplus(spark, rows):
    df = spark.createDataFrame([(*r, "q", 1) for r in rows], SCHEMA)
    return {r.delivery_id for r in delivery.surplus_deliveries(df).collect()}


def test_against_brute_force_with_a_hot_message(spark):
    rng, rows = random.Random(1), []
    for i in range(600):
        job = "job_00000000000000aa" if i % 3 == 0 else f"job_{rng.randrange(8):016x}" if i % 3 == 1 else f"other {rng.randrange(5)}"
        job = rng.choice([job, job.upper(), f" {job}\n", job.title()])
        rows.append((i, job, rng.randrange(3), rng.choice([None, T0 + timedelta(seconds=rng.randrange(5))])))
    best = {}
    for i, job, event, at in rows:
        key = (job.strip().lower(), event)
        best[key] = min(best.get(key, (True, T0, 10**9)), (at is None, at or T0, i)) if key in best else (at is None, at or T0, i)
    assert surplus(spark, rows) == {r[0] for r in rows} - {b[2] for b in best.values()}


def test_nulls_ties_and_empty(spark):
    rows = [(1, None, 1, T0), (2, None, 1, T0), (3, "job_1", None, T0), (4, "a", 1, T0), (5, "A ", 1, T0), (None, "a", 1, T0), (6, "", 1, None), (7, " ", 1, None)]
    assert surplus(spark, rows) == {5, 7}
    assert surplus(spark, []) == set()


def test_exactly_once_keeps_the_other_columns(spark):
    df = spark.createDataFrame([(1, "j", 1, T0, "a", 7), (2, "j", 1, T0, "b", 8), (3, None, 1, T0, "c", 9)], SCHEMA)
    got = delivery.exactly_once(df)
    assert set(got.columns) == set(df.columns)
    assert {(r.delivery_id, r.first) for r in got.collect()} == {(1, 7), (3, 9)}


def test_permutation_is_a_bijection(spark):
    from pyspark.sql import functions as F

    n = 20000
    left, right = delivery.permute(F.col("id"), F.col("id") * 0)
    got = spark.range(n).select(left.alias("a"), right.alias("b"))
    assert got.distinct().count() == n
    shards = got.groupBy(F.pmod("a", F.lit(16))).count().collect()
    assert len(shards) == 16 and max(r["count"] for r in shards) < 1.3 * n / 16


def test_stream_gives_each_message_once(spark, tmp_path):
    df = spark.createDataFrame([(1, "j", 1, T0, "a", 1), (2, "J ", 1, T0, "b", 2), (3, None, 1, T0, "c", 3), (4, None, 1, T0, "d", 4)], SCHEMA)
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = events.once(stream).writeStream.format("memory").queryName("once_out").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    rows = spark.table("once_out").collect()
    assert sum(r.job_id is not None for r in rows) == 1 and sum(r.job_id is None for r in rows) == 2


def test_table_inserts_each_identifier_once_and_grows():
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(3)
    ids = rng.integers(0, 30_000, 90_000).astype(np.uint64)
    h, w = delivery.permuted(ids % np.uint64(7), ids)
    w[ids == 5] = w[ids == 6][0]  # equal remainders under different quotients are different identifiers
    table, none = delivery.QuotientTable(), pa.nulls(9_000, pa.string())
    got = np.concatenate([table.insert(h[i : i + 9_000], w[i : i + 9_000], none) for i in range(0, 90_000, 9_000)])
    assert table.size == len(set(zip(h.tolist(), w.tolist())))
    assert (table.high[got] == h).all() and (table.low[got] == w).all()


def test_equal_hashes_of_long_names_are_no_match(monkeypatch):
    import numpy as np
    import pyarrow as pa

    monkeypatch.setattr(delivery, "_text_hash", lambda t: 1)
    h, w, text = delivery.packed(pa.array(["some name", "Some Name ", "another"]), np.array([1, 1, 1]))
    assert delivery.QuotientTable().insert(h, w, text).tolist() == [0, 0, 1]


def test_plan_has_no_sorted_aggregate(spark):
    df = spark.createDataFrame([(1, "j", 1, T0, "a", 7)], SCHEMA)
    plan = delivery.surplus_deliveries(df)._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and plan.count("MapInArrow") == 2
