"""Quality metrics: set overlap, classification, consistency, ranking, percentiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrystone.plans.scans import numbered

from quarrystone.plans.scans import running_max


def set_scores(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Micro precision, recall and F1 of set-valued records; null sets are empty, zero denominators give null."""
    t, p = (F.coalesce(F.array_distinct(c), F.array().cast("array<string>")) for c in (truth, predicted))
    s = df.agg(*[F.coalesce(F.sum(F.size(x)), F.lit(0)).alias(n) for n, x in (("tp", F.array_intersect(t, p)), ("fp", F.array_except(p, t)), ("fn", F.array_except(t, p)))])
    ratio = lambda a, b: F.try_divide(F.col(a), b)
    s = s.withColumn("precision", ratio("tp", F.col("tp") + F.col("fp"))).withColumn("recall", ratio("tp", F.col("tp") + F.col("fn")))
    both = F.col("precision") + F.col("recall")
    f1 = F.when(both > 0, 2 * F.col("precision") * F.col("recall") / both).when(both == 0, 0.0)
    return s.select(*[F.col(c).cast("bigint").alias(c) for c in ("tp", "fp", "fn")], "precision", "recall", f1.alias("f1"))


def label_scores(df: DataFrame, expected: str, predicted: str) -> DataFrame:
    """One-vs-rest F1 of every label that occurs on either side; null counts as ``UNKNOWN``."""
    e, p = (F.coalesce(F.col(c), F.lit("UNKNOWN")) for c in (expected, predicted))
    pairs = df.groupBy(e.alias("e"), p.alias("p")).agg(F.count("*").alias("n"))
    part = lambda label, tp, fp, fn: pairs.select(F.col(label).alias("label"), *[F.when(c, F.col("n")).otherwise(0).alias(k) for k, c in (("tp", tp), ("fp", fp), ("fn", fn))])
    same, no = F.col("e") == F.col("p"), F.lit(False)
    long = part("e", same, no, ~same).unionByName(part("p", no, ~same, no))
    s = long.groupBy("label").agg(*[F.sum(k).cast("bigint").alias(k) for k in ("tp", "fp", "fn")])
    return s.withColumn("f1", F.coalesce(F.try_divide(2.0 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), F.lit(0.0)))


def macro_f1(scores: DataFrame) -> DataFrame:
    """Mean of the one-vs-rest F1 values."""
    return scores.agg(F.avg("f1").alias("macro_f1"), F.count("*").alias("labels"))


def unknown_rate(df: DataFrame, predicted: str) -> Column:
    """Aggregate: share of predictions that are null or ``UNKNOWN``."""
    return F.avg(F.when(F.coalesce(F.col(predicted), F.lit("UNKNOWN")) == "UNKNOWN", 1.0).otherwise(0.0))


def consistency(df: DataFrame, keys: list[str], run: str, value: str) -> DataFrame:
    """Share of equal values between neighbouring runs of each key, over all keys; null equals null.

    ``run`` is a number, unique within its key; keys may be of any size.
    """
    last = F.struct(F.col(run), F.col(value).alias("v"))
    pairs = running_max(df, keys, [run], {"_p": (last, False)}, F.floor(F.col(run) / 4096)).where("_p is not null")
    pairs = pairs.withColumn("_same", F.col("_p.v").eqNullSafe(F.col(value)))
    return pairs.agg(F.count("*").alias("comparisons"), F.coalesce(F.sum(F.col("_same").cast("bigint")), F.lit(0)).alias("matches")).withColumn("consistency", F.try_divide("matches", "comparisons"))


def ranking_scores(rankings: DataFrame, query: str, rank: str, relevance: str, ideal: DataFrame, k: int) -> DataFrame:
    """Hit@k, reciprocal rank and NDCG@k per query.

    ``rankings`` has the first k or more results with a relevance (0 or null: none); ``ideal``
    has per query the array ``gains`` of all relevances, highest first, of at least k.
    """
    rel = F.coalesce(F.col(relevance), F.lit(0))
    discount = lambda r: F.log2(r + 1)
    got = rankings.groupBy(query).agg(
        F.max(F.when((rel > 0) & (F.col(rank) <= k), 1.0).otherwise(0.0)).alias("hit"),
        F.coalesce(1.0 / F.min(F.when(rel > 0, F.col(rank))), F.lit(0.0)).alias("rr"),
        F.sum(F.when(F.col(rank) <= k, (F.pow(F.lit(2.0), rel) - 1) / discount(F.col(rank))).otherwise(0.0)).alias("dcg"),
    )
    gain = F.transform(F.slice("gains", 1, k), lambda g, i: (F.pow(F.lit(2.0), g) - 1) / F.log2(i + 2))
    best = ideal.select(query, F.aggregate(gain, F.lit(0.0), lambda a, x: a + x).alias("idcg"))
    return got.join(best, query).select(query, "hit", "rr", F.coalesce(F.try_divide("dcg", F.nullif("idcg", F.lit(0.0))), F.lit(0.0)).alias("ndcg"))


def nearest_rank(value: str, share: float) -> Column:
    """Aggregate: nearest-rank percentile; the smallest value that at least the share does not exceed."""
    return F.expr(f"percentile_disc({share}) WITHIN GROUP (ORDER BY {value})")


def nearest_ranks(df: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """``keys`` and, under each given name, the nearest-rank percentile of a share, for groups of any size.

    Values are numbered by a range sort, so no group stands in one task or buffer. Null values
    are passed over; a group without any is left out.
    """
    rows = numbered(df.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_v")), keys, ["_v"], "_n")
    size = rows.groupBy(*[F.col(k).alias(f"_g{i}") for i, k in enumerate(keys)]).agg(F.count("*").alias("_all"))
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_g{i}"))
    at = rows.join(size, same)
    return at.groupBy(*keys).agg(*[F.max(F.when(F.col("_n") == F.greatest(F.lit(1), F.ceil(F.col("_all") * share)), F.col("_v"))).alias(name) for name, share in shares.items()])
