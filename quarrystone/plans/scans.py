"""Running aggregates over ordered groups that may be larger than one task.

A plain ``Window.partitionBy(key)`` sorts a whole key in one task. Here each key is cut into
blocks of its order column; a block's own running maximum is combined with the maximum of all
earlier blocks, which come from an aggregate that is smaller by the block width. A task sorts
one block only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrystone.session import cut


def running_max(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    values: dict[str, tuple[Column, bool]],
    block: Column,
    descending: bool = False,
) -> DataFrame:
    """Add, per key, the running maximum of each value in the given order.

    ``values`` maps a new column to (expression, include the current row). ``descending``
    walks the order backwards and takes the running *minimum* instead, so that the next
    element can be found like the previous one. Nulls are skipped; keys must not be null.
    """
    agg, pick = (F.min, F.least) if descending else (F.max, F.greatest)
    sort = [F.col(c).desc() if descending else F.col(c).asc() for c in order]
    blocked = df.withColumn("_block", block)
    for i, (expr, _) in enumerate(values.values()):
        blocked = blocked.withColumn(f"_v{i}", expr)
    n = len(values)
    heads = blocked.groupBy(*keys, "_block").agg(*[agg(f"_v{i}").alias(f"_m{i}") for i in range(n)])
    over = Window.partitionBy(*keys).orderBy(F.col("_block").desc() if descending else F.col("_block"))
    over = over.rowsBetween(Window.unboundedPreceding, -1)
    carry = heads.select(*keys, "_block", *[agg(f"_m{i}").over(over).alias(f"_c{i}") for i in range(n)])
    out = blocked.join(carry, [*keys, "_block"], "left")
    within = Window.partitionBy(*keys, "_block").orderBy(*sort)
    for i, (name, (_, inclusive)) in enumerate(values.items()):
        frame = within.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
        local = agg(f"_v{i}").over(frame)
        out = out.withColumn(name, pick(F.col(f"_c{i}"), local))
    return out.select(*df.columns, *values)


def running_sum(df: DataFrame, keys: list[str], order: list[str], value: Column, name: str, block: Column) -> DataFrame:
    """Add the sum of ``value`` over the rows of the same key up to and including this one.

    Works by blocks like ``running_max``; nulls count as zero; the order must be total.
    """
    blocked = df.withColumn("_block", block).withColumn("_v", F.coalesce(value, F.lit(0)))
    heads = blocked.groupBy(*keys, "_block").agg(F.sum("_v").alias("_s"))
    over = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    heads = heads.select(*keys, "_block", F.coalesce(F.sum("_s").over(over), F.lit(0)).alias("_c"))
    within = Window.partitionBy(*keys, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = blocked.join(heads, [*keys, "_block"], "left")
    return out.select(*df.columns, (F.col("_c") + F.sum("_v").over(within)).alias(name))


def numbered(df: DataFrame, keys: list[str], order: list[str], name: str = "n") -> DataFrame:
    """Number the rows of each key 1, 2, 3... in a total order, without a key ever standing in one task.

    Rows are sorted into ranges of (key, order); the rows of a key in earlier ranges are added up.
    """
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = cut(df.repartitionByRange(ranges, *keys, *order).withColumn("_range", F.spark_partition_id()))
    heads = placed.groupBy(*keys, "_range").agg(F.count("*").alias("_rows"))
    over = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    heads = heads.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_range").alias("_r"), F.coalesce(F.sum("_rows").over(over), F.lit(0)).alias("_off"))
    same = F.col("_range") == F.col("_r")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    within = F.row_number().over(Window.partitionBy(*keys, "_range").orderBy(*order))
    return placed.join(heads, same).select(*df.columns, (F.col("_off") + within).alias(name))
