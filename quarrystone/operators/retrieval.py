"""Ranking of all rows for a stated set of queries, in blocks of queries of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrystone.plans.topk import first_per_group

BLOCK = 2048


def _matrix(column: pa.Array) -> np.ndarray:
    rows = column.to_pylist() if column.null_count else None
    if rows is not None:
        raise ValueError("null vector")
    return np.asarray(column.flatten().cast(pa.float64())).reshape(len(column), -1)


def rank_by_dot(vectors: DataFrame, ident: str, vector: str, queries: DataFrame, k: int) -> DataFrame:
    """The ``k`` rows of largest dot product for every query: ``query, ident, score, rank``.

    A query is not ranked for itself; ties go to the smaller id. Null vectors take no part. Each
    task keeps k rows per query and batch; the queries are broadcast ``BLOCK`` at a time.
    """
    sc = vectors.sparkSession.sparkContext
    rows = vectors.where(F.col(vector).isNotNull() & F.col(ident).isNotNull()).select(F.col(ident).cast("bigint").alias("i"), F.col(vector).alias("v"))
    ask = queries.where(F.col(vector).isNotNull() & F.col(ident).isNotNull()).select(F.col(ident).cast("bigint").alias("i"), F.col(vector).alias("v"))
    total = ask.count()
    n = max(1, -(-total // BLOCK))
    out = None
    for b in range(n):
        part = (ask if n == 1 else ask.where(F.pmod(F.xxhash64("i"), F.lit(n)) == b)).collect()
        held = sc.broadcast((np.array([r.i for r in part], np.int64), np.array([r.v for r in part], np.float64)))

        def score(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            ids, q = held.value
            for batch in batches:
                if not batch.num_rows or not len(ids):
                    continue
                own = np.asarray(batch.column(0))
                s = _matrix(batch.column(1)) @ q.T
                s[own[:, None] == ids[None, :]] = -np.inf
                for j in range(len(ids)):
                    top = np.lexsort((own, -s[:, j]))[:k]
                    top = top[np.isfinite(s[top, j])]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(top), ids[j])), pa.array(own[top]), pa.array(s[top, j])], names=["query", "i", "score"])

        found = rows.mapInArrow(score, "query bigint, i bigint, score double")
        out = found if out is None else out.unionByName(found)
    out = first_per_group(out, ["query"], [F.col("score").desc(), F.col("i")], F.lit(k), F.col("i"))
    return out.select("query", F.col("i").alias(ident), "score", "rank")
