"""Weighted cosine join: pairs of vectors of two sides whose dot product reaches a threshold.

Vectors are sets of (term, weight) of unit length. Each side keeps inverted lists, in one order of
terms for both. A vector is not entered in the list of a term when what stands from there on in
the order cannot reach the threshold any more: neither by its own length (residual norm) nor by its
weights times the largest weights that the terms have on the other side (maximum weight; none for
terms that the other side lacks). Where two vectors meet in a list, the product of their residual
norms must reach the threshold, or the pair is dropped. The first common term of a pair that
reaches the threshold stands in both prefixes, so none is missed; exact dot products follow.
Lists with many members are split.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrystone.session import cut

LIST = 4096  # members of one side of a list that meet the other side in one piece
MAP_BITS = 27
_SLACK = 1e-6


def prefixes(terms: np.ndarray, weights: np.ndarray, most: np.ndarray, lists: np.ndarray | None, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Terms in list order, residual norms, and which entries are kept; one vector a row, padded with weight 0.

    ``most`` are the largest weights of the terms on the other side. The order is by ``lists``
    (members of the list, short ones first) where given, then by term.
    """
    order = np.argsort(terms, axis=1, kind="stable") if lists is None else np.lexsort((terms, lists), axis=1)
    terms, weights, most = (np.take_along_axis(x, order, 1) for x in (terms, weights, most))
    weights = np.where(most > 0, weights, 0.0)
    ahead = lambda x: np.cumsum(x[:, ::-1], axis=1)[:, ::-1]
    rest = np.sqrt(ahead(weights**2))
    bound = np.minimum(rest, ahead(weights * most))
    return terms, rest, (weights > 0) & (bound >= threshold - _SLACK)


class TermMap:
    """A bit map of fixed size over hashed terms: a term without its bit is not there."""

    SCHEMA = "word int, bits bigint"

    def __init__(self, words: np.ndarray, bits: np.ndarray) -> None:
        self.map = np.zeros(1 << (MAP_BITS - 6), np.uint64)
        self.map[words] = bits.view(np.uint64)

    @staticmethod
    def _place(terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = terms.view(np.uint64) >> np.uint64(64 - MAP_BITS)
        return (at >> np.uint64(6)).astype(np.int32), at & np.uint64(63)

    @classmethod
    def words(cls, terms: np.ndarray) -> pa.RecordBatch:
        """The words of the map that some terms set."""
        word, bit = cls._place(terms)
        by = np.argsort(word, kind="stable")
        word, bits = word[by], np.left_shift(np.uint64(1), bit[by])
        starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]]) if len(word) else np.zeros(0, np.int64)
        merged = np.bitwise_or.reduceat(bits, starts) if len(starts) else bits
        return pa.RecordBatch.from_arrays([pa.array(word[starts]), pa.array(merged.view(np.int64))], names=["word", "bits"])

    @classmethod
    def collected(cls, words: DataFrame) -> TermMap:
        """The whole map from its words; at most 2 ** (MAP_BITS - 6) rows come to the driver."""
        t = words.groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
        return cls(np.asarray(t.column(0), np.int64), np.asarray(t.column(1), np.int64).copy())

    def holds(self, terms: np.ndarray) -> np.ndarray:
        word, bit = self._place(terms)
        return ((self.map[word] >> bit) & np.uint64(1)).astype(bool)


def met_lists(left: DataFrame, right: DataFrame, ids: list[str], threshold: float, most: int | None = None) -> DataFrame:
    """Candidate pairs (ids with ``l_`` and ``r_`` before them) of list entries ``term, *ids, rest``; a pair may come several times.

    A list with more than ``most`` members on the left is cut into slices that each meet all
    members on the right.
    """
    most = LIST if most is None else most
    left = cut(left)
    long_ = left.groupBy("term").agg(F.count("*").alias("n")).where(F.col("n") > most).select("term", F.ceil(F.col("n") / most).cast("int").alias("slices"))
    long_ = cut(long_)  # a fraction of 1 / most of the entries at most; the join is left to Spark by its size
    renamed = lambda d, side: d.select("term", *[F.col(c).alias(side + c) for c in [*ids, "rest"]])
    a, b, on = renamed(left, "l_"), renamed(right, "r_"), ["term"]
    if not long_.isEmpty():
        slices = F.coalesce("slices", F.lit(1))
        a = a.join(long_, "term", "left").withColumn("slice", F.pmod(F.xxhash64(*[f"l_{c}" for c in ids]), slices).cast("int")).drop("slices")
        b = b.join(long_, "term", "left").withColumn("slice", F.explode(F.sequence(F.lit(0), slices - 1))).drop("slices")
        on = ["term", "slice"]
    return a.join(b, on).where(F.col("l_rest") * F.col("r_rest") >= threshold - _SLACK).select(*[f"{side}_{c}" for side in "lr" for c in ids])


_ENTRY = "term bigint, id bigint, rest float"


def _entries(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """List entries of vectors ``id, parts array<struct<term, weight, most, lists>>``, those of one length class together."""
    for batch in batches:
        parts = batch.column(1)
        size = np.asarray(pc.list_value_length(parts).fill_null(0), np.int64)
        flat = parts.flatten()
        start = np.r_[0, np.cumsum(size)]
        field = {c: np.asarray(pc.struct_field(flat, c)) for c in ("term", "weight", "most", "lists")}
        classes = np.ceil(np.log2(np.maximum(size, 1))).astype(int)
        for c in np.unique(classes[size > 0]):
            rows = np.flatnonzero((classes == c) & (size > 0))
            at = np.arange(size[rows].max())
            inside = at < size[rows, None]
            pick = np.where(inside, start[rows, None] + at, 0)
            get = lambda name, none, pick=pick, inside=inside: np.where(inside, field[name][pick], none)
            terms, rest, keep = prefixes(get("term", 0), get("weight", 0.0), get("most", 0.0), get("lists", 0), threshold)
            r, col = np.nonzero(keep)
            yield pa.RecordBatch.from_arrays([pa.array(terms[r, col]), batch.column(0).take(pa.array(rows[r])), pa.array(rest[r, col].astype(np.float32))], names=["term", "id", "rest"])


def cosine_join(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """``left_id, right_id, dot`` of all pairs with a dot product of at least ``threshold`` (above 0).

    Both sides have ``id bigint`` (unique) and ``vector array<struct<term bigint, weight double>>``
    with positive weights and no term twice; vectors are brought to unit length. Null and empty
    vectors have no pairs.
    """

    def unit(d: DataFrame) -> DataFrame:
        d = d.where("id is not null and size(vector) > 0").select("id", "vector")
        norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x["weight"] * x["weight"]))
        return d.withColumn("n", norm).where("n > 0").select("id", F.transform("vector", lambda x: F.struct(x["term"].alias("term"), (x["weight"] / F.col("n")).alias("weight"))).alias("vector"))

    a, b = cut(unit(left)), cut(unit(right))
    rows = lambda d: d.select("id", F.explode("vector").alias("x")).select("id", "x.term", "x.weight")
    stats = lambda d: rows(d).groupBy("term").agg(F.max("weight").alias("most"), F.count("*").alias("n"))
    sa, sb = stats(a), stats(b)
    both = cut(sa.select("term", F.col("most").alias("la"), F.col("n").alias("na")).join(sb.select("term", F.col("most").alias("lb"), F.col("n").alias("nb")), "term").withColumn("lists", F.col("na") + F.col("nb")))

    def entries(d: DataFrame, other: str) -> DataFrame:
        parts = rows(d).join(both.select("term", F.col(other).alias("most"), "lists"), "term")
        parts = parts.groupBy("id").agg(F.collect_list(F.struct("term", "weight", "most", "lists")).alias("parts"))
        return parts.mapInArrow(lambda x: _entries(x, threshold), _ENTRY)

    pairs = met_lists(entries(a, "lb"), entries(b, "la"), ["id"], threshold).select(F.col("l_id").alias("left_id"), F.col("r_id").alias("right_id")).distinct()
    held = pairs.join(a.select(F.col("id").alias("left_id"), F.col("vector").alias("v")), "left_id").join(b.select(F.col("id").alias("right_id"), F.map_from_entries("vector").alias("m")), "right_id")
    dot = F.aggregate("v", F.lit(0.0), lambda s, x: s + x["weight"] * F.coalesce(F.try_element_at(F.col("m"), x["term"]), F.lit(0.0)))
    return held.select("left_id", "right_id", dot.alias("dot")).where(F.col("dot") >= threshold - 1e-12)
