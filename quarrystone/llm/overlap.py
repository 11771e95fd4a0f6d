"""Records of evaluation splits that also stand, exactly or nearly, in the training split.

Near copies are found by a weighted cosine join (``cosine``). A 128-bit fingerprint is the unit
vector of its signed bits, so two that differ in h bits have the dot product 1 - 2h/128, and "at
most 10 bits" is the threshold 1 - 20/128. Signed bits make lists of half of all records, so the
lists are kept for terms made of several bits: the bits fall into groups, of which one has few
differences; a group is cut into pieces, and its vector has a term of equal weight for each choice
of some pieces. Two fingerprints within the threshold have, in one of the groups, a dot product of
at least the design's own threshold, so the join on the groups' vectors misses none of them; the
exact dot product of the signed bits follows. The design is the cheapest for the numbers at hand.

Equal content hashes are a term of weight one of their own. Fingerprints are joined once per
distinct value and expanded to keys only at the end; counts are made from classes of equal hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations
from math import comb, exp

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrystone.llm.cosine import MAP_BITS, TermMap, met_lists, prefixes
from quarrystone.session import cut

BITS = 128
MOST_DIFFERENT = 10

# fixed values: spellings of split names, without punctuation
TRAIN = ["train", "training", "trn", "tr", "trainset", "trainsplit"]
VALIDATION = ["val", "valid", "validation", "validate", "dev", "devel", "development", "eval", "evaluation", "valset", "devset", "evalset", "validationset"]
TEST = ["test", "testing", "tst", "te", "testset", "holdout", "heldout", "holdoutset"]


def _named(token: Column) -> Column:
    t = F.regexp_replace(F.lower(token), r"[\s\p{Z}_.-]+", "")
    return F.when(t.isin(TRAIN), "train").when(t.isin(VALIDATION), "validation").when(t.isin(TEST), "test")


def split_of(split_name: Column, path: Column) -> Column:
    """``train``, ``validation``, ``test`` or null; the path's first telling folder counts where no name is given."""
    folders = F.slice(F.split(path, r"[/\\]+"), 1, F.greatest(F.size(F.split(path, r"[/\\]+")) - 1, F.lit(0)))
    by_path = F.element_at(F.filter(F.transform(folders, _named), lambda x: x.isNotNull()), 1)
    by_path = F.when(F.size(F.filter(F.transform(folders, _named), lambda x: x.isNotNull())) > 0, by_path)
    blank = split_name.isNull() | (F.trim(split_name) == "")
    return F.when(blank, by_path).otherwise(_named(split_name))


def sha256_of(value: Column) -> Column:
    """The 32 bytes of a SHA-256 value however it is spelled; null for anything else."""
    digits = F.regexp_extract(F.lower(F.trim(value)), r"^(?:sha-?256:)?\s*([0-9a-f]{64})$", 1)
    return F.when(digits != "", F.unhex(digits))


def _u64(digits: Column, at: int) -> Column:
    half = lambda i: F.conv(F.substring(digits, i, 8), 16, 10).cast("bigint")
    return F.shiftleft(half(at), 32).bitwiseOR(half(at + 8))


def records(candidates: DataFrame, samples: DataFrame) -> DataFrame:
    """Distinct ``key, resource_id, split, sha, high, low`` of all records that have a split."""

    def of(df: DataFrame, key: str, phash: Column) -> DataFrame:
        return df.select(F.col(key).alias("key"), "resource_id", split_of(F.col("split_name"), F.col("path")).alias("split"), sha256_of(F.col("content_hash")).alias("sha"), phash.alias("p"))

    print_ = F.lower(F.trim(F.col("phash")))
    both = of(candidates, "candidate_key", F.when(print_.rlike("^[0-9a-f]{32}$"), print_)).unionByName(of(samples, "sample_key", F.lit(None).cast("string")))
    both = both.where("key is not null and split is not null and (sha is not null or p is not null)")
    return both.select("key", "resource_id", "split", "sha", _u64(F.col("p"), 1).alias("high"), _u64(F.col("p"), 17).alias("low"))


def _cut_bits(first: int, size: int, parts: int) -> list[tuple[int, int]]:
    """Even pieces of a range of bits as (first, size)."""
    edges = [first + size * i // parts for i in range(parts + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


@dataclass(frozen=True)
class Design:
    """Terms as (group, bit ranges that must agree), and the least number of ``per_group`` terms that a near pair shares in some group."""

    terms: list[tuple[int, list[tuple[int, int]]]]
    per_group: int
    shared: int

    @property
    def threshold(self) -> float:
        return self.shared / self.per_group

    @property
    def kept(self) -> int:
        """Lists in which a fingerprint stands after pruning by maximum weights."""
        return len(self.terms) // self.per_group * (self.per_group - self.shared + 1)


def designs(bits: int = BITS, most: int = MOST_DIFFERENT) -> list[Design]:
    """Designs without a miss.

    The bits fall into g groups, one of which has at most d = most // g differences; cut into s
    pieces, that group has s - d whole pieces. One term for each choice of k pieces.
    """
    out = []
    for g in range(3, most + 2):
        d = most // g
        for s in range(d + 1, d + 5):
            for k in range(1, s - d + 1):
                n, shared = comb(s, k), comb(s - d, k)
                if (n - shared + 1) * g <= 64:
                    terms = [(i, list(c)) for i, (a, w) in enumerate(_cut_bits(0, bits, g)) for c in combinations(_cut_bits(a, w, s), k)]
                    out.append(Design(terms, n, shared))
    return out


def cheapest(train: int, evaluation: int, row_cost: float = 15.0) -> tuple[Design, bool]:
    """The design of least expected cost in compared pairs, and whether the terms of the evaluation side are mapped first.

    To move an entry costs ``row_cost`` pairs, to make a term one. With a map, terms of the training
    side that the evaluation side lacks weigh nothing and are not moved; that pays where the
    evaluation side is much the smaller one.
    """

    def cost(choice: tuple[Design, bool]) -> float:
        d, mapped = choice
        n = len(d.terms)
        chance = [2.0 ** -sum(b for _, b in t) for _, t in d.terms]
        met = [min(1.0, 1 - exp(-evaluation * c) + evaluation * n / 2**MAP_BITS) for c in chance] if mapped else [1.0] * n
        rows = d.kept / n * (train * sum(met) + evaluation * n) + mapped * evaluation * n
        return n * (train + evaluation) + row_cost * rows + sum(chance) * train * evaluation

    return min(((d, m) for d in designs() for m in (False, True)), key=cost)


def _mask(ranges: list[tuple[int, int]]) -> tuple[int, int]:
    bits = 0
    for a, n in ranges:
        bits |= ((1 << n) - 1) << (BITS - a - n)
    return bits >> 64, bits & ((1 << 64) - 1)


def _vectors(batches: Iterator[pa.RecordBatch], design: Design) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Fingerprints with the term numbers of their groups, as (rows, groups, terms of a group)."""
    masks = [_mask(t) for _, t in design.terms]
    for batch in batches:
        high, low = (np.asarray(batch.column(i)).view(np.uint64) for i in (0, 1))
        terms = np.empty((len(high), len(masks)), np.int64)
        with np.errstate(over="ignore"):
            for i, (h, w) in enumerate(masks):
                x = (high & np.uint64(h)) * np.uint64(0x9E3779B97F4A7C15) + (low & np.uint64(w)) * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(i + 1) * np.uint64(0x165667B19E3779F9)
                x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
                x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
                terms[:, i] = (x ^ (x >> np.uint64(32))).view(np.int64)
        yield batch, terms.reshape(len(high), -1, design.per_group)


_LIST = "term bigint, high bigint, low bigint, rest float"


def _listed(batches: Iterator[pa.RecordBatch], design: Design, met: TermMap | None) -> Iterator[pa.RecordBatch]:
    """Entries of the inverted lists; ``met`` has the terms of the other side, all others weigh nothing there."""
    weight = design.per_group**-0.5
    for batch, terms in _vectors(batches, design):
        n, g, k = terms.shape
        flat = terms.reshape(n * g, k)
        if design.shared == 1:  # each term alone reaches the threshold: nothing to put in order
            keep, rest = met.holds(flat) if met is not None else np.ones(flat.shape, bool), np.ones(flat.shape)
        else:
            most = weight * met.holds(flat) if met is not None else np.full(flat.shape, weight)
            flat, rest, keep = prefixes(flat, np.full(flat.shape, weight), most, None, design.threshold)
        at, col = np.nonzero(keep)
        row = pa.array(at // g)
        yield pa.RecordBatch.from_arrays([pa.array(flat[at, col]), batch.column(0).take(row), batch.column(1).take(row), pa.array(rest[at, col].astype(np.float32))], names=["term", "high", "low", "rest"])


def _marked(batches: Iterator[pa.RecordBatch], design: Design) -> Iterator[pa.RecordBatch]:
    for _, terms in _vectors(batches, design):
        yield TermMap.words(terms.ravel())


def near_prints(train: DataFrame, evaluation: DataFrame, most: int = MOST_DIFFERENT) -> DataFrame:
    """Pairs of fingerprints ``(th, tl, eh, el)`` that differ in at most ``most`` bits.

    Both sides are distinct ``(high, low)``.
    """
    design, mapped = cheapest(train.count(), evaluation.count())
    tasks = int(train.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    train, evaluation = train.repartition(tasks), evaluation.repartition(tasks)  # small rows, much work on each
    met = None
    if mapped:
        words = evaluation.mapInArrow(lambda b: _marked(b, design), TermMap.SCHEMA)
        met = train.sparkSession.sparkContext.broadcast(TermMap.collected(words))
    left = train.mapInArrow(lambda b: _listed(b, design, met and met.value), _LIST)
    right = evaluation.mapInArrow(lambda b: _listed(b, design, None), _LIST)
    pairs = met_lists(left, right, ["high", "low"], design.threshold)
    pairs = pairs.toDF("th", "tl", "eh", "el")
    differ = F.bit_count(F.col("th").bitwiseXOR(F.col("eh"))) + F.bit_count(F.col("tl").bitwiseXOR(F.col("el")))
    dot = F.lit(1.0) - differ * (2.0 / BITS)
    return pairs.where(dot >= 1 - 2.0 * most / BITS).distinct()


def cross_split_pairs(candidates: DataFrame, samples: DataFrame) -> DataFrame:
    """``(train_key, eval_key)`` of one training and one evaluation record that are the same or nearly.

    Same SHA-256 value, or fingerprints at most ``MOST_DIFFERENT`` bits apart; any resources. A
    key is never paired with itself; repeated listings give a pair once; records without a split,
    or with neither hash, give none.
    """
    r = cut(records(candidates, samples).select("key", (F.col("split") == "train").alias("train"), "sha", "high", "low").distinct())
    t, e = r.where("train"), r.where("not train")
    prints = lambda d: d.where("high is not null").select("high", "low").distinct()
    near = near_prints(cut(prints(t)), cut(prints(e)))
    return _expanded(t, e, near).where("train_key <> eval_key").distinct()


def _expanded(t: DataFrame, e: DataFrame, near: DataFrame) -> DataFrame:
    """``train_key, eval_key`` of rows ``key, sha, high, low`` of both sides with the same content or near fingerprints; may repeat."""
    of = lambda d, name, **columns: d.where(f"{next(iter(columns.values()))} is not null").select(*[F.col(c).alias(a) for a, c in columns.items()], F.col("key").alias(name)).distinct()
    same = of(t, "train_key", sha="sha").join(of(e, "eval_key", sha="sha"), "sha")
    by_print = near.join(of(t, "train_key", th="high", tl="low"), ["th", "tl"]).join(of(e, "eval_key", eh="high", el="low"), ["eh", "el"])
    return same.select("train_key", "eval_key").unionByName(by_print.select("train_key", "eval_key"))


def overlap_links(candidates: DataFrame, samples: DataFrame) -> DataFrame:
    """One row per record and hash that is met in the other split, without expanding groups of copies.

    ``key, split, content_class, same_links, print_class, near_links``: the classes are the hex
    values of the hashes; the links count distinct records of the other side with the same
    content, and with a fingerprint at most ``MOST_DIFFERENT`` bits away. A record listed with
    several hashes has several rows; a key listed on both sides counts on both.
    """
    r = cut(records(candidates, samples).withColumn("train", F.col("split") == "train").select("key", "split", "train", "sha", "high", "low").distinct())
    both = lambda df, by: df.groupBy(*by).agg(F.countDistinct(F.when(F.col("train"), F.col("key"))).alias("t"), F.countDistinct(F.when(~F.col("train"), F.col("key"))).alias("e"))
    other = lambda t, e: F.when(F.col("train"), F.col(e)).otherwise(F.col(t))
    shas = both(r.where("sha is not null"), ["sha"]).where("t > 0 and e > 0").select("sha", F.col("t").alias("st"), F.col("e").alias("se"))
    prints = cut(both(r.where("high is not null"), ["high", "low"]))
    near = cut(near_prints(prints.where("t > 0").select("high", "low"), prints.where("e > 0").select("high", "low")))
    size = lambda h, w, n, c: prints.select(F.col("high").alias(h), F.col("low").alias(w), F.col(n).alias(c))
    of_train = near.join(size("eh", "el", "e", "n"), ["eh", "el"]).groupBy("th", "tl").agg(F.sum("n").alias("n")).select(F.lit(True).alias("train"), F.col("th").alias("high"), F.col("tl").alias("low"), "n")
    of_eval = near.join(size("th", "tl", "t", "n"), ["th", "tl"]).groupBy("eh", "el").agg(F.sum("n").alias("n")).select(F.lit(False).alias("train"), F.col("eh").alias("high"), F.col("el").alias("low"), "n")
    out = r.join(shas, "sha", "left").join(of_train.unionByName(of_eval), ["train", "high", "low"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    hexed = lambda c: F.lpad(F.lower(F.hex(c)), 16, "0")
    out = out.select(
        "key", "split", F.lower(F.hex("sha")).alias("content_class"), zero(other("st", "se")).alias("same_links"),
        F.concat(hexed("high"), hexed("low")).alias("print_class"), zero(F.col("n")).alias("near_links"),
    )
    return out.where("same_links > 0 or near_links > 0")


def overlap_counts(candidates: DataFrame, samples: DataFrame) -> DataFrame:
    """Per evaluation split and resource of the evaluation record: pairs and affected records.

    Pairs are those of ``cross_split_pairs``, counted without listing them: records with one
    content hash and one fingerprint form classes, and links are added up between classes (same
    content, plus near fingerprints, less both). Only records listed with several values, or on
    both sides, have their own pairs listed.
    """
    r = cut(records(candidates, samples).withColumn("train", F.col("split") == "train"))
    own = F.struct("high", "low")
    print_ = F.when(F.col("high").isNotNull(), own)
    keys = r.groupBy("key").agg(
        *[f(x).alias(f"{n}{i}") for i, f in enumerate((F.min, F.max)) for n, x in (("sha", F.col("sha")), ("print", print_), ("train", F.col("train")))]
    )
    plain = F.coalesce(F.col("sha0") == F.col("sha1"), F.lit(True)) & F.coalesce(F.col("print0") == F.col("print1"), F.lit(True)) & (F.col("train0") == F.col("train1"))
    keys = cut(keys.select("key", F.col("train0").alias("train"), F.col("sha0").alias("sha"), F.col("print0.high").alias("high"), F.col("print0.low").alias("low"), plain.alias("plain")))
    prints = lambda train: r.where(F.col("train") == train).where("high is not null").select("high", "low").distinct()
    near = cut(near_prints(cut(prints(True)), cut(prints(False))))
    classes = lambda train: keys.where("plain").where(F.col("train") == train).groupBy("sha", "high", "low").agg(F.count("*").alias("n"))
    t = classes(True)
    e = classes(False).select(F.col("sha").alias("esha"), F.col("high").alias("eh"), F.col("low").alias("el"))
    same = e.join(t.where("sha is not null").groupBy(F.col("sha").alias("esha")).agg(F.sum("n").alias("n")), "esha").select("esha", "eh", "el", "n")
    by_print = near.join(t.where("high is not null").groupBy(F.col("high").alias("th"), F.col("low").alias("tl")).agg(F.sum("n").alias("n")), ["th", "tl"]).groupBy("eh", "el").agg(F.sum("n").alias("n"))
    close = e.join(by_print, ["eh", "el"]).select("esha", "eh", "el", "n")
    both = e.join(t.where("sha is not null and high is not null").select(F.col("sha").alias("esha"), F.col("high").alias("th"), F.col("low").alias("tl"), "n"), "esha").join(near, ["th", "tl", "eh", "el"]).select("esha", "eh", "el", (-F.col("n")).alias("n"))
    links = same.unionByName(close).unionByName(both).groupBy("esha", "eh", "el").agg(F.sum("n").alias("n"))
    safe = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    counted = keys.where("plain and not train").join(links, safe("sha", "esha") & safe("high", "eh") & safe("low", "el")).select(F.col("key").alias("eval_key"), "n")
    # what is listed: pairs with a record of several values on one side or the other
    odd = keys.where("not plain").select("key")
    side = lambda train: r.where(F.col("train") == train).select("key", "sha", "high", "low").distinct()
    listed = _expanded(side(True), side(False).join(odd, "key", "left_semi"), near).unionByName(_expanded(side(True).join(odd, "key", "left_semi"), side(False).join(odd, "key", "left_anti"), near))
    listed = listed.where("train_key <> eval_key").distinct().groupBy("eval_key").agg(F.count("*").alias("n"))
    pairs = counted.unionByName(listed).groupBy("eval_key").agg(F.sum("n").alias("n")).where("n > 0")
    who = r.where("not train").select(F.col("key").alias("eval_key"), "split", "resource_id").distinct()
    return pairs.join(who, "eval_key").groupBy("split", "resource_id").agg(F.sum("n").cast("bigint").alias("pairs"), F.countDistinct("eval_key").alias("records"))
