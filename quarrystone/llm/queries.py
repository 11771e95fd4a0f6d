"""Queries of the training-data operators over the project's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrystone.llm import leaks, mixing, overlap, truncation, variety
from quarrystone.session import table

Query = Callable[[SparkSession, str], DataFrame]


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = overlap.cross_split_pairs(table(spark, d, "image_candidates"), table(spark, d, "sample_refs"))
    return pairs.select(F.least("train_key", "eval_key").alias("key_a"), F.greatest("train_key", "eval_key").alias("key_b")).distinct()


def p2_counts(spark: SparkSession, d: str) -> DataFrame:
    return overlap.overlap_counts(table(spark, d, "image_candidates"), table(spark, d, "sample_refs"))


def p2_links(spark: SparkSession, d: str) -> DataFrame:
    return overlap.overlap_links(table(spark, d, "image_candidates"), table(spark, d, "sample_refs"))


def p4_subset(spark: SparkSession, d: str) -> DataFrame:
    return variety.varied_subset(table(spark, d, "image_candidates"), table(spark, d, "sampling_summaries"))


def p4_coverage(spark: SparkSession, d: str) -> DataFrame:
    return variety.coverage_report(table(spark, d, "image_candidates"), table(spark, d, "sampling_summaries"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaked_items(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p6_clean(spark: SparkSession, d: str) -> DataFrame:
    clean = leaks.without_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))
    return clean.select("doc_id", "text", "removed_bytes")


def p6_items(spark: SparkSession, d: str) -> DataFrame:
    found = leaks.leaked_items(table(spark, d, "documents"), table(spark, d, "eval_items"))
    items = table(spark, d, "eval_items").select("item_id", "split_name")
    return items.join(found, "item_id", "left").groupBy("item_id", "split_name").agg(F.count("doc_id").alias("documents"))


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mixture(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mixture(table(spark, d, "documents"), table(spark, d, "mix_targets"))[1]


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return truncation.truncation_report(table(spark, d, "documents")).select("doc_id")


def p8_rates(spark: SparkSession, d: str) -> DataFrame:
    return truncation.truncation_rates(table(spark, d, "documents"))


QUERIES: dict[str, Query] = {
    f.__name__: f for f in (p2_found, p2_counts, p2_links, p4_subset, p4_coverage, p6_found, p6_clean, p6_items, p7_mix, p7_shares, p8_found, p8_rates)
}

_GRAMS = """
SELECT {id} AS id, unnest([array_to_string(w[i:i + 9], ' ') for i in range(1, greatest(len(w) - 8, 1))]) AS gram
FROM (SELECT {id}, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM {table}) WHERE len(w) >= 10"""

_SPLIT = r"""
  CASE WHEN k IN ('train', 'training', 'trn', 'tr', 'trainset', 'trainsplit') THEN 'train' WHEN k IS NULL OR k = '' THEN NULL
       WHEN regexp_full_match(k, '(val|valid|validation|validate|dev|devel|development|eval|evaluation|test|testing|tst|te|holdout|heldout)(set)?') THEN 'eval' END"""
_FOLDER = r"regexp_extract('/' || lower(replace(path, '\\', '/')), '/(train|training|trn|tr|val|valid|validation|validate|dev|devel|development|eval|evaluation|test|testing|tst|te|hold[-_ .]?out|held[-_ .]?out)/', 1)"
_P2 = f"""
WITH r AS (
  SELECT candidate_key AS key, split_name, path, content_hash, CASE WHEN regexp_full_match(lower(trim(phash)), '[0-9a-f]{{{{32}}}}') THEN lower(trim(phash)) END AS p FROM image_candidates
  UNION ALL SELECT sample_key, split_name, path, content_hash, NULL FROM sample_refs),
n AS (SELECT key, p, nullif(regexp_extract(lower(trim(content_hash)), '^(?:sha-?256:)?([0-9a-f]{{{{64}}}})$', 1), '') AS h,
  regexp_replace(lower(CASE WHEN split_name IS NULL OR trim(split_name) = '' THEN {_FOLDER} ELSE split_name END), '[-_. ]+', '', 'g') AS k FROM r),
s AS (SELECT DISTINCT key, h, CAST('0x' || substr(p, 1, 16) AS UBIGINT) AS hi, CAST('0x' || substr(p, 17, 16) AS UBIGINT) AS lo, {_SPLIT} AS side FROM n)
SELECT DISTINCT least(t.key, e.key) AS key_a, greatest(t.key, e.key) AS key_b
FROM (SELECT * FROM s WHERE side = 'train') t JOIN (SELECT * FROM s WHERE side = 'eval') e
  ON t.key <> e.key AND (t.h = e.h OR bit_count(xor(t.hi, e.hi)) + bit_count(xor(t.lo, e.lo)) <= 10)""".replace("{{", "{").replace("}}", "}")

_P6 = f"""
WITH item_grams AS (SELECT DISTINCT * FROM ({_GRAMS.format(id="item_id", table="eval_items")})),
     doc_grams AS ({_GRAMS.format(id="doc_id", table="documents")})
SELECT DISTINCT doc_grams.id AS doc_id, item_grams.id AS item_id FROM doc_grams JOIN item_grams USING (gram)"""
_WHO = _P2[: _P2.index("SELECT DISTINCT least")].replace("SELECT candidate_key AS key,", "SELECT candidate_key AS key, resource_id,").replace("SELECT sample_key,", "SELECT sample_key, resource_id,").replace("n AS (SELECT key,", "n AS (SELECT key, resource_id,")

SQL: dict[str, str] = {
    "p2_found": _P2,
    "p2_counts": f"""
{_WHO},
w AS (SELECT DISTINCT key, resource_id, CASE WHEN regexp_full_match(k, '(test|testing|tst|te|holdout|heldout)(set)?') THEN 'test' ELSE 'validation' END AS split FROM (SELECT *, {_SPLIT} AS side FROM n) WHERE side = 'eval'),
t AS (SELECT DISTINCT key FROM s WHERE side = 'train'),
pairs AS (SELECT * FROM ({_P2})),
d AS (SELECT DISTINCT e.key AS e, o.key AS o FROM pairs p JOIN (SELECT DISTINCT key FROM w) e ON e.key IN (p.key_a, p.key_b) JOIN t o ON o.key IN (p.key_a, p.key_b) AND o.key <> e.key)
SELECT split, resource_id, count(*) AS pairs, count(DISTINCT e) AS records FROM d JOIN w ON w.key = d.e GROUP BY 1, 2""",
    "p2_links": f"""
{_WHO.replace("s AS (SELECT DISTINCT key, h,", "s AS (SELECT DISTINCT key, h, p, k,")},
x AS (SELECT DISTINCT key, h, p, hi, lo, side, CASE WHEN side = 'train' THEN 'train' WHEN regexp_full_match(k, '(test|testing|tst|te|holdout|heldout)(set)?') THEN 'test' ELSE 'validation' END AS split FROM s WHERE side IS NOT NULL AND (h IS NOT NULL OR p IS NOT NULL)),
sc AS (SELECT h, side, count(DISTINCT key) AS n FROM x WHERE h IS NOT NULL GROUP BY 1, 2),
pc AS (SELECT p, hi, lo, side, count(DISTINCT key) AS n FROM x WHERE p IS NOT NULL GROUP BY 1, 2, 3, 4),
nl AS (SELECT a.p, a.side, sum(b.n) AS n FROM pc a JOIN pc b ON a.side <> b.side AND bit_count(xor(a.hi, b.hi)) + bit_count(xor(a.lo, b.lo)) <= 10 GROUP BY 1, 2)
SELECT key, split, x.h AS content_class, CAST(coalesce(sc.n, 0) AS BIGINT) AS same_links, x.p AS print_class, CAST(coalesce(nl.n, 0) AS BIGINT) AS near_links
FROM x LEFT JOIN sc ON sc.h = x.h AND sc.side <> x.side LEFT JOIN nl ON nl.p = x.p AND nl.side = x.side WHERE sc.n > 0 OR nl.n > 0""",
    "p6_found": _P6,
    "p6_items": f"SELECT i.item_id, i.split_name, count(doc_id) AS documents FROM eval_items i LEFT JOIN ({_P6}) f ON f.item_id = i.item_id GROUP BY 1, 2",
}
