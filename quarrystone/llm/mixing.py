"""Mixing sources to target shares of all tokens (Efraimidis-Spirakis sampling).

Within its source each document has an exponential key divided by its quality weight; the
documents with the smallest keys are a weighted sample without replacement. A source that must
give more than it holds is first taken whole, as often as it fits, and the rest of its budget is
filled in key order by a prefix sum of tokens. The prefix sum runs over buckets of keys first and
inside one bucket per source last, so that no task sorts a whole source.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrystone.llm.truncation import plain_source
from quarrystone.session import cut

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# fixed value: the pattern that splits text before the merges of the rank files
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
PIECE = 1 << 18
_BREAK = re.compile(r"(?<=\S)\n(?=\S)")
BUCKETS, BUCKET_ROWS = 4096, 50_000  # least number of key buckets, and about the most rows in one
TOLERANCE = 0.002  # of a source's budget that may stay unfilled while documents that fit are left
SEED = 42
MOST_TARGETS = 10_000


@lru_cache(maxsize=2)
def _encoding(path: str):  # noqa: ANN202
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _pieces(text: str) -> Iterator[str]:
    """A text in pieces of about ``PIECE`` signs whose tokens are those of the whole.

    A single line break between two other signs is a token of its own, so a cut behind it changes nothing.
    """
    at = 0
    while len(text) - at > PIECE:
        m = _BREAK.search(text, at + PIECE)
        if not m:
            break
        yield text[at : m.end()]
        at = m.end()
    yield text[at:] if at else text


def _count(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    encode = _encoding(path).encode_ordinary
    for batch in batches:
        n = [len(encode(t)) if len(t) <= PIECE else sum(len(encode(x)) for x in _pieces(t)) for t in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), pa.array(n, pa.int64())], names=["doc_id", "source", "chars", "tokens"])


def counted(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """``doc_id, source, chars, tokens`` of every document with a text and an id."""
    rows = documents.where("text is not null and doc_id is not null")
    rows = rows.select(F.col("doc_id").cast("bigint").alias("doc_id"), plain_source(F.col("source")).alias("source"), "text", F.char_length("text").cast("bigint").alias("chars"))
    return rows.mapInArrow(lambda b: _count(b, tokenizer), "doc_id bigint, source string, chars bigint, tokens bigint")


def quality_weight() -> F.Column:
    """Weight of a document: characters per token over four, between 0.1 and 1.

    Text that the tokenizer needs many pieces for (encoded binaries, hashes) weighs less.
    """
    return F.greatest(F.lit(0.1), F.least(F.lit(1.0), F.col("chars") / F.col("tokens") / 4))


def plan_budgets(targets: list[tuple[str, float, int]], held: dict[str, int], total: int | None = None) -> tuple[int, dict[str, int]]:
    """Total size and token budget of each source.

    Shares of sources without documents go to the others in proportion. Without a given total
    it is the largest at which no source must be repeated more often than allowed; with one, it
    is lowered to that.
    """
    live = [(s, share, most) for s, share, most in targets if held.get(s, 0) > 0 and share > 0 and most > 0]
    whole = sum(share for _, share, _ in live)
    if not live:
        return 0, {}
    most = min(int(most * held[s] * whole / share) for s, share, most in live)
    total = most if total is None else min(total, most)
    return total, {s: min(int(total * share / whole), m * held[s]) for s, share, m in live}


def _stops(keyed: DataFrame, rests: dict[str, int], behind: dict[str, tuple[float, int]], buckets: int) -> dict[str, tuple[float | None, int | None, int]]:
    """Per source the first document in key order that does not fit, and the tokens of those before it.

    Documents larger than the rest are passed over, as are those up to ``behind``. No document
    where all the others fit.
    """
    spark = keyed.sparkSession
    plan = spark.createDataFrame([(s, r, *behind.get(s, (-1.0, 0))) for s, r in rests.items()], "source string, rest bigint, from_key double, from_id bigint")
    open_ = keyed.join(plan, "source").where("tokens <= rest and (key > from_key or (key = from_key and doc_id > from_id))")
    open_ = open_.withColumn("bucket", F.floor(F.lit(buckets) * F.col("key") / (F.col("key") + 1)))
    sums = open_.groupBy("source", "bucket").agg(F.sum("tokens").alias("sum"), F.max("rest").alias("rest"))
    before = F.sum("sum").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.withColumn("before", F.coalesce(before, F.lit(0)))
    edge = sums.where("before <= rest and before + sum > rest").drop("rest", "sum")
    run = F.sum("tokens").over(Window.partitionBy("source").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    inside = open_.join(edge, ["source", "bucket"]).withColumn("run", F.col("before") + run)
    stop = inside.where("run > rest").groupBy("source").agg(F.min(F.struct("key", "doc_id", (F.col("run") - F.col("tokens")).alias("used"))).alias("s"))
    total = sums.groupBy("source").agg(F.sum("sum").alias("all"))
    rows = total.join(stop, "source", "left").select("source", "s.key", "s.doc_id", F.coalesce("s.used", "all").alias("used")).collect()
    return {r.source: (r.key, r.doc_id, r.used) for r in rows}


def mixture(documents: DataFrame, mix_targets: DataFrame, tokenizer: str = TOKENIZER, total: int | None = None, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """Chosen documents ``doc_id, source, repeats, tokens`` and the shares ``source, ...`` reached.

    Every document of a source is taken the same number of whole times, and some once more. No
    source exceeds its budget; what stays unfilled is at most ``TOLERANCE`` of the budget or less
    than the smallest document left. Documents without text, tokens or a wanted source are not
    chosen. Sources are compared without case and surrounding blanks; targets that name one source
    twice are added up, with the larger number of repeats.
    """
    docs = cut(counted(documents, tokenizer).where("tokens > 0"))
    wanted = mix_targets.where("source is not null").groupBy(plain_source(F.col("source")).alias("source"))
    wanted = wanted.agg(F.sum(F.coalesce("target_share", F.lit(0.0))).alias("share"), F.max(F.coalesce("max_repeats", F.lit(1))).alias("most")).orderBy("source").take(MOST_TARGETS + 1)
    if len(wanted) > MOST_TARGETS:
        raise ValueError(f"more than {MOST_TARGETS} target sources")
    spark = documents.sparkSession
    names = [w.source for w in wanted]
    ours = docs.where(F.col("source").isin(names))
    counts = {r.source: (r.tokens, r.rows) for r in ours.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("rows")).collect()}
    held = {s: tokens for s, (tokens, _) in counts.items()}
    size, budget = plan_budgets([(w.source, w.share, w.most) for w in wanted], held, total)
    u = (F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(seed)), 11) + 0.5) / float(1 << 53)
    keyed = ours.withColumn("key", -F.log(u) / quality_weight())
    buckets = max([BUCKETS, *(rows // BUCKET_ROWS for _, rows in counts.values())])
    rests = {s: b - b // held[s] * held[s] for s, b in budget.items()}
    left = {s: r for s, r in rests.items() if r > 0}
    behind: dict[str, tuple[float, int]] = {}
    spans: dict[str, list] = {s: [] for s in budget}
    while left:
        found = _stops(keyed, left, behind, buckets)
        for s in list(left):
            if s not in found:  # nothing that fits is left
                del left[s]
                continue
            key, doc, used = found[s]
            spans[s].append((*behind.get(s, (-1.0, 0)), key, doc, left[s]))
            left[s] -= used
            if key is None or left[s] <= TOLERANCE * budget[s]:
                del left[s]
            else:
                behind[s] = (key, doc)
    rows = [(s, b // held[s], spans[s]) for s, b in budget.items()]
    span = "struct<from_key:double,from_id:bigint,to_key:double,to_id:bigint,most:bigint>"
    plan = spark.createDataFrame(rows, f"source string, epochs bigint, spans array<{span}>")
    key, doc = F.col("key"), F.col("doc_id")
    after = lambda k, d: (key > k) | ((key == k) & (doc > d))
    inside = lambda x: (F.col("tokens") <= x["most"]) & after(x["from_key"], x["from_id"]) & (x["to_key"].isNull() | (key < x["to_key"]) | ((key == x["to_key"]) & (doc < x["to_id"])))
    more = F.exists("spans", inside).cast("bigint")
    chosen = keyed.join(plan, "source").select("doc_id", "source", (F.col("epochs") + more).alias("repeats"), "tokens").where("repeats > 0")
    goals = spark.createDataFrame([(w.source, float(w.share), int(w.most), held.get(w.source, 0), budget.get(w.source, 0)) for w in wanted], "source string, target_share double, max_repeats int, held_tokens bigint, budget_tokens bigint")
    got = chosen.groupBy("source").agg(F.count("*").alias("documents"), F.sum(F.col("repeats") * F.col("tokens")).alias("mixed_tokens"), F.max("repeats").alias("repeats"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    shares = goals.join(got, "source", "left").select(*goals.columns, zero("documents"), zero("mixed_tokens"), zero("repeats"))
    all_tokens = F.sum("mixed_tokens").over(Window.partitionBy())
    shares = shares.withColumn("actual_share", F.coalesce(F.col("mixed_tokens") / F.nullif(all_tokens, F.lit(0)), F.lit(0.0)))
    return chosen, shares
