"""Held-out texts inside a corpus: broadcast set of test n-grams, scanned token windows.

The n-grams of the test items go to every task as one sorted array of hashes with the n-grams
behind them. The corpus is scanned as bytes: word bounds, word hashes and window hashes are
computed for whole batches at once, and only windows whose hash is in the set are compared word
by word, so a reported hit is exact. Only a set of bounded size is broadcast like this; of a larger
one the tasks get a bit map of fixed size, and the windows it lets through are joined with the
n-grams by hash and words. Either way the corpus is scanned once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrystone.session import cut

WORDS = 10
MOST_ITEM_BYTES = 2 << 20  # of test text in one broadcast block; about 100 MB with its n-grams
SLICE_BYTES = 2 << 20
MAP_BITS = 27  # of the bit map of a larger test set: 16 MB

_B = np.uint64(0x9E3779B97F4A7C15)
_BINV = np.uint64(pow(int(_B), -1, 1 << 64))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = True
_ODD = re.compile("[\u212a\u0130]")  # the two non-ASCII letters whose lower case holds an ASCII letter


def words(text: str) -> list[str]:
    """Runs of letters a-z and digits after lower-casing."""
    return re.findall("[a-z0-9]+", text.lower())


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


class Scanner:
    """Word and window hashes of byte buffers; keeps the power tables."""

    def __init__(self, n: int = WORDS) -> None:
        self.n, self.up, self.down = n, _powers(_B, 1), _powers(_BINV, 1)

    def tokens(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and hash of each word in lower-cased bytes; words do not cross ``bounds``."""
        size = len(data)
        if size + 1 > len(self.up):
            self.up, self.down = _powers(_B, size + 1), _powers(_BINV, size + 1)
        inside = _WORD[data]
        first, final = inside.copy(), inside.copy()
        cut = np.zeros(size + 1, bool)
        cut[bounds] = True
        first[1:] &= ~inside[:-1] | cut[1:-1]
        final[:-1] &= ~inside[1:] | cut[1:-1]
        start, end = np.flatnonzero(first), np.flatnonzero(final) + 1
        with np.errstate(over="ignore"):
            run = np.zeros(size + 1, np.uint64)
            np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.up[:size], dtype=np.uint64, out=run[1:])
            h = (run[end] - run[start]) * self.down[start]
            h ^= h >> np.uint64(29)
            h *= np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(32)
        return start, end, h

    def long_tokens(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``tokens`` of one text of any length, piece by piece; pieces end between words."""
        parts, at = [], 0
        while at < len(data) or not parts:
            end = min(len(data), at + SLICE_BYTES)
            while end < len(data) and _WORD[data[end]]:
                end += 1
            start, stop, h = self.tokens(data[at:end], np.array([0, end - at]))
            parts.append((start + at, stop + at, h))
            at = end
        return tuple(np.concatenate(x) for x in zip(*parts))

    def windows(self, h: np.ndarray) -> np.ndarray:
        """Hash of each run of ``n`` words."""
        m = len(h) - self.n + 1
        if m <= 0:
            return np.zeros(0, np.uint64)
        with np.errstate(over="ignore"):
            w = np.zeros(m, np.uint64)
            for j in range(self.n):
                w = w * np.uint64(0x94D049BB133111EB) + h[j : j + m]
            return w ^ (w >> np.uint64(31))


class Grams:
    """The n-grams of a block of test items."""

    def __init__(self, items: list[tuple[int, str]], n: int = WORDS) -> None:
        self.n, self.of = n, {}
        scan = Scanner(n)
        for item, text in items:
            data = np.frombuffer(" ".join(words(text)).encode(), np.uint8)
            start, end, h = scan.tokens(data, np.array([0, len(data)]))
            raw = data.tobytes()
            for k, w in enumerate(scan.windows(h)):
                held = self.of.setdefault(int(w), {}).setdefault(raw[start[k] : end[k + n - 1]], [])
                if item not in held:
                    held.append(item)
        self.keys = np.sort(np.fromiter(self.of, np.uint64, len(self.of)))
        self.bits = np.zeros(1 << 20, bool)
        self.bits[(self.keys >> np.uint64(44)).astype(np.int64)] = True

    def hits(self, w: np.ndarray) -> np.ndarray:
        """Indices of the window hashes that are in the set."""
        if not len(self.keys):
            return np.zeros(0, np.int64)
        maybe = np.flatnonzero(self.bits[(w >> np.uint64(44)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.keys, w[maybe]), len(self.keys) - 1)
        return maybe[self.keys[at] == w[maybe]]


def _slices(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``SLICE_BYTES``; a longer text stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + SLICE_BYTES, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def scan_texts(texts: pa.Array, grams: Grams, scan: Scanner) -> Iterator[tuple[int, int, int, list[int]]]:
    """Verified hits as (row, first byte, end byte, items); bytes are those of the stored text."""
    for row, first, end, w, text in _hits(texts, grams, scan):
        if items := grams.of[w].get(text):
            yield row, first, end, items


def _hits(texts: pa.Array, grams: Grams, scan: Scanner) -> Iterator[tuple[int, int, int, int, bytes]]:
    """Windows whose hash is in the set as (row, first byte, end byte, hash, words)."""
    stored = texts
    odd = [i for i, t in enumerate(texts.to_pylist()) if t and _ODD.search(t)] if _has_odd(texts) else []
    if odd:
        rows = texts.to_pylist()
        for i in odd:
            rows[i] = rows[i].replace("K", "k").replace("İ", "i̇")
        texts = pa.array(rows, pa.string())
    moved = set(odd)
    texts = texts.cast(pa.large_string())
    n = len(texts)
    _, off, buf = texts.buffers()
    offsets = np.frombuffer(off, np.int64)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, np.int64)
    whole = np.frombuffer(buf, np.uint8) if buf is not None else np.zeros(0, np.uint8)
    for i, j in _slices(offsets):
        base = offsets[i]
        data = _LOWER[whole[base : offsets[j]]]
        bounds = offsets[i : j + 1] - base
        start, end, h = scan.tokens(data, bounds) if j > i + 1 else scan.long_tokens(data)
        w = scan.windows(h)
        hit = grams.hits(w)
        if not len(hit):
            continue
        row = np.searchsorted(bounds, start[hit], "right") - 1
        same = end[hit + grams.n - 1] <= bounds[row + 1]
        for k, r in zip(hit[same], row[same]):
            raw = data[start[k] : end[k + grams.n - 1]]
            text = b" ".join(re.findall(rb"[a-z0-9]+", raw.tobytes()))
            a, b = int(start[k] - bounds[r]), int(end[k + grams.n - 1] - bounds[r])
            if i + int(r) in moved:
                a, b = _stored_span(stored[i + int(r)].as_py(), a, b)
            yield i + int(r), a, b, int(w[k]), text


def _stored_span(text: str, first: int, end: int) -> tuple[int, int]:
    """The bytes of a text that stand behind bytes of its scanned form, in which two letters have other lengths."""
    shift, out = 0, [first, end]
    for m in _ODD.finditer(text):
        was = len(m.group().encode())
        now = 1 if m.group() == "\u212a" else 3
        at = len(text[: m.start()].encode())  # in the stored text
        for k, edge in enumerate((first, end)):
            if edge + shift >= at + now:  # behind the letter
                out[k] = edge + shift + was - now
            elif edge + shift > at:  # inside it
                out[k] = at + was * k
        shift += was - now
    return out[0], out[1]


def _has_odd(texts: pa.Array) -> bool:
    return bool(pc.any(pc.match_substring(texts, "K")).as_py() or pc.any(pc.match_substring(texts, "İ")).as_py())


def _small_set(items: DataFrame, item_id: str, text: str) -> Grams | None:
    """The n-grams of all items; None if their text is larger than ``MOST_ITEM_BYTES``."""
    rows = items.where(F.col(text).isNotNull() & F.col(item_id).isNotNull()).select(F.col(item_id).cast("bigint").alias("i"), F.col(text).alias("t")).distinct()
    total = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    return Grams([(r.i, r.t) for r in rows.collect()]) if total <= MOST_ITEM_BYTES else None


def _corpus(documents: DataFrame) -> DataFrame:
    return documents.where("text is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")


def _item_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            own = Grams([(item, text)])
            rows = [(np.uint64(w).view(np.int64), g.decode()) for w, grams in own.of.items() for g in grams]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()), pa.array([item] * len(rows), pa.int64())], names=["hash", "words", "item_id"])


class _Marked(Grams):
    """A bit map of n-gram hashes in place of the n-grams."""

    def __init__(self, words: dict[int, int]) -> None:
        self.n, self.map = WORDS, np.zeros(1 << (MAP_BITS - 5), np.uint32)
        self.map[list(words)] = list(words.values())

    def hits(self, w: np.ndarray) -> np.ndarray:
        at = w >> np.uint64(64 - MAP_BITS)
        return np.flatnonzero((self.map[(at >> np.uint64(5)).astype(np.int64)] >> (at & np.uint64(31)).astype(np.uint32)) & np.uint32(1))


def _marked_windows(batches: Iterator[pa.RecordBatch], marked: _Marked) -> Iterator[pa.RecordBatch]:
    scan = Scanner(marked.n)
    for batch in batches:
        rows = list(_hits(batch.column(1), marked, scan))
        ids = batch.column(0).take(pa.array([r[0] for r in rows], pa.int64()))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays([ids, *[pa.array(c, k) for c, k in zip(zip(*[(a, b, int(np.uint64(w).view(np.int64)), t.decode()) for _, a, b, w, t in rows]) if rows else [()] * 4, kinds)]], names=["doc_id", "first", "end", "hash", "words"])


def _joined_hits(documents: DataFrame, items: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """``doc_id, first, end, item_id`` of every hit of a test set of any size."""
    rows = items.where(F.col(text).isNotNull() & F.col(item_id).isNotNull()).select(F.col(item_id).cast("bigint").alias("i"), F.col(text).alias("t")).distinct()
    grams = cut(rows.mapInArrow(_item_grams, "hash bigint, words string, item_id bigint").distinct())
    at = F.shiftrightunsigned("hash", 64 - MAP_BITS)
    bits = grams.select(at.alias("at")).groupBy(F.shiftright("at", 5).cast("int").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(at & 31 as int)))").alias("bits"))
    marked = documents.sparkSession.sparkContext.broadcast(_Marked({r.word: r.bits for r in bits.toLocalIterator()}))  # at most 2 ** MAP_BITS bits
    hits = _corpus(documents).mapInArrow(lambda b: _marked_windows(b, marked.value), "doc_id bigint, first bigint, end bigint, hash bigint, words string")
    return hits.join(grams, ["hash", "words"]).select("doc_id", "first", "end", "item_id")


def _pairs(batches: Iterator[pa.RecordBatch], grams: Grams) -> Iterator[pa.RecordBatch]:
    scan = Scanner(grams.n)
    for batch in batches:
        found = {(r, i) for r, _, _, items in scan_texts(batch.column(1), grams, scan) for i in items}
        rows, ids = ([x[k] for x in sorted(found)] for k in (0, 1))
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(ids, pa.int64())], names=["doc_id", "item_id"])


def leaked_items(documents: DataFrame, items: DataFrame) -> DataFrame:
    """``(doc_id, item_id)`` for each document with at least ``WORDS`` consecutive words of an item.

    Shorter items cannot be found; null and empty texts hold nothing; a repeated hit gives one
    row; items that share a passage are all named. Memory does not depend on the longest text
    beyond that text itself.
    """
    grams = _small_set(items, "item_id", "text")
    if grams is None:
        return _joined_hits(documents, items).select("doc_id", "item_id").distinct()
    held = documents.sparkSession.sparkContext.broadcast(grams)
    return _corpus(documents).mapInArrow(lambda b: _pairs(b, held.value), "doc_id bigint, item_id bigint").distinct()


def _cut_out(batches: Iterator[pa.RecordBatch], grams: Grams, at: int, whole: bool) -> Iterator[pa.RecordBatch]:
    """The batches without leaked passages (in column ``at``) or without the rows that hold any; the last column is replaced by the bytes removed."""
    scan = Scanner(grams.n)
    for batch in batches:
        texts, spans = batch.column(at), {}
        for r, a, b, _ in scan_texts(texts.fill_null(""), grams, scan):
            held = spans.setdefault(r, [])
            if held and a <= held[-1][1]:
                held[-1][1] = max(b, held[-1][1])
            else:
                held.append([a, b])
        rows = sorted(spans)
        mask = np.zeros(len(batch), bool)
        mask[rows] = True
        if whole:
            yield batch.filter(pa.array(~mask))
            continue
        removed = np.zeros(len(batch), np.int64)
        kept = []
        for r in rows:
            kept.append(_without(texts[r].as_py(), spans[r]))
            removed[r] = sum(b - a for a, b in spans[r])
        cols = list(batch.columns)
        cols[at] = pc.replace_with_mask(texts, pa.array(mask), pa.array(kept, texts.type)) if rows else texts
        cols[-1] = pa.array(removed)
        yield pa.RecordBatch.from_arrays(cols, schema=batch.schema)


def _without(text: str, spans: list[list[int]]) -> str:
    raw, at, kept = text.encode(), 0, []
    for a, b in spans:
        kept.append(raw[at:a])
        at = b
    return b"".join([*kept, raw[at:]]).decode()


@F.pandas_udf(T.StringType())
def _without_spans(texts, spans):  # noqa: ANN001, ANN202
    out = []
    for t, ss in zip(texts, spans):
        if t is None or ss is None:
            out.append(t)
            continue
        merged: list[list[int]] = []
        for a, b in sorted((x["first"], x["end"]) for x in ss):
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(b, merged[-1][1])
            else:
                merged.append([a, b])
        out.append(_without(t, merged))
    return pd.Series(out, dtype="object")


def without_leaks(documents: DataFrame, items: DataFrame, whole_documents: bool = False) -> DataFrame:
    """The corpus without leaked passages, or without the documents that hold any.

    Adds ``removed_bytes`` (0 where nothing was found), in place of a column of that name; rows
    with null texts stay, what is kept of a text is unchanged. The passages are cut out where they
    are found, so the corpus is not moved; only with a test set too large to be broadcast are
    documents joined with their passages, by ``doc_id``.
    """
    names = [c for c in documents.columns if c != "removed_bytes"]
    rows = documents.select(*[F.col(f"`{c}`") for c in names], F.lit(0).cast("bigint").alias("removed_bytes"))
    grams = _small_set(items, "item_id", "text")
    if grams is not None:
        held = documents.sparkSession.sparkContext.broadcast(grams)
        return rows.mapInArrow(lambda b: _cut_out(b, held.value, names.index("text"), whole_documents), rows.schema)
    hits = _joined_hits(documents, items)
    if whole_documents:
        return rows.join(hits.select("doc_id").distinct(), "doc_id", "left_anti")
    spans = hits.groupBy("doc_id").agg(F.collect_set(F.struct("first", "end")).alias("__spans"))
    clean = rows.join(spans, "doc_id", "left").withColumn("__clean", F.when(F.col("__spans").isNotNull() & F.col("text").isNotNull(), _without_spans("text", "__spans")).otherwise(F.col("text")))
    size = lambda c: F.coalesce(F.octet_length(c), F.lit(0)).cast("bigint")
    return clean.select(*[F.col("__clean").alias("text") if c == "text" else F.col(f"`{c}`") for c in names], (size("text") - size("__clean")).alias("removed_bytes"))
