"""Exactly one copy of each message that was delivered at least once (quotient hash tables).

A message identifier is packed into 128 bits and permuted by a Feistel network, which is a
bijection: equal permuted values mean equal identifiers. The leading bits are the quotient; they
name the shard and, inside a shard, the home slot of the table. The table stores the remainder
of every identifier whole, so there are no false matches, and each identifier is inserted once:
a later copy meets the entry and only the earlier delivery of the two is kept with it.

Tables are filled twice. A map task fills one with what it reads, so that one identifier with most
of the rows leaves it as a single row; what survives is sorted into shards by quotient and inserted
there. Copies that lost already are known to be surplus and only pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUOTIENT_BITS = 16
ROUNDS = 4
MOST_ENTRIES = 1 << 20  # of a map task's table; a full one is handed on and begun anew


def _u64(digits: Column) -> Column:
    """16 hex digits as a signed 64-bit number."""
    half = lambda at: F.conv(F.substring(digits, at, 8), 16, 10).cast("bigint")
    return F.shiftleft(half(1), 32).bitwiseOR(half(9))


def permute(high: Column, low: Column, rounds: int = ROUNDS) -> tuple[Column, Column]:
    """A bijection of pairs of 64-bit numbers (Feistel network over a keyed 64-bit hash)."""
    for r in range(rounds):
        high, low = low, high.bitwiseXOR(F.xxhash64(low, F.lit(r)))
    return high, low


def message_table_key(df: DataFrame, job: str = "job_id", event: str = "event_id") -> DataFrame:
    """Add ``quotient``, ``rem_high``, ``rem_low`` and ``rem_text`` for each message identifier.

    For streams, whose state store is the table. Job names that differ in surrounding white space
    or letter case are one job. A job name of a prefix and 16 hex digits fills the high half and
    the prefix is kept as ``rem_text``; any other name is kept whole in ``rem_text``. All four are
    null when a part of the identifier is.
    """
    name = F.lower(F.regexp_replace(F.col(job), r"(?U)^\s+|\s+$", ""))
    fixed = name.rlike("^job_[0-9a-f]{16}$")
    high = F.when(fixed, _u64(F.substring(name, 5, 16))).otherwise(F.xxhash64(name))
    known = F.col(job).isNotNull() & F.col(event).isNotNull()
    out = df.withColumn("_h", high).withColumn("_text", F.when(~fixed, name).otherwise(F.lit("")))
    left, right = permute(F.col("_h"), F.col(event).cast("bigint"))
    out = out.withColumn("_l", left).withColumn("_r", right)
    mask = (1 << (64 - QUOTIENT_BITS)) - 1
    return out.select(
        *df.columns,
        F.when(known, F.shiftrightunsigned("_l", 64 - QUOTIENT_BITS)).alias("quotient"),
        F.when(known, F.col("_l").bitwiseAND(F.lit(mask))).alias("rem_high"),
        F.when(known, F.col("_r")).alias("rem_low"),
        F.when(known, F.col("_text")).alias("rem_text"),
    )


_HEX = np.full(256, 255, np.uint8)
_HEX[48:58], _HEX[97:103] = np.arange(10), np.arange(10, 16)
_PREFIX = np.frombuffer(b"job_", np.uint8)


def _mix(x: np.ndarray, key: int) -> np.ndarray:
    """A keyed hash of 64-bit numbers (the finaliser of SplitMix64)."""
    x = x + np.uint64(0x9E3779B97F4A7C15) * np.uint64(key + 1)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permuted(high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``permute`` for arrays, with another round function."""
    with np.errstate(over="ignore"):
        for r in range(ROUNDS):
            high, low = low, high ^ _mix(low, r)
    return high, low


def packed(job: pa.Array, event: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Permuted identifiers and, for job names that do not fit into 64 bits, their text (else null)."""
    name = pc.utf8_lower(pc.utf8_trim_whitespace(job.cast(pa.large_string())))
    long_ = np.flatnonzero(np.asarray(pc.binary_length(name)) == 20)
    some = name.take(pa.array(long_))
    raw = np.frombuffer(some.buffers()[2], np.uint8)[: 20 * len(long_)].reshape(-1, 20) if len(long_) else np.zeros((0, 20), np.uint8)
    digit = _HEX[raw[:, 4:]]
    fits = (raw[:, :4] == _PREFIX).all(1) & (digit < 16).all(1)
    high = np.zeros(len(name), np.uint64)
    with np.errstate(over="ignore"):
        high[long_[fits]] = (digit[fits].astype(np.uint64) << (np.uint64(60) - np.uint64(4) * np.arange(16, dtype=np.uint64))).sum(1, dtype=np.uint64)
    odd = np.ones(len(name), bool)
    odd[long_[fits]] = False
    if odd.any():
        codes = name.filter(pa.array(odd)).dictionary_encode()
        own = np.array([_text_hash(t) for t in codes.dictionary.to_pylist()], np.uint64)
        high[odd] = own[np.asarray(codes.indices)]
    h, w = permuted(high, event.astype(np.int64).view(np.uint64))
    return h, w, pc.if_else(pa.array(odd), name.cast(pa.string()), pa.scalar(None, pa.string()))


def _text_hash(text: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"))


class QuotientTable:
    """Identifiers with open addressing: home slots by quotient, whole remainders, one entry each."""

    def __init__(self, bits: int = 12) -> None:
        self.size, self.high, self.low = 0, np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.texts: dict[tuple[str, int, int], int] = {}  # names that are no part of the 128 bits
        self._slots(bits)

    def _slots(self, bits: int) -> None:
        self.bits, self.slot = bits, np.full(1 << bits, -1, np.int64)

    def _reserve(self, more: int) -> None:
        if self.size + more > len(self.high):
            room = np.zeros(max(self.size + more, 2 * len(self.high)) - len(self.high), np.uint64)
            self.high, self.low = np.r_[self.high, room], np.r_[self.low, room]
        if (self.size + more) * 2 > len(self.slot):
            self._slots(int((self.size + more) * 2).bit_length())
            held = np.arange(self.size)
            held = held[~np.isin(held, list(self.texts.values()))] if self.texts else held
            self._place(self.high[held], self.low[held], held)

    def _place(self, h: np.ndarray, w: np.ndarray, entry: np.ndarray | None = None) -> np.ndarray:
        """Entry of each identifier; unknown ones are inserted (as ``entry`` where that is given)."""
        mask, out = len(self.slot) - 1, np.full(len(h), -1, np.int64)
        at = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        todo = np.arange(len(h))
        while len(todo):
            held = self.slot[at[todo]]
            free, full = todo[held < 0], todo[held >= 0]
            self.slot[at[free]] = -2 - free  # of several claims of one slot one remains
            won = self.slot[at[free]] == -2 - free
            new = free[won]
            ids = self.size + np.arange(len(new)) if entry is None else entry[new]
            if entry is None:
                self.high[ids], self.low[ids] = h[new], w[new]
                self.size += len(new)
            self.slot[at[new]] = out[new] = ids
            held = held[held >= 0]
            same = (self.high[held] == h[full]) & (self.low[held] == w[full])
            out[full[same]] = held[same]
            full = full[~same]
            at[full] = (at[full] + 1) & mask
            todo = np.r_[free[~won], full]
        return out

    def insert(self, h: np.ndarray, w: np.ndarray, text: pa.Array) -> np.ndarray:
        """Entry number of each identifier; new ones are inserted once."""
        self._reserve(len(h))
        odd = np.asarray(text.is_valid())
        out = np.empty(len(h), np.int64)
        out[~odd] = self._place(h[~odd], w[~odd])
        for i, t in zip(np.flatnonzero(odd), text.drop_null().to_pylist()):
            key = (t, int(h[i]), int(w[i]))
            if key not in self.texts:
                self.high[self.size], self.low[self.size] = h[i], w[i]
                self.texts[key] = self.size
                self.size += 1
            out[i] = self.texts[key]
        return out


class FirstCopies:
    """A quotient table that keeps with each entry the earliest delivery, then the smallest id."""

    def __init__(self) -> None:
        self.table = QuotientTable()
        self.late, self.when, self.row = np.zeros(0, bool), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, h: np.ndarray, w: np.ndarray, text: pa.Array, late: np.ndarray, when: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Inserts deliveries and returns the rows that are known to be surplus."""
        before, entry = self.table.size, self.table.insert(h, w, text)
        room = self.table.size - before
        self.late, self.when, self.row = np.r_[self.late, np.zeros(room, bool)], np.r_[self.when, np.zeros(room, np.int64)], np.r_[self.row, np.zeros(room, np.int64)]
        order = np.lexsort((row, when, late, entry))
        first = np.ones(len(order), bool)
        first[1:] = entry[order][1:] != entry[order][:-1]
        best, lost = order[first], [row[order[~first]]]
        e = entry[best]
        old = e < before
        b, o = best[old], e[old]
        earlier = late[b] < self.late[o]
        tie = late[b] == self.late[o]
        earlier |= tie & (when[b] < self.when[o])
        earlier |= tie & (when[b] == self.when[o]) & (row[b] < self.row[o])
        lost += [self.row[o[earlier]], row[b[~earlier]]]
        put = np.r_[best[~old], b[earlier]]
        e = entry[put]
        self.late[e], self.when[e], self.row[e] = late[put], when[put], row[put]
        return np.concatenate(lost)

    def names(self) -> pa.Array:
        out = np.full(self.table.size, None, object)
        for (t, _, _), e in self.table.texts.items():
            out[e] = t
        return pa.array(out, pa.string())


_PACKED = "shard int, high bigint, low bigint, name string, late boolean, at bigint, row bigint"
_KINDS = (pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.int64(), pa.int64())
_FIELDS = [c.split()[0] for c in _PACKED.split(", ")]


def _numbers(column: pa.Array, kind: type = np.int64) -> np.ndarray:
    return np.asarray(column.fill_null(False if kind is bool else 0)).astype(kind)


def _lost(rows: np.ndarray) -> pa.RecordBatch:
    """Surplus rows on their way through the shards, without an identifier."""
    none = [pa.nulls(len(rows), k) for k in _KINDS[1:6]]
    return pa.RecordBatch.from_arrays([pa.array((rows & 0xFFFF).astype(np.int32)), *none, pa.array(rows)], names=_FIELDS)


def _handed_on(held: FirstCopies) -> pa.RecordBatch:
    h, w = held.table.high[: held.table.size], held.table.low[: held.table.size]
    shard = (h >> np.uint64(64 - QUOTIENT_BITS)).astype(np.int32)
    cols = [shard, h.view(np.int64), w.view(np.int64), held.names(), held.late, held.when, held.row]
    return pa.RecordBatch.from_arrays([pa.array(c, k) if isinstance(c, np.ndarray) else c for c, k in zip(cols, _KINDS)], names=_FIELDS)


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The map side: rows ``job, event, at, row`` into a table of first copies."""
    held = FirstCopies()
    for batch in batches:
        h, w, text = packed(batch.column(0), _numbers(batch.column(1)))
        yield _lost(held.add(h, w, text, np.asarray(batch.column(2).is_null()), _numbers(batch.column(2)), _numbers(batch.column(3))))
        if held.table.size > MOST_ENTRIES:
            yield _handed_on(held)
            held = FirstCopies()
    yield _handed_on(held)


def _insert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A shard: what the map tasks hand on into one table; surplus rows come out, the first copies at the end."""
    held = FirstCopies()
    out = lambda rows, surplus: pa.RecordBatch.from_arrays([pa.array(rows), pa.array(np.full(len(rows), surplus))], names=["row", "surplus"])
    for batch in batches:
        known = batch.column(1).is_valid()
        yield out(_numbers(batch.filter(pc.invert(known)).column(6)), True)
        own = batch.filter(known)
        h, w, late, when, row = (_numbers(own.column(i), k) for i, k in ((1, np.int64), (2, np.int64), (4, bool), (5, np.int64), (6, np.int64)))
        yield out(held.add(h.view(np.uint64), w.view(np.uint64), own.column(3), late, when, row), True)
    yield out(held.row, False)


def judged_deliveries(deliveries: DataFrame, row_id: str = "delivery_id", when: str = "received_at", job: str = "job_id", event: str = "event_id") -> DataFrame:
    """``row_id`` of every delivery of a complete identifier and whether it is ``surplus``.

    Of a message the earliest delivery is kept, then the one with the smallest id; a null time
    counts as later than any other. Rows without ``row_id`` and rows whose identifier is incomplete
    are no copies of anything and are not listed. ``row_id`` is a whole number.
    """
    time = F.unix_micros(when) if isinstance(deliveries.schema[when].dataType, T.TimestampType) else F.col(when).cast("bigint")
    rows = deliveries.where(F.col(row_id).isNotNull() & F.col(job).isNotNull() & F.col(event).isNotNull())
    rows = rows.select(F.col(job).alias("job"), F.col(event).cast("bigint").alias("event"), time.alias("at"), F.col(row_id).cast("bigint").alias("row"))
    table = rows.mapInArrow(_combine, _PACKED).repartition("shard").mapInArrow(_insert, "row bigint, surplus boolean")
    return table.select(F.col("row").cast(deliveries.schema[row_id].dataType).alias(row_id), "surplus")


def kept_deliveries(deliveries: DataFrame, row_id: str = "delivery_id", when: str = "received_at", job: str = "job_id", event: str = "event_id") -> DataFrame:
    """``row_id`` of the delivery to keep of each message, as ``judged_deliveries`` has it."""
    return judged_deliveries(deliveries, row_id, when, job, event).where(~F.col("surplus")).select(row_id)


def surplus_deliveries(deliveries: DataFrame, row_id: str = "delivery_id", when: str = "received_at", job: str = "job_id", event: str = "event_id") -> DataFrame:
    """``row_id`` of every delivery that repeats a message already delivered; an empty table gives no rows."""
    return judged_deliveries(deliveries, row_id, when, job, event).where("surplus").select(row_id)


def exactly_once(deliveries: DataFrame, row_id: str = "delivery_id", when: str = "received_at", job: str = "job_id", event: str = "event_id") -> DataFrame:
    """The deliveries without their surplus copies, all columns kept, by one anti join on the unique ``row_id``.

    Rows with an incomplete identifier, or without ``row_id``, cannot be recognised as copies and stay.
    """
    return deliveries.join(surplus_deliveries(deliveries, row_id, when, job, event), row_id, "left_anti")
