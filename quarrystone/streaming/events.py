"""Event streams: exactly-once delivery, replay, validation of order, and windows over event time.

The windows are an extension: the operators they stand beside have none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrystone.operators.delivery import message_table_key


def once(stream: DataFrame, when: str = "received_at", lateness: str = "7 days") -> DataFrame:
    """A stream of deliveries with each message once, by its permuted identifier.

    Copies that come later than ``lateness`` behind the newest delivery cannot be told any more;
    state is dropped with the watermark. Deliveries with an incomplete identifier pass.
    """
    whole = stream.select(F.struct(*stream.columns).alias("__row"), "job_id", "event_id", "delivery_id", when)
    ident = message_table_key(whole)
    own = F.when(F.col("quotient").isNull(), F.col("delivery_id"))
    message = F.struct("quotient", "rem_high", "rem_low", "rem_text", own.alias("own"))
    keyed = ident.select("__row", when, message.alias("__message")).withWatermark(when, lateness)
    return keyed.dropDuplicatesWithinWatermark(["__message"]).select("__row.*")


def replay(events: DataFrame, after: int, ordinal: str = "event_id") -> DataFrame:
    """Events behind the last one seen; works on tables and streams."""
    return events.where(F.col(ordinal) > after)


def plain_events(stream: DataFrame) -> DataFrame:
    """Progress events brought to one form: results and ends are dropped, stages and messages get their defaults."""
    kept = stream.where(~F.col("event_type").isin("result", "end"))
    stage = F.coalesce(F.try_variant_get(F.try_parse_json("data_json"), "$.stage", "string"), F.lit("unknown"))
    message = F.coalesce(F.try_variant_get(F.try_parse_json("data_json"), "$.message", "string"), F.concat_ws(" ", F.col("event_type"), stage))
    return kept.withColumn("stage", stage).withColumn("message", message)


def windowed_counts(events: DataFrame, when: str, key: str, size: str, slide: str | None = None, lateness: str | None = None) -> DataFrame:
    """Counts per time window and key, on a table or a stream."""
    e = events.withWatermark(when, lateness) if lateness else events
    w = F.window(when, size, slide) if slide else F.window(when, size)
    return e.groupBy(w.alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), key, "n")


def sessions(events: DataFrame, when: str, key: str, gap: str, lateness: str | None = None) -> DataFrame:
    """Sessions of a key: events less than ``gap`` apart."""
    e = events.withWatermark(when, lateness) if lateness else events
    return e.groupBy(key, F.session_window(when, gap).alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("session_start"), "n")


def into_table(stream: DataFrame, path: str, checkpoint: str, key: str, order: list[str] | None = None):  # noqa: ANN201
    """A stream of keyed rows kept as a table of the last row per key; returns the started query.

    Within a batch the last row is the one that is last in ``order`` (by default in all its other
    columns, so that the result does not depend on the order of arrival).
    """
    from quarrystone.sources.sinks import latest, upsert

    def write(batch: DataFrame, _: int) -> None:
        upsert(batch.sparkSession, path, latest(batch, key, order or [c for c in batch.columns if c != key]), key)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).start()
