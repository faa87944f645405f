"""The event log as a stream: once-a-day events, debounced taps, replayed responses and windowed counts."""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def once_a_day(events: DataFrame, late: str = "1 day") -> DataFrame:
    """The first of an event, person and day. On a stream its memory is bounded by the watermark."""
    df = events.withColumn("day", F.to_date("occurred_at"))
    df = df.withWatermark("occurred_at", late) if df.isStreaming else df
    return df.dropDuplicatesWithinWatermark(["event_type", "account_id", "day"]) if df.isStreaming else df.dropDuplicates(["event_type", "account_id", "day"])


def debounced(events: DataFrame, seconds: int = 10, late: str = "1 minute") -> DataFrame:
    """Of one tap's events each counts that comes `seconds` or more after the last one that counted. events: id, tap, occurred_at.

    On a stream the state is one time a tap, and it goes once the watermark has passed that time by `seconds`: a later event counts anyway.
    """

    def keep(key, pdfs, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(pdfs)).sort_values(["occurred_at", "id"])
        kept = []
        for r in rows.itertuples():
            at = int(r.occurred_at.value // 1000)
            if last is None or at - last >= seconds * 1_000_000:
                kept.append((int(r.id), key[0], r.occurred_at))
                last = at
        state.update((last,))
        gone = last // 1000 + seconds * 1000
        if gone > state.getCurrentWatermarkMs():
            state.setTimeoutTimestamp(gone)
        yield pd.DataFrame(kept, columns=["id", "tap", "occurred_at"])

    taps = events.select("id", "tap", "occurred_at")
    if taps.isStreaming:
        return taps.withWatermark("occurred_at", late).groupBy("tap").applyInPandasWithState(keep, "id long, tap string, occurred_at timestamp", "last long", "append", GroupStateTimeout.EventTimeTimeout)

    def whole(batches):
        who, last = (), None  # no tap yet
        for batch in batches:
            kept = []
            for i, (tap, at) in enumerate(zip(batch.column("tap").to_pylist(), batch.column("occurred_at").to_pylist(), strict=True)):
                if tap != who or (at is not None and last is not None and (at - last).total_seconds() >= seconds):
                    kept.append(i)
                    who, last = tap, at
            yield batch.take(pa.array(kept, pa.int64()))

    order = F.col("occurred_at").asc_nulls_last()
    taps = taps.select(F.col("id").cast("long"), F.col("tap").cast("string"), F.col("occurred_at").cast("timestamp"))
    return taps.repartition("tap").sortWithinPartitions("tap", order, "id").mapInArrow(whole, taps.schema)


def hourly(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Counts and sums by hour and type; late events up to the watermark are still counted."""
    df = events.withWatermark("occurred_at", late) if events.isStreaming else events
    return df.groupBy(F.window("occurred_at", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("hour"), "event_type", "n", "total")
