"""Structured Streaming jobs and the quota helper that batch and stream share."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def store_events(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append allowed events as they arrive (ST1)."""
    return events.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def daily_counts(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Events per day and type; rows later than the watermark are dropped (ST2)."""
    windowed = events.withWatermark("created_at", late).groupBy(F.window("created_at", "1 day"), "event_type").count()
    return windowed.select(F.to_date("window.start").alias("day"), "event_type", F.col("count").alias("n"))


def take(times: list[float], start: float, used: int, span: float, quota: int) -> tuple[list[bool], float, int]:
    """Accept events in time order: a window of ``span`` seconds opens at the first event after the last one's end."""
    out = []
    for t in times:
        if used == 0 or t > start + span:
            start, used = t, 0
        used += 1
        out.append(used <= quota)
    return out, start, used


def quota_batch(events: DataFrame, span: float = 60, quota: int = 30) -> DataFrame:
    """(user_id, accepted, rejected) with windows anchored at a key's first event (ST3).

    Rows come dealt by user and sorted by time; they are streamed through the task, so a hot user needs the state of one
    window only and no group is gathered.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, start, used, counts = None, 0.0, 0, [0, 0]
        for pdf in frames:
            out = []
            for user, part in pdf.groupby("user_id", sort=False):
                if user != now:
                    if now is not None:
                        out.append((now, counts[0], counts[1]))
                    now, start, used, counts = user, 0.0, 0, [0, 0]
                ok, start, used = take(part["t"].tolist(), start, used, span, quota)
                counts[0] += sum(ok)
                counts[1] += len(ok) - sum(ok)
            yield pd.DataFrame(out, columns=["user_id", "accepted", "rejected"])
        if now is not None:
            yield pd.DataFrame([(now, *counts)], columns=["user_id", "accepted", "rejected"])

    d = events.where("user_id IS NOT NULL").select("user_id", F.unix_micros(F.col("created_at").cast("timestamp")).alias("us")).withColumn("t", F.col("us") / 1e6)
    return d.repartition("user_id").sortWithinPartitions("user_id", "us").select("user_id", "t").mapInPandas(run, "user_id long, accepted long, rejected long")


def quota_stream(events: DataFrame, span: float = 60, quota: int = 30, late: str = "10 seconds") -> DataFrame:
    """The same with state per key in a stream: counts of each batch (ST3).

    State is a key's open window. It goes when the watermark (``late`` behind the newest event) passes the window's end,
    so keys that fall silent cost nothing; a later event opens a new window, as it would have done anyway. Events older
    than the watermark are dropped.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        start, used = state.get if state.exists else (0.0, 0)
        times = sorted(t for pdf in frames for t in pdf["t"].tolist())
        ok, start, used = take(times, start, used, span, quota)
        over = int((start + span) * 1000) + 2  # no later event can still belong to the window
        if over > state.getCurrentWatermarkMs():
            state.update((start, used))
            state.setTimeoutTimestamp(over)
        elif state.exists:
            state.remove()
        yield pd.DataFrame([(key[0], sum(ok), len(ok) - sum(ok))], columns=["user_id", "accepted", "rejected"])

    at = F.col("created_at").cast("timestamp")
    # a millisecond on, since an event as old as the first watermark, the epoch, would count as late
    d = events.where("user_id IS NOT NULL").select("user_id", (at + F.expr("INTERVAL 1 MILLISECOND")).alias("mark"), (F.unix_micros(at) / 1e6).alias("t")).withWatermark("mark", late)
    return d.groupBy("user_id").applyInPandasWithState(run, "user_id long, accepted long, rejected long", "start double, used long", "append", GroupStateTimeout.EventTimeTimeout)


def maintain_rollup(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keep a rollup of events by day (``stats.daily_rollup``) as they arrive: each batch adds its own part (A26 to A28 with ST2).

    A batch that runs again after a failure writes its part again, in the same place.
    """
    from ..operators.stats import daily_rollup

    def add(batch: DataFrame, number: int) -> None:
        daily_rollup(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return events.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
