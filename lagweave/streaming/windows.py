"""Event-time windows and finality over streams of samples."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def timed(events: DataFrame) -> DataFrame:
    """Events with ts as a timestamp, which a watermark asks for."""
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, size: str = "1 day", late: str = "1 hour") -> DataFrame:
    """start, c, v: counts and sums of windows one after another. Works on streams (with a watermark) and tables alike."""
    e = timed(events).withWatermark("ts", late) if events.isStreaming else timed(events)
    return e.groupBy(F.window("ts", size)).agg(F.count("*").alias("c"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("v")).select(F.col("window.start").alias("start"), "c", "v")


def sliding(events: DataFrame, size: str = "1 day", step: str = "12 hours", late: str = "1 hour") -> DataFrame:
    e = timed(events).withWatermark("ts", late) if events.isStreaming else timed(events)
    return e.groupBy(F.window("ts", size, step)).agg(F.count("*").alias("c")).select(F.col("window.start").alias("start"), "c")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """user_id, start, c: each user's events with no gap over ``gap``."""
    e = timed(events).withWatermark("ts", late) if events.isStreaming else timed(events)
    return e.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("c")).select("user_id", F.col("session_window.start").alias("start"), "c")


def final_prefix(blocks: DataFrame) -> DataFrame:
    """signal, final: how far each signal is final, from a stream of decoded blocks (signal, start, count) that come in any order.

    The state of a signal is the end of its final prefix and the blocks past it; the prefix only grows.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        final, starts, counts = state.get if state.exists else (0, [], [])
        waiting = dict(zip(starts, counts, strict=True))
        for b in batches:
            waiting.update(zip(b["start"].tolist(), b["count"].tolist(), strict=True))
        while final in waiting:
            final += waiting.pop(final)
        state.update((final, list(waiting), list(waiting.values())))
        yield pd.DataFrame({"signal": [key[0]], "final": [final]})

    return blocks.groupBy("signal").applyInPandasWithState(step, "signal long, final long", "final long, starts array<long>, counts array<long>", "update", "NoTimeout")
