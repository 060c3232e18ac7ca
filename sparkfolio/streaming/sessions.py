"""Streams: conversations with memory, append-only traces, windows over events. The batch form of each is the same expression."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def history(turns: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """Rows (key, n, turns): the turns of each conversation in order."""
    return turns.groupBy(key).agg(F.count("*").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda t: t[text]).alias("turns"))


def windowed(events: DataFrame, time: str, size: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Events per window and type, for streams and tables; late events are waited for. An extension."""
    w = F.window(time, size, slide) if slide else F.window(time, size)
    return events.withWatermark(time, late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, key: str, time: str, gap: str) -> DataFrame:
    """Sessions per key, closed by a gap."""
    return events.groupBy(key, F.session_window(time, gap).alias("s")).agg(F.count("*").alias("n")).select(key, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def remember(stream: DataFrame, most: int = 50) -> DataFrame:
    """Rows (session_id, turn, text, seen) of a stream (session_id, text): each turn with its number and the turns before it that are remembered.

    State is kept per session, the last `most` turns of it, and survives restarts from the query's checkpoint.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, texts = state.get if state.exists else (0, [])
        texts = list(texts)
        rows = []
        for b in batches:
            for t in b["text"]:
                n += 1
                rows.append((key[0], n, t, list(texts)))
                texts = [*texts, t][-most:]
        state.update((n, texts))
        yield pd.DataFrame(rows, columns=["session_id", "turn", "text", "seen"])

    return stream.groupBy("session_id").applyInPandasWithState(
        step, "session_id string, turn long, text string, seen array<string>", "n long, texts array<string>", "append", GroupStateTimeout.NoTimeout
    )


def append_spans(stream: DataFrame, folder: str, checkpoint: str):
    """Write a stream of spans as an append-only Parquet table, exactly once; returns the query."""
    return stream.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append").start()


def read_stream(spark: SparkSession, folder: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)
