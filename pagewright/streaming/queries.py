"""Streams: new files, windowed counts, the store of corrections and admission with state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def new_files(spark: SparkSession, folder: str, pattern: str = "*", at_a_time: int = 50) -> DataFrame:
    """path, modificationTime, length, content of files as they come, at_a_time for each batch."""
    return spark.readStream.format("binaryFile").option("pathGlobFilter", pattern).option("maxFilesPerTrigger", at_a_time).schema("path string, modificationTime timestamp, length long, content binary").load(folder)


def windowed_counts(events: DataFrame, at: str = "ts", window: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """window_start, event_type, n of events that come at most late after the newest."""
    return events.withWatermark(at, late).groupBy(F.window(at, window), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("window_start"), "event_type", "n")


def session_counts(events: DataFrame, at: str = "ts", gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """session_start, user_id, n: events of a user with no longer gap between them."""
    return events.withWatermark(at, late).groupBy(F.session_window(at, gap), "user_id").agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("session_start"), "user_id", "n")


def correction_counts(events: DataFrame) -> DataFrame:
    """The store of corrections as a stream in update mode."""
    return events.groupBy("original", "font", "domain").agg(F.count("*").alias("n"), F.max("confidence").alias("confidence"), F.max("seen_at").alias("last_seen"))


def admitted(requests: DataFrame, most: int = 20, window_us: int = 60_000_000) -> DataFrame:
    """client, request_id, at_us, admitted of a stream of requests; a client's state is the times of the last admitted ones, most at most."""

    def judge(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        live = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(frames)).sort_values(["at_us", "request_id"])
        said = []
        for at in rows.at_us:
            live = [t for t in live if at - t <= window_us]
            said.append(len(live) < most)
            if said[-1]:
                live.append(int(at))
        state.update((live,))
        yield pd.DataFrame({"client": key[0], "request_id": rows.request_id.to_numpy(), "at_us": rows.at_us.to_numpy(), "admitted": said})

    schema = "client long, request_id long, at_us long, admitted boolean"
    return requests.groupBy("client").applyInPandasWithState(judge, schema, "live array<bigint>", "append", GroupStateTimeout.NoTimeout)
