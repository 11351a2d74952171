"""Admission by a sliding window: who asked too often within a minute is refused."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame


def admitted(requests: DataFrame, most: int = 20, window_us: int = 60_000_000) -> DataFrame:
    """client, request_id, at_us, admitted for requests (client, request_id, at_us).

    A request is admitted if fewer than most requests admitted before it are
    within the window; refused ones don't count. Whether one is admitted
    depends on the answers before it, so each client's requests stream by in
    order. What is kept meanwhile is the times of the last admitted ones, most
    at most, however many requests a client makes.
    """
    rows = requests.select("client", "request_id", "at_us")

    def judge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        client, live = object(), deque()
        for batch in batches:
            said = []
            for c, at in zip(batch.column("client").to_pylist(), batch.column("at_us").to_pylist(), strict=True):
                if c != client:
                    client, live = c, deque()
                while live and at - live[0] > window_us:
                    live.popleft()
                said.append(len(live) < most)
                if said[-1]:
                    live.append(at)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(said, pa.bool_())], names=[*batch.schema.names, "admitted"])

    in_order = rows.repartition("client").sortWithinPartitions("client", "at_us", "request_id")
    return in_order.mapInArrow(judge, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields) + ", admitted boolean")
