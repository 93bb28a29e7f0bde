"""Fixed rate windows that begin with a key's first request, in batch and as a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..config import CONFIG

A = CONFIG.api
VERDICT = "ok boolean, remaining long, reset_ms long, retry_after long"


class Window:
    """The window of one key: calls are counted until it ends, refused ones too."""

    __slots__ = ("count", "reset")

    def __init__(self, count: int = 0, reset: int = -(1 << 62)):
        self.count, self.reset = count, reset

    def call(self, now: int, limit: int, length: int) -> tuple[bool, int, int, int]:
        if self.reset <= now:
            self.count, self.reset = 0, now + length
        self.count += 1
        return self.count <= limit, max(0, limit - self.count), self.reset, max(1, -(-(self.reset - now) // 1000))


def rate_limit(events: DataFrame, key: str, ts: str, tie: str, limit: int = A.per_minute, window_ms: int = A.window_ms) -> DataFrame:
    """``events`` with ok, remaining, reset_ms and retry_after, replayed for each key in
    the order of (ts, tie).

    Keys are dealt and sorted by Spark; a task passes over its rows once and holds one
    window, however many calls a key makes.
    """
    parts = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ms = events.withColumn("_ms", F.unix_millis(F.col(ts).cast("timestamp")))
    ordered = ms.repartition(parts, key).sortWithinPartitions(key, "_ms", tie)
    schema = T.StructType([*events.schema.fields, *T._parse_datatype_string(VERDICT).fields])
    at_key, names = events.columns.index(key), events.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, window = object(), Window()
        for batch in batches:
            rows = []
            for k, now in zip(batch.column(at_key).to_pylist(), batch.column(len(names)).to_pylist(), strict=True):
                if k != own:
                    own, window = k, Window()
                rows.append(window.call(now, limit, window_ms))
            verdict = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.bool_(), pa.int64(), pa.int64(), pa.int64()), strict=True)] if rows else [pa.array([], t) for t in (pa.bool_(), pa.int64(), pa.int64(), pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], *verdict], names=schema.names)

    return ordered.mapInArrow(run, schema)


class RateLimiter(StatefulProcessor):
    """State of a key: calls in its window and when that ends."""

    def __init__(self, limit: int, window_ms: int):
        self.limit, self.window_ms = limit, window_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("window", "count long, reset long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        window = Window(*self.state.get()) if self.state.exists() else Window()
        frames = pd.concat(list(rows)).sort_values(["ms", "event_id"])
        out = [(key[0], int(e), int(m), *window.call(int(m), self.limit, self.window_ms)) for e, m in zip(frames["event_id"], frames["ms"], strict=True)]
        self.state.update((window.count, window.reset))
        yield pd.DataFrame(out, columns=["key", "event_id", "ms", "ok", "remaining", "reset_ms", "retry_after"])

    def close(self) -> None:
        pass


def rate_limit_stream(calls: DataFrame, limit: int = A.per_minute, window_ms: int = A.window_ms) -> DataFrame:
    """The same over a stream of calls (key, event_id, ms); needs the RocksDB state
    store provider."""
    return calls.groupBy("key").transformWithStateInPandas(
        statefulProcessor=RateLimiter(limit, window_ms), outputStructType=f"key string, event_id long, ms long, {VERDICT}", outputMode="Append", timeMode="None"
    )
