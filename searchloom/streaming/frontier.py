"""The crawl frontier: each URL once, and no host more often than a delay allows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions.urls import host_with_port, without_fragment


def push(urls: DataFrame, seen: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """Distinct URLs (fragments dropped) in order of ``ordinal`` that ``seen`` lacks; no
    more than fit when ``limit`` URLs in all may be known."""
    own = urls.withColumn("url", without_fragment("url")).where("url <> ''").groupBy("url").agg(F.min("ordinal").alias("ordinal"))
    known = 0
    if seen is not None:
        own = own.join(seen.select("url"), "url", "left_anti")
        known = seen.count() if limit is not None else 0
    return own if limit is None else own.orderBy("ordinal", "url").limit(max(0, limit - known))


def schedule(urls: DataFrame, delay_ms: int = 800, start_ms: int = 0) -> DataFrame:
    """(url, host, ordinal, due_ms): when each URL may be fetched first if every host is
    asked at most once in ``delay_ms``, in the order of its URLs."""
    own = urls.withColumn("host", host_with_port("url"))
    turn = F.row_number().over(Window.partitionBy("host").orderBy("ordinal", "url")) - 1
    return own.select("url", "host", "ordinal", (F.lit(start_ms) + turn * delay_ms).cast("long").alias("due_ms"))


class Politeness(StatefulProcessor):
    """State of a host: when it may be asked next."""

    def __init__(self, delay_ms: int):
        self.delay_ms = delay_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.next = handle.getValueState("next", "ms long")
        self.seen = handle.getMapState("seen", "url string", "ms long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        due = self.next.get()[0] if self.next.exists() else -(1 << 62)
        out = []
        for frame in rows:
            for url, ms in sorted(zip(frame["url"], frame["ms"], strict=True), key=lambda x: (x[1], x[0])):
                if not self.seen.containsKey((url,)):
                    due = max(due, int(ms))
                    self.seen.updateValue((url,), (due,))
                    out.append((key[0], url, due))
                    due += self.delay_ms
        self.next.update((due,))
        yield pd.DataFrame(out, columns=["host", "url", "due_ms"])

    def close(self) -> None:
        pass


def frontier_stream(urls: DataFrame, delay_ms: int = 800) -> DataFrame:
    """(host, url, due_ms) for a stream of URLs (url, ms): the first sight of each, and
    when its host may be asked for it; needs the RocksDB state store provider."""
    own = urls.select(without_fragment("url").alias("url"), "ms").where("url <> ''").withColumn("host", host_with_port("url"))
    return own.groupBy("host").transformWithStateInPandas(statefulProcessor=Politeness(delay_ms), outputStructType="host string, url string, due_ms long", outputMode="Append", timeMode="None")
