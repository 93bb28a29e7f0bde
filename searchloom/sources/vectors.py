"""Vectors of texts from an embedding service, which the caller plugs in."""

from __future__ import annotations

import time
from collections import OrderedDict
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import truncated

#: Texts sent at once, tries after the first, and queries that are remembered.
BATCH, RETRIES, REMEMBERED = 16, 3, 200

Service = Callable[[list[str]], list[list[float]]]


def embed_batch(texts: list[str], service: Service, retries: int = RETRIES, wait: Callable[[float], None] = time.sleep) -> list[list[float]] | None:
    """Vectors of the texts that are not empty, None if the service fails after all
    tries, with doubled waits between, or answers with another number of vectors or an
    empty one: a search has to work without them."""
    texts = [t for t in texts if t]
    if not texts:
        return None
    for attempt in range(retries + 1):
        try:
            found = service(texts)
        except Exception:  # noqa: BLE001  any failure of the service
            if attempt == retries:
                return None
            wait(2.0**attempt)
            continue
        return found if len(found) == len(texts) and all(found) else None
    return None


def embed_all(texts: list[str], service: Service, batch: int = BATCH, **options) -> list[list[float]] | None:
    """Vectors in batches; those before the first batch that failed, None if there are none."""
    out: list[list[float]] = []
    for at in range(0, len(texts), batch):
        found = embed_batch(texts[at : at + batch], service, **options)
        if found is None:
            break
        out += found
    return out or None


def with_vectors(docs: DataFrame, service: Service, text: str = "text", batch: int = BATCH, retries: int = RETRIES) -> DataFrame:
    """``docs`` with ``embedding``: an array of floats, null for empty texts and for the
    rows of batches that failed.  Texts are collapsed and cut as the service wants them;
    each task sends its own batches, so a failure costs no other rows."""
    sent = docs.drop("embedding").withColumn("_sent", truncated(F.coalesce(text, F.lit(""))))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            vectors: list = [None] * len(frame)
            full = [i for i, t in enumerate(frame["_sent"]) if t]
            for at in range(0, len(full), batch):
                own = full[at : at + batch]
                for i, v in zip(own, embed_batch([frame["_sent"].iloc[i] for i in own], service, retries) or [], strict=False):
                    vectors[i] = v
            yield frame.drop(columns="_sent").assign(embedding=pd.Series(vectors, index=frame.index, dtype=object))

    kept = sent.drop("_sent").schema.add("embedding", T.ArrayType(T.FloatType()))
    return sent.mapInPandas(run, kept)


class QueryVectors:
    """Vectors of queries; the last REMEMBERED are not asked for again."""

    def __init__(self, service: Service, remembered: int = REMEMBERED):
        self.service, self.remembered = service, remembered
        self.known: OrderedDict[str, list[float]] = OrderedDict()

    def vector(self, query: str) -> list[float] | None:
        key = query.strip().lower()
        if key not in self.known:
            found = embed_batch([key], self.service, 0)
            if found is None:
                return None
            self.known[key] = found[0]
            if len(self.known) > self.remembered:
                self.known.popitem(last=False)
        return self.known[key]


def with_country(requests: DataFrame, places: DataFrame, ip: str = "ip") -> DataFrame:
    """``requests`` with ``country`` from a table of addresses (ip, country); ``XX``
    where it is not known."""
    own = places.select(F.col("ip").alias("_ip"), F.upper("country").alias("country")).dropDuplicates(["_ip"])
    return requests.join(own, F.col(ip) == F.col("_ip"), "left").drop("_ip").withColumn("country", F.coalesce("country", F.lit("XX")))
