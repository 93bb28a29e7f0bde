"""Incremental indexing of a landing folder, and the plan of a filling run."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import CONFIG
from ..operators.corpus import deduplicated, new_documents, parsed_docs
from ..operators.index import Index
from ..scratch import cut_lineage

S = CONFIG.storage


@dataclass(frozen=True)
class Footprint:
    docs: int
    bytes: int

    @property
    def per_doc(self) -> int:
        return int(self.bytes / self.docs + 0.5) if self.docs else 0

    def remaining(self, budget_mb: float) -> float:
        return max(0, (budget_mb * 1_048_576 - self.bytes) // self.per_doc) if self.per_doc else float("inf")


@dataclass(frozen=True)
class Decision:
    phase: str
    batch: int = 0
    reason: str = ""


def plan_fill(
    footprint: Footprint, tried_hosts: int, total_hosts: int, fetched: int, max_pages: int, now_ms: int, deadline_ms: int,
    discover_rounds: int = 0, long_tail: bool = False, budget_mb: float = S.budget_mb,
) -> Decision:
    """What the next round of a filling run should do: sitemaps of the chosen hosts, then
    a bounded number of index scans, then, if asked for, the long tail."""
    if fetched >= max_pages:
        return Decision("done", reason=f"page cap reached ({max_pages})")
    if now_ms >= deadline_ms:
        return Decision("done", reason="time budget reached")
    room = footprint.remaining(budget_mb)
    if room <= 0:
        return Decision("done", reason="disk budget reached")
    if room <= 50:
        return Decision("done", reason=f"only {int(room)} docs of headroom left")
    if tried_hosts < total_hosts:
        return Decision("sitemaps", int(min(S.sitemap_per_host, max(20, room))))
    if discover_rounds < S.discover_rounds and room > 500:
        return Decision("discover", int(min(400, max(50, room))))
    if long_tail and room > 2000:
        return Decision("longtail", int(min(2000, max(200, room))))
    return Decision("done", reason="no more curated sources to harvest")


def deadline(minutes: float, now_ms: int) -> int:
    return int(now_ms + max(1, minutes) * 60_000)


def host_queue(hosts: DataFrame, done: DataFrame) -> DataFrame:
    """Hosts in their order that are not done."""
    return hosts.join(done.select("host"), "host", "left_anti").orderBy("ordinal")


PAGES = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("html", T.StringType())])


def index_pages(spark: SparkSession, landing: str, index_path: str, checkpoint: str):
    """A streaming query that adds the pages that have arrived in ``landing`` (Parquet)
    to the index at ``index_path`` and ends.

    Each micro-batch is parsed, gated and deduplicated against what is indexed, then
    appended under its batch number, so that a batch that is run again replaces itself.
    Readers use ``read_index``.
    """

    def add(batch: DataFrame, number: int) -> None:
        # Parsed once, as a table; the index is built from it in several passes.
        docs = cut_lineage(parsed_docs(batch), "parsed")
        before = existing(spark, index_path, number)
        fresh = deduplicated(docs) if before is None else new_documents(docs, before)
        Index.build(cut_lineage(fresh, "fresh")).write(f"{index_path}/batch={number}")

    source = spark.readStream.schema(PAGES).parquet(landing)
    return source.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def existing(spark: SparkSession, path: str, before: int) -> DataFrame | None:
    """Documents of the batches before ``before``; none yet if the folder is empty."""
    if before == 0:
        return None
    return spark.read.parquet(*(f"{path}/batch={n}/docs" for n in range(before)))


def read_index(spark: SparkSession, path: str, batches: int) -> Index:
    """The index of the first ``batches`` micro-batches, with statistics over all."""
    read = lambda t: spark.read.parquet(*(f"{path}/batch={n}/{t}" for n in range(batches)))
    return Index(read("docs"), read("postings"), read("stats").agg(F.sum("n").alias("n"), F.sum("total_len").alias("total_len")))


def without_vectors(docs: DataFrame, most: int = 200) -> DataFrame:
    """The documents to embed next: the first without a vector."""
    return docs.where("vec IS NULL").orderBy("ordinal").limit(most)
