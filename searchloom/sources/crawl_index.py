"""Crawl catalogues: lines of JSON, sorted-key files, and the archives they point into."""

from __future__ import annotations

import gzip
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, InputPartition

from ..config import CONFIG
from ..functions.text import col
from ..functions.urls import discovered_url, is_ip_host

S = CONFIG.storage
FIELDS = "url string, status string, mime string, filename string, offset string, length string"


def record(line: Column | str) -> Column:
    """The JSON of a line, from its first brace on; every field as text."""
    c = col(line)
    return F.from_json(F.when(F.instr(c, "{") > 0, F.substr(c, F.instr(c, "{"))), FIELDS)


def pointer(rec: Column) -> Column:
    """Struct of url, mime, filename, offset and length, or null if it points to nothing
    that can become a document."""
    offset, length = rec["offset"].try_cast("double"), rec["length"].try_cast("double")
    usable = rec["mime"].rlike(r"(?i)text/html|application/xhtml") & (F.coalesce(rec["filename"], F.lit("")) != "") & (offset >= 0) & (length >= 200)
    made = F.struct(rec["url"].alias("url"), rec["mime"].alias("mime"), rec["filename"].alias("filename"), offset.cast("long").alias("offset"), length.cast("long").alias("length"))
    return F.when(usable, made)


def parse_cdx(lines: DataFrame, line: str = "value") -> DataFrame:
    """Pointers of a sorted-key file (key, time, JSON); hosts that are addresses are
    left out."""
    rec = lines.select(pointer(record(line)).alias("r")).where("r IS NOT NULL").select("r.*")
    return rec.where((F.coalesce("url", F.lit("")) != "") & ~is_ip_host("url"))


def parse_index(lines: DataFrame, line: str = "value") -> DataFrame:
    """Pointers of an index answer, one JSON record to a line."""
    return lines.where(F.trim(line) != "").select(pointer(record(line)).alias("r")).where("r IS NOT NULL").select("r.*")


def discovered(lines: DataFrame, line: str = "value", most: int | None = None) -> DataFrame:
    """Distinct URLs of successful HTML or text captures."""
    rec = lines.where(F.trim(line).startswith("{")).select(record(line).alias("r")).select("r.*")
    ok = (F.col("status") == "200") & (F.coalesce(F.nullif("mime", F.lit("")), F.lit("html")).rlike("html|text/plain"))
    urls = rec.where(ok).select(discovered_url("url").alias("url")).where("url IS NOT NULL").distinct()
    return urls if most is None else urls.limit(most)


def discover_many(patterns: list[tuple[str, DataFrame]], per_pattern: int = 40) -> DataFrame:
    """(url, pattern) over several catalogues, each URL under the first that has it."""
    every = None
    for i, (name, lines) in enumerate(patterns):
        own = discovered(lines, most=per_pattern).select("url", F.lit(i).alias("at"), F.lit(name).alias("pattern"))
        every = own if every is None else every.unionByName(own)
    return every.groupBy("url").agg(F.min_by("pattern", "at").alias("pattern"))


def latest_collection(collections: DataFrame) -> DataFrame:
    """The id of the first collection (JSON array text ``value``) that is a main crawl."""
    ids = F.transform(F.from_json("value", "array<struct<id: string>>"), lambda x: x["id"])
    return collections.select(F.get(F.filter(ids, lambda i: i.contains("MAIN")), 0).alias("id"))


def record_bytes(length: Column) -> Column:
    return F.least(length, F.lit(S.max_record_bytes))


def byte_range(offset: Column, length: Column) -> Column:
    return F.format_string("bytes=%d-%d", offset, offset + record_bytes(length) - 1)


def extract_html(data: bytes) -> str | None:
    """The HTML of one gzipped archive record, or None."""
    try:
        text = gzip.decompress(data).decode("utf-8", "replace")
    except (OSError, EOFError):
        return None
    status = re.search(r"^HTTP/1\.[01] ", text, re.M)
    if not status or (head := text.find("\r\n\r\n", status.start())) < 0:
        return None
    body = text[head + 4 :]
    return body if re.search(r"<html|<!doctype", body, re.I) else None


def fetch_records(records: DataFrame, root: str) -> DataFrame:
    """``records`` (url, filename, offset, length) with ``html`` read from archives under
    ``root``; those that hold no HTML are left out.

    Files are read whole by Spark, wherever they lie, and cut to records on the workers;
    the files, not the records, decide the tasks.
    """
    spark = records.sparkSession
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "content")
    own = records.groupBy("filename").agg(F.collect_list(F.struct("url", "offset", "length")).alias("records"))
    named = files.withColumn("filename", F.regexp_extract("path", r"([^/]*)$", 1)).drop("path")
    both = named.join(own.withColumn("filename", F.regexp_extract("filename", r"([^/]*)$", 1)), "filename")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for content, recs in zip(f["content"], f["records"], strict=True):
                for r in recs:
                    html = extract_html(content[r["offset"] : r["offset"] + min(r["length"], S.max_record_bytes)])
                    if html is not None:
                        rows.append((r["url"], html))
            yield pd.DataFrame(rows, columns=["url", "html"])

    return both.mapInPandas(run, "url string, html string")


class CatalogueReader(DataSourceReader):
    """Lines of a catalogue file on a path that every worker sees, with the status
    filter evaluated while reading."""

    def __init__(self, options):
        self.path, self.status = options["path"], None

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("status",):
                self.status = f.value
            else:
                yield f

    def partitions(self):
        import glob

        return [InputPartition(p) for p in sorted(glob.glob(self.path))] or [InputPartition(None)]

    def read(self, partition):
        import json

        if partition.value is None:
            return
        with open(partition.value, encoding="utf-8", errors="replace") as lines:
            for line in lines:
                start = line.find("{")
                if start < 0:
                    continue
                try:
                    rec = json.loads(line[start:])
                except ValueError:
                    continue
                if self.status is None or rec.get("status") == self.status:
                    yield tuple(None if rec.get(k) is None else str(rec.get(k)) for k in ("url", "status", "mime", "filename", "offset", "length"))


class CatalogueSource(DataSource):
    """``spark.read.format("crawl_catalogue")``, with a pushed filter on status."""

    @classmethod
    def name(cls) -> str:
        return "crawl_catalogue"

    def schema(self) -> str:
        return FIELDS

    def reader(self, schema) -> DataSourceReader:
        return CatalogueReader(self.options)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(CatalogueSource)
