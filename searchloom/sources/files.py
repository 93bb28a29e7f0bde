"""Bytes to text, and indexes of the older single-file form."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import CONFIG
from ..operators.index import Index


def decode_bytes(data: bytes, content_type: str = "") -> str:
    """Text of a page: the charset of its header, of its meta tag, or UTF-8; the first
    that leaves no replacement characters."""
    head = data[:4096].decode("utf-8", "replace")
    found = [re.search(r'charset\s*=\s*"?([\w-]+)', content_type or "", re.I), re.search(r'<meta[^>]+charset\s*=\s*"?([\w-]+)', head, re.I)]
    for name in [*(m[1] for m in found if m), "utf-8"]:
        try:
            text = data.decode(name.lower(), "replace")
        except LookupError:
            continue
        if "�" not in text:
            return text
    return head + data[4096:].decode("utf-8", "replace")


@F.pandas_udf(T.StringType())
def decoded(data: pd.Series, content_type: pd.Series) -> pd.Series:
    cut = CONFIG.crawl.max_bytes
    return pd.Series([None if d is None or len(d) > 2 * cut else decode_bytes(d[:cut], c or "") for d, c in zip(data, content_type, strict=True)])


def fetched_pages(files: DataFrame) -> DataFrame:
    """(url, html) of stored answers (url, content, content_type): HTML or text, of at
    most twice the size that is read."""
    ok = F.coalesce("content_type", F.lit("")).rlike("^$|html|text")
    return files.where(ok).select("url", decoded("content", F.coalesce("content_type", F.lit(""))).alias("html")).where("html IS NOT NULL")


DOC = "id string, url string, title string, text string, lang string, outlinks array<string>, contentHash string, wordCount int, vec struct<v: string, s: double>"


def read_json_index(spark: SparkSession, path: str) -> Index:
    """An index from the single JSON file of the older form: its documents are read and
    indexed again, so postings that point at removed documents do no harm.  A damaged
    file raises."""
    raw = spark.read.schema("docs array<string>, _bad string").option("multiLine", True).option("columnNameOfCorruptRecord", "_bad").json(path)
    if not raw.select("docs", "_bad").where("_bad IS NOT NULL OR docs IS NULL").isEmpty():
        raise ValueError(f"{path} is no index")
    docs = raw.select(F.posexplode("docs").alias("ordinal", "j")).select(F.col("ordinal").cast("long"), F.from_json("j", DOC).alias("d"))
    return Index.build(docs.select(F.col("d.id").alias("doc_id"), "ordinal", "d.url", "d.title", "d.text", F.coalesce("d.lang", F.lit("")).alias("lang"), "d.outlinks", F.col("d.contentHash").alias("content_hash"), F.col("d.wordCount").alias("word_count")))


def decode_postings(lists: DataFrame) -> DataFrame:
    """(term, ordinal, tf) of stored posting lists (term, ids, tfs: base64 of 32-bit
    little-endian integers and floats); non-positive frequencies are dropped."""
    import numpy as np

    def run(frames):
        for f in frames:
            rows = []
            for term, ids, tfs in zip(f["term"], f["ids"], f["tfs"], strict=True):
                own, counts = np.frombuffer(ids, "<i4"), np.frombuffer(tfs, "<f4")
                rows += [(term, int(i), int(c)) for i, c in zip(own, counts, strict=False) if c > 0]
            yield pd.DataFrame(rows, columns=["term", "ordinal", "tf"])

    return lists.select("term", F.unbase64("ids").alias("ids"), F.unbase64("tfs").alias("tfs")).mapInPandas(run, "term string, ordinal int, tf int")


def export_json(index: Index) -> DataFrame:
    """One JSON line for each document, with its postings."""
    own = index.postings.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("term", "tf"))).alias("terms"))
    return index.docs.join(own, "doc_id").select(F.to_json(F.struct("doc_id", "url", "title", "terms")).alias("value"))
