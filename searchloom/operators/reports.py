"""Facets, statistics and budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import CONFIG
from ..functions.text import round_half_up
from ..functions.urls import domain, is_trusted

MB = 1_048_576


def facet_counts(items: DataFrame, most: int = 10) -> DataFrame:
    """(domain, count) of items (domain, trust): by mean trust, count, then name.  Means
    are rounded, so that equal ones tie however they were summed."""
    counted = items.where("domain <> ''").groupBy("domain").agg(F.count("*").alias("count"), round_half_up(F.avg("trust"), 9).alias("mean_trust"))
    return counted.orderBy(F.desc("mean_trust"), F.desc("count"), "domain").limit(most).select("domain", "count")


def vertical_counts(docs: DataFrame) -> DataFrame:
    """Documents of each kind, and of all."""
    kind = F.coalesce("media.type", F.lit("text")).alias("type")
    return docs.groupBy(kind).agg(F.count("*").alias("n"))


def top_hosts(docs: DataFrame, most: int = 20) -> DataFrame:
    own = docs.select(domain("url").alias("host"))
    return own.groupBy("host").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "host").limit(most)


def corpus_hosts(docs: DataFrame, most: int = 12, trusted: Column | None = None) -> DataFrame:
    """The hosts that a summary names: trusted ones first, then by documents."""
    counted = docs.select(domain("url").alias("host")).where("host <> ''").groupBy("host").agg(F.count("*").alias("n"))
    flagged = counted.withColumn("trusted", is_trusted(F.col("host")) if trusted is None else trusted)
    return flagged.orderBy(F.desc("trusted"), F.desc("n"), "host").limit(most)


def vertical_and_host_counts(docs: DataFrame) -> DataFrame:
    """Both counts in one pass, as grouping sets."""
    own = docs.select(F.coalesce("media.type", F.lit("text")).alias("type"), domain("url").alias("host"))
    return own.groupingSets([["type"], ["host"]], "type", "host").agg(F.count("*").alias("n"))


def stats_report(index) -> DataFrame:
    """docs, terms, hosts and a count for each vertical, one row."""
    docs = index.docs
    kinds = [F.count_if(F.coalesce("media.type", F.lit("text")) == k).alias(k) for k in ("text", "image", "video", "short")] if "media" in docs.columns else [F.count("*").alias("text")]
    own = docs.agg(F.count("*").alias("docs"), F.count_distinct(domain("url")).alias("hosts"), *kinds)
    return own.crossJoin(index.postings.agg(F.count_distinct("term").alias("terms")))


def embedding_coverage(docs: DataFrame, vector: str = "vec") -> DataFrame:
    """total, embedded and the share in whole percent."""
    share = F.when(F.col("total") > 0, F.floor(F.col("embedded") / F.col("total") * 100 + 0.5)).otherwise(0)
    return docs.agg(F.count("*").alias("total"), F.count(vector).alias("embedded")).withColumn("percent", share)


# Storage arithmetic, on columns docs, terms and bytes. -------------------------


def megabytes(bytes_: Column) -> Column:
    return F.floor(bytes_ / MB * 10 + 0.5) / 10


def bytes_per_doc(docs: Column, bytes_: Column) -> Column:
    return F.when(docs > 0, F.floor(bytes_ / docs + 0.5)).otherwise(0)


def docs_remaining(docs: Column, bytes_: Column, budget_mb: float = CONFIG.storage.budget_mb) -> Column:
    """Documents that still fit; infinite when nothing was measured."""
    per = bytes_per_doc(docs, bytes_)
    room = F.lit(budget_mb * MB) - bytes_
    return F.when(per <= 0, F.lit(float("inf"))).otherwise(F.greatest(F.lit(0.0), F.floor(room / per).cast("double")))


def can_afford(docs: Column, bytes_: Column, count: int, budget_mb: float = CONFIG.storage.budget_mb) -> Column:
    per = bytes_per_doc(docs, bytes_)
    return F.when(per <= 0, F.lit(count <= 2000)).otherwise(bytes_ + per * count <= budget_mb * MB)


def run_allowance(docs: Column, bytes_: Column, cap: int = 5000, budget_mb: float = CONFIG.storage.budget_mb) -> Column:
    return F.least(F.lit(float(cap)), docs_remaining(docs, bytes_, budget_mb))


def estimated_docs(budget_mb: Column, full_text: Column, bytes_full_text: Column) -> Column:
    per = F.when(full_text, bytes_full_text).otherwise(F.greatest(F.lit(400), F.floor(bytes_full_text / 12 + 0.5)))
    return F.greatest(F.lit(0), F.floor(budget_mb * MB / per))


def footprint(docs: DataFrame, terms: int, text: str = "text") -> DataFrame:
    """docs, terms, bytes, mb, bytes_per_doc, remaining, affordable of a corpus whose
    size is that of its texts."""
    own = docs.agg(F.count("*").alias("docs"), F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).alias("bytes"))
    n, b = F.col("docs"), F.col("bytes")
    return own.select(n, F.lit(terms).cast("long").alias("terms"), b, megabytes(b).alias("mb"), bytes_per_doc(n, b).cast("long").alias("bytes_per_doc"), docs_remaining(n, b).alias("remaining"), can_afford(n, b, 1000).alias("affords_1000"), run_allowance(n, b).alias("allowance"))


def describe_budget(docs: Column, bytes_: Column, budget_mb: int = CONFIG.storage.budget_mb) -> Column:
    per, left = bytes_per_doc(docs, bytes_), docs_remaining(docs, bytes_, budget_mb)
    per_text = F.when(per > 0, F.concat(F.floor(per / 1024 + 0.5).cast("string"), F.lit(" KB/doc"))).otherwise("unknown size")
    used = F.format_number(megabytes(bytes_), "0.#")
    room = F.concat(used, F.lit(f" MB of {budget_mb} MB used ("), per_text, F.lit("), room for ~"), F.format_number(left, 0), F.lit(" more docs"))
    return F.when(per > 0, room).otherwise(F.concat(used, F.lit(f" MB / {budget_mb} MB budget ("), per_text, F.lit(")")))
