"""From parsed pages to a corpus: cards, duplicates, caps and samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import CONFIG, CURATED_URLS, SEED_URLS
from ..functions.html import parse_pages
from ..functions.text import is_allowed_language, media_card_text, normalize_text, script_profile, short_hash, site_card_text
from ..functions.urls import hostname, normalize_url
from ..scratch import cut_lineage
from .quality import is_junk_url, is_low_quality, word_count

C, Q = CONFIG.crawl, CONFIG.quality


def numbered(df: DataFrame, order: str, name: str = "ordinal") -> DataFrame:
    """A rank by a unique column without moving all rows to one task: the ranks inside
    each range of the order, after the sizes of the ranges before it.

    The bounds of the ranges are drawn from a sample each time that a plan runs, so the
    rows are written with their range, and sizes and ranks both come from that table.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut_lineage(df.repartitionByRange(parts, order).withColumn("_part", F.spark_partition_id()), "ranges")
    inside = Window.partitionBy("_part").orderBy(order)
    # One row for each range.
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_size"))
    before = sizes.select("_part", (F.sum("_size").over(Window.orderBy("_part")) - F.col("_size")).alias("_before"))
    return ranged.withColumn("_rank", F.row_number().over(inside)).join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_rank") - 1).drop("_part", "_rank", "_before")


def per_host_cap(df: DataFrame, host: str, order: str, most: int = C.max_per_host, exempt: Column | None = None) -> DataFrame:
    """The first ``most`` rows of each host in order; exempt rows stay and count."""
    rank = F.row_number().over(Window.partitionBy(host).orderBy(order))
    keep = F.col("_rank") <= most
    return df.withColumn("_rank", rank).where(keep if exempt is None else keep | exempt).drop("_rank")


def stride_sample(df: DataFrame, order: str, wanted: int, total_lines: int) -> DataFrame:
    """Every stride-th row, ``wanted`` at most; the stride comes from the number of
    lines that the rows were picked from.  All rows if there are no more than wanted."""
    if wanted <= 0:
        return df.limit(0)
    stride = max(1, total_lines // wanted)
    size = df.select(F.count("*").alias("_size"))
    ranked = numbered(df, order, "_at").crossJoin(F.broadcast(size))
    on_stride = (F.col("_at") % stride == 0) & (F.floor(F.col("_at") / stride) < wanted)
    return ranked.where((F.col("_size") <= wanted) | on_stride).drop("_at", "_size")


def parsed_docs(pages: DataFrame, ordinal: str = "page_id") -> DataFrame:
    """Pages (url, html, and an ordinal) to documents that the crawl would keep.

    Thin pages stay only as cards: of curated pages by their own address, and of media
    by title and description.
    """
    parsed = parse_pages(pages.withColumn("url", normalize_url("url")).where("url IS NOT NULL"))
    curated = sorted({u.rstrip("/") for u in (*CURATED_URLS, *SEED_URLS)})
    thin = is_low_quality("text") | (F.length("text") < C.min_text_chars) | (word_count("text") < C.min_words) | (F.col("link_density") > Q.max_link_density)
    flagged = parsed.withColumn("site_card", thin).withColumn("media_card", F.col("site_card") & (F.col("media.type") != "text") & ((F.length("title") > 0) | (F.length("description") > 0)))
    cardable = F.regexp_replace("url", "/+$", "").isin(curated)
    allowed = F.col("media_card") | is_allowed_language(script_profile("text"))
    kept = flagged.where((~F.col("site_card") | cardable | F.col("media_card")) & allowed)
    host = hostname("url")
    body = F.when(F.col("media_card"), media_card_text(F.col("title"), F.col("description"), F.col("media.type"), F.coalesce("media.provider", host))).when(F.col("site_card"), site_card_text(F.col("title"), F.col("text"), host)).otherwise(F.col("text"))
    return kept.select(
        short_hash("url").alias("doc_id"),
        F.col(ordinal).cast("long").alias("ordinal"),
        "url",
        "title",
        body.alias("text"),
        "lang",
        "link_density",
        "site_card",
        "media_card",
        "media",
        F.col("links").alias("outlinks"),
        short_hash(normalize_text("text")).alias("content_hash"),
        word_count("text").alias("word_count"),
    )


def deduplicated(docs: DataFrame) -> DataFrame:
    """The first row, by ordinal, of each doc_id and then of each content_hash."""
    first = F.struct("ordinal", F.struct(*[c for c in docs.columns if c != "ordinal"]).alias("rest"))

    def firsts(df: DataFrame, key: str) -> DataFrame:
        best = df.groupBy(F.col(key).alias("_key")).agg(F.min_by(first, "ordinal").alias("f"))
        return best.select(F.col("f.ordinal").alias("ordinal"), "f.rest.*").select(docs.columns)

    return firsts(firsts(docs, "doc_id"), "content_hash")


def new_documents(docs: DataFrame, existing: DataFrame) -> DataFrame:
    """Deduplicated ``docs`` of which neither id nor content is in ``existing``."""
    fresh = deduplicated(docs).join(existing.select("doc_id"), "doc_id", "left_anti")
    return fresh.join(existing.select("content_hash"), "content_hash", "left_anti").select(docs.columns)


def crawlable_links(docs: DataFrame) -> DataFrame:
    """Distinct outgoing links that are no junk."""
    return docs.select(F.explode("outlinks").alias("url")).where(~is_junk_url("url")).distinct()


def import_candidates(records: DataFrame, indexed: DataFrame, most: int = CONFIG.storage.per_host) -> DataFrame:
    """Records (url, pos) to fetch: the cap of a host counts before what is already
    indexed is taken out."""
    own = records.withColumn("url", normalize_url("url")).where("url IS NOT NULL").withColumn("host", hostname("url"))
    capped = per_host_cap(own.groupBy("url").agg(F.min_by(F.struct(*own.columns), "pos").alias("r")).select("r.*"), "host", "pos", most)
    return capped.join(indexed.select("url"), "url", "left_anti")
