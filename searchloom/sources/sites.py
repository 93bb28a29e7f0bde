"""Seeds, robots rules, sitemaps and certificate logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import CONFIG, CURATED_URLS, SEED_URLS
from ..functions.html import decode_xml_entities
from ..functions.text import col
from ..functions.urls import host_with_port, hostname, path

S = CONFIG.storage
LOC = r"<loc>\s*([^<]+?)\s*</loc>"


def seeds(spark: SparkSession, file: str | None = None) -> DataFrame:
    """(ordinal, url): the lines of a text file without blanks and comments, or the
    built-in starting points."""
    if file is None:
        return spark.createDataFrame(list(enumerate(dict.fromkeys([*CURATED_URLS, *SEED_URLS]))), "ordinal long, url string")
    lines = spark.read.text(file).select(F.trim("value").alias("url")).where("url <> '' AND NOT startswith(url, '#')")
    return lines.withColumn("ordinal", F.monotonically_increasing_id()).select("ordinal", "url")


def robots_rules(files: DataFrame, agent: str = "*", strict: bool = False) -> DataFrame:
    """(host, prefixes) of robots files (host, text).

    Agents add up: once a matching one was named, every later rule counts.  ``strict``
    begins a new group with each agent line that follows a rule instead.
    """
    lines = files.select("host", F.posexplode(F.split("text", "\n")).alias("at", "raw"))
    line = F.trim(F.element_at(F.split(F.col("raw"), "#"), 1))
    parsed = lines.select("host", "at", F.lower(F.trim(F.regexp_extract(line, r"^([^:]*):", 1))).alias("field"), F.trim(F.regexp_extract(line, r"^[^:]*:([\s\S]*)$", 1)).alias("value")).where("field IN ('user-agent', 'disallow', 'allow')")
    mine = (F.col("field") == "user-agent") & F.lower("value").isin("*", agent.lower())
    order = Window.partitionBy("host").orderBy("at")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    if strict:
        begins = (F.col("field") == "user-agent") & (F.coalesce(F.lag("field").over(order), F.lit("")) != "user-agent")
        parsed = parsed.withColumn("group", F.sum(F.when(begins, 1).otherwise(0)).over(so_far))
        so_far = Window.partitionBy("host", "group").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    active = parsed.withColumn("active", F.max(F.when(mine, 1).otherwise(0)).over(so_far))
    rules = active.where("field = 'disallow' AND active = 1 AND value <> ''")
    return rules.groupBy("host").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "value"))), lambda x: x["value"]).alias("prefixes"))


def blocked(path_: Column, prefixes: Column) -> Column:
    return F.exists(prefixes, lambda p: (p == "/") | ((p != "") & path_.startswith(p)))


def allowed(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``urls`` (url) that the rules of their host admit; hosts without rules admit all."""
    own = urls.withColumn("_host", host_with_port("url"))
    both = own.join(rules.select(F.col("host").alias("_host"), "prefixes"), "_host", "left")
    return both.where(F.col("prefixes").isNull() | ~blocked(path("url"), F.col("prefixes"))).drop("_host", "prefixes")


def robots_sitemaps(text: Column | str) -> Column:
    found = F.regexp_extract_all(col(text), F.lit(r"(?im)^\s*sitemap:\s*(\S+)"), F.lit(1))
    return F.array_distinct(F.filter(found, lambda u: u.rlike("(?i)^http")))


def sitemap_locations(text: Column | str) -> Column:
    return F.transform(F.regexp_extract_all(col(text), F.lit(f"(?i){LOC}"), F.lit(1)), decode_xml_entities)


def collect_sitemaps(documents: DataFrame, roots: list[str], max_sitemaps: int = S.sitemaps, max_urls: int = S.sitemap_urls) -> DataFrame:
    """Distinct page URLs reached from ``roots`` through sitemap documents (url, text).

    Indexes are followed level by level; each level is one join, and the frontier that
    comes to the driver is bounded by ``max_sitemaps``.
    """
    spark, read, frontier = documents.sparkSession, [], list(dict.fromkeys(roots))
    pages = spark.createDataFrame([], "url string, level int, pos int")
    level = 0
    while frontier and len(read) < max_sitemaps:
        batch = [u for u in frontier if u not in read][: max_sitemaps - len(read)]
        if not batch:
            break
        read += batch
        own = documents.where(F.col("url").isin(batch)).select(F.posexplode(sitemap_locations("text")).alias("pos", "loc"), F.col("text").rlike("(?i)<sitemapindex").alias("is_index"))
        pages = pages.unionByName(own.where("NOT is_index").select(F.col("loc").alias("url"), F.lit(level).alias("level"), "pos"))
        frontier = [r["loc"] for r in own.where("is_index").orderBy("pos", "loc").limit(max(4 * max_sitemaps, 32)).collect()]
        level += 1
    once = pages.groupBy("url").agg(F.min(F.struct("level", "pos")).alias("at"))
    return once.orderBy("at", "url").limit(max_urls).select("url")


def certificate_hosts(rows: DataFrame, domain: str, most: int = 50) -> DataFrame:
    """URLs of subdomains in certificate records (name_value: names by line)."""
    names = rows.select(F.explode(F.split("name_value", "\n")).alias("n")).select(F.regexp_replace(F.lower(F.trim("n")), r"^\*\.", "").alias("host"))
    own = names.where(F.col("host").endswith(domain) & (F.col("host") != "") & ~F.col("host").startswith("xn--") & ~F.col("host").contains(" "))
    return own.distinct().orderBy("host").limit(most).select(F.concat(F.lit("https://"), F.col("host"), F.lit("/")).alias("url"))


def curated_missing(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Curated pages of whose host no document is indexed."""
    own = seeds(spark).where(F.col("url").isin(CURATED_URLS)).withColumn("host", hostname("url"))
    return own.join(docs.select(hostname("url").alias("host")).distinct(), "host", "left_anti").select("ordinal", "url")


def all_urls(*parts: DataFrame) -> DataFrame:
    """The distinct URLs of several sources."""
    every = parts[0].select("url")
    for p in parts[1:]:
        every = every.unionByName(p.select("url"))
    return every.distinct()
