"""The inverted index as ordinary tables, keyed by document and clustered by term."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import CONFIG
from ..functions.ranking import idf
from ..functions.text import normalize_phrase, tokenize
from ..functions.urls import domain, host_labels
from ..scratch import cut_lineage


def with_tokens(docs: DataFrame) -> DataFrame:
    """``docs`` with ``tokens``: the title twice, then the text."""
    title, text = F.coalesce("title", F.lit("")), F.coalesce("text", F.lit(""))
    repeated = F.concat(*([title, F.lit(" ")] * CONFIG.bm25.title_repeat), text)
    return docs.withColumn("tokens", tokenize(repeated))


@dataclass
class Index:
    """docs: one row for each document, with doc_len, title_terms, host and host_terms;
    postings: (term, doc_id, tf); stats: one row (n, total_len).  An index that was just
    built also has ``words``: what its postings count, (term, doc_id) of each word."""

    docs: DataFrame
    postings: DataFrame
    stats: DataFrame
    words: DataFrame | None = None

    @classmethod
    def build(cls, docs: DataFrame) -> Index:
        """From docs with doc_id, ordinal, url, title and text.  Documents without terms
        are left out, as they can never be found.

        Texts are cut to terms once: what the three tables are made from is written, and
        documents without terms are left out of what is read, as a filter before that
        would cut the texts again.
        """
        host = domain("url")
        tokens = with_tokens(docs).withColumn("doc_len", F.size("tokens")).withColumn("host", host).withColumn("host_terms", host_labels(host)).withColumn("title_terms", F.array_distinct(tokenize("title")))
        tokens = cut_lineage(tokens, "tokens").where("doc_len > 0")
        # Words are counted before they are shuffled.
        words = tokens.select("doc_id", F.explode("tokens").alias("term"))
        postings = words.groupBy("term", "doc_id").agg(F.count("*").cast("int").alias("tf"))
        stats = tokens.agg(F.count("*").alias("n"), F.coalesce(F.sum("doc_len"), F.lit(0)).alias("total_len"))
        return cls(tokens.drop("tokens"), postings, stats, words)

    def write(self, path: str, mode: str = "overwrite") -> None:
        """Postings are sorted by term, so a query's terms prune files and row groups."""
        parts = int(self.docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        self.docs.write.mode(mode).parquet(f"{path}/docs")
        self.postings.repartitionByRange(parts, "term").sortWithinPartitions("term", "doc_id").write.mode(mode).parquet(f"{path}/postings")
        self.stats.write.mode(mode).parquet(f"{path}/stats")

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> Index:
        """A missing or damaged index raises; it never reads as an empty one."""
        return cls(*(spark.read.parquet(f"{path}/{t}") for t in ("docs", "postings", "stats")))

    def term_stats(self) -> DataFrame:
        """(term, df): how many documents hold each term."""
        return self.postings.groupBy("term").agg(F.count("*").alias("df"))

    def some_term_stats(self, terms: DataFrame) -> DataFrame:
        """(term, df) of a few distinct ``terms`` (term), broadcast.  Postings that are not
        a table yet are counted for these alone: a join does not pass a count."""
        found = (self.postings if self.words is None else self.words).join(F.broadcast(terms), "term", "left_semi").select("term", "doc_id")
        return (found if self.words is None else found.distinct()).groupBy("term").agg(F.count("*").alias("df"))

    def term_weights(self) -> DataFrame:
        return self.term_stats().crossJoin(F.broadcast(self.stats)).select("term", "df", idf(F.col("n"), F.col("df")).alias("idf"))

    def corpus_stats(self) -> DataFrame:
        """doc_count, term_count, avg_doc_len to one decimal."""
        terms = self.postings.agg(F.count_distinct("term").alias("term_count"))
        avg = F.when(F.col("n") > 0, F.floor(F.col("total_len") / F.col("n") * 10 + 0.5) / 10).otherwise(0.0)
        return self.stats.crossJoin(terms).select(F.col("n").alias("doc_count"), "term_count", avg.alias("avg_doc_len"))

    def without(self, gone: DataFrame) -> Index:
        """The index without the doc_ids of ``gone``; statistics count what is left."""
        docs = self.docs.join(gone.select("doc_id"), "doc_id", "left_anti")
        postings = self.postings.join(gone.select("doc_id"), "doc_id", "left_anti")
        return Index(docs, postings, docs.agg(F.count("*").alias("n"), F.coalesce(F.sum("doc_len"), F.lit(0)).alias("total_len")))

    def with_documents(self, docs: DataFrame) -> Index:
        """The index with new documents added (see ``corpus.new_documents``)."""
        more = Index.build(docs)
        stats = self.stats.unionByName(more.stats).agg(F.sum("n").alias("n"), F.sum("total_len").alias("total_len"))
        return Index(self.docs.unionByName(more.docs, allowMissingColumns=True), self.postings.unionByName(more.postings), stats)

    def has_terms(self, terms: DataFrame) -> DataFrame:
        """The rows of ``terms`` (term) that some document holds."""
        return terms.join(self.postings.select("term"), "term", "left_semi")

    def has_hosts(self, hosts: DataFrame) -> DataFrame:
        """``hosts`` (host) with ``indexed``: whether a document has exactly that host."""
        own = self.docs.select("host", F.lit(True).alias("_own")).distinct()
        return hosts.join(own, "host", "left").select(hosts["*"], F.coalesce("_own", F.lit(False)).alias("indexed"))

    def phrase_columns(self) -> DataFrame:
        return self.docs.select("doc_id", normalize_phrase("title").alias("phrase_title"), normalize_phrase("text").alias("phrase_text"))
