"""Link authority of hosts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import CONFIG
from ..functions.urls import domain
from ..scratch import cut_lineage, discard

R = CONFIG.ranking


def host_links(docs: DataFrame) -> DataFrame:
    """(src, dst, n): links between different hosts, counted for each document."""
    pairs = docs.select(domain("url").alias("src"), F.explode("outlinks").alias("link")).select("src", domain("link").alias("dst"))
    return pairs.where("src <> '' AND dst <> '' AND src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"))


def hosts_of(docs: DataFrame) -> DataFrame:
    return docs.select(domain("url").alias("host")).where("host <> ''").distinct()


def page_rank(links: DataFrame, hosts: DataFrame | None = None, damping: float = R.damping, iterations: int = R.iterations) -> DataFrame:
    """(host, score, inlinks) from links (src, dst, n) and, if given, hosts without any.

    The start is each host's share of links; hosts without outgoing links spread their
    rank over all.  Each round writes the ranks as a table, so plans stay as short as one
    round and a lost executor costs no more than that.
    """
    links = cut_lineage(links.select("src", "dst", "n"), "links")
    nodes = links.select(F.explode(F.array("src", "dst")).alias("host"))
    if hosts is not None:
        nodes = nodes.unionByName(hosts.select("host"))
    inlinks = links.groupBy(F.col("dst").alias("host")).agg(F.sum("n").alias("inlinks"))
    degree = links.groupBy("src").agg(F.count("*").alias("degree"))
    edges = cut_lineage(links.join(degree, "src").select("src", "dst", (1.0 / F.col("degree")).alias("share")), "edges")
    node = nodes.distinct().join(inlinks, "host", "left").join(degree, F.col("host") == F.col("src"), "left")
    node = cut_lineage(node.select("host", F.coalesce("inlinks", F.lit(0)).alias("inlinks"), F.col("degree").isNull().alias("dangling")), "nodes")
    total = node.agg(F.count("*").alias("n"), F.sum(1 + F.col("inlinks")).alias("total"), F.max("inlinks").alias("most")).first()
    n = total["n"]

    def written(rank: DataFrame) -> tuple[DataFrame, float, float]:
        table = cut_lineage(rank, "rank")
        loose = F.coalesce(F.sum(F.when(F.col("dangling"), F.col("rank"))), F.lit(0.0))
        return table, *table.agg(loose, F.max("rank")).first()

    rank, loose, top = written(node.select("host", "dangling", ((1 + F.col("inlinks")) / F.lit(total["total"] or 1)).alias("rank")))
    for _ in range(iterations if n else 0):
        got = edges.join(rank.select(F.col("host").alias("src"), "rank"), "src").select(F.col("dst").alias("host"), (F.col("rank") * F.col("share")).alias("got"), F.lit(False).alias("dangling"))
        own = node.select("host", F.lit(0.0).alias("got"), "dangling")
        spread = got.unionByName(own).groupBy("host").agg(F.sum("got").alias("got"), F.max("dangling").alias("dangling"))
        new = spread.select("host", "dangling", ((1 - damping) / n + damping * (F.col("got") + loose / n)).alias("rank"))
        old = rank
        rank, loose, top = written(new)
        discard(old)
    discard(links, edges)
    score = F.least(F.lit(1.0), F.col("rank") / F.lit(top) * 0.75 + F.sqrt(F.col("inlinks") / float(max(1, total["most"] or 0))) * 0.25)
    return rank.join(node.select("host", "inlinks"), "host").select("host", score.alias("score"), F.col("inlinks").cast("long").alias("inlinks"))


def authority(docs: DataFrame) -> DataFrame:
    """``page_rank`` of the hosts of documents (url, outlinks)."""
    return page_rank(host_links(docs), hosts_of(docs))
