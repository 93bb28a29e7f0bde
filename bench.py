"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each figure is the median of warm runs.  Searches run on an index that was written as
Parquet first, as a deployment would.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

from pyspark.sql import SparkSession

from searchloom import queries
from searchloom.functions.html import parse_pages
from searchloom.operators.index import Index
from searchloom.plans import search

RUNS = int(os.environ.get("BENCH_RUNS", "5"))


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    path = tempfile.mkdtemp(prefix="bench-")
    queries.doc_index(spark, sf).write(path)
    index = Index.read(spark, path)
    run = {
        "index_build": lambda: queries.doc_index(spark, sf).write(path + "-again"),
        "search_1_term": lambda: search.search(index, "nder", 10).collect(),
        "search_3_terms": lambda: search.search(index, "nder ingth onndst", 10).collect(),
        "search_6_terms": lambda: search.search(index, "nder ingth onndst shth reth anan", 10).collect(),
        "deep_search": lambda: search.deep_search(index, "nder and ingth", 10).hits.collect(),
        "page_parse": lambda: parse_pages(spark.read.parquet(f"{sf}/pages.parquet")).write.mode("overwrite").format("noop").save(),
        "tokenize_tf": lambda: queries.tokenize_tf(spark, sf).write.mode("overwrite").format("noop").save(),
        "host_pagerank": lambda: queries.host_pagerank(spark, sf).collect(),
        "rate_limits": lambda: queries.rate_limits(spark, sf).write.mode("overwrite").format("noop").save(),
        "vector_cosine": lambda: queries.vector_cosine(spark, sf).write.mode("overwrite").format("noop").save(),
    }
    took = {}
    for name, f in run.items():
        times = []
        for i in range(RUNS + 1):
            start = time.perf_counter()
            f()
            times.append(time.perf_counter() - start)
            if i and sum(times) > 60:
                break
        took[name] = round(statistics.median(times[1:]), 4)
        print(name, took[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "sum of median warm seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf, "cpus": int(cpus), "spark": spark.version, "shuffle_partitions": int(cpus)}))


if __name__ == "__main__":
    main()
