"""Rate limits, the frontier, incremental indexing and the filling plan."""

from searchloom.streaming import frontier, ingest, rate_limit

CALLS = [("a", i, i * 1000) for i in range(5)] + [("b", 9, 0), ("a", 10, 61_000)]


def test_rate_limit_batch(spark):
    df = spark.createDataFrame(CALLS, "key string, event_id long, ms long").selectExpr("key", "event_id", "timestamp_millis(ms) AS ts")
    got = {r["event_id"]: (r["ok"], r["remaining"], r["reset_ms"], r["retry_after"]) for r in rate_limit.rate_limit(df, "key", "ts", "event_id", 3).collect()}
    assert got[2] == (True, 0, 60_000, 58) and got[3][0] is False and got[10] == (True, 2, 121_000, 60) and got[9][0] is True


def test_rate_limit_stream(spark, tmp_path):
    schema = "key string, event_id long, ms long"
    spark.createDataFrame(CALLS, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    calls = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    run = rate_limit.rate_limit_stream(calls, 3).writeStream.format("memory").queryName("verdicts").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    run.awaitTermination()
    got = {r["event_id"]: r["ok"] for r in spark.sql("SELECT * FROM verdicts").collect()}
    assert got == {0: True, 1: True, 2: True, 3: False, 4: False, 9: True, 10: True}


def test_frontier(spark, tmp_path):
    urls = spark.createDataFrame([("https://a.test/1#x", 0), ("https://a.test/1", 1), ("https://a.test/2", 2), ("https://b.test/", 3)], "url string, ordinal long")
    due = {r["url"]: r["due_ms"] for r in frontier.schedule(frontier.push(urls), 800).collect()}
    assert due == {"https://a.test/1": 0, "https://a.test/2": 800, "https://b.test/": 0}
    assert frontier.push(urls, limit=2).count() == 2
    urls.selectExpr("url", "ordinal AS ms").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("url string, ms long").parquet(str(tmp_path / "in"))
    run = frontier.frontier_stream(stream, 800).writeStream.format("memory").queryName("due").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    run.awaitTermination()
    assert {r["url"]: r["due_ms"] for r in spark.sql("SELECT * FROM due").collect()} == {"https://a.test/1": 0, "https://a.test/2": 800, "https://b.test/": 3}


def test_incremental_index(spark, tmp_path):
    def page(i):
        return (i, f"https://site{i}.test/p", "<html><title>crawler</title><p>" + " ".join(f"prose{i}x{j} about crawling pages" for j in range(60)) + "</p></html>")

    land = str(tmp_path / "land")
    for n, rows in enumerate(([page(1), page(2)], [page(2), page(3)])):
        spark.createDataFrame(rows, ingest.PAGES).coalesce(1).write.mode("append").parquet(land)
        ingest.index_pages(spark, land, str(tmp_path / "index"), str(tmp_path / "ck")).awaitTermination()
        assert ingest.read_index(spark, str(tmp_path / "index"), n + 1).stats.first()["n"] == 2 + n


def test_filling_plan():
    base = dict(footprint=ingest.Footprint(1000, 44_000_000), tried_hosts=0, total_hosts=3, fetched=0, max_pages=100, now_ms=0, deadline_ms=10)
    assert ingest.plan_fill(**base).phase == "sitemaps"
    assert ingest.plan_fill(**base | {"tried_hosts": 3}).phase == "discover"
    assert ingest.plan_fill(**base | {"tried_hosts": 3, "discover_rounds": 6}).phase == "done"
    assert ingest.plan_fill(**base | {"tried_hosts": 3, "discover_rounds": 6, "long_tail": True}).phase == "longtail"
    assert ingest.plan_fill(**base | {"fetched": 100}).reason.startswith("page cap")
    assert ingest.plan_fill(**base | {"now_ms": 10}).reason == "time budget reached"
    assert ingest.deadline(0, 5) == 60_005
