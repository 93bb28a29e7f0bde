"""Catalogues, archives, robots, sitemaps, seeds, bytes."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from searchloom.sources import crawl_index, files, sites


def lines(spark, rows):
    return spark.createDataFrame([(r,) for r in rows], "value string")


GOOD = {"url": "https://a.test/x", "mime": "text/html", "status": "200", "filename": "f.warc.gz", "offset": "896", "length": "2707"}


def test_cdx_lines(spark):
    rows = [f"com,a)/ 2024 {json.dumps(GOOD)}", "no json", f"k t {json.dumps(GOOD | {'url': 'http://1.2.3.4/'})}", f"k t {json.dumps(GOOD | {'length': '10'})}", f"k t {json.dumps(GOOD | {'mime': 'image/png'})}"]
    got = crawl_index.parse_cdx(lines(spark, rows)).collect()
    assert [(r["url"], r["offset"], r["length"]) for r in got] == [("https://a.test/x", 896, 2707)]
    ranges = crawl_index.parse_index(lines(spark, [json.dumps(GOOD), "", "{bad"])).select(crawl_index.byte_range(F.col("offset"), F.col("length"))).collect()
    assert [r[0] for r in ranges] == ["bytes=896-3602"]


def test_discovery(spark):
    rows = [json.dumps(GOOD), json.dumps(GOOD | {"status": "404", "url": "https://a.test/y"}), json.dumps(GOOD | {"url": "https://a.test/z.pdf"}), json.dumps(GOOD | {"url": "https://a.test/x#f"})]
    assert [r["url"] for r in crawl_index.discovered(lines(spark, rows)).collect()] == ["https://a.test/x"]
    many = crawl_index.discover_many([("p", lines(spark, rows)), ("q", lines(spark, rows))]).collect()
    assert [(r["url"], r["pattern"]) for r in many] == [("https://a.test/x", "p")]


def test_catalogue_source_pushes_status(spark, tmp_path):
    (tmp_path / "c.cdx").write_text("\n".join(["k t " + json.dumps(GOOD), "k t " + json.dumps(GOOD | {"status": "404"}), "junk"]))
    crawl_index.register(spark)
    df = spark.read.format("crawl_catalogue").option("path", str(tmp_path / "*.cdx")).load()
    assert df.count() == 2 and df.where("status = '200'").count() == 1


def test_archive_records(spark, tmp_path):
    body = "WARC/1.0\r\n\r\nHTTP/1.1 200 OK\r\nX: y\r\n\r\n<html><body>hi</body></html>"
    record = gzip.compress(body.encode())
    (tmp_path / "f.warc.gz").write_bytes(b"junk" + record)
    assert crawl_index.extract_html(record).startswith("<html>") and crawl_index.extract_html(b"x") is None
    rows = spark.createDataFrame([("https://a.test/x", "seg/f.warc.gz", 4, len(record))], "url string, filename string, offset long, length long")
    got = crawl_index.fetch_records(rows, str(tmp_path)).collect()
    assert [r["url"] for r in got] == ["https://a.test/x"] and "hi" in got[0]["html"]


def test_robots(spark):
    text = "User-agent: other\nDisallow: /o\n\nUser-agent: *\nDisallow: /private # no\nAllow: /private/x\nDisallow:\n\nUser-agent: last\nDisallow: /late"
    robots = spark.createDataFrame([("a.test", text)], "host string, text string")
    rules = sites.robots_rules(robots)
    assert rules.first()["prefixes"] == ["/private", "/late"]
    assert sites.robots_rules(robots, strict=True).first()["prefixes"] == ["/private"]
    urls = spark.createDataFrame([("https://a.test/private/1",), ("https://a.test/pub",), ("https://b.test/private",)], "url string")
    assert sorted(r["url"] for r in sites.allowed(urls, rules).collect()) == ["https://a.test/pub", "https://b.test/private"]


def test_sitemaps(spark):
    documents = spark.createDataFrame([("i", "<sitemapindex><loc>s1</loc><loc> s2 </loc></sitemapindex>"), ("s1", "<urlset><loc>https://a.test/1&amp;x</loc></urlset>"), ("s2", "<urlset><loc>https://a.test/2</loc><loc>https://a.test/1&amp;x</loc></urlset>")], "url string, text string")
    assert [r["url"] for r in sites.collect_sitemaps(documents, ["i"]).collect()] == ["https://a.test/1&x", "https://a.test/2"]
    got = documents.limit(1).select(sites.robots_sitemaps(F.lit("a\nSitemap: https://a.test/s.xml\nsitemap: ftp://x"))).first()[0]
    assert got == ["https://a.test/s.xml"]


def test_certificates_and_seeds(spark, tmp_path):
    rows = spark.createDataFrame([("*.a.test\nb.a.test\nother.org\nxn--x.a.test",)], "name_value string")
    assert [r["url"] for r in sites.certificate_hosts(rows, "a.test").collect()] == ["https://a.test/", "https://b.a.test/"]
    (tmp_path / "seeds.txt").write_text("# c\n\n https://x.test \n")
    assert [r["url"] for r in sites.seeds(spark, str(tmp_path / "seeds.txt")).collect()] == ["https://x.test"]
    assert sites.seeds(spark).count() > 100


def test_bytes(spark):
    assert files.decode_bytes("café".encode("cp1252"), "text/html; charset=windows-1252") == "café"
    assert files.decode_bytes("café".encode(), "text/html; charset=bogus") == "café"
    rows = spark.createDataFrame([("u", bytearray(b"<p>x"), "text/html"), ("v", bytearray(b"x"), "image/png")], "url string, content binary, content_type string")
    assert [r["url"] for r in files.fetched_pages(rows).collect()] == ["u"]


def test_old_indexes(spark, tmp_path):
    doc = {"id": "d1", "url": "https://a.test/", "title": "t", "text": "plain words here", "outlinks": [], "contentHash": "h", "wordCount": 3}
    (tmp_path / "i.json").write_text(json.dumps({"docs": [doc], "index": []}))
    assert files.read_json_index(spark, str(tmp_path / "i.json")).stats.first()["n"] == 1
    (tmp_path / "bad.json").write_text('{"docs": [')
    with pytest.raises(ValueError):
        files.read_json_index(spark, str(tmp_path / "bad.json"))
