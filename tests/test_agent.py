"""Tool requests, embedding services and countries."""

import pytest

from searchloom.operators.index import Index
from searchloom.plans import agent
from searchloom.sources import vectors


def test_requests_in_replies():
    own = agent.parse_action('I will look. TOOL: {"name": "search_index", "args": {"query": "a } \\" b"}} thanks')
    assert own == agent.Action("search_index", {"query": 'a } " b'}, "I will look.  thanks")
    assert agent.parse_action('TOOL: {"name": "x", "arguments": {"a": 1}}').args == {"a": 1}
    assert agent.parse_action('```json\n{"name": "index_stats"}\n```') == agent.Action("index_stats")
    assert agent.parse_action('TOOL: {"name": 3}') is None and agent.parse_action("TOOL: {broken") is None and agent.parse_action("plain") is None
    assert agent.json_object("x {} y", 1) == ({}, 4)


def test_short_versions():
    assert [agent.short_version(v) for v in ("0.3.4", "2", "1.x.5", "beta")] == ["v0.3", "v2.0", "v1.5", "vbeta"]


def test_tools_answer(spark):
    text = "alpha beta gamma " * 10
    docs = spark.createDataFrame([(1, 1, "https://a.test/1", "One", text, "en")], "doc_id long, ordinal long, url string, title string, text string, lang string")
    index = Index.build(docs)
    found = agent.execute(index, "search_index", {"query": "alpha", "limit": "3"})
    assert found["resultCount"] == 1 and found["results"][0]["url"] == "https://a.test/1"
    assert agent.execute(index, "read_page", {"url": "https://a.test/1"})["title"] == "One"
    assert agent.execute(index, "index_stats", {})["docs"] == 1
    for name, args in (("search_index", {}), ("read_page", {"url": "ftp://x"}), ("read_page", {"url": "https://b.test/"}), ("other", {})):
        assert "error" in agent.execute(index, name, args)


def test_batches_retries_and_partial_prefixes():
    calls, waits = [], []

    def service(texts):
        calls.append(len(texts))
        if "bad" in texts or (len(calls) == 1):
            raise RuntimeError("busy")
        return [[float(len(t))] for t in texts]

    assert vectors.embed_batch(["a", "", "bcd"], service, wait=waits.append) == [[1.0], [3.0]] and waits == [1.0]
    assert vectors.embed_all(["a"] * 40 + ["bad"], service, wait=waits.append, retries=1) == [[1.0]] * 32
    assert vectors.embed_all(["bad"], service, wait=waits.append) is None and vectors.embed_batch(["", ""], service) is None
    assert vectors.embed_batch(["a", "b"], lambda t: [[1.0]]) is None and vectors.embed_batch(["a"], lambda t: [[]]) is None
    asked = []
    queries = vectors.QueryVectors(lambda t: asked.extend(t) or [[1.0]], remembered=2)
    for q in ("a", "A ", "b", "c", "a"):
        assert queries.vector(q) == [1.0]
    assert asked == ["a", "b", "c", "a"]


def test_vectors_and_countries_of_tables(spark):
    def service(texts):
        if any("fail" in t for t in texts):
            raise RuntimeError
        return [[float(len(t)), 1.0] for t in texts]

    rows = [(i, t) for i, t in enumerate(["ab", None, "", "  c  d ", "fail"])]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = {r["doc_id"]: r["embedding"] for r in vectors.with_vectors(df, service, batch=1, retries=0).collect()}
    assert got == {0: [2.0, 1.0], 1: None, 2: None, 3: [3.0, 1.0], 4: None}
    asked = spark.createDataFrame([("1.1.1.1",), ("2.2.2.2",), (None,)], "ip string")
    known = spark.createDataFrame([("1.1.1.1", "it"), ("1.1.1.1", "it")], "ip string, country string")
    assert sorted(r["country"] for r in vectors.with_country(asked, known).collect()) == ["IT", "XX", "XX"]
    with pytest.raises(ValueError, match="share"):
        from searchloom import scratch

        class Cluster:
            class conf:  # noqa: N801
                get = staticmethod(lambda *a: None)

            class sparkContext:  # noqa: N801
                master = "spark://x"
                getConf = staticmethod(lambda: type("C", (), {"get": staticmethod(lambda *a: None)}))

        scratch.scratch_path(Cluster, "t")
