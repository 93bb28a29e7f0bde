"""Index, search plans, ranking and answers: orders, not golden scores."""

import math

import pytest
from pyspark.sql import functions as F

from searchloom import queries
from searchloom.operators import corpus, graph, quality, reports
from searchloom.operators.index import Index
from searchloom.plans import answers, query, search

PROSE = "Standards bodies publish documents that browsers follow when they render pages on the open web every day. "


#: Long enough, and of enough different words, to pass the gate.
LONG = " ".join(f"alpha{i} crawler beta{i * 3} ranking gamma{i * 5}" for i in range(60))


def docs(spark, rows):
    made = [(i, i, u, t, x, "en") for i, (u, t, x) in enumerate(rows)]
    return spark.createDataFrame(made, "doc_id long, ordinal long, url string, title string, text string, lang string")


def order(spark, rows, q, k=10):
    return [r["doc_id"] for r in search.search(Index.build(docs(spark, rows)), q, k).orderBy("rank").collect()]


def test_title_phrase_wins(spark):
    rows = [("https://a.test/1", "Noise", "never up you give " * 30), ("https://b.test/2", "Rick Astley - Never Gonna Give You Up (Official Video)", PROSE)]
    assert order(spark, rows, "never gonna give you up")[0] == 1


def test_covering_all_terms_beats_repeating_one(spark):
    rows = [("https://a.test/1", "x", "standards " * 40), ("https://b.test/2", "y", "html standards " + PROSE)]
    assert order(spark, rows, "html standards")[0] == 1


def test_own_host_wins(spark):
    rows = [("https://a.test/1", "about github", "github github github " + PROSE), ("https://github.com/", "GitHub", "github code hosting " + PROSE)]
    assert order(spark, rows, "github")[0] == 1


def test_scores_equal_a_plain_evaluator(spark):
    rows = [(f"https://h{i}.test/", f"title {w}", f"{w} {'alpha ' * i} beta {PROSE}") for i, w in enumerate(["alpha", "beta", "gamma", "delta"])]
    q = "alpha gamma zzqx"
    plan = query.analyze(q)
    toks = [query.terms_of(" ".join([t, t, x])) for _, t, x in rows]
    n, avg = len(rows), sum(map(len, toks)) / len(rows)
    df = {t: sum(t in x for x in toks) for t in plan.terms}
    weights = plan.weights({t for t in df if df[t]})
    want = {}
    for i, ((_, title, _), x) in enumerate(zip(rows, toks, strict=True)):
        if not set(plan.terms) & set(x):
            continue
        s = 0.0
        for t in plan.terms:
            if df[t]:
                tf = x.count(t)
                s += math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(x) / avg))
        s *= (sum(w for t, w in weights.items() if t in x) / sum(weights.values())) ** 1.6
        s *= 1 + len(set(query.terms_of(title)) & set(plan.terms)) / len(plan.terms) * 1.2
        want[i] = math.floor(s * 1000 + 0.5) / 1000
    got = {r["doc_id"]: r["score"] for r in search.search(Index.build(docs(spark, rows)), q).collect()}
    assert got == pytest.approx(want)


def test_query_without_terms_or_documents(spark):
    index = Index.build(docs(spark, [("https://a.test/", "t", PROSE)]))
    assert search.search(index, "the of").isEmpty()
    assert search.search(Index.build(docs(spark, [("https://a.test/", "", "")])), "web").isEmpty()


def test_deep_search_fuses_and_expands(spark):
    rows = [("https://a.test/1", "rust", "rust ownership borrow checker " + PROSE), ("https://b.test/2", "python", "python typing generators " + PROSE), ("https://c.test/3", "other", "gardening tomatoes " + PROSE)]
    found = search.deep_search(Index.build(docs(spark, rows)), "rust and python", 5)
    assert found.sub_queries == ["rust", "python"] and found.expanded
    ids = [r["doc_id"] for r in found.hits.orderBy("position").collect()]
    assert set(ids[:2]) == {0, 1}


def test_run_search_gates_pages_and_counts_facets(spark):
    long = LONG
    rows = [(f"https://site{i}.test/p", f"crawler {i}", long + f" unique{i}") for i in range(3)] + [("https://www.reddit.com/r/x", "crawler", long)]
    found = search.run_search(Index.build(docs(spark, rows)), "crawler ranking", 2, trusted=F.col("domain") == "site1.test", curated=F.lit(False))
    hits = search.api_rows(found).orderBy("rank").collect()
    assert hits[0]["domain"] == "site1.test" and len(hits) == 2
    assert found.hits.first()["total"] == 3 and found.hits.first()["next_offset"] == 2
    assert [r["domain"] for r in found.facets.collect()][0] == "site1.test"


def test_intents_and_decomposition():
    assert query.analyze("How does BM25 work?").focus == ("bm25",)
    assert query.analyze("never gonna give you up").focus == ("never", "gonna", "give", "up")
    assert query.decompose("rust vs python, go and zig") == ["rust", "python", "go"] or query.decompose("rust vs python, zig and ocaml") == ["rust", "python", "zig"]
    assert query.decompose("one thing") == []


def test_index_write_read_remove(spark, tmp_path):
    index = Index.build(docs(spark, [("https://a.test/1", "one", PROSE), ("https://a.test/2", "two", PROSE + "extra")]))
    index.write(str(tmp_path / "i"))
    again = Index.read(spark, str(tmp_path / "i"))
    assert again.corpus_stats().first() == index.corpus_stats().first()
    less = again.without(spark.createDataFrame([(0,)], "doc_id long"))
    assert less.stats.first()["n"] == 1 and less.postings.where("term = 'one'").isEmpty()
    with pytest.raises(Exception):  # noqa: B017
        Index.read(spark, str(tmp_path / "missing"))


@pytest.mark.parametrize(("n", "want"), [(7, range(7)), (20, range(20)), (250, range(0, 240, 12)), (2500, range(0, 2500, 125))])
def test_counted_stride_walks_the_whole_table(spark, tmp_path, n, want):
    spark.range(n).select(F.col("id").alias("page_id")).write.parquet(str(tmp_path / "pages.parquet"))
    assert sorted(r["page_id"] for r in queries.QUERIES["stride_sample"](spark, str(tmp_path)).collect()) == list(want)


def power_iteration(links, hosts, rounds=25):
    """(score, inlinks) by host, from (src, dst) -> n."""
    inlinks = {h: sum(n for (_, d), n in links.items() if d == h) for h in hosts}
    out = {h: [d for s, d in links if s == h] for h in hosts}
    rank = {h: (1 + inlinks[h]) / sum(1 + i for i in inlinks.values()) for h in hosts}
    for _ in range(rounds):
        loose = sum(rank[h] for h in hosts if not out[h]) / len(hosts)
        rank = {h: 0.15 / len(hosts) + 0.85 * (loose + sum(rank[s] / len(out[s]) for s in hosts if h in out[s])) for h in hosts}
    top, most = max(rank.values()), max(1, *inlinks.values())
    return {h: (min(1, rank[h] / top * 0.75 + math.sqrt(inlinks[h] / most) * 0.25), inlinks[h]) for h in hosts}


@pytest.mark.parametrize("links", [{(0, 1): 3, (5, 1): 1, (1, 2): 2}, {(0, 5): 1}, {(0, 1): 1, (1, 0): 1, (5, 0): 4, (2, 5): 1, (5, 2): 2}])
def test_host_authority_ranks_all_links(spark, tmp_path, links):
    """Sparse graphs with dangling nations (2; all but 0; none but 3) and one alone (3)."""
    keys = [0, 1, 2, 3, 5]
    write = lambda name, rows, schema: spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    write("nation", [(k, f"n{k}") for k in keys], "n_nationkey long, n_name string")
    write("customer", [(100 + k, k) for k in keys], "c_custkey long, c_nationkey long")
    write("supplier", [(200 + k, k) for k in keys], "s_suppkey long, s_nationkey long")
    write("orders", [(300 + k, 100 + k) for k in keys], "o_orderkey long, o_custkey long")
    lines = [(300 + s, 200 + d) for (s, d), n in {**links, (3, 3): 2}.items() for _ in range(n)]
    write("lineitem", lines, "l_orderkey long, l_suppkey long")
    got = {r["host"]: (r["score"], r["inlinks"]) for r in queries.QUERIES["host_pagerank"](spark, str(tmp_path)).collect()}
    want = power_iteration({(f"n{s}", f"n{d}"): n for (s, d), n in links.items()}, [f"n{k}" for k in keys])
    assert got.keys() == want.keys()
    for h, (score, inlinks) in want.items():
        assert got[h] == (pytest.approx(score, abs=2e-6), inlinks)


def test_page_rank_prefers_the_linked(spark):
    links = spark.createDataFrame([(f"s{i}", "hub", 1) for i in range(5)] + [("hub", "s0", 1)], "src string, dst string, n long")
    rank = {r["host"]: r["score"] for r in graph.page_rank(links, spark.createDataFrame([("alone",)], "host string")).collect()}
    assert rank["hub"] == max(rank.values()) and rank["alone"] < rank["hub"] and max(rank.values()) <= 1


def test_quality(spark):
    bad = ["short", "var a = {" + '"k":1,' * 80 + "}", "home about contact " * 60]
    rows = spark.createDataFrame([(x,) for x in [*bad, " ".join(f"word{i} plain prose here" for i in range(60))]], "text string")
    assert [r[0] for r in rows.select(quality.is_low_quality("text")).collect()] == [True, True, True, False]


def test_facets_rank_by_mean_trust(spark):
    items = spark.createDataFrame([("farm.test", 0.3)] * 4 + [("good.test", 1.2), ("", 1.2)], "domain string, trust double")
    assert [tuple(r) for r in reports.facet_counts(items).collect()] == [("good.test", 1), ("farm.test", 4)]


def test_dedup_and_caps(spark):
    rows = spark.createDataFrame([(1, 0, "h1"), (1, 1, "h2"), (2, 2, "h1"), (3, 3, "h3")], "doc_id long, ordinal long, content_hash string")
    assert sorted(r["doc_id"] for r in corpus.deduplicated(rows).collect()) == [1, 3]
    assert corpus.per_host_cap(spark.range(10).selectExpr("id", "'h' AS host"), "host", "id", 3).count() == 3
    assert [r["id"] for r in corpus.stride_sample(spark.range(10), "id", 3, 10).orderBy("id").collect()] == [0, 3, 6]


def test_answers_and_api(spark):
    long = LONG
    api = answers.Api(Index.build(docs(spark, [("https://a.test/p", "Crawler guide", long)])), trusted=F.lit(True), curated=F.lit(False))
    status, body = api.handle("/api/v1/search?q=crawler&limit=999")
    assert status == 200 and body["limit"] == 50 and body["results"][0]["rank"] == 1
    assert api.handle("/api/v1/search")[0] == 400 and api.handle("/api/v1/none")[0] == 404
    assert "[Crawler guide](https://a.test/p)" in api.handle("/api/v1/overview?q=what+is+a+crawler")[1]["answer"]
    assert "No indexed pages" in api.handle("/api/v1/overview?q=zzqx")[1]["answer"]


def test_ordinals_of_a_million_rows_with_a_payload(spark):
    n = 1_000_000
    rows = spark.range(n).select(((F.col("id") * 7919) % n).alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("payload"))
    found = corpus.numbered(rows, "k")
    assert found.where("ordinal <> k").isEmpty() and found.select("ordinal").distinct().count() == n


def test_dangling_hosts_and_sparse_links(spark):
    links = spark.createDataFrame([("a", "b", 1), ("c", "b", 2), ("b", "d", 1)], "src string, dst string, n long")
    hosts = spark.createDataFrame([("e",)], "host string")
    got = {r["host"]: (r["score"], r["inlinks"]) for r in graph.page_rank(links, hosts).collect()}
    names, out = "abcde", {"a": ["b"], "c": ["b"], "b": ["d"]}
    inlinks = {"b": 3, "d": 1}
    rank = {h: (1 + inlinks.get(h, 0)) / 9 for h in names}
    for _ in range(25):
        loose = sum(rank[h] for h in names if h not in out)
        rank = {h: 0.15 / 5 + 0.85 * (sum(rank[s] / len(d) for s, d in out.items() if h in d) + loose / 5) for h in names}
    want = {h: (min(1.0, rank[h] / max(rank.values()) * 0.75 + math.sqrt(inlinks.get(h, 0) / 3) * 0.25), inlinks.get(h, 0)) for h in names}
    assert got.keys() == want.keys() and all(got[h] == pytest.approx(want[h]) for h in names)


def test_best_rows_are_those_of_all_scores(spark):
    rows = [(f"https://h{i}.test/", f"title {i}", f"{'alpha ' * (i % 7 + 1)} beta {'alpha beta gamma' if i % 5 == 0 else 'gamma'} {PROSE}") for i in range(60)]
    index = Index.build(docs(spark, rows))
    for q in ("alpha beta gamma", "alpha", "beta gamma", "zq alpha"):
        plan = query.analyze(q)
        stats = search.term_stats(index, plan.terms)
        key = lambda r: (-r["score"], -r["matched_terms"], r["first_term"], r["ordinal"])
        want = sorted(search.scored(index, plan, stats).collect(), key=key)[:7]
        got = sorted(search.best_rows(index, plan, stats, 7).collect(), key=key)
        assert [(r["doc_id"], round(r["score"], 9)) for r in got] == [(r["doc_id"], round(r["score"], 9)) for r in want], q


def test_texts_are_cut_once_and_by_runs_of_letters(spark, monkeypatch):
    from searchloom.operators import index as own

    plans, cut = [], own.cut_lineage
    monkeypatch.setattr(own, "cut_lineage", lambda df, tag: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or cut(df, tag))
    got = Index.build(docs(spark, [("https://a.test/1", "Straße", "Crème-brûlée İx 7 of a"), ("https://a.test/2", "", "the of ß")]))
    # No filter before the table, which would hold the expression of the terms again, and
    # no class of what is left out, which Java seeks slowly.
    assert "Filter" not in plans[0] and "[^a-z" not in plans[0] and "regexp_extract_all" in plans[0]
    assert {(r["term"], r["tf"]) for r in got.postings.collect()} == {("stra", 2), ("crème", 1), ("brûlée", 1)}
    assert got.stats.first()["n"] == 1


def test_expansion_counts_only_the_terms_it_weighs(spark):
    index = Index.build(docs(spark, [("https://a.test/1", "one", PROSE), ("https://a.test/2", "two", PROSE + "extra extra"), ("https://a.test/3", "two", "extra")]))
    terms = spark.createDataFrame([("extra",), ("two",), ("nowhere",)], "term string")
    stored = Index(index.docs, index.postings, index.stats)
    for own in (index, stored):
        assert {(r["term"], r["df"]) for r in own.some_term_stats(terms).collect()} == {("extra", 2), ("two", 2)}
    # The terms are met before words are counted, so what they leave out is not shuffled.
    plan = index.some_term_stats(terms)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.rindex("Aggregate") < plan.index("Join LeftSemi")


def test_search_reads_its_matches_from_a_table(spark, monkeypatch):
    tags, cut = [], search.cut_lineage
    monkeypatch.setattr(search, "cut_lineage", lambda df, tag: tags.append(tag) or cut(df, tag))
    index = Index.build(docs(spark, [("https://a.test/1", "x", "html and css standards " + PROSE), ("https://a.test/2", "x", "css html " + PROSE), ("https://a.test/3", "y", "HTML, css: standards")]))
    got = search.search(index, "html css standards", 3).orderBy("rank").collect()
    assert tags == ["matches"] and [r["doc_id"] for r in got][0] == 2 and len(got) == 3
