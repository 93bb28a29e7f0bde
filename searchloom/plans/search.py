"""Search plans: a BM25 pass, multi-pass search, and the final ranking.

Query terms are few and known when a plan is made, so they stand in it as literals: they
prune the postings, and scores are sums of one column for each term, in a fixed order.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import CONFIG
from ..functions.ranking import cosine, country_boost, language_boost, popularity, trust, vertical_boost
from ..functions.text import normalize_phrase, round_half_up, snippet, tokenize
from ..functions.urls import domain, is_curated, is_exact_host, is_trusted
from ..operators.index import Index
from ..operators.quality import gate
from ..operators.reports import facet_counts
from ..scratch import cut_lineage, held
from .query import QueryPlan, analyze, decompose

B, D, R = CONFIG.bm25, CONFIG.deep, CONFIG.ranking


@dataclass(frozen=True)
class TermStats:
    """Corpus size and the document frequencies of a query's terms."""

    n: int
    total_len: int
    df: dict[str, int]

    def idf(self, term: str) -> Column:
        df = self.df.get(term, 0)
        return F.ln(F.lit(1 + (self.n - df + 0.5) / (df + 0.5))) if df else F.lit(0.0)


def term_stats(index: Index, terms) -> TermStats:
    """Corpus and term statistics of a query, in one job."""
    found = index.postings.where(F.col("term").isin(list(terms))).groupBy("term").agg(F.count("*").alias("n")).select("term", "n", F.lit(0).cast("long").alias("total_len"))
    rows = found.unionByName(index.stats.select(F.lit(None).cast("string").alias("term"), F.col("n").cast("long").alias("n"), F.col("total_len").cast("long").alias("total_len"))).collect()
    s = next((r for r in rows if r["term"] is None), None)
    return TermStats(s["n"] or 0 if s else 0, s["total_len"] or 0 if s else 0, {r["term"]: r["n"] for r in rows if r["term"] is not None})


def matches(index: Index, terms) -> DataFrame:
    """(doc_id, tf_0, tf_1, ...): documents with any of the terms."""
    found = index.postings.where(F.col("term").isin(list(terms)))
    return found.groupBy("doc_id").agg(*(F.coalesce(F.max(F.when(F.col("term") == t, F.col("tf"))), F.lit(0)).alias(f"tf_{i}") for i, t in enumerate(terms)))


def bm25(plan: QueryPlan, stats: TermStats) -> Column:
    """Over columns tf_i and doc_len."""
    avg = stats.total_len / stats.n if stats.n else 1.0
    total = F.lit(0.0)
    for i, t in enumerate(plan.terms):
        tf = F.col(f"tf_{i}").cast("double")
        total = total + stats.idf(t) * (tf * (B.k1 + 1)) / (tf + B.k1 * (1 - B.b + B.b * F.col("doc_len") / F.lit(avg or 1.0)))
    return total


def coordination(plan: QueryPlan, stats: TermStats) -> Column:
    """The share of the query's weighted terms that a document has, as a power."""
    weights = plan.weights(set(stats.df))
    total, got = sum(weights.values()), F.lit(0.0)
    for i, t in enumerate(plan.terms):
        if t in weights:
            got = got + F.when(F.col(f"tf_{i}") > 0, weights[t]).otherwise(0.0)
    return F.pow(got / total, F.lit(B.coordination)) if total else F.lit(0.0)


def matched_terms(plan: QueryPlan) -> Column:
    return sum((F.when(F.col(f"tf_{i}") > 0, 1).otherwise(0) for i in range(len(plan.terms))), F.lit(0))


def first_matched(plan: QueryPlan) -> Column:
    return F.coalesce(*(F.when(F.col(f"tf_{i}") > 0, i) for i in range(len(plan.terms))))


def field_factors(plan: QueryPlan) -> Column:
    """Title and host factors multiplied."""
    n = len(plan.terms)
    terms = F.array(*map(F.lit, plan.terms))
    title = 1 + F.size(F.array_intersect("title_terms", terms)) / n * B.title
    exact = sum((F.when(is_exact_host(F.col("host"), t), 1).otherwise(0) for t in plan.terms), F.lit(0))
    host = 1 + exact / n * B.host + F.size(F.array_intersect("host_terms", terms)) / n * B.subdomain_host
    return title * host


def phrase_factor(plan: QueryPlan) -> Column:
    """What the whole query in the title or the text adds."""
    phrase = plan.phrase
    if len(phrase) <= 3:
        return F.lit(1.0)
    # Texts without the words are not normalized.
    body = F.lit(True)
    for word in sorted(set(phrase.split()), key=len, reverse=True):
        body = body & F.lower("text").contains(word)
    return F.when(normalize_phrase("title").contains(phrase), 1 + B.phrase).when(body & normalize_phrase("text").contains(phrase), 1 + B.body_phrase).otherwise(1.0)


def without_phrase(index: Index, plan: QueryPlan, stats: TermStats) -> DataFrame:
    """All documents with any term: doc_id, ordinal, ``plain`` (the score but for the
    phrase), matched_terms, first_term.  Titles and texts are not read."""
    rows = matches(index, plan.terms).join(index.docs.select("doc_id", "ordinal", "doc_len", "host", "host_terms", "title_terms"), "doc_id")
    plain = bm25(plan, stats) * coordination(plan, stats) * field_factors(plan)
    return rows.withColumn("plain", plain).withColumn("matched_terms", matched_terms(plan)).withColumn("first_term", first_matched(plan))


def scored(index: Index, plan: QueryPlan, stats: TermStats) -> DataFrame:
    """All documents with any term: docs' columns, score, matched_terms, first_term."""
    rows = matches(index, plan.terms).join(index.docs, "doc_id")
    score = bm25(plan, stats) * coordination(plan, stats) * field_factors(plan) * phrase_factor(plan)
    return rows.withColumn("score", score).withColumn("matched_terms", matched_terms(plan)).withColumn("first_term", first_matched(plan))


def best_rows(index: Index, plan: QueryPlan, stats: TermStats, k: int) -> DataFrame:
    """The best ``k`` of ``scored``.

    The phrase raises a score by a bounded factor.  A few of the best without it give a
    score that the k-th reaches at least; what cannot reach that with the factor is out,
    and texts are looked at for the rest alone.
    """
    order = [F.desc("score"), F.desc("matched_terms"), "first_term", "ordinal"]
    narrow = ("ordinal", "doc_len", "host", "host_terms", "title_terms")
    rows, texts = without_phrase(index, plan, stats).select("doc_id", "ordinal", "plain", "matched_terms", "first_term"), index.docs.drop(*narrow)
    if len(plan.phrase) <= 3:
        return rows.withColumn("score", F.col("plain") * 1.0).orderBy(*order).limit(k).join(texts, "doc_id")
    # Read twice; and as a table, few rows are seen to be few and are broadcast to the texts.
    rows = cut_lineage(rows, "matches")
    most = float(max(1 + B.phrase, 1 + B.body_phrase, 1.0))
    score = (F.col("plain") * phrase_factor(plan)).alias("score")
    some = rows.select("doc_id", "plain").orderBy(F.desc("plain")).limit(4 * k).join(texts, "doc_id").select(score)
    kth = some.orderBy(F.desc("score")).limit(k).agg(F.min("score"), F.count("*")).first()
    least = kth[0] / most * (1 - 1e-9) if kth[1] == k else float("-inf")
    return rows.where(F.col("plain") >= F.lit(least)).join(texts, "doc_id").withColumn("score", score).orderBy(*order).limit(k)


def no_hits(index: Index) -> DataFrame:
    empty = index.docs.limit(0)
    return empty.select("doc_id", "ordinal", "url", "title", F.lit("").alias("snippet"), F.lit(0.0).alias("score"), F.lit(0).alias("matched_terms"), F.lit(0).alias("query_terms"), F.lit("").alias("lang"), F.lit(0).alias("rank"))


def search(index: Index, query: str, k: int = 10, with_snippets: bool = True) -> DataFrame:
    """One pass: the best ``k`` documents by score, matched terms, then the order in
    which the terms first meet them.  Snippets are made for these alone."""
    plan = analyze(query)
    stats = term_stats(index, plan.terms)
    if not plan.terms or not stats.n:
        return no_hits(index)
    top = best_rows(index, plan, stats, k)
    rank = F.row_number().over(Window.orderBy(F.desc("score"), F.desc("matched_terms"), "first_term", "ordinal"))
    lang = F.coalesce("lang", F.lit("")) if "lang" in index.docs.columns else F.lit("")
    return top.select(
        "doc_id",
        "ordinal",
        "url",
        F.when(F.coalesce("title", F.lit("")) == "", F.col("url")).otherwise(F.col("title")).alias("title"),
        (snippet(F.coalesce("text", F.lit("")), list(plan.terms)) if with_snippets else F.lit("")).alias("snippet"),
        round_half_up(F.col("score")).alias("score"),
        "matched_terms",
        F.lit(len(plan.terms)).alias("query_terms"),
        lang.alias("lang"),
        rank.alias("rank"),
    )


def expansion_terms(index: Index, hits: DataFrame, plan: QueryPlan, n_docs: int, most: int = D.expansion_terms) -> list[str]:
    """Terms frequent in the first hits and rare elsewhere, by weight; of equals the one
    met first.  The rows that come to the driver are the answer."""
    top = hits.where(F.col("rank") <= D.expansion_hits).select("doc_id", "rank")
    docs = cut_lineage(index.docs.join(F.broadcast(top), "doc_id").select("rank", "title", "text"), "expansion")
    own = lambda c, w: docs.select("rank", F.posexplode(tokenize(F.coalesce(c, F.lit("")))).alias("pos", "term"), F.lit(w).alias("w"), F.lit(2 - w).alias("part"))
    counts = own("title", 2).unionByName(own("text", 1)).groupBy("term", "rank").agg(F.sum("w").alias("n"), F.min(F.struct("part", "pos")).alias("first"))
    counts = counts.where(~F.col("term").isin(list(plan.terms))) if plan.terms else counts
    df = index.some_term_stats(counts.select("term").distinct())
    weighted = counts.join(df, "term").where(F.col("df") <= D.df_ceiling * n_docs)
    total = weighted.groupBy("term").agg(F.sum(F.col("n") * F.ln(1 + F.lit(float(n_docs)) / F.col("df"))).alias("weight"), F.min(F.struct("rank", "first")).alias("first"))
    return [r["term"] for r in total.orderBy(F.desc("weight"), "first").limit(most).collect()]


def fuse(passes: DataFrame, k: int = D.rrf_k) -> DataFrame:
    """Reciprocal rank fusion of (pass_no, rank, doc_id, ...): ``fused``, and the other
    columns of the first pass that found the document."""
    rest = [c for c in passes.columns if c != "doc_id"]
    return passes.groupBy("doc_id").agg(F.sum(1.0 / (k + F.col("rank"))).alias("fused"), F.min_by(F.struct(*rest), F.struct("pass_no", "rank")).alias("h")).select("doc_id", "fused", "h.*")


@dataclass
class DeepResult:
    hits: DataFrame
    passes: list[tuple[str, str]]
    expanded: list[str]
    sub_queries: list[str]


def deep_search(index: Index, query: str, limit: int = 10, deep: bool = True) -> DeepResult:
    """The query, its parts and its expansion, fused by rank and blended with the score
    of the first pass that found each hit."""
    plan = analyze(query)
    depth = max(2 * limit, 20)
    done: list[tuple[str, str]] = []
    found: list[DataFrame] = []

    def run(label: str, text: str) -> DataFrame:
        rows = held(search(index, text, depth), depth)
        found.append(rows.withColumn("pass_no", F.lit(len(done))))
        done.append((label, text))
        return rows

    first = run("query", plan.subject or " ".join(plan.terms))
    parts = decompose(plan.raw) if deep else []
    for part in parts:
        run(f"sub:{part[:24]}", part)
    expanded = expansion_terms(index, first, plan, index.stats.first()["n"] or 0) if deep else []
    if expanded:
        run(f"expand:{' '.join(expanded[:3])}", " ".join([*plan.focus, *expanded]))
    every = found[0]
    for f in found[1:]:
        every = every.unionByName(f)
    fused = fuse(every)
    best = F.max("score").over(Window.partitionBy())
    blended = F.when(F.col("_best") > 0, F.col("fused") * (1 + D.score_blend * F.greatest(F.lit(0.0), F.col("score")) / F.col("_best"))).otherwise(F.col("fused"))
    position = F.row_number().over(Window.orderBy(F.desc("fused"), "pass_no", "rank"))
    # A few hundred rows at most, so these windows are small.
    rows = fused.withColumn("_best", best).withColumn("position", position).where(F.col("position") <= limit)
    return DeepResult(rows.withColumn("score", round_half_up(blended)).drop("_best", "rank"), done, expanded, parts)


def rank_columns(hits: DataFrame, country: str = "XX", vertical: str | None = None, trusted: Column | None = None, curated: Column | None = None) -> DataFrame:
    """Hits (url, lang, score, media type, authority, lift) with domain, trust and the
    final score."""
    host = domain("url")
    own = hits.withColumn("domain", host)
    is_own = is_trusted(F.col("domain")) if trusted is None else trusted
    root = is_curated(F.col("domain")) if curated is None else curated
    own = own.withColumn("trust", trust(is_own))
    lift = 1 + R.semantic * F.coalesce(F.col("lift"), F.lit(0.0))
    geo = country_boost(F.col("url"), country) * language_boost(F.col("lang"), country)
    score = F.col("score") * geo * popularity(F.col("authority"), root) * F.col("trust") * vertical_boost(F.coalesce("type", F.lit("text")), vertical) * lift
    return own.withColumn("score", round_half_up(score))


@dataclass
class SearchResult:
    hits: DataFrame
    facets: DataFrame
    all_hits: DataFrame
    deep: DeepResult


def oversample(offset: int, limit: int) -> int:
    return min(max((offset + limit) * 6, 60), 400)


def run_search(
    index: Index, query: str, limit: int = 10, offset: int = 0, country: str = "XX", vertical: str | None = None, domain_filter: str | None = None,
    deep: bool = True, authority: DataFrame | None = None, vectors: DataFrame | None = None, facets_after_filter: bool = False,
    trusted: Column | None = None, curated: Column | None = None,
) -> SearchResult:
    """Multi-pass search, the gate, the first hit of each URL, the final ranking, facets
    and a page.

    ``authority``: (host, score).  ``vectors``: (doc_id, lift), the similarities of
    documents to the query.  The public interface counts facets after the domain filter.
    """
    result = deep_search(index, query, oversample(offset, limit), deep)
    docs = index.docs
    extra = [c for c in ("media", "word_count", "link_density", "site_card", "media_card", "text") if c in docs.columns]
    hits = result.hits.join(docs.select("doc_id", *extra), "doc_id")
    kept = gate(hits).where("reject_reason IS NULL")
    once = kept.withColumn("_n", F.row_number().over(Window.partitionBy("url").orderBy("position"))).where("_n = 1").drop("_n")
    once = once.withColumn("type", F.coalesce("media.type", F.lit("text")) if "media" in extra else F.lit("text"))
    host = domain("url")
    once = once.withColumn("_host", host)
    if authority is not None:
        once = once.join(authority.select(F.col("host").alias("_host"), F.col("score").alias("authority")), "_host", "left")
    else:
        once = once.withColumn("authority", F.lit(None).cast("double"))
    once = once.join(vectors.select("doc_id", "lift"), "doc_id", "left") if vectors is not None else once.withColumn("lift", F.lit(None).cast("double"))
    wanted = None if vertical == "text" else vertical
    final = rank_columns(once.drop("_host", "text"), country, wanted, trusted, curated)
    if wanted:
        final = final.where(F.col("type") == wanted)
    filtered = final
    if domain_filter:
        filtered = final.where((F.col("domain") == domain_filter) | F.col("domain").endswith("." + domain_filter))
    facets = facet_counts((filtered if facets_after_filter else final).select("domain", "trust"))
    return SearchResult(page(filtered, limit, offset), facets, filtered, result)


def page(hits: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """Rows ``offset + 1`` to ``offset + limit`` by score and position, with ``rank``,
    ``total`` and ``next_offset`` (null on the last page)."""
    order = Window.orderBy(F.desc("score"), "position")
    ranked = hits.withColumn("rank", F.row_number().over(order)).withColumn("total", F.count("*").over(Window.partitionBy()))
    end = F.least(F.col("total"), F.lit(offset + limit))
    rows = ranked.where((F.col("rank") > offset) & (F.col("rank") <= offset + limit))
    return rows.withColumn("next_offset", F.when(end < F.col("total"), end))


def api_rows(result: SearchResult) -> DataFrame:
    """The columns of a public answer's results."""
    h = result.hits
    media = (lambda f: F.col(f"media.{f}")) if "media" in h.columns else (lambda f: F.lit(None).cast("string"))
    return h.select(
        "rank", "url", "title", "snippet", "domain", "score", "type", media("image").alias("thumbnail"), media("video_url").alias("mediaUrl"),
        media("provider").alias("provider"), media("duration").cast("double").alias("durationSeconds"), F.nullif("lang", F.lit("")).alias("language"),
        (F.col("word_count") if "word_count" in h.columns else F.lit(None).cast("int")).alias("wordCount"),
    )


def semantic_lift(docs: DataFrame, query_vector: list[float], candidates: int | None = R.semantic_candidates) -> DataFrame:
    """(doc_id, lift) of documents with a vector (vec: q, scale) similar to the query.

    ``candidates``: only the first that many by ordinal, as the plain engine does; None
    for all.
    """
    own = docs.where("vec IS NOT NULL")
    if candidates is not None:
        own = own.orderBy("ordinal").limit(candidates)
    query = F.array(*(F.lit(float(x)) for x in query_vector))
    return own.select("doc_id", cosine(query, F.col("vec.q"), F.col("vec.scale")).alias("lift")).where("lift > 0")
