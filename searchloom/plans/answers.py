"""Answers from search results without a language model, and the public interface."""

from __future__ import annotations

import json
from dataclasses import dataclass
from urllib.parse import parse_qs, urlsplit

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import CONFIG
from ..functions.ranking import country_boost, trust
from ..functions.text import clean_snippet, ellipsized, round_half_up
from ..functions.urls import canonical, domain, is_trusted
from ..operators.graph import authority as link_authority
from ..operators.index import Index
from ..operators.reports import stats_report
from .query import analyze
from .search import api_rows, run_search, search

LEADS = {"best": "What the crawl covers, in order of authority:", "lookup": "Top matches from the crawl:"}
FROM_PAGES = "From the pages we crawled:"


def sources(index: Index, query: str, limit: int = 5, country: str = "XX", trusted: Column | None = None) -> DataFrame:
    """The best of one pass of 25 by score, country and trust: title, url, snippet,
    score, position."""
    n = min(max(1, limit), 10)
    hits = search(index, query, 25)
    own = is_trusted(domain("url")) if trusted is None else trusted
    ranked = hits.withColumn("score", round_half_up(F.col("score") * country_boost(F.col("url"), country) * trust(own)))
    position = F.row_number().over(Window.orderBy(F.desc("score"), "rank"))
    return ranked.withColumn("position", position).where(F.col("position") <= n).select("position", "title", "url", "snippet", "score")


def extractive_overview(hits: DataFrame, intent: str) -> DataFrame:
    """One row, ``text``: a lead and the first three snippets with their sources."""
    lead = LEADS.get(intent, FROM_PAGES)
    cited = F.concat(clean_snippet("snippet"), F.lit(" ["), ellipsized("title", 48), F.lit("]("), F.col("url"), F.lit(")"))
    top = hits.where("position <= 3").select("position", cited.alias("s"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "s"))), lambda x: x["s"]), " ")
    return top.agg(body.alias("b")).select(F.trim(F.concat(F.lit(lead + " "), F.col("b"))).alias("text"))


def extractive_answer(hits: DataFrame) -> DataFrame:
    """One row, ``text``: the hits as a numbered list."""
    line = F.concat(F.col("position").cast("string"), F.lit(". ["), F.col("title"), F.lit("]("), F.col("url"), F.lit(") — "), F.col("snippet"))
    rows = hits.select("position", line.alias("s"))
    return rows.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "s"))), lambda x: x["s"]), "\n").alias("text"))


def overview(index: Index, query: str, country: str = "XX", trusted: Column | None = None) -> dict:
    """answer, sources and mode of a question."""
    plan = analyze(query)
    hits = sources(index, plan.subject or " ".join(plan.terms), 6, country, trusted).collect()
    if not hits:
        s = index.stats.first()
        hosts = index.docs.select("host").distinct().count()
        return {"mode": "extractive", "answer": f"No indexed pages cover that. This index holds {s['n']} documents from {hosts} sites — try simpler keywords.", "sources": []}
    rows = index.docs.sparkSession.createDataFrame(hits)
    return {"mode": "extractive", "answer": extractive_overview(rows, plan.intent).first()["text"], "sources": [{"title": h["title"], "url": h["url"]} for h in hits]}


def read_page(index: Index, url: str, chars: int = 4000) -> DataFrame:
    """url, title and the beginning of the text of an indexed page, by its address."""
    wanted = index.docs.sparkSession.range(1).select(canonical(F.lit(url)).alias("url"))
    found = index.docs.join(F.broadcast(wanted), "url", "left_semi")
    return found.select("url", "title", F.substring("text", 1, chars).alias("text"))


def site_note(index: Index, query: str) -> str | None:
    """A note for a query of one word that names a site the index has no page of."""
    words = query.strip().split()
    if len(words) != 1 or "." not in words[0]:
        return None
    label = words[0].lower().removeprefix("www.")
    own = F.col("host")
    if index.docs.where((own == label) | own.startswith(label.split(".")[0] + ".") | own.endswith("." + label)).isEmpty():
        return f"No page of {label} is in the index."
    return None


# The public interface ---------------------------------------------------------


@dataclass
class Api:
    """Routes of the public interface over an index, for any HTTP server to call."""

    index: Index
    country: str = "XX"
    authority: DataFrame | None = None
    trusted: Column | None = None
    curated: Column | None = None

    def handle(self, url: str) -> tuple[int, dict]:
        parts = urlsplit(url)
        route = parts.path.rstrip("/").removeprefix("/api/v1")
        args = {k: v[0] for k, v in parse_qs(parts.query, keep_blank_values=True).items()}
        routes = {"": lambda a: (200, self.describe()), "/search": self.search, "/overview": self.overview, "/stats": lambda a: (200, stats_report(self.index).first().asDict())}
        if route not in routes:
            return 404, {"error": "no such route"}
        return routes[route](args)

    def describe(self) -> dict:
        return {"version": "v1", "routes": ["/api/v1/search", "/api/v1/overview", "/api/v1/stats"], "limits": {"perMinute": CONFIG.api.per_minute, "maxLimit": CONFIG.api.max_limit}}

    def country_of(self, args: dict) -> str:
        own = args.get("country", "").upper()
        return own if len(own) == 2 and own.isalpha() and own.isascii() else self.country

    def search(self, args: dict) -> tuple[int, dict]:
        query = (args.get("q") or args.get("query") or "").strip()
        if not query:
            return 400, {"error": "missing required parameter: q"}
        limit = clamp_int(args.get("limit"), 10, 1, CONFIG.api.max_limit)
        offset = clamp_int(args.get("offset"), 0, 0, CONFIG.api.max_offset)
        kind = (args.get("type") or args.get("vertical") or "text").lower()
        kind = kind if kind in ("text", "image", "video", "short") else "text"
        site = args.get("domain", "").lower().removeprefix("www.") or None
        found = run_search(
            self.index, query, limit, offset, self.country_of(args), kind, site, parse_bool(args.get("deep"), True),
            self.authority if self.authority is not None else (link_authority(self.index.docs) if "outlinks" in self.index.docs.columns else None),
            None, True, self.trusted, self.curated,
        )
        results = [{k: v for k, v in r.asDict(True).items() if v is not None} for r in api_rows(found).orderBy("rank").collect()]
        total = found.all_hits.count()
        end = offset + len(results)
        facets = [r.asDict() for r in found.facets.collect()]
        return 200, {"query": query, "total": total, "limit": limit, "offset": offset, "nextOffset": end if end < total else None, "country": self.country_of(args), "vertical": kind, "facets": facets, "results": results}

    def overview(self, args: dict) -> tuple[int, dict]:
        query = (args.get("q") or args.get("query") or "").strip()
        if not query:
            return 400, {"error": "missing required parameter: q"}
        return 200, {"query": query, **overview(self.index, query, self.country_of(args), self.trusted)}

    def as_json(self, url: str) -> str:
        return json.dumps(self.handle(url)[1], indent=2, ensure_ascii=False)


def clamp_int(raw: str | None, fallback: int, low: int, high: int) -> int:
    import re

    m = re.match(r"\s*([+-]?\d+)", raw or "")
    return min(max(int(m[1]), low), high) if m else fallback


def parse_bool(raw: str | None, fallback: bool) -> bool:
    return fallback if raw is None else raw.lower() not in ("0", "false", "no", "off")
