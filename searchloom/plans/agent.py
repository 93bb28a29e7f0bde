"""Tools for a language model over an index: reading its requests and answering them.

The model itself is the caller's; nothing here leaves the driver but the plans of the
searches.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

from ..operators.index import Index
from ..operators.reports import stats_report
from .answers import read_page, sources

FENCED = re.compile(r"```(?:json|tool|action)?\s*(.*?)```", re.DOTALL)


@dataclass(frozen=True)
class Action:
    """A request: the tool's name, its arguments, and the reply without the request."""

    name: str
    args: dict = field(default_factory=dict)
    clean: str = ""


def json_object(text: str, start: int = 0) -> tuple[dict, int] | None:
    """(the first JSON object at or after ``start``, where it ends)."""
    at = text.find("{", start)
    if at < 0:
        return None
    try:
        found, end = json.JSONDecoder(strict=False).raw_decode(text, at)
    except ValueError:
        return None
    return found, end


def parse_action(reply: str, marker: str = "TOOL:") -> Action | None:
    """The request in a model's reply: a JSON object with a ``name`` after the marker,
    or in a fenced block; None if there is none."""
    at = reply.find(marker)
    if at >= 0 and (found := json_object(reply, at + len(marker))) and isinstance(found[0].get("name"), str):
        own, end = found
        return Action(own["name"], own.get("args") or own.get("arguments") or {}, (reply[:at] + reply[end:]).strip())
    if block := FENCED.search(reply):
        found = json_object(block[1].strip())
        if found and isinstance(found[0].get("name"), str):
            return Action(found[0]["name"], found[0].get("args") or {})
    return None


def execute(index: Index, name: str, args: dict) -> dict:
    """The answer of a tool: search_index, read_page or index_stats.  Whatever fails is
    told to the model as an error."""
    try:
        if name == "search_index":
            query = str(args.get("query") or "").strip()
            if not query:
                return {"error": "query is required"}
            raw = args.get("limit", 5)
            limit = int(raw) if isinstance(raw, (int, float)) or str(raw).isdigit() else 5
            results = [r.asDict() for r in sources(index, query, limit).orderBy("position").collect()]
            return {"query": query, "resultCount": len(results), "results": results}
        if name == "read_page":
            url = str(args.get("url") or "").strip()
            if not re.match(r"(?i)https?://", url):
                return {"error": "url must be http(s)"}
            page = read_page(index, url).first()
            return page.asDict() if page else {"error": "no page of that address is in the index"}
        if name == "index_stats":
            return stats_report(index).first().asDict()
    except Exception as error:  # noqa: BLE001  the model has to be told
        return {"error": str(error)}
    return {"error": f"Unknown tool: {name}"}


def short_version(version: str) -> str:
    """``0.3.4`` as ``v0.3``."""
    numbers = [p for p in version.split(".") if p.isascii() and p.isdigit()]
    return f"v{numbers[0]}.{numbers[1] if len(numbers) > 1 else '0'}" if numbers else f"v{version}"
