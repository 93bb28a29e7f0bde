"""Stateful operators: rate limits, the crawl frontier, incremental indexing, planning."""
