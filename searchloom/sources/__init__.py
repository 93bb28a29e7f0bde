"""Readers and writers: seeds, crawl indexes, archives, sitemaps, robots, old indexes."""
