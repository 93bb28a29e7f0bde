"""Column functions: text, URLs, HTML, scores, vectors."""
