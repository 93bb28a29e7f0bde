"""DataFrame to DataFrame operators: quality gate, corpus, index, link graph, reports."""
