"""DataFrame operators: filters, ranking, aggregates, chunking, graph, layout."""
