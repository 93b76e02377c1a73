"""DataFrame operators: candidates, validation, graph, pages."""
