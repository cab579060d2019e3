"""The operators, by family: filters, lookups, aggregates, windows, folds, expand, graph."""
