"""DataFrame operators: joins, windows, aggregates, culling, chains, groups, estimators."""
