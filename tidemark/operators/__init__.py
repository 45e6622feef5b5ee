"""DataFrame operators: joins in time, series, paths, aggregates, splits, models, positions."""
