"""DataFrame-in, DataFrame-out operators (relational, aggregate, window,
quality, statistics, models)."""
