"""Column-expression builders (projections, casts, buckets, filters)."""
