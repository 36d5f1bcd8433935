"""Query catalogue: each query with its reference SQL."""
