"""DataFrame-level operators (joins, reshape, shares, ordering, statistics)."""
