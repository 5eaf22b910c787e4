"""DataFrame operators: counts, shares, running totals, donut geometry, top-k, points, layers, clip."""
