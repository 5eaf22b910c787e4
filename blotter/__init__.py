"""blotter: incident analytics as plain Spark DataFrame functions.

Layout
------
- ``blotter.sources``   CSV/Parquet ingest with reject counts, polygon/line file sources, profiling.
- ``blotter.functions`` column-level functions: rule categorisation, name cleaning, recoding,
                        date parts, chart labels and scales.
- ``blotter.operators`` DataFrame operators: counts, shares, stack/donut geometry, top-k with ties,
                        points and WKT, layered series, line-in-polygon clip.
- ``blotter.plans``     the end-to-end questions (ingest, category counts, monthly trend, shares,
                        hotspots, base map) composed from the operators above.
- ``blotter.streaming`` the categorise/count path on a streaming DataFrame.

Every function takes and returns DataFrames; nothing is collected on the driver except
one-row statistics used to pick a physical strategy.
"""

__version__ = "0.1.0"
