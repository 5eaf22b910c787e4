"""Sources and sinks: CSV ingest with rejects, Parquet, polygon/line files, profiling."""
