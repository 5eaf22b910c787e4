"""Column-level functions: categorisation, names, recoding, dates, labels, scales."""
