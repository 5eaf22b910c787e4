"""Streaming variants of the categorise/count path."""
