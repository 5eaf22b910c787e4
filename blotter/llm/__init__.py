"""Operators of a large-scale training-data pipeline, their queries and their SQL."""

from .oracles import ORACLES
from .queries import QUERIES

__all__ = ["QUERIES", "ORACLES"]
