"""All queries of the toolkit's own operators."""

from . import analysis, exchange, relational  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
