"""All registered queries."""
from gridloom.queries import answers, matching, privacy, quality, searching, streams, tidying  # noqa: F401
from gridloom.queries.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
