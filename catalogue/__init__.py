"""Every operator as a query over the given tables, with its SQL oracle."""

from catalogue import content_queries, harvest_queries, url_queries  # noqa: F401
from catalogue.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
