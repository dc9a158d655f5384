"""Every operator as a query over the test tables, with the same question in SQL."""

from capledger.queries import cleansing, documents, extraction, filings, projections, summaries  # noqa: F401
from capledger.queries.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
