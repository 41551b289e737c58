"""Registered queries, by theme. Importing this package fills the catalog."""

from tidemark.plans.catalog import CATALOG, query
from tidemark.plans.tables import Tables
from tidemark.plans import delivery, evidence, intake, reconciliation, reports, streams, timelines  # noqa: F401

__all__ = ["CATALOG", "Tables", "query"]
