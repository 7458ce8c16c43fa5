"""All queries and their SQL."""

from longwatch import catalog_runs, catalog_tables  # noqa: F401  they add their queries to the catalog
from longwatch.catalog import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
