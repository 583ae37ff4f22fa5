"""The registered queries."""

from . import catalog, inventory, reports, scalars, startup
from .registry import oracle_sql, queries

__all__ = ["catalog", "inventory", "oracle_sql", "queries", "reports", "scalars", "startup"]
