"""All named queries."""

from . import (  # noqa: F401
    dashboard_queries, evidence_queries, match_queries, normalise_queries, report_queries, upkeep_queries, validate_queries,
)
from .registry import CHECK_SQL, QUERIES  # noqa: F401
