"""All registered queries."""

from sparkdemand.plans import analysis_queries, closed_form_queries, forecast_queries, model_queries, stamp_queries, table_queries  # noqa: F401  (registers on import)
from sparkdemand.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
