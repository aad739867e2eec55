"""Imports every query module, which fills the registry."""

from flowmarrow.plans import (  # noqa: F401
    alert_queries,
    drift_queries,
    feature_queries,
    flow_queries,
    io_queries,
    label_queries,
    metric_queries,
    model_checks,
    model_queries,
    stream_queries,
)
from flowmarrow.plans.registry import QUERIES, SQL_CHECKS

__all__ = ["QUERIES", "SQL_CHECKS"]
