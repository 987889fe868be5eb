"""All registered queries (import side effect fills the registry)."""

from __future__ import annotations

from cauce.plans import (q_churn, q_governance, q_kpi, q_metrics, q_procurement, q_quality,  # noqa: F401
                         q_extras, q_io, q_sales, q_sinks, q_streaming)
from cauce.plans.registry import ORACLE, QUERIES

__all__ = ["QUERIES", "ORACLE"]
