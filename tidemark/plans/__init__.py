"""Registered queries, grouped by area; importing this package fills the registry."""

from . import aggregate_plans, corpus_plans, flow_plans, ingest_plans, join_plans, label_plans, performance_plans, regime_plans, relational_plans, risk_plans, streaming_plans, surveillance_plans, timeseries_plans, window_plans  # noqa: F401
from .registry import QUERIES, SQL  # noqa: F401
