"""Imports every query module so that the registry is complete."""

from pegwatch.plans import q_contagion, q_features, q_graph, q_metrics, q_models, q_series, q_trades  # noqa: F401
from pegwatch.plans.registry import QUERIES, oracles

__all__ = ["QUERIES", "oracles"]
