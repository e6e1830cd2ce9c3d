"""Imports every plan module, so that QUERIES and ORACLES are complete."""

from textloom.plans import document_plans, feature_plans, graph_plans, join_plans, retrieval_plans, scalar_plans, source_plans, table_plans  # noqa: F401
from textloom.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
