"""Registered queries: each takes (spark, folder of tables) and returns a DataFrame; many have SQL that says the same."""

from .. import registry
from . import algorithm_queries, change_queries, core_problems, core_sql, delivery_queries, event_queries, feature_queries, history_queries, inventory_queries, mart_queries, model_queries, relational_queries, scalar_queries, serving_queries, storage_queries, warehouse_queries  # noqa: F401

QUERIES = core_problems.QUERIES | registry.QUERIES
ORACLES = core_sql.ORACLES | registry.ORACLES
